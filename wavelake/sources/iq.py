"""Captures: raw I/Q files, their sidecars, SigMF meta, and windows out of them.

`read_captures` lists files, drops those over the limit before their bytes are
read, decodes them in Arrow batches and gives one row for each window of 1024
samples. A file that cannot be decoded gives one row with `error`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavelake.functions.dsp import to_complex as _to_complex
from wavelake.functions.dsp import unit_power as _unit_power
from wavelake.vocab import CHUNK, MAX_FILE

SIDECAR = "source string, block_name string, expected_family string, expected_order string, sample_rate_hz int, center_freq_hz int, snr_db float, notes string"
REQUIRED = ["source", "block_name", "expected_family", "expected_order", "sample_rate_hz"]
CHUNKS = "path string, stem string, chunk_idx int, i array<float>, q array<float>, error string"
CHUNKS_ARROW = pa.schema([("path", pa.string()), ("stem", pa.string()), ("chunk_idx", pa.int32()), ("i", pa.list_(pa.float32())), ("q", pa.list_(pa.float32())), ("error", pa.string())])


def stem(path: Column) -> Column:
    """A path without its file's extension."""
    return F.regexp_replace(path, "\\.(iq|sigmf-data|sigmf-meta|json)$", "")


def decode(content: bytes, datatype: str | None, size: int = CHUNK, truncate: bool = False, first: int | None = None) -> np.ndarray:
    """Little-endian float32 pairs to (windows, size) complex, of unit power; trailing bytes are dropped.

    SigMF types that begin with cf32 lose an odd last value. A length that is
    no multiple of the window is an error unless truncate.
    """
    flat = np.frombuffer(content, dtype="<f4", count=len(content) // 4)
    if datatype and datatype.startswith("cf32"):
        flat = flat[: len(flat) // 2 * 2]
    x = _to_complex(flat)
    if truncate:
        x = x[: len(x) // size * size]
    if len(x) % size:
        raise ValueError(f"{len(x)} samples are no multiple of {size}")
    x = x.reshape(-1, size)[:first]
    return _unit_power(x)


def _decoder(truncate: bool, first: int | None, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, name, content, kind in zip(*(batch[c].to_pylist() for c in ("path", "stem", "content", "datatype")), strict=True):
                try:
                    x = decode(content or b"", kind, size, truncate, first)
                    if not len(x):
                        raise ValueError("no chunks")
                except ValueError as e:
                    yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((path, name, None, None, None, str(e)), CHUNKS_ARROW, strict=True)], schema=CHUNKS_ARROW)
                    continue
                for a in range(0, len(x), 256):
                    part = x[a : a + 256]
                    n = len(part)
                    offsets = pa.array(np.arange(0, (n + 1) * part.shape[1], part.shape[1], dtype=np.int32))
                    i, q = (pa.ListArray.from_arrays(offsets, pa.array(v.astype(np.float32).ravel())) for v in (part.real, part.imag))
                    yield pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array([name] * n), pa.array(np.arange(a, a + n, dtype=np.int32)), i, q, pa.array([None] * n, pa.string())], schema=CHUNKS_ARROW)

    return run


def read_captures(spark: SparkSession, path: str, pattern: str = "*.iq", max_bytes: int = MAX_FILE, size: int = CHUNK, truncate: bool = False, first: int | None = None) -> DataFrame:
    """(path, stem, chunk_idx, i, q, error) of all files under path that match."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    small = files.filter(F.col("length") <= max_bytes).select("path", "content").withColumn("stem", stem(F.col("path")))
    meta = sigmf_meta(spark, path) if pattern.endswith("sigmf-data") else None
    small = small.withColumn("datatype", F.lit(None).cast("string")) if meta is None else small.join(meta, "stem", "left")
    decoded = small.select("path", "stem", "content", "datatype").mapInArrow(_decoder(truncate, first, size), CHUNKS)
    large = files.filter(F.col("length") > max_bytes).select("path", stem(F.col("path")).alias("stem"), F.lit(None).cast("int").alias("chunk_idx"), F.lit(None).cast("array<float>").alias("i"), F.lit(None).cast("array<float>").alias("q"), F.lit("file too large").alias("error"))
    return decoded.unionByName(large)


def _json(spark: SparkSession, path: str, pattern: str, schema: str) -> DataFrame:
    return spark.read.schema(schema + ", _corrupt string").option("multiLine", "true").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def sigmf_meta(spark: SparkSession, path: str) -> DataFrame:
    """(stem, datatype) of SigMF meta files."""
    meta = _json(spark, path, "*.sigmf-meta", "global struct<`core:datatype`:string>")
    return meta.select(stem(F.col("_metadata.file_path")).alias("stem"), F.col("global")["core:datatype"].alias("datatype"))


def read_sidecars(spark: SparkSession, path: str) -> DataFrame:
    """(stem, fields, error): sidecars with their defaults; an error names the first required field that is missing."""
    rows = _json(spark, path, "*.json", SIDECAR).select(stem(F.col("_metadata.file_path")).alias("stem"), *[c.split()[0] for c in SIDECAR.split(", ")])
    missing = F.coalesce(*[F.when(F.col(c).isNull(), F.lit(f"missing field {c}")) for c in REQUIRED])
    return rows.withColumns({"center_freq_hz": F.coalesce("center_freq_hz", F.lit(0)), "notes": F.coalesce("notes", F.lit("")), "error": missing})


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    from wavelake.operators.textmine import truth_lines

    return truth_lines(spark.read.text(path), "value")


def read_signals(spark: SparkSession, path: str, truth: str, first: int = 4) -> DataFrame:
    """Numbered .tim signals with their classes, the first windows of each; SNR is taken as 0."""
    return _signals(spark, path, truth, first).filter("error is null").drop("error")


def _signals(spark: SparkSession, path: str, truth: str, first: int) -> DataFrame:
    """Windows of all .tim files, those without a number, an entry or a known class, and those that do not open, with an error."""
    chunks = read_captures(spark, path, "*.tim", truncate=True, first=first)
    idx = F.regexp_extract("path", "_(\\d+)\\.tim$", 1).try_cast("int")
    known = read_truth(spark, truth).withColumn("_there", F.lit(True))
    both = chunks.withColumn("idx", idx).join(known, "idx", "left")
    error = F.coalesce("error", F.when(F.col("idx").isNull(), "no number in the name").when(F.col("_there").isNull(), "no entry in the truth file"))
    return both.withColumn("error", error).drop("_there").withColumn("snr_db", F.lit(0.0).cast("float"))


def sorted_out(chunks: DataFrame, out: str) -> tuple[DataFrame, DataFrame]:
    """Good windows, and rejected files as (path, error), of chunks with an `error`: one read, written to two parts of the folder `out`.

    A file that is rejected has no good window. The folder is written anew.
    """
    chunks.withColumn("rejected", F.col("error").isNotNull()).write.mode("overwrite").partitionBy("rejected").parquet(out)
    back = chunks.sparkSession.read.schema(f"{_ddl(chunks)}, rejected boolean").parquet(out)
    return back.filter("not rejected").drop("rejected", "error"), back.filter("rejected").select("path", "error").distinct()


def _ddl(frame: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema)


def rejections(rejected: DataFrame) -> DataFrame:
    """(reason, files): rejected files by reason; numbers in reasons do not count."""
    return rejected.groupBy(F.regexp_replace("error", "\\d+", "N").alias("reason")).agg(F.count("*").alias("files"))


def write_captures(chunks: DataFrame, path: str) -> None:
    """One .iq file and one sidecar for each `name` of chunks (name, chunk_idx, i, q, sidecar fields).

    Files are written under names of their attempt and moved, so a task that
    is run again replaces its own files.
    """
    ordered = chunks.repartition("name").sortWithinPartitions("name", "chunk_idx")
    fields = [c for c in chunks.columns if c in {f.split()[0] for f in SIDECAR.split(", ")}]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json
        import uuid
        from itertools import groupby

        from pyarrow import fs as pafs

        fs, base = pafs.FileSystem.from_uri(path)
        fs.create_dir(base, recursive=True)
        rows = (r for b in batches for r in b.to_pylist())
        for name, group in groupby(rows, key=lambda r: r["name"]):
            temp, last = f"{base}/_{uuid.uuid4().hex}", None
            with fs.open_output_stream(temp) as out:
                for r in group:
                    flat = np.empty(2 * len(r["i"]), dtype="<f4")
                    flat[0::2], flat[1::2] = r["i"], r["q"]
                    out.write(flat.tobytes())
                    last = r
            with fs.open_output_stream(f"{base}/{name}.json") as out:
                out.write(json.dumps({k: last[k] for k in fields}).encode())
            fs.move(temp, f"{base}/{name}.iq")
            yield pa.RecordBatch.from_arrays([pa.array([name])], names=["name"])

    ordered.mapInArrow(write, "name string").count()
