"""Manifest of data files: digests that are made anew only for files whose length or time changed.

The manifest is a table with a row for each file, kept in a store like the
audit's: a refresh writes rows of new, changed and vanished files. Expected
digests come from it first and from the releases' list where it has none;
status is told from it without opening a file.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavelake.store import AuditStore

TABLES = {"files": "file_id bigint, dataset string, name string, path string, length bigint, modified timestamp, sha string"}
#: Suffixes of files that a manifest lists, and what a digest that nobody has checked is called.
SUFFIXES = [".tim", ".zip", ".gz", ".bz2", ".bin", ".txt", ".7z", ".pkl", ".dat", ".h5"]
UNVERIFIED = "UNVERIFIED"
#: The file whose digest stands for a data set.
PRIMARY = [("radioml", "RML2016.10a_dict.pkl"), ("hisarmod", "HisarMod2019.1.h5")]
DIGEST = pa.schema([("path", pa.string()), ("sha", pa.string())])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of files that are read in pieces, so none is too large."""
    from pyarrow import fs as pafs

    for batch in batches:
        shas = []
        for path in batch["path"].to_pylist():
            held = hashlib.sha256()
            fs, base = pafs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
            with fs.open_input_stream(base) as f:
                while piece := f.read(1 << 20):
                    held.update(piece)
            shas.append(held.hexdigest())
        yield pa.RecordBatch.from_arrays([batch["path"], pa.array(shas, pa.string())], schema=DIGEST)


def digests(files: DataFrame) -> DataFrame:
    """(path, sha) of files (path), dealt out one by one."""
    return files.select("path").repartition(F.col("path")).mapInArrow(_digest, "path string, sha string")


class Manifest:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, AuditStore(spark, root, TABLES)

    def read(self) -> DataFrame:
        return self.store.read("files")

    def refresh(self, files: DataFrame, dataset: str | None = None) -> int:
        """Bring the manifest to a listing (path, folder, name, length, modificationTime), of one data set or all; how many rows changed.

        The data set is the name of the file's folder, or of the one above batch
        folders. Only files that are new or of another length or time are opened.
        """
        owner = F.lower(F.regexp_extract("folder", "([^/]*)(/Batch_Dir[^/]*)?$", 1))
        listed = files.filter(F.lower("name").rlike("(" + "|".join(s.replace(".", "\\.") for s in SUFFIXES) + ")$"))
        listed = listed.select(owner.alias("dataset"), "name", "path", "length", F.col("modificationTime").alias("modified"))
        if dataset is not None:
            listed = listed.filter(F.col("dataset") == dataset)

        def changes(now: DataFrame) -> DataFrame:
            mine = now if dataset is None else now.filter(F.col("dataset") == dataset)
            held = mine.select("path", "file_id", F.col("length").alias("_length"), F.col("modified").alias("_modified"))
            known = listed.join(held, "path", "left")
            changed = known.filter(F.col("file_id").isNull() | (F.col("length") != F.col("_length")) | (F.col("modified") != F.col("_modified"))).drop("_length", "_modified")
            gone = mine.join(listed.select("path"), "path", "left_anti").withColumn("_gone", F.lit(True))
            return changed.join(digests(changed), "path").withColumn("_gone", F.lit(False)).unionByName(gone)

        return self.store.change("files", changes)

    def expected(self, releases: DataFrame) -> DataFrame:
        """(dataset, name, sha) of the manifest, and of releases (dataset, name, sha) for files that it has not; digests that are none are left out."""
        valid = F.col("sha").rlike("^[0-9a-fA-F]{64}$")
        mine = self.read().groupBy("dataset", "name").agg(F.max_by("sha", F.struct("modified", "path")).alias("sha")).filter(valid)
        rest = releases.select("dataset", "name", F.lower("sha").alias("sha")).filter(valid).join(mine, ["dataset", "name"], "left_anti")
        return mine.unionByName(rest)

    def status(self, primary: DataFrame) -> DataFrame:
        """(dataset, files, batches, checksum) by the manifest alone; primary (dataset, name) names the file whose digest's first 16 digits stand for the set, else the first by name."""
        rows = self.read().join(primary.select("dataset", F.col("name").alias("_primary")), "dataset", "left")
        best = F.min_by("sha", F.struct((F.col("name") != F.coalesce("_primary", F.lit(""))).alias("o"), "name", "path"))
        g = rows.groupBy("dataset").agg(F.count("*").alias("files"), F.count_if(F.col("name").endswith(".tim") | F.lower("name").contains("batch")).alias("batches"), best.alias("sha"))
        return g.select("dataset", "files", "batches", F.coalesce(F.when(F.col("sha").rlike("^[0-9a-fA-F]{64}$"), F.left("sha", F.lit(16))), F.lit(UNVERIFIED)).alias("checksum"))
