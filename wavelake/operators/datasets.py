"""Data set and model management over listings of files: presence, status, verification, checksum files, options."""

from __future__ import annotations

import tomllib
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavelake import vocab
from wavelake.operators import textmine

#: Names of truth files, best first, and suffixes of archives.
TRUTH_FILES = ["signal_record.txt", "signal_record_C_2023.txt", "signal_record_first_20000.txt", "metadata.txt"]
ARCHIVES = ["zip", "gz", "bz2", "bin", "7z", "tar"]
#: Command line names of the synthetic classes are the classes in lower case with hyphens, but for these.
CLASS_KEYS = {"nbfm25": "NBFM_25", "nbfm50": "NBFM_50", "dmr": "DMR", "wbfm": "WBFM"}


def class_of_key(key: str) -> str:
    """The synthetic class of a command line name; unknown names raise and list the known ones."""
    known = {c.lower().replace("_", "-"): c for v in vocab.SYNTHETIC.values() for c in v} | CLASS_KEYS
    try:
        return known[key.strip().lower().replace("_", "-")]
    except KeyError:
        raise ValueError(f"unknown class {key!r}; known: {', '.join(sorted(known))}") from None


def check_parameters(tau: float = 0.0, deviation: float | None = None, nominal: float | None = None) -> None:
    """Reject a negative time constant, the 75 microseconds of broadcast emphasis, and a deviation over three times the nominal one."""
    if tau < 0:
        raise ValueError("tau must not be negative")
    if abs(tau - 75e-6) < 1e-6:
        raise ValueError("tau of 75 microseconds belongs to broadcast FM, not to narrow channels")
    if deviation is not None and nominal is not None and deviation > 3 * nominal:
        raise ValueError(f"deviation {deviation:g} Hz is over three times the nominal {nominal:g} Hz")


def truth_file(files: DataFrame) -> DataFrame:
    """(path): the truth file to use: by name in the order known, in the root before batch folders, these in order."""
    names = F.array(*[F.lit(n) for n in TRUTH_FILES])
    batch = F.regexp_extract("folder", "(Batch_Dir[^/]*)$", 1)
    ranked = files.withColumn("_at", F.array_position(names, F.col("name"))).filter("_at > 0")
    return ranked.agg(F.min_by("path", F.struct(F.when(batch == "", 0).otherwise(1), batch, "_at")).alias("path")).filter("path is not null")


def signal_files(files: DataFrame) -> DataFrame:
    """Recordings in the root and in batch folders; all others only where there are none of these."""
    tims = files.filter(F.col("name").rlike("^signal_.*\\.tim$"))
    levels = F.size(F.split("folder", "/"))
    least = tims.agg(F.min(levels).alias("_least"))
    # One row.
    near = tims.crossJoin(F.broadcast(least)).filter((levels == F.col("_least")) | F.col("folder").rlike("/Batch_Dir[^/]*$")).drop("_least")
    return near


def checksum_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """(name, sha) of a checksum file's lines: a digest of 64 characters first, the file's name last; comments and blanks are left out."""
    parts = F.split(F.trim(column), "\\s+")
    rows = lines.filter(~F.trim(column).startswith("#") & (F.size(parts) >= 2) & (F.length(parts[0]) == 64))
    return rows.select(F.regexp_extract(F.element_at(parts, -1), "([^/]*)$", 1).alias("name"), F.lower(parts[0]).alias("sha"))


def read_checksums(spark: SparkSession, path: str, on_missing: str = "error") -> DataFrame:
    """(name, sha) of a checksum file. A file that is not there is an error, or with on_missing "warn" a warning and no rows."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if on_missing == "warn" and not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        warnings.warn(f"no checksum file {path}: nothing is verified", stacklevel=2)
        return spark.createDataFrame([], "name string, sha string")
    return checksum_lines(spark.read.text(path))


def write_checksums(entries: DataFrame, path: str, title: str = "SHA-256 of model files") -> None:
    """A checksum file of entries (name, sha) in the order of names, one line each under a comment."""
    lines = entries.select("name", F.concat_ws("  ", F.lower("sha"), "name").alias("value"))
    head = vocab.frame(entries.sparkSession, [("", f"# {title}")], "name string, value string")
    # Names of a model folder: one sorted file.
    head.unionByName(lines).coalesce(1).sortWithinPartitions("name").select("value").write.mode("overwrite").text(path)


def file_digests(files: DataFrame) -> DataFrame:
    return files.select("name", F.sha2("content", 256).alias("actual_sha"))


def update_checksums(files: DataFrame, path: str, suffix: str = ".onnx") -> int:
    """Write the digests of all files of the suffix; none of them is an error."""
    mine = file_digests(files.filter(F.col("name").endswith(suffix))).withColumnRenamed("actual_sha", "sha").cache()
    n = mine.count()
    if not n:
        raise FileNotFoundError(f"no {suffix} file")
    write_checksums(mine, path)
    mine.unpersist()
    return n


def verify_checksums(files: DataFrame, checksums: DataFrame) -> DataFrame:
    """(name, status) of each registered file: ok, missing or mismatch. Of files of one name in several folders all must match."""
    both = checksums.join(file_digests(files), "name", "left")
    g = both.groupBy("name").agg(F.count("actual_sha").alias("n"), F.every(F.col("actual_sha") == F.col("sha")).alias("same"))
    return g.select("name", F.when(F.col("n") == 0, "missing").when(F.col("same"), "ok").otherwise("mismatch").alias("status"))


def verified_names(files: DataFrame, checksums: DataFrame) -> list[str]:
    """The registered names, all of them verified; else an error that names those that fail, or that there is none."""
    rows = {r["name"]: r["status"] for r in verify_checksums(files, checksums).collect()}
    failed = sorted(f"{n} ({s})" for n, s in rows.items() if s != "ok")
    if failed or not rows:
        raise ValueError(f"checksums fail: {', '.join(failed)}" if failed else "no checksum entries")
    return sorted(rows)


def model_names(files: DataFrame, stem: str, quantised: bool) -> str:
    """The model file to load: the quantised one where it is wanted and there, else the full one."""
    there = quantised and not files.filter(F.col("name") == f"{stem}_int8.onnx").isEmpty()
    return f"{stem}_int8.onnx" if there else f"{stem}.onnx"


def present(files: DataFrame) -> DataFrame:
    """(dataset, path): what is there of each data set by folder name: radioml a pickle, then any other pickle, then an archive; hisarmod the HDF5 file, cspb its folder."""
    kind = F.lower(F.regexp_extract("path", "/(radioml|hisarmod|cspb)[^/]*/", 1))
    low = F.lower("name")
    rank = (
        F.when((kind == "radioml") & low.startswith("rml2016.10a") & low.rlike("\\.(pkl|dat)$"), 0).when((kind == "radioml") & low.rlike("\\.(pkl|pickle|dat)$"), 1).when((kind == "radioml") & low.rlike("\\.(tar|tar\\.gz|tar\\.bz2|tgz)$"), 2)
        .when((kind == "hisarmod") & low.rlike("\\.(h5|hdf5)$"), 0).when((kind == "cspb") & (low.endswith(".tim") | low.rlike(f"\\.({'|'.join(ARCHIVES)})$")), 0)
    )
    found = files.withColumn("dataset", kind).withColumn("_rank", rank).filter("_rank is not null and length > 0")
    return found.groupBy("dataset").agg(F.min_by(F.when(F.col("dataset") == "cspb", F.col("folder")).otherwise(F.col("path")), F.struct("_rank", "path")).alias("path"))


def status(files: DataFrame) -> DataFrame:
    """(dataset, status, size) of radioml, hisarmod and cspb: present, incomplete, missing, and of cspb a warning for the first release and a note where the truth file lacks."""
    kind = F.lower(F.regexp_extract("path", "/(radioml|hisarmod|cspb)[^/]*/", 1))
    low = F.lower("name")
    each = files.withColumn("dataset", kind).filter("dataset <> ''").withColumn("variant", textmine.archive_variant(F.col("name")))
    facts = each.groupBy("dataset").agg(
        F.sum("length").alias("bytes"), F.max(low.rlike("\\.(pkl|pickle|dat|tar|tar\\.gz|tar\\.bz2|tgz)$") & (F.col("length") > 0)).alias("pickle"),
        F.max(low.rlike("\\.(h5|hdf5)$") & (F.col("length") > 0)).alias("hdf"), F.max((low.endswith(".tim") | low.rlike(f"\\.({'|'.join(ARCHIVES)})$")) & (F.col("length") > 0)).alias("signals"),
        F.max(F.col("name").isin(TRUTH_FILES)).alias("truth"), F.max(F.col("variant") == "r2").alias("r2"), F.max(F.col("variant") == "original").alias("old"),
    )
    names = vocab.frame(files.sparkSession, [("cspb",), ("hisarmod",), ("radioml",)], "dataset string")
    cspb = F.when(F.col("old") & ~F.col("r2"), "warning (original, not R2)").when(F.col("signals") & F.col("truth"), "present").when(F.col("signals"), "present (no truth file)")
    state = F.coalesce(
        F.when(F.col("bytes").isNull(), "missing"), F.when(F.col("dataset") == "cspb", cspb), F.when((F.col("dataset") == "radioml") & F.col("pickle"), "present"),
        F.when((F.col("dataset") == "hisarmod") & F.col("hdf"), "present"), F.when(F.col("bytes") > 0, "incomplete"), F.lit("missing"),
    )
    return F.broadcast(names).join(facts, "dataset", "left").select("dataset", state.alias("status"), textmine.human_size(F.coalesce("bytes", F.lit(0))).alias("size"))


def verification(files: DataFrame, expected: DataFrame) -> DataFrame:
    """(dataset, detail, failure): what a verification finds. radioml and cspb must be there, hisarmod may lack, cspb must not be the first release; registered digests (name, sha) must hold."""
    states = status(files).select(
        "dataset", F.col("status").alias("detail"),
        (F.col("status").startswith("warning") | (F.col("status").isin("missing", "incomplete") & (F.col("dataset") != "hisarmod"))).alias("failure"),
    )
    digests = verify_checksums(files, expected).select(F.col("name").alias("dataset"), F.col("status").alias("detail"), (F.col("status") != "ok").alias("failure"))
    return states.unionByName(digests)


def info(windows: DataFrame) -> DataFrame:
    """One row for each source of windows (source, class, snr_db): its classes, keys of class and SNR, windows, and least and largest SNR."""
    keys = windows.groupBy("source", "class", "snr_db").agg(F.count(F.lit(1)).alias("n"))
    return keys.groupBy("source").agg(
        F.array_sort(F.collect_set("class")).alias("classes"), F.count(F.lit(1)).alias("keys"), F.sum("n").alias("windows"), F.min("snr_db").alias("snr_min"), F.max("snr_db").alias("snr_max"),
    )


def options(text: str) -> dict:
    """Options of a scan from TOML text: section `scan`; lists that are none count as empty."""
    section = tomllib.loads(text).get("scan", {})
    names = lambda key: [str(x) for x in v] if isinstance(v := section.get(key, []), list) else []
    root = section.get("root") or section.get("scan_root")
    return {"root": str(root) if root else None, "includes": names("include_projects"), "excludes": names("exclude_projects"), "iq_output": str(section.get("iq_output", ".scan_iq")), "default_yes": bool(section.get("default_yes", False))}
