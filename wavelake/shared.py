"""Tables in the folder that driver and executors share: they cut lineage and outlive lost executors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is named, a local one if driver and executors are one process, else an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    import tempfile

    made = f"file://{tempfile.mkdtemp(prefix='wavelake-')}"
    spark.sparkContext.setCheckpointDir(made)
    expire(spark, made)
    return made


def expire(spark: SparkSession, path: str) -> None:
    """Delete a path when the application ends."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)


def stored(frame: DataFrame, name: str) -> DataFrame:
    """The frame written to the shared folder and read back: its lineage ends here."""
    spark = frame.sparkSession
    path = f"{shared_dir(spark)}/wavelake-{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    expire(spark, path)
    out = spark.read.schema(frame.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for frame in frames:
        spark = frame.sparkSession
        place = spark._jvm.org.apache.hadoop.fs.Path(frame.stored_at)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
