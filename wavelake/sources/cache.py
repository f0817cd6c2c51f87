"""Versioned cache of prepared windows: shards that are checked when read, and rebuilt only where one is missing or broken.

A shard is a folder `<key>_<version>.shard` of Parquet files below the folder of
its source. The version is a digest of the code that makes the windows, so
a change of that code leaves old shards aside. Each build appends what its
shards hold, rows and a hash of them, to an index; a shard that does not
hold it is broken, whether its files fail to open or read as something else.
"""

from __future__ import annotations

import hashlib
import inspect
import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavelake.functions import dsp

SHARD = "source string, key string"
INDEX = "source string, key string, version string, rows bigint, hash bigint, mark bigint, built bigint"
#: Suffixes of the single-file shards that other tools leave in a cache.
FILES = (".npz", ".npy")


def version_of(*functions: Callable) -> str:
    """Eight digits that change with the functions' code."""
    return hashlib.md5("".join(inspect.getsource(f) for f in functions).encode(), usedforsecurity=False).hexdigest()[:8]


VERSION = version_of(dsp.fourier_resample, dsp.unit_power)


def safe(key: str) -> str:
    return re.sub("[/ ]", "_", key)


def shard_path(root: str, source: str, key: str, version: str = VERSION) -> str:
    return f"{root.rstrip('/')}/{source}/{safe(key)}_{version}.shard"


def is_current(name: str, version: str = VERSION) -> bool:
    """Whether a file or folder name is that of a shard of the version."""
    return bool(version) and any(name.endswith(f"_{version}{s}") for s in (".shard", ".npy.npz"))


def is_shard(name: str) -> bool:
    """Whether a name is that of any shard: folders of this cache, array files of other tools; nothing else is touched."""
    return bool(re.search("_[0-9a-f]{8}\\.shard$", name)) or name.endswith(FILES)


def _fs(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def clean(spark: SparkSession, root: str, version: str = VERSION, dry_run: bool = False) -> tuple[int, int]:
    """Delete shards of other versions below root; (removed, kept), in a dry run without deleting. Hidden folders and all that is no shard stay; an empty version is an error."""
    if not version:
        raise ValueError("a version is needed to tell shards that stay")
    fs, top = _fs(spark, root)
    if not fs.exists(top):
        return 0, 0
    stale, kept, open_ = [], 0, [top]
    while open_:
        for s in fs.listStatus(open_.pop()):
            name = s.getPath().getName()
            if is_shard(name) and s.isDirectory() == name.endswith(".shard"):
                if is_current(name, version):
                    kept += 1
                else:
                    stale.append(s.getPath())
            elif s.isDirectory() and name[0] not in "._":
                open_.append(s.getPath())
    # Counted before anything goes.
    if not dry_run:
        for path in stale:
            fs.delete(path, True)
    return len(stale), kept


class ShardCache:
    """Shards of rows (source, key, ...) of one schema under a root that all executors share."""

    def __init__(self, spark: SparkSession, root: str, schema: str, version: str = VERSION):
        self.spark, self.root, self.version = spark, root.rstrip("/"), version
        self.schema = spark.createDataFrame([], f"{SHARD}, {schema}").schema

    def _content(self) -> list[Column]:
        # A sum over rows, so that it needs no order; equal rows count each.
        row = F.xxhash64(*self.schema.names)
        return [F.count("*").alias("rows"), F.sum(F.shiftright(row, 34)).alias("hash"), F.bit_xor(row).alias("mark")]

    def _index(self) -> DataFrame:
        fs, path = _fs(self.spark, f"{self.root}/_index")
        if not fs.exists(path):
            return self.spark.createDataFrame([], INDEX)
        return self.spark.read.schema(INDEX).parquet(f"{self.root}/_index")

    def _rows(self, shards: list[tuple[str, str]]) -> DataFrame:
        fs, _ = _fs(self.spark, self.root)
        there = [p for p in (shard_path(self.root, *s, self.version) for s in shards) if fs.exists(_fs(self.spark, p)[1])]
        if not there:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).option("ignoreCorruptFiles", "true").parquet(*there)

    def state(self, shards: DataFrame) -> DataFrame:
        """shards (source, key) with `state`: current, missing, or corrupt for those whose rows are not what was built."""
        known = self._index().filter(F.col("version") == self.version).groupBy("source", "key").agg(F.max_by(F.struct("rows", "hash", "mark"), "built").alias("want"))
        names = [(r.source, r.key) for r in shards.select("source", "key").distinct().toLocalIterator()]
        held = self._rows(names).groupBy("source", "key").agg(*self._content())
        both = shards.select("source", "key").distinct().join(known, ["source", "key"], "left").join(held, ["source", "key"], "left")
        same = (F.coalesce("rows", F.lit(0)) == F.col("want.rows")) & F.col("hash").eqNullSafe(F.col("want.hash")) & F.col("mark").eqNullSafe(F.col("want.mark"))
        return both.select("source", "key", F.when(F.col("want").isNull() & F.col("rows").isNull(), "missing").when(same, "current").when(F.col("rows").isNull(), "missing").otherwise("corrupt").alias("state"))

    def save(self, rows: DataFrame, shards: DataFrame) -> None:
        """Write the rows of shards (source, key), those without any row too, and swap each in as a whole."""
        run = uuid.uuid4().hex
        staged = f"{self.root}/_staged/{run}"
        rows = rows.select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in self.schema])
        # A shard is spread over as many tasks as hold its rows.
        rows.withColumns({"_source": F.col("source"), "_shard": F.regexp_replace("key", "[/ ]", "_")}).write.partitionBy("_source", "_shard").parquet(staged)
        back = self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(staged)
        held = back.groupBy("source", "key").agg(*self._content())
        fs, top = _fs(self.spark, staged)
        built = F.lit(int(self._index().agg(F.coalesce(F.max("built"), F.lit(0))).first()[0]) + 1).cast("bigint")
        names = [(r.source, r.key) for r in shards.select("source", "key").distinct().toLocalIterator()]
        index = shards.select("source", "key").distinct().join(held, ["source", "key"], "left")
        index.select("source", "key", F.lit(self.version).alias("version"), F.coalesce("rows", F.lit(0)).cast("bigint").alias("rows"), "hash", "mark", built.alias("built")).write.mode("append").parquet(f"{self.root}/_index")
        for source, key in names:
            _, target = _fs(self.spark, shard_path(self.root, source, key, self.version))
            _, made = _fs(self.spark, f"{staged}/_source={_escaped(source)}/_shard={_escaped(safe(key))}")
            fs.delete(target, True)
            fs.mkdirs(target.getParent())
            if fs.exists(made):
                fs.rename(made, target)
            else:
                fs.mkdirs(target)
        fs.delete(top, True)

    def load(self, shards: DataFrame, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """The rows of shards (source, key); build gives the rows of those that are missing or corrupt, and only these are built."""
        lacking = self.state(shards).filter("state <> 'current'").select("source", "key")
        names = [(r.source, r.key) for r in lacking.toLocalIterator()]
        if names:
            todo = self.spark.createDataFrame(names, SHARD)
            self.save(build(todo), todo)
        return self._rows([(r.source, r.key) for r in shards.select("source", "key").distinct().toLocalIterator()])


def _escaped(value: str) -> str:
    """As Spark writes a partition's value."""
    return re.sub("[\"#%'*/:=?\\\\{\\[\\]^\x01-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)
