"""Training-set preparation: union, labels, split, weights, calibration, agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavelake import vocab


def union_sources(frames: dict[str, DataFrame]) -> DataFrame:
    """Frames of one schema under one another, each named by `source`."""
    out = None
    for name, f in frames.items():
        f = f.withColumn("source", F.lit(name))
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    return out


def snr_bin(snr: Column) -> Column:
    """How many of -20, -10, 0, 10, 20 are at most the SNR."""
    return sum((F.when(snr >= edge, 1).otherwise(0) for edge in (-20, -10, 0, 10, 20)), F.lit(0))


def stratified_split(rows: DataFrame, strata: list[str], key: str, block: int = 1 << 16, train: float = 0.70, val: float = 0.15) -> DataFrame:
    """Adds `part`: of each stratum by the integer key floor(n train) rows train, floor(n val) validate, the rest test.

    Rows are numbered within blocks of the key, and counts of blocks add up
    to where each begins, so no stratum has to be sorted by one task.
    """
    cut = rows.withColumn("_b", F.floor(F.col(key) / block))
    sizes = cut.groupBy(*strata, "_b").agg(F.count(F.lit(1)).alias("_k"))
    ahead = Window.partitionBy(*strata).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    places = sizes.withColumn("_before", F.coalesce(F.sum("_k").over(ahead), F.lit(0))).withColumn("_n", F.sum("_k").over(Window.partitionBy(*strata)))
    out = cut.withColumn("_i", F.row_number().over(Window.partitionBy(*strata, "_b").orderBy(key))).join(places.drop("_k"), [*strata, "_b"])
    i = F.col("_before") + F.col("_i")
    a = F.floor(F.col("_n") * F.lit(train))
    b = a + F.floor(F.col("_n") * F.lit(val))
    return out.withColumn("part", F.when(i <= a, "train").when(i <= b, "val").otherwise("test")).drop("_b", "_i", "_before", "_n")


def class_weights(rows: DataFrame, label: str, classes: DataFrame) -> DataFrame:
    """(label, n, weight) for every class; weights are inverse to max(n, 1) and sum to the number of classes."""
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    full = classes.join(counts, label, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    inverse = full.withColumn("_w", F.lit(1.0) / F.greatest(F.col("n"), F.lit(1)))
    total = inverse.agg(F.sum("_w").alias("_t"), F.count(F.lit(1)).alias("_k"))
    return inverse.crossJoin(F.broadcast(total)).select(label, "n", (F.col("_w") * F.col("_k") / F.col("_t")).alias("weight"))


def skewed(rows: DataFrame, label: str, of: str, ratio: float = 3.0) -> DataFrame:
    """One row: the count of `of`, the largest other count, and whether the first is over `ratio` times the second."""
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.coalesce(F.sum(F.when(F.col(label) == of, F.col("n"))), F.lit(0)).alias("n_of"), F.coalesce(F.max(F.when(F.col(label) != of, F.col("n"))), F.lit(0)).alias("n_other")).withColumn("skewed", (F.col("n_other") > 0) & (F.col("n_of") > F.col("n_other") * ratio))


def with_fallback(rows: DataFrame, condition: Column) -> DataFrame:
    """Rows that meet the condition; all rows if none does."""
    some = rows.agg(F.coalesce(F.max(F.coalesce(condition, F.lit(False))), F.lit(False)).alias("_some"))
    return rows.crossJoin(F.broadcast(some)).filter(~F.col("_some") | condition).drop("_some")


def calibration_sample(rows: DataFrame, condition: Column, order: list, n: int) -> DataFrame:
    """n rows in the order given, of those that meet the condition or else of all."""
    return with_fallback(rows, condition).orderBy(*order).limit(n)


def agreement(left: DataFrame, right: DataFrame, key: str, tolerance: float = 3.0) -> DataFrame:
    """Share of keys on which two predictions agree, in percent, and whether the drop is within tolerance."""
    both = left.select(key, F.col("pred").alias("a")).join(right.select(key, F.col("pred").alias("b")), key)
    percent = F.coalesce(F.avg((F.col("a") == F.col("b")).cast("double")) * 100.0, F.lit(0.0))
    return both.agg(F.count(F.lit(1)).alias("n"), percent.alias("agreement")).withColumn("accepted", F.lit(100.0) - F.col("agreement") <= tolerance)


def order_families(orders: DataFrame, order: str) -> DataFrame:
    """Adds the family of an order by the first data set that knows it; null if none does."""
    dims = vocab.family_frame(orders.sparkSession).groupBy("order_name").agg(F.min_by("family", "prio").alias("family"), F.min_by("source", "prio").alias("family_source"))
    return orders.join(F.broadcast(dims.withColumnRenamed("order_name", order)), order, "left")


def vocabulary(names: DataFrame, column: str) -> DataFrame:
    """Distinct names with their index in sorted order; a vocabulary is small and passes one task."""
    return names.select(column).distinct().withColumn("idx", F.row_number().over(Window.orderBy(column)) - 1)
