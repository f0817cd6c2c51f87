"""Exact dedup by skew-safe combining.

Three stages, each of which groups on the full normalised content and not on
its digest alone:

1. every task combines the rows it has read (the partial aggregate),
2. (digest, salt) groups are merged, the salt being the task that read a row,
   so that a content held by a third of all rows meets in many groups,
3. the winners of the salts are merged to one winner for each content.

Every row then learns its winner by a join on SHA-256 and 64 more bits: that
join decides nothing, and with the contents in it both sides would be shuffled
whole once more. It has one row for each content on one side, which is written
first, so Spark can split a hot digest on the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavelake.llm.textkit import stored

#: Salts of a digest: an upper bound for the rows that meet in stage 3.
SALTS = 64


def normalised(text: Column) -> Column:
    """The text without any character of [\\x20\\x09-\\x0D]; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", "")


def _rank(chars: Column, doc_id: Column) -> Column:
    """One number that orders by most code points, then smallest doc_id; fixed width, so hash aggregation can hold it."""
    big = F.lit("18446744073709551616").cast("decimal(20,0)")
    turned = F.lit("9223372036854775807").cast("decimal(20,0)") - doc_id.cast("decimal(20,0)")
    return (chars.cast("decimal(12,0)") * big + turned).cast("decimal(38,0)")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row for each row of docs: id, keep_id, group_size, kept, text_sha256.

    Rows are equal when their normalised texts are identical. The row with the
    most code points in the original text stays, then the one of smallest id.
    Null and empty texts are equal to each other. Rows that repeat an id count
    in group_size each; those of them with fewer code points than the one that
    stays go, and those equal in id and code points too are one document, of
    which all rows stay or go. Rows without an id count in group_size and stay
    only if no row of the group has an id (all of them); their keep_id is then
    null. An empty table gives no rows; texts of any length are compared whole;
    other columns of docs are not read. Ids are castable to bigint.
    """
    content = normalised(F.col(text_col))
    base = docs.select(
        F.col(id_col).cast("long").alias("_id"),
        F.char_length(F.coalesce(F.col(text_col), F.lit(""))).alias("_chars"),
        content.alias("_norm"),
    ).withColumn("_sha", F.sha2("_norm", 256))
    salted = (
        base.groupBy("_sha", "_norm", F.pmod(F.spark_partition_id(), F.lit(salts)).alias("_salt"))
        .agg(F.max(_rank(F.col("_chars"), F.col("_id"))).alias("_best"), F.count(F.lit(1)).alias("_n"))
    )
    winners = (
        salted.groupBy("_sha", "_norm")
        .agg(F.max("_best").alias("_best"), F.sum("_n").alias("group_size"))
        .select("_sha", F.xxhash64("_norm").alias("_second"), "_best", "group_size")
    )
    winners = stored(winners, "exact-winners")
    big = F.lit("18446744073709551616").cast("decimal(20,0)")
    keep = (F.lit("9223372036854775807").cast("decimal(20,0)") - F.pmod(F.col("_best"), big)).cast("decimal(38,0)")
    # pmod leaves 0..2^64-1; ids are 2^63-1 minus it.
    # A row that repeats the winner's id but has fewer code points goes.
    rows = base.select("_id", "_sha", F.xxhash64("_norm").alias("_second"), _rank(F.col("_chars"), F.col("_id")).alias("_own"))
    return rows.join(winners, ["_sha", "_second"]).select(
        F.col("_id").alias(id_col),
        keep.cast("long").alias("keep_id"),
        "group_size",
        F.coalesce(F.col("_own") == F.col("_best"), F.col("_best").isNull()).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )
