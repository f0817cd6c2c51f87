"""Benchmark decontamination by a prefix-filtered set join, in native Spark.

An item window is a set of shingles at fixed places, and it occurs in a text
only if all of them do. So its necessary prefix, in order of rarity, is one
shingle long: the one that the fewest item windows have. These are chosen
before anything is joined. The texts are read once; their shingles meet the
chosen ones in a broadcast hash join that runs inside the scan's stage, and
what matches is written with the words around it. Length and positional bounds,
and then the words themselves, decide whether the window stands there.

The broadcast side is counted first. Where it has more than `SHINGLES` rows
it is taken in blocks, each of them against all rows.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavelake.llm.textkit import stored

#: Words of an item window, and of a shingle.
WIDTH = 13
SHINGLE = 5
#: Most shingles (a hash each, about 50 MB as a hash table) that are broadcast at once.
SHINGLES = 1_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_list(text: Column) -> Column:
    """Lower-case A-Z, then the words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+; null has none."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(lowered, "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), "")


def _shingles(words: Column, k: int) -> Column:
    """A hash for each word: of it and the k - 1 words after it. Those at the end are short and match no full one but by chance."""
    return F.transform(words, lambda w, i: F.xxhash64(F.lit(k), w, *[F.get(words, i + j) for j in range(1, k)]))


def item_windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """(win, words, len, item_id): the windows of all items; win is the words joined by a space."""
    items = benchmark.select("item_id", word_list(F.col("text")).alias("w")).withColumn("n", F.size("w")).filter("n > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.col("n") - width + 1, F.lit(1)))
    rows = items.select("item_id", "n", "w", F.explode(starts).alias("s"))
    return rows.select("item_id", F.slice("w", F.col("s"), F.least(F.col("n"), F.lit(width))).alias("words")).select(F.concat_ws(" ", "words").alias("win"), "words", F.size("words").alias("len"), "item_id")


def hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, k: int = SHINGLE, most: int = SHINGLES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents (row, id, n_words), occurrences (row, start, len, win) and windows (win, item_id)."""
    windows = stored(item_windows(benchmark, width), "decon-windows")
    distinct = windows.groupBy("win").agg(F.first("words").alias("words"), F.first("len").alias("len"))
    # At most k lengths and a count: what the driver learns of the benchmark.
    sizes = sorted(r[0] for r in distinct.select(F.least("len", F.lit(k)).alias("k")).distinct().collect())
    tokens = functools.reduce(
        DataFrame.unionByName,
        [
            distinct.filter(F.least("len", F.lit(x)) == x if x == k else F.col("len") == x)
            .select("win", "words", "len", F.posexplode(F.slice(_shingles(F.col("words"), x), F.lit(1), F.col("len") - x + 1)).alias("off", "h"))
            for x in sizes
        ],
    ) if sizes else distinct.select("win", "words", "len", F.lit(0).alias("off"), F.lit(0).cast("long").alias("h")).limit(0)
    tokens = stored(tokens, "decon-tokens")
    common = tokens.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    rarest = tokens.join(common, "h").groupBy("win").agg(F.min(F.struct("n", "h", "off", "len", "words")).alias("t")).select("win", "t.h", "t.off", "t.len", "t.words")
    rarest = stored(rarest, "decon-prefixes")
    keys = rarest.select("h").distinct()
    blocks = max(1, math.ceil(keys.count() / most))

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # Read once for each block: numbers that are written are the same each time.
    numbered = numbered if blocks == 1 else stored(numbered, "decon-rows")
    base = numbered.select("row", "id", word_list(F.col("text")).alias("w")).withColumn("n_words", F.size("w"))
    # Place 0 stands for the document itself, so one pass gives every row and its size.
    marks = F.concat(F.array(F.lit(0).cast("long")), *[_shingles(F.col("w"), x) for x in sizes])
    parts = []
    for b in range(blocks):
        side = keys if blocks == 1 else keys.filter(F.pmod("h", F.lit(blocks)) == b)
        side = side.filter("h <> 0").unionByName(docs.sparkSession.range(1).select(F.lit(0).cast("long").alias("h")))
        placed = base.select("row", "id", "n_words", "w", F.posexplode(marks).alias("at", "h")).join(F.broadcast(side), "h")
        place = F.when(F.col("at") == 0, F.lit(-1)).otherwise(F.pmod(F.col("at") - 1, F.col("n_words")))
        found = placed.withColumn("pos", place).withColumn("from", F.greatest(F.col("pos") - (width - 1), F.lit(0)))
        found = found.select("row", "id", "n_words", "h", "pos", "from", F.when(F.col("pos") >= 0, F.slice("w", F.col("from") + 1, F.lit(2 * width))).alias("near"))
        parts.append(found if b == 0 else found.filter("pos >= 0"))
    matches = stored(functools.reduce(DataFrame.unionByName, parts), "decon-matches")

    start = F.col("pos") - F.col("off")
    occurs = (
        matches.filter("pos >= 0").join(rarest, "h")
        .filter((start >= 0) & (start + F.col("len") <= F.col("n_words")))
        .filter(F.slice("near", (start - F.col("from") + 1).cast("int"), F.col("len")) == F.col("words"))
        .select("row", start.alias("start"), "len", "win")
    )
    return matches.filter("pos < 0").select("row", "id", "n_words"), occurs, windows.select("win", "item_id")


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, share: int = 20) -> DataFrame:
    """(id, n_words, n_hit, items, contaminated) for each row of docs.

    A word is hit inside any occurrence of an item window; a document is
    contaminated when n_hit > 0 and share * n_hit >= n_words. `items` are the
    ids, as strings in order, of the items that have an occurring window.
    Null and empty texts have no words and null item texts no windows. Rows
    that repeat an id are judged each on its own; repeated item ids count
    once and a null item id is hit without being listed. No documents give no
    rows, no items no hits. Texts of any length are read whole; other columns
    of docs, whatever their names, are not read.
    """
    rows, occurs, items = hits(docs, benchmark, id_col, text_col, width)
    occurs = stored(occurs, "decon-hits")
    before = Window.partitionBy("row").orderBy("start", "len").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("len")
    new = F.greatest(end - F.greatest(F.col("start"), F.coalesce(F.max(end).over(before), F.lit(0))), F.lit(0))
    covered = occurs.select("row", new.alias("new")).groupBy("row").agg(F.sum("new").cast("long").alias("n_hit"))
    listed = occurs.select("row", "win").distinct().join(items.distinct(), "win").groupBy("row").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    out = rows.join(covered, "row", "left").join(listed, "row", "left")
    n_hit, n_words = F.coalesce("n_hit", F.lit(0)), F.col("n_words").cast("long")
    return out.select(F.col("id").alias(id_col), n_words.alias("n_words"), n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), ((n_hit > 0) & (share * n_hit >= n_words)).alias("contaminated"))
