"""Mixing sources to target weights by pivotal dependent rounding, in native Spark.

Each document gets a fractional number of copies, its source's target over its
source's size. The whole part is taken as it is. The fractions are rounded
together: of two documents, mass in words is moved from one to the other, the
direction drawn at random so that the expected copies stay as they were, until
one of the two is integral. Larger documents go first, so that what is left
over at the end is small. Blocks of about `BLOCK` documents are paired off
in one array each; the one residual of a block goes up a reduction tree. The
words taken from a source therefore differ from its target by less than one
document's.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wavelake.llm.textkit import stored

#: Documents of one source paired off in one array, on average.
BLOCK = 64
#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: A target is at most this many times its source's size.
MOST = 3

WORD = "[^\\x20\\x09-\\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, n, target) from (source, size) rows.

    The sources' shares go by weight; a share over `most` times its source's
    size stops there and the excess is shared again by weight. In order of
    cap / weight the capped sources come first, so running sums find the level
    at which the rest stand. One row for each source passes the windows.
    """
    sums = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"), F.count(F.lit(1)).alias("n"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sums.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    ranked = ranked.withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    by_level = Window.orderBy((F.col("_cap") / F.col("_w")).asc(), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    levels = (
        ranked.withColumn("_caps", F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        .withColumn("_ws", F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
        .withColumn("_all", F.sum(F.col("source_size").cast("double")).over(whole))
        .withColumn("_w_all", F.sum("_w").over(whole))
        .withColumn("_level", (F.col("_all") - F.col("_caps")) / (F.col("_w_all") - F.col("_ws")))
        .withColumn("_fits", F.col("_level") * F.col("_w") <= F.col("_cap"))
        .withColumn("_at", F.max(F.when(F.col("_fits"), F.col("_level"))).over(whole))
    )
    # The level rises while sources are capped and falls after the first that fits: its highest value is the one that holds.
    return levels.select("source", "source_size", "n", F.when(F.col("_at").isNull(), F.col("_cap")).otherwise(F.least(F.col("_at") * F.col("_w"), F.col("_cap"))).alias("target"))


_ITEM = "struct<id:bigint,size:bigint,k:bigint,p:double,u:double>"
#: Equal rows that one array numbers.
PLACES = 10_000


def _pair_off(items: Column) -> Column:
    """Fold an array of fractional items: {carry, done}, each done item with p 0 or 1.

    With carry i and next item j, in words: A moves min((1-p_i) s_i, p_j s_j)
    from j to i, B moves min(p_i s_i, (1-p_j) s_j) from i to j, and A is drawn
    with probability B / (A + B).
    """
    def step(acc: Column, x: Column) -> Column:
        i = acc["carry"]
        si, sj = i["size"].cast("double"), x["size"].cast("double")
        up = F.least((F.lit(1.0) - i["p"]) * si, x["p"] * sj)
        down = F.least(i["p"] * si, (F.lit(1.0) - x["p"]) * sj)
        take_up = x["u"] * (up + down) < down
        i_full = take_up & ((F.lit(1.0) - i["p"]) * si <= x["p"] * sj)
        j_empty = take_up & ~i_full
        i_empty = ~take_up & (i["p"] * si <= (F.lit(1.0) - x["p"]) * sj)
        moved = F.when(take_up, up).otherwise(-down)
        new_i, new_j = i["p"] + moved / si, x["p"] - moved / sj
        def item(a: Column, p: Column) -> Column:
            return F.struct(a["id"].alias("id"), a["size"].alias("size"), a["k"].alias("k"), F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)).alias("p"), a["u"].alias("u"))
        i_done = i_full | i_empty
        done = F.when(i_done, item(i, F.when(i_full, F.lit(1.0)).otherwise(F.lit(0.0)))).otherwise(item(x, F.when(j_empty, F.lit(0.0)).otherwise(F.lit(1.0))))
        carry = F.when(i_done, item(x, new_j)).otherwise(item(i, new_i))
        return F.when(
            i.isNull(), F.struct(x.alias("carry"), acc["done"].alias("done"))
        ).otherwise(F.struct(carry.alias("carry"), F.concat(acc["done"], F.array(done)).alias("done")))

    start = F.struct(F.lit(None).cast(_ITEM).alias("carry"), F.array().cast(f"array<{_ITEM}>").alias("done"))
    return F.aggregate(items, start, step)


def placed(sized: DataFrame) -> DataFrame:
    """Each row with `k`, its place among the rows of equal source, id and size: they are counted, and numbered from the counts.

    Equal rows are alike, so no row needs to know which of them it was; and a
    hot id is spread over the blocks as other rows are.
    """
    counted = sized.groupBy("source", "id", "size").agg(F.count(F.lit(1)).alias("c"))
    runs = counted.select("source", "id", "size", "c", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("c") - 1) / PLACES))).alias("run"))
    start = F.col("run") * PLACES
    return runs.select("source", "id", "size", F.explode(F.sequence(start, F.least(start + PLACES, F.col("c")) - 1)).alias("k"))


def _uniform(*parts: Column) -> Column:
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") + 0.5) / F.lit(float(1 << 53))


def mix(docs: DataFrame, id_col: str = "doc_id", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK, seed: int = 17, with_source: bool = False) -> DataFrame:
    """(id, size, source_size, target, taken) for each row of docs (id, text, source), with `with_source` also its source.

    Null texts have size 0. Rows without words take nothing. Null is a source
    of its own. Rows that repeat an id, or have none, are rounded each on its
    own. With no words at all every target is 0; an empty table gives no rows.
    Texts of any length are counted whole. Ids are castable to bigint; other
    columns of docs are not read. Draws are hashes of the id, the size, the
    place among equal rows, the seed and the level, so reruns agree whatever
    the partitioning.
    """
    sized = docs.select(F.col(id_col).cast("long").alias("id"), F.col("source").alias("source"), word_count(F.col("text")).alias("size"))
    sized = stored(sized, "mix-sizes")
    targets = stored(source_targets(sized, weights, most), "mix-targets")
    most_rows = targets.agg(F.max("n")).first()[0] or 0
    # A row of its own for each source, of any number: Spark chooses the join by the table's size.
    parts = (
        placed(sized).join(targets.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
        .drop("_s")
        .withColumn("_ratio", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
        .withColumn("_whole", F.least(F.floor("_ratio"), F.lit(most)))
        .withColumn("_p", F.when((F.col("size") > 0) & (F.col("_whole") < most), F.col("_ratio") - F.col("_whole")).otherwise(F.lit(0.0)))
    )
    settled = parts.filter(F.col("_p") <= 0).select("id", "source", "size", F.lit(0.0).alias("p"))
    rest = parts.filter(F.col("_p") > 0).select("source", F.struct("id", "size", "k", F.col("_p").alias("p"), _uniform(F.col("id"), F.col("size"), F.col("k"), F.lit(seed), F.lit(0)).alias("u")).alias("item"))
    rounded = [settled]
    left, level = most_rows, 0
    while left > 0:
        blocks = max(1, math.ceil(left / block))
        level += 1
        key = F.pmod(F.xxhash64(F.col("item.id"), F.col("item.size"), F.col("item.k"), F.lit(seed), F.lit(level)), F.lit(blocks))
        arrays = rest.groupBy("source", key.alias("_block")).agg(F.array_sort(F.collect_list(F.struct((-F.col("item.size")).alias("o"), F.col("item.u").alias("u"), F.col("item.id").alias("i"), F.col("item.k").alias("k"), "item"))).alias("_list"))
        folded = stored(arrays.select("source", _pair_off(F.transform("_list", lambda x: x["item"])).alias("r")), f"mix-{level}")
        done = folded.select("source", F.explode("r.done").alias("d"))
        rounded.append(done.select("d.id", "source", "d.size", "d.p"))
        rest = folded.select("source", F.col("r.carry").alias("c"))
        if blocks == 1:
            # The last residual of a source goes to the nearer side, at most half a document from the target.
            rounded.append(rest.select("c.id", "source", "c.size", F.when(F.col("c.p") >= 0.5, F.lit(1.0)).otherwise(F.lit(0.0)).alias("p")))
            break
        rest = rest.select("source", F.struct("c.id", "c.size", "c.k", "c.p", _uniform(F.col("c.id"), F.col("c.size"), F.col("c.k"), F.lit(seed), F.lit(level)).alias("u")).alias("item"))
        left = blocks
    out = rounded[0]
    for frame in rounded[1:]:
        out = out.unionByName(frame)
    return (
        out.join(targets.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
        .withColumn("_ratio", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
        .select(
            F.col("id").alias(id_col), *(["source"] if with_source else []), "size", "source_size", "target",
            ((F.least(F.floor("_ratio"), F.lit(most)) + F.col("p").cast("long")) * F.col("size")).cast("long").alias("taken"),
        )
    )
