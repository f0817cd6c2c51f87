"""Prefix trie of conversations by distributed MSD radix partitioning.

Turns are coded: a dictionary gives each distinct (role, text) an id, and from
there on a turn is its conversation, its place, its id and its number of words.
A *bucket* is the conversations below one node. A large one is partitioned by
the id of the first turn at which its conversations differ; what they share
before it are nodes of one child, found by one aggregate however long it is.
Buckets of one conversation are a chain of nodes; those of few turns are local:
a task sorts them by multikey quicksort and emits their nodes; the rest go to the
next round. Sums over subtrees then go up from bucket to bucket.

Only ids are dealt out, texts never. A conversation is never held as one row
unless its bucket is local, so neither a hot conversation, nor many copies of
one, nor a first turn that a third of all share makes a large task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavelake.llm.textkit import arrow_limits, discard, stored

#: Turns of a bucket that one task sorts.
LOCAL = 2048
#: Ids of ended conversations in one row, and turns of a shared path in one window.
BLOCK = 4096
WORD = r"[^\x20\x09-\x0D]+"
TURN = ["conv_id", "pos", "id", "words"]
NODE = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
LOCAL_NODE = pa.schema([(x.split()[0], pa.string() if "string" in x else pa.int64()) for x in f"{NODE}, pb bigint, pd bigint".split(", ")])
NONE = hashlib.sha256(b"").hexdigest()


def coded(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, id, words): the turns of each conversation by place, from 1.

    Turns are in the order of `turn`, null first; equal ones by role, then by the
    SHA-256 of role and text, so that order does not depend on partitions.
    id: equal for turns equal in role and text. Rows without a conv_id are of no
    conversation.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), role.alias("role"),
        F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("words"),
    )
    # Written, so that texts are read and hashed once; the row parts equal turns over range partitions.
    turns = stored(turns.withColumn("row", F.monotonically_increasing_id()), "turns")
    order = [F.col("turn").asc_nulls_first(), "role", "digest", "row"]
    ranged = stored(turns.repartitionByRange("conv_id", *order).withColumn("task", F.spark_partition_id()), "ranged-turns")
    dictionary = stored(turns.select("digest").distinct().withColumn("id", F.monotonically_increasing_id()), "turn-ids")
    discard(turns)
    placed = ranged.withColumn("at", F.row_number().over(Window.partitionBy("conv_id", "task").orderBy(*order)))
    earlier = Window.partitionBy("conv_id").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = ranged.groupBy("conv_id", "task").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).filter("before > 0").drop("n")
    placed = stored(placed.join(before, ["conv_id", "task"], "left").select("conv_id", (F.col("at") + F.coalesce("before", F.lit(0))).alias("pos"), "digest", "words"), "placed-turns")
    out = stored(placed.join(dictionary, "digest").select(*TURN), "coded-turns")
    discard(ranged, dictionary, placed)
    return out


def lengths(turns: DataFrame) -> DataFrame:
    """(conv_id, n): conversations with their number of turns."""
    return turns.groupBy("conv_id").agg(F.count("*").alias("n"))


def rebuilt(turns: DataFrame, group: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """Turns and lengths of conversations that begin as the first one of their group does.

    Conversation c takes the first h turns of conversation c - c % group, all if
    it has fewer and none if there is none, with h = crc32 of c as text modulo
    `heads`; its own turns after the first h follow. % has the sign of c.
    """
    n = stored(lengths(turns), "lengths")
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(heads))
    first = F.col("conv_id") - F.col("conv_id") % group
    heading = n.filter(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("g"), F.col("n").alias("g_n"))
    taken = F.least(F.col("h"), F.coalesce("g_n", F.lit(0)))
    own = turns.withColumn("h", h).filter("pos > h").withColumn("g", first).join(heading, "g", "left")
    own = own.select("conv_id", (taken + F.col("pos") - F.col("h")).alias("pos"), "id", "words")
    shared = turns.filter((F.col("conv_id") % group == 0) & (F.col("pos") < heads)).select(F.col("conv_id").alias("g"), "pos", "id", "words")
    head = n.select("conv_id", h.alias("h"), first.alias("g")).join(shared, "g").filter("pos <= h").select(*TURN)
    sizes = n.withColumn("h", h).withColumn("g", first).join(heading, "g", "left").select("conv_id", (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n"))
    return stored(own.unionByName(head), "rebuilt-turns"), stored(sizes, "rebuilt-lengths")


def local_nodes(members: list[tuple[int, list[int], list[int]]], depth: int, up: int) -> list[tuple]:
    """Nodes below and with the one at `depth` that all members, (conv_id, ids, words) by conv_id, share.

    Multikey quicksort: members are parted into those whose id at a place is
    less than, equal to and greater than a pivot's. Those equal are a node and
    go on at the next place; the parting is stable, so the first is the least.
    """
    nodes: list[list] = []
    work = [(members, 0, -1)]
    while work:
        some, at, parent = work.pop()
        pivot = some[len(some) // 2][1][at]
        same = [x for x in some if x[1][at] == pivot]
        if len(same) < len(some):
            work += [(part, at, parent) for part in ([x for x in some if x[1][at] < pivot], [x for x in some if x[1][at] > pivot]) if part]
        ended = ",".join(str(x[0]) for x in same if len(x[1]) == at + 1)
        rest = [x for x in same if len(x[1]) > at + 1]
        nodes.append([same[0][0], depth + at, parent, len(same), 0, 0, (len(same) - 1) * same[0][2][at], hashlib.sha256(ended.encode()).hexdigest()])
        if rest:
            work.append((rest, at + 1, len(nodes) - 1))
    for node in reversed(nodes):  # a node comes after its parent
        node[5] = node[5] or 1
        if node[2] >= 0:
            above = nodes[node[2]]
            above[4] += 1
            above[5] += node[5]
            above[6] += node[6]
    return [(conv, at, up if parent < 0 else nodes[parent][0], *rest) for conv, at, parent, *rest in nodes]


def _sorted_locally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("b", "d", "up", "pb", "pd", "conv_id", "id", "words")
    rows = (row for batch in batches for row in zip(*(batch[c].to_pylist() for c in names), strict=True))
    out: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), LOCAL_NODE, strict=True)], schema=LOCAL_NODE)

    for (b, d), bucket in groupby(rows, lambda r: r[:2]):
        members = []
        for conv, turns in groupby(bucket, lambda r: r[5]):
            turns = list(turns)
            members.append((conv, [r[6] for r in turns], [r[7] for r in turns]))
            up, pb, pd = turns[0][2:5]
        out += [(*node, *((pb, pd) if node[1] == d else (None, None))) for node in local_nodes(members, d, up)]
        if len(out) > 5000:
            yield batch()
            out = []
    if out:
        yield batch()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(b, depth, ends_sha256) of rows sorted by b, depth and block; the ids of a node pass as they come."""
    rows = (row for batch in batches for row in zip(*(batch[c].to_pylist() for c in ("b", "depth", "ids")), strict=True))
    for (b, depth), some in groupby(rows, lambda r: r[:2]):
        held, first = hashlib.sha256(), True
        for _, _, ids in some:
            held.update(("" if first else ",").encode() + ids.encode())
            first = False
        yield pa.RecordBatch.from_pydict({"b": [b], "depth": [depth], "ends_sha256": [held.hexdigest()]}, schema=pa.schema([("b", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string())]))


def ended(ends: DataFrame) -> DataFrame:
    """(b, depth, ends_sha256) of (b, depth, conv_id): the hash of a node's ids, ascending and joined by commas. Ids are packed in blocks of a range first."""
    packed = ends.groupBy("b", "depth", F.floor(F.col("conv_id") / BLOCK).alias("block")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))
    return packed.repartition("b", "depth").sortWithinPartitions("b", "depth", "block").mapInArrow(_hashed, "b bigint, depth bigint, ends_sha256 string")


def suffix_sums(path: DataFrame) -> DataFrame:
    """path (b, d, pos, words) with `below`: the words from pos on, in two levels, so that a long path is no single window."""
    block = F.floor(F.col("pos") / BLOCK)
    later = Window.partitionBy("b", "d").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    sums = path.groupBy("b", "d", block.alias("block")).agg(F.sum("words").alias("s")).select("b", "d", "block", F.coalesce(F.sum("s").over(later), F.lit(0)).alias("later"))
    within = Window.partitionBy("b", "d", "block").orderBy(F.desc("pos"))
    return path.withColumn("block", block).withColumn("here", F.sum("words").over(within)).join(sums, ["b", "d", "block"]).withColumn("below", F.col("here") + F.col("later")).drop("block", "here", "later")


def _nodes(*, conv: Column, depth: Column, parent: Column, convs: Column, children: Column, leaves: Column, saved: Column, ends: Column) -> list[Column]:
    kinds = [x.split() for x in NODE.split(", ")]
    return [c.cast(kind).alias(name) for (name, kind), c in zip(kinds, (conv, depth, parent, convs, children, leaves, saved, ends), strict=True)]


def prefix_trie(turns: DataFrame, sizes: DataFrame, local: int = LOCAL) -> DataFrame:
    """One row for each distinct sequence of first turns, the empty one included.

    turns: (conv_id, pos, id, words) with pos from 1 without gaps; sizes:
    (conv_id, n), conversations without turns too. Both are read several times.
    A node is named by its smallest conversation and its depth. Buckets of up to
    `local` turns are sorted in one task.
    """
    least = sizes.agg(F.min("conv_id")).first()[0]
    if least is None:
        return turns.sparkSession.createDataFrame([], NODE)
    null = F.lit(None).cast("bigint")
    # The bucket of node (b, d): up is its parent's conversation, (pb, pd) its parent's bucket.
    bucket = ["b", "d", "up", "pb", "pd"]
    active = sizes.select("conv_id", "n", F.lit(least).alias("b"), F.lit(0).cast("bigint").alias("d"), null.alias("up"), null.alias("pb"), null.alias("pd"))
    splits, paths, ends, done = [], [], [], []
    while True:
        below = turns.join(active.select("conv_id", "b", "d"), "conv_id").filter("pos >= d") if splits else turns.withColumns({"b": F.lit(least), "d": F.lit(0).cast("bigint")})
        places = stored(below.groupBy("b", "d", "pos").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("c"), F.max("words").alias("words")), "places")
        whole = active.groupBy(*bucket).agg(F.count("*").alias("members"), F.min("n").alias("shortest"))
        parting = places.join(whole.select("b", "d", "members"), ["b", "d"]).filter("lo <> hi or c < members").groupBy("b", "d").agg((F.min("pos") - 1).alias("shared"))
        split = stored(whole.join(parting, ["b", "d"], "left").select(*bucket, "members", F.coalesce("shared", "shortest").alias("last")), "splits")
        path = places.join(split.select("b", "d", "last"), ["b", "d"]).filter("pos <= last").select("b", "d", "pos", "words")
        if not splits:  # the root has no turn
            path = path.unionByName(split.select("b", "d", F.lit(0).cast("bigint").alias("pos"), F.lit(0).cast("bigint").alias("words")))
        path = stored(path, "paths")
        discard(places)
        reached = active.select("conv_id", "n", "b", "d").join(split.select("b", "d", "last"), ["b", "d"])
        ends.append(stored(reached.filter("n = last").select("b", F.col("last").alias("depth"), "conv_id"), "ends"))
        going = reached.filter("n > last").withColumn("pos", F.col("last") + 1)
        digits = stored(turns.select("conv_id", "pos", "id").join(going, ["conv_id", "pos"]), "digits")
        child = stored(digits.groupBy("b", "d", "id").agg(F.min("conv_id").alias("least"), F.count("*").alias("members"), F.sum(F.col("n") - F.col("last")).alias("turns")), "buckets")
        dealt = digits.join(child, ["b", "d", "id"]).select("conv_id", "n", F.col("least").alias("b"), F.col("pos").alias("d"), F.col("b").alias("up"), F.col("b").alias("pb"), F.col("d").alias("pd"), "members", "turns")
        dealt = stored(dealt, "dealt")
        splits.append((split, child.groupBy("b", "d").agg(F.count("*").alias("n_children"))))
        paths.append(path)
        large = (F.col("members") > 1) & (F.col("turns") > local)
        done.append(dealt.filter(~large).withColumn("alone", F.col("members") == 1).drop("members", "turns"))
        active = dealt.filter(large).drop("members", "turns")
        discard(digits)
        if active.isEmpty():
            break

    def union(frames: list[DataFrame]) -> DataFrame:
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    ready = stored(union(done), "ready")
    rows = stored(turns.join(ready, "conv_id").filter("pos >= d"), "ready-turns")
    alone = rows.filter("alone")
    leaf = F.col("pos") == F.col("n")
    single = alone.select(*_nodes(
        conv=F.col("conv_id"), depth=F.col("pos"), parent=F.when(F.col("pos") == F.col("d"), F.col("up")).otherwise(F.col("conv_id")), convs=F.lit(1), children=F.when(leaf, 0).otherwise(1),
        leaves=F.lit(1), saved=F.lit(0), ends=F.when(leaf, F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(F.lit(NONE)),
    ))
    few = rows.filter("not alone").repartition("b", "d").sortWithinPartitions("b", "d", "conv_id", "pos")
    few = stored(few.select("b", "d", "up", "pb", "pd", "conv_id", "id", "words").mapInArrow(_sorted_locally, f"{NODE}, pb bigint, pd bigint"), "local-nodes")

    tops = few.filter("pb is not null").select("pb", "pd", "n_leaves", "saved_tokens")
    tops = tops.unionByName(ready.filter("alone").select("pb", "pd", F.lit(1).cast("bigint").alias("n_leaves"), F.lit(0).cast("bigint").alias("saved_tokens")))
    out, hashes = [], ended(union(ends))
    summed = stored(tops.groupBy("pb", "pd").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")), "sums")
    from_large = None
    for (split, children), path in zip(reversed(splits), reversed(paths), strict=True):
        sums = summed if from_large is None else summed.unionByName(from_large)
        sums = sums.groupBy(F.col("pb").alias("b"), F.col("pd").alias("d")).agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved"))
        known = split.join(sums, ["b", "d"], "left").join(children, ["b", "d"], "left")
        known = stored(known.select(*bucket, "members", "last", F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"), F.coalesce("saved", F.lit(0)).alias("saved"), F.coalesce("n_children", F.lit(0)).alias("n_children")), "known")
        along = stored(suffix_sums(path).join(known, ["b", "d"]).withColumn("saved", F.col("saved") + (F.col("members") - 1) * F.col("below")), "along")
        from_large = along.filter("pos = d and pb is not null").select("pb", "pd", "n_leaves", F.col("saved").alias("saved_tokens"))
        last = F.col("pos") == F.col("last")
        out.append(along.join(hashes.withColumnRenamed("depth", "pos"), ["b", "pos"], "left").select(*_nodes(
            conv=F.col("b"), depth=F.col("pos"), parent=F.when(F.col("pos") == F.col("d"), F.col("up")).otherwise(F.col("b")), convs=F.col("members"), children=F.when(last, F.col("n_children")).otherwise(1),
            leaves=F.col("n_leaves"), saved=F.col("saved"), ends=F.coalesce("ends_sha256", F.lit(NONE)),
        )))
    return union([single, few.drop("pb", "pd"), *out])


def conversation_trie(conversations: DataFrame, rebuild: tuple[int, int] | None = None, local: int = LOCAL) -> DataFrame:
    """One row for each distinct sequence of first turns of conversations, from the textless root on.

    conv_id: the smallest conversation that starts so; depth; parent_conv_id: the
    parent's conv_id, null for the root; n_convs: conversations that start so;
    n_children; n_leaves: childless nodes of the subtree; saved_tokens: over the
    subtree, (n_convs - 1) times the words of a node's last text, that is what
    sharing prefixes saves; ends_sha256: of the conversations that end there,
    ascending and joined by commas. With rebuild = (group, heads) conversations
    are first rebuilt (see `rebuilt`).

    A null role or text is an empty one, a null turn comes first, turns of one
    number go by role and hash (see `coded`), repeated rows are turns of their
    own. Rows without a conv_id are left out; a table without others gives no
    rows, not even a root. Texts count whole; other columns are not read.
    """
    arrow_limits(conversations.sparkSession)
    turns = coded(conversations)
    turns, sizes = rebuilt(turns, *rebuild) if rebuild else (turns, stored(lengths(turns), "lengths"))
    return prefix_trie(turns, sizes, local)
