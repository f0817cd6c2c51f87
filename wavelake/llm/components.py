"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavelake.llm.textkit import discard, stored

PAIR = pa.schema([("u", pa.int64()), ("v", pa.int64())])
#: Nodes that a task holds while it unites the edges that it reads.
HELD = 500_000


def united(pairs: Iterator[tuple[int, int]]) -> dict[int, int]:
    """Each node of the pairs with the least node that they link it to."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges that a task has read, as stars around least nodes."""
    held: dict[int, int] = {}

    def out() -> pa.RecordBatch:
        some = [(x, c) for x, c in held.items() if x != c]
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in some], pa.int64()), pa.array([c for _, c in some], pa.int64())], schema=PAIR)

    for batch in batches:
        held = united([*held.items(), *zip(batch["u"].to_pylist(), batch["v"].to_pylist(), strict=True)])
        if len(held) > HELD:
            yield out()
            held = {}
    if held:
        yield out()


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's least neighbour, itself included. Edges are (u > v)."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # Written, so that the join deals out its sides anew and Spark can split a node with many edges.
    least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), F.least("u", "m").alias("m")), "least")
    return edges.join(least, "v").select("u", F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of them."""
    least = stored(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
    kept = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return kept.filter("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(v, c) for every node of edges (u, v), c the least node of its component.

    Tasks first unite the edges that they read. The star of least nodes is
    reached in a number of rounds that grows with the logarithm of the size of
    the components; it is reached when every node has one edge and no node is
    both end and centre. Each round is written, so its lineage is short. Loops
    and repeated edges do no harm; no edges give no rows.
    """
    now = stored(edges.filter("u <> v").select(F.col("u").cast("bigint").alias("u"), F.col("v").cast("bigint").alias("v")).mapInArrow(_stars, "u bigint, v bigint").distinct(), "edges")
    while True:
        ends = now.select(F.col("u").alias("x"), F.lit(1).alias("leaf"), F.lit(0).alias("centre")).unionByName(now.select(F.col("v").alias("x"), F.lit(0).alias("leaf"), F.lit(1).alias("centre")))
        if ends.groupBy("x").agg(F.sum("leaf").alias("leaf"), F.max("centre").alias("centre")).filter("leaf > 1 or (leaf = 1 and centre = 1)").isEmpty():
            break
        large = stored(_large(now), "stars")
        discard(now)
        now = stored(_small(large), "stars")
        discard(large)
    return now.select(F.col("u").alias("v"), F.col("v").alias("c")).unionByName(now.select("v", F.col("v").alias("c")).distinct())
