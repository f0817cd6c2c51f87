"""Repeated byte strings by prefix-free parsing.

A rolling hash over `GRAM` bytes makes triggers, and triggers cut each text
into phrases. A trigger depends on its own bytes alone, so equal strings are
cut alike wherever they stand, and a suffix of the corpus is named by what is
left of its phrase (a suffix of a dictionary word) and by what follows from
the next trigger on (a suffix of the parse). Repeats of `width` bytes need
corpus order to that depth only, so both suffix orders are kept to it: the
suffixes of the parse as classes by hash, those of the dictionary as the
strings before a trigger.

1. Each trigger names the class of its right side (the parse suffix, to
   `width / 2` bytes) and the class of its phrase with the full right side (the
   dictionary word in its context). A right side that stands alone rules out
   repeats around the trigger. Where two contexts agree, all strings that
   start in the phrase repeat.
2. Where one right side has different contexts, one holder of each context
   names the classes of the strings that start in its phrase, and equal classes
   meet.

Strings whose next trigger is further than `width / 2` away (long phrases)
are classed one by one beside the triggers. A context is told by 64 bits and
by 32 and its part of the right side, a string by 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavelake.llm.blocks import BLOCK, VALUES, answers, blocks, delivered, exchanged, received
from wavelake.llm.textkit import BYTE_A, BYTE_B, U64, Rolling, arrow_limits, gathered, mix, partitions, ragged, runs, stored, utf8

GRAM = 12
#: One gram in so many is a trigger: the mean length of a phrase.
RATE = 20
FAR = U64(0xC2B2AE3D27D4EB4F)

FULL, MIXED, STRING = 1, 2, 3
OUT_ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])
OUT = "doc_id bigint, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary"


class Parse(NamedTuple):
    """Places of a batch: triggers first, then the starts of far strings."""

    at: np.ndarray
    low: np.ndarray
    high: np.ndarray
    stop: np.ndarray
    row: np.ndarray
    right: np.ndarray
    rolling: Rolling


def parse(data: np.ndarray, offsets: np.ndarray, width: int) -> Parse:
    """Strings that start in at - high .. at - low belong to a place; `stop` ends its right side."""
    n, half = len(data), width // 2
    rolling = Rolling(BYTE_A[data])
    at = np.flatnonzero(rolling.windows(GRAM) < U64((1 << 64) // RATE))
    row = np.searchsorted(offsets, at, side="right") - 1
    end = offsets[row + 1]
    inside = at + GRAM <= end
    at, row, end = at[inside], row[inside], end[inside]
    before = offsets[row]
    if len(at):
        before[1:] = np.where(row[1:] == row[:-1], at[:-1] + 1, before[1:])
    high = np.minimum(at - before, half)
    low = np.maximum(at + width - end, 0)
    some = low <= high
    at, row, end, high, low = at[some], row[some], end[some], high[some], low[some]
    # Starts of strings that no place has.
    delta = np.zeros(n + 1, dtype=np.int32)
    lengths = np.diff(offsets)
    long = lengths >= width
    np.add.at(delta, offsets[:-1][long], 1)
    np.add.at(delta, offsets[1:][long] - width + 1, -1)
    delta[at - high] -= 1
    np.add.at(delta, at - low + 1, 1)
    far = np.flatnonzero(np.cumsum(delta[:-1]) > 0)
    right = np.concatenate([rolling.of(at, at + width - half), rolling.of(far, far + width) ^ FAR])
    zero = np.zeros(len(far), dtype=np.int64)
    return Parse(
        np.concatenate([at, far]), np.concatenate([low, zero]), np.concatenate([high, zero]),
        np.concatenate([np.minimum(at + width, end), far + width]), np.concatenate([row, np.searchsorted(offsets, far, side="right") - 1]), right, rolling,
    )


def contexts(p: Parse, which: np.ndarray, other: Rolling) -> np.ndarray:
    """The class of phrase and right side of the chosen places, with their lengths."""
    at, high, stop = p.at[which], p.high[which], p.stop[which]
    return mix(other.of(at - high, stop) + high.astype(np.uint64) * U64(0x9FB21C651E98DF25))


def union(right: np.ndarray, context: np.ndarray) -> np.ndarray:
    return mix(right ^ (context * U64(0x9E3779B97F4A7C15)))


def strings(p: Parse, which: np.ndarray, other: Rolling, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, index into `which` and second class of all strings that belong to the chosen places."""
    n = p.high[which] - p.low[which] + 1
    starts = ragged(p.at[which] - p.high[which], n)
    return starts, np.repeat(np.arange(len(which)), n), other.of(starts, starts + width)


def grouped(first: np.ndarray, second: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted order, first index of each class, and size of each class."""
    order = np.argsort(first) if second is None else np.lexsort((second, first))
    a = first[order]
    new = np.concatenate([[True], a[1:] != a[:-1]]) if len(a) else np.zeros(0, dtype=bool)
    if second is not None and len(a):
        b = second[order]
        new[1:] |= b[1:] != b[:-1]
    at = np.flatnonzero(new)
    return order, at, np.diff(np.append(at, len(a)))


def part_of(lead: np.ndarray, n: int) -> np.ndarray:
    return (((lead * U64(0xD1342543DE82EF95)) >> U64(32)) % U64(n)).astype(np.int64)


def short(right: np.ndarray) -> np.ndarray:
    """32 bits of a right side's class; the part that it goes to tells more."""
    return right & U64(0xFFFFFFFF)


def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]]:
    for table in gathered(batches, "text"):
        data, offsets = utf8(table["text"])
        if len(data):
            yield table, table["at"].to_numpy(), data, offsets


def told(table: pa.Table, kind: int) -> np.ndarray:
    """All values of one kind among the answers that rows of the batch have got. What is shared is so for all documents."""
    out = [np.frombuffer(x["keys"], dtype=np.uint64) for row in table["told"].to_pylist() for x in row or () if x["kind"] == kind]
    return np.unique(np.concatenate(out)) if out else np.zeros(0, dtype=np.uint64)


def _round1(n: int, width: int):
    def run(batches):
        for _, ids, data, offsets in texts(batches):
            p = parse(data, offsets, width)
            if not len(p.at):
                continue
            docs, context = ids[p.row], contexts(p, np.arange(len(p.at)), Rolling(BYTE_B[data], 1))
            order, at, size = grouped(p.right, context)
            full = order[np.repeat(size > 1, size)]
            yield from answers(n, FULL, docs[full], union(short(p.right[full]), context[full]))
            lead = order[at]
            keys = np.empty((len(lead), 3), dtype=np.uint32)
            keys[:, 0] = short(p.right[lead])
            keys[:, 1:] = context[lead].view(np.uint32).reshape(-1, 2)
            yield blocks(n, VALUES, part_of(p.right[lead], n), docs[lead], keys, size > 1)

    return run


def _contexts(n: int):
    """Which contexts occur more than once, and which right sides have several."""

    def run(batches):
        got: list = []
        yield from received(batches, 3, got, np.uint32)
        if not got:
            return
        keys, docs, many = got
        right, context = keys[:, 0].astype(np.uint64), np.ascontiguousarray(keys[:, 1:]).view(np.uint64).ravel()
        order, at, size = grouped(right, context)
        hit = order[np.repeat(size > 1, size)]
        hit = hit[~many[hit]]
        yield from answers(n, FULL, docs[hit], union(right[hit], context[hit]))
        lead = order[at]
        side = right[lead]
        starts = np.flatnonzero(np.concatenate([[True], side[1:] != side[:-1]]))
        several = np.diff(np.append(starts, len(side)))
        mixed = lead[np.repeat(several > 1, several)]
        yield from answers(n, MIXED, docs[mixed], union(right[mixed], context[mixed]))

    return run


def _strings(n: int):
    """Strings that occur more than once: an answer to each holder that doesn't know yet."""

    def run(batches):
        got: list = []
        yield from received(batches, 2, got)
        if got:
            keys, docs, many = got
            order, at, size = grouped(keys[:, 0], keys[:, 1])
            hit = order[np.repeat(size > 1, size)]
            hit = hit[~many[hit]]
            yield from answers(n, STRING, docs[hit], union(keys[hit, 0], keys[hit, 1]))

    return run


def _round2(n: int, width: int):
    def run(batches):
        for table, ids, data, offsets in texts(batches):
            p, other = parse(data, offsets, width), Rolling(BYTE_B[data], 1)
            which = np.arange(len(p.at))
            which = which[np.isin(union(short(p.right), contexts(p, which, other)), told(table, MIXED))]
            if not len(which):
                continue
            starts, index, second = strings(p, which, other, width)
            first, docs = p.rolling.of(starts, starts + width), ids[p.row[which]][index]
            order, at, size = grouped(first, second)
            shared = order[np.repeat(size > 1, size)]
            lead = order[at]
            yield from answers(n, STRING, docs[shared], union(first[shared], second[shared]))
            yield blocks(n, VALUES, part_of(first[lead], n), docs[lead], np.stack([first[lead], second[lead]], axis=1), size > 1)

    return run


def _removals(width: int):
    def run(batches):
        for table in gathered(batches, "text"):
            data, offsets = utf8(table["text"])
            spans: list[list[dict]] = [[] for _ in range(table.num_rows)]
            full, mixed, one = told(table, FULL), told(table, MIXED), told(table, STRING)
            kept = [b""] * table.num_rows
            raw = data.tobytes()
            covered = np.zeros(len(data), dtype=bool)
            if len(full) or len(one):
                p, other = parse(data, offsets, width), Rolling(BYTE_B[data], 1)
                which = np.arange(len(p.at))
                both = union(short(p.right), contexts(p, which, other))
                whole = np.isin(both, full)
                a = p.at[whole]
                delta = np.zeros(len(data) + 1, dtype=np.int32)
                np.add.at(delta, a - p.high[whole], 1)
                np.add.at(delta, a - p.low[whole] + width, -1)
                part = which[np.isin(both, mixed)]
                if len(part) and len(one):
                    starts, _, second = strings(p, part, other, width)
                    hit = starts[np.isin(union(p.rolling.of(starts, starts + width), second), one)]
                    np.add.at(delta, hit, 1)
                    np.add.at(delta, hit + width, -1)
                covered = np.cumsum(delta[:-1]) > 0
            for i in range(table.num_rows):
                s, e = int(offsets[i]), int(offsets[i + 1])
                here = covered[s:e]
                if here.any():
                    a, b = runs(here)
                    spans[i] = [{"start": x, "end": y} for x, y in zip(a.tolist(), b.tolist(), strict=True)]
                    kept[i] = data[s:e][~here].tobytes()
                else:
                    kept[i] = raw[s:e]
            yield pa.RecordBatch.from_arrays([table["doc_id"].combine_chunks(), pa.array(np.diff(offsets), pa.int64()), pa.array(spans, OUT_ARROW.field("spans").type), pa.array(kept, pa.binary())], schema=OUT_ARROW)

    return run


def remove_repeated_bytes(docs: DataFrame, width: int = 200) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) for each row of docs (doc_id, text).

    `spans` are the maximal runs of UTF-8 bytes covered by a string of `width`
    bytes that also starts anywhere else in the corpus, the same document
    included; `kept` are the other bytes. Strings never cross documents. Null
    texts are empty. Rows that repeat a doc_id or have none are documents of
    their own, as all others. An empty table gives no rows; texts of any length
    are read whole; other columns of docs are not read. Ids are castable to
    bigint.
    """
    spark = docs.sparkSession
    arrow_limits(spark)
    n = partitions(spark)
    # Where a row is told what repeats. Rows that share it are told more than they need, and all of it is so.
    at = F.coalesce(F.col("doc_id").cast("bigint"), F.xxhash64("text")).alias("at")
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), at)
    first = delivered(exchanged(docs.mapInArrow(_round1(n, width), BLOCK), n, _contexts(n)), n)
    first = stored(first.withColumnRenamed("doc_id", "at"), "byte-contexts")
    # One shuffle of the texts by document, which both joins below use.
    docs = docs.repartition(n, "at")
    open_ = first.filter(F.exists("told", lambda t: t["kind"] == MIXED))
    second = delivered(exchanged(docs.join(open_, "at").mapInArrow(_round2(n, width), BLOCK), n, _strings(n)), n)
    both = docs.join(first, "at", "left").join(second.toDF("at", "more"), "at", "left")
    nothing = F.array().cast("array<struct<kind:int,keys:binary>>")
    return both.select("doc_id", "text", F.concat(F.coalesce("told", nothing), F.coalesce("more", nothing)).alias("told")).mapInArrow(_removals(width), OUT)
