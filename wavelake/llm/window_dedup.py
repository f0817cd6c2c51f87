"""Substring dedup over token windows: Rabin-Karp hashes of every window of `width` words, counted in Spark.

Every window of every document is hashed with a rolling polynomial over word
hashes. A task first settles what it can by itself: of the documents that it
has read with the same window, all but the one of smallest id are hit. It
sends on one value for each distinct window, with that smallest document, so
a passage that a third of all rows hold costs one value for each task flush.
The shuffle deals windows by further hash bits, which tell apart what 64 bits
may not: the identity of a window is its bucket and its hash.

The reducers find the smallest document of each window and answer the others.
Each document then merges its hit windows into maximal removal intervals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavelake.llm.blocks import BLOCK, VALUES, answers, blocks, delivered, exchanged, received
from wavelake.llm.textkit import BYTE_A, U64, Rolling, arrow_limits, gathered, mix, partitions, ragged, runs, spread, utf8, words

HIT = 1
OUT = "doc_id bigint, n_words bigint, spans array<struct<start:bigint,end:bigint>>, kept string"
OUT_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.string())])


def window_keys(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row and word start of each window, its key, its bucket bits, and the first word of each row."""
    starts, ends, first = words(data, offsets)
    hashes = Rolling(BYTE_A[data]).of(starts, ends)
    n = np.maximum(first[1:] - first[:-1] - width + 1, 0)
    at = ragged(first[:-1], n)
    keys = Rolling(hashes, 1).windows(width)[at]
    bits = Rolling(mix(hashes + U64(0x9E3779B97F4A7C15)), 0).windows(width)[at]
    return np.repeat(np.arange(len(n)), n), at, keys, bits, first


def _entries(n: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches, "text"):
            table = table.filter(table["doc_id"].is_valid())
            if not table.num_rows:
                continue
            ids = table["doc_id"].to_numpy()
            row, _, keys, bits, _ = window_keys(*utf8(table["text"]), width)
            if not len(keys):
                continue
            docs = ids[row]
            order = np.argsort(keys)
            keys, docs, part = keys[order], docs[order], (bits[order] >> U64(33)) % U64(n)
            at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            least = np.minimum.reduceat(docs, at)
            hit = docs > np.repeat(least, np.diff(np.append(at, len(keys))))
            yield from answers(n, HIT, docs[hit], keys[hit])
            # One value for each distinct window goes on.
            yield blocks(n, VALUES, part[at].astype(np.int64), least, keys[at])

    return run


def _least(n: int):
    """For one part: which documents hold a window that a smaller document holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: list = []
        yield from received(batches, 1, got)
        if got:
            keys, docs, _ = got
            order = np.argsort(keys)
            keys, docs = keys[order], docs[order]
            at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            least = np.minimum.reduceat(docs, at)
            hit = docs > np.repeat(least, np.diff(np.append(at, len(keys))))
            yield from answers(n, HIT, docs[hit], keys[hit])

    return run


def told_values(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The row and value of everything that the rows of a batch were told."""
    row, value = [], []
    for i, blocks_ in enumerate(column.to_pylist()):
        for block in blocks_ or ():
            value.append(np.frombuffer(block["keys"], dtype=np.uint64))
            row.append(np.full(len(value[-1]), i))
    if not row:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    return np.concatenate(row), np.concatenate(value)


def _removals(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches, "text"):
            data, offsets = utf8(table["text"])
            hit_row, hit_key = told_values(table["told"])
            spans: list[list[dict]] = [[] for _ in range(table.num_rows)]
            if len(hit_row):
                row, at, keys, _, first = window_keys(data, offsets, width)
                tag = lambda r, k: mix(k ^ (r.astype(np.uint64) * U64(0xD1342543DE82EF95)))
                hit = np.isin(tag(row, keys), tag(hit_row, hit_key))
                covered = spread(at[hit], width, int(first[-1]))
                for i in np.unique(hit_row).tolist():
                    a, b = runs(covered[first[i] : first[i + 1]])
                    spans[i] = [{"start": x, "end": y} for x, y in zip(a.tolist(), b.tolist(), strict=True)]
            n_words, kept = [], []
            raw = data.tobytes()
            for i in range(table.num_rows):
                parts = raw[offsets[i] : offsets[i + 1]].split()
                n_words.append(len(parts))
                at_word, left = 0, []
                for s in spans[i]:
                    left += parts[at_word : s["start"]]
                    at_word = s["end"]
                kept.append(b" ".join(left + parts[at_word:] if at_word else parts))
            yield pa.RecordBatch.from_arrays([table["doc_id"].combine_chunks(), pa.array(n_words, pa.int64()), pa.array(spans, OUT_ARROW.field("spans").type), pa.array(kept, pa.binary()).cast(pa.string())], schema=OUT_ARROW)

    return run


def remove_repeated_windows(docs: DataFrame, width: int = 50) -> DataFrame:
    """(doc_id, n_words, spans, kept) for each row of docs (doc_id, text).

    `spans` are the maximal runs of words, from start to before end, that are
    covered by a window of `width` consecutive words which also starts in a
    document with a smaller doc_id; `kept` are the other words, joined by one
    space. Words are `[^\\x20\\x09-\\x0D]+`, unchanged. Null and empty texts have
    no words. Rows without a doc_id are kept whole and are no one's
    predecessor. Rows that repeat a doc_id are not smaller than each other:
    each keeps what no smaller document holds. Texts of any length are read
    whole; other columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    arrow_limits(spark)
    n = partitions(spark)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    values = docs.mapInArrow(_entries(n, width), BLOCK)
    told = delivered(exchanged(values, n, _least(n)), n)
    return docs.join(told, "doc_id", "left").select("doc_id", "text", "told").mapInArrow(_removals(width), OUT)
