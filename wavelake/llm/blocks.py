"""Blocks: packed values with the documents that hold them, dealt by part.

A block has one row for each part and flush, not for each value or document.
Values travel to the part that their hash names; answers travel to the part
that their document's hash names, where each document gets what it was told.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavelake.llm.textkit import U64, mix, trim

BLOCK = "part int, kind int, keys binary, docs binary, many binary"
BLOCK_ARROW = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("keys", pa.binary()), ("docs", pa.binary()), ("many", pa.binary())])
TOLD = "doc_id bigint, told array<struct<kind:int,keys:binary>>"
TOLD_ARROW = pa.schema([("doc_id", pa.int64()), ("told", pa.list_(pa.struct([("kind", pa.int32()), ("keys", pa.binary())])))])
#: Blocks of this kind are values on their way; other kinds are answers.
VALUES = 0


def packed_ids(ids: np.ndarray) -> bytes:
    """Ascending ids as the first one and differences of the least width."""
    steps = np.diff(ids).astype(np.uint64)
    most = int(steps.max()) if len(steps) else 0
    kind = next(k for k in ("u1", "u2", "u4", "u8") if most < 1 << (8 * int(k[1])))
    return kind[1].encode() + np.int64(ids[0]).tobytes() + steps.astype(kind).tobytes()


def unpacked_ids(raw: bytes) -> np.ndarray:
    steps = np.frombuffer(raw, dtype=f"u{raw[:1].decode()}", offset=9).astype(np.int64)
    return np.cumsum(np.concatenate([np.frombuffer(raw[1:9], dtype=np.int64), steps]))


def home(docs: np.ndarray, n: int) -> np.ndarray:
    """The part of a document."""
    return (mix(docs.astype(np.int64).view(np.uint64)) % U64(n)).astype(np.int64)


def blocks(n: int, kind: int, part: np.ndarray, docs: np.ndarray, keys: np.ndarray, many: np.ndarray | None = None) -> pa.RecordBatch:
    """Keys (one or more columns), their documents and, if given, a flag for each, by part."""
    order = np.lexsort((docs, part))
    part, docs, keys = part[order], docs[order], keys[order]
    bounds = np.searchsorted(part, np.arange(n + 1))
    some = np.flatnonzero(np.diff(bounds)).tolist()
    spans = [(bounds[p], bounds[p + 1]) for p in some]
    flags = [b""] * len(some) if many is None else [np.packbits(many[order][a:b]).tobytes() for a, b in spans]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(some, pa.int32()), pa.array([kind] * len(some), pa.int32()), pa.array([keys[a:b].tobytes() for a, b in spans], pa.binary()),
            pa.array([packed_ids(docs[a:b]) for a, b in spans], pa.binary()), pa.array(flags, pa.binary()),
        ],
        schema=BLOCK_ARROW,
    )


def answers(n: int, kind: int, docs: np.ndarray, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Keys addressed to their documents; none for no keys."""
    if len(docs):
        yield blocks(n, kind, home(docs, n), docs, keys)


def received(batches: Iterator[pa.RecordBatch], wide: int, out: list, kind=np.uint64) -> Iterator[pa.RecordBatch]:
    """Pass answers on and gather the values of a part into out: keys, docs, flags."""
    keys, docs, many = [], [], []
    for batch in batches:
        kinds = batch["kind"].to_numpy()
        rest = np.flatnonzero(kinds != VALUES)
        if len(rest):
            yield batch.take(pa.array(rest))
        for i in np.flatnonzero(kinds == VALUES).tolist():
            d = unpacked_ids(batch["docs"][i].as_py())
            k = np.frombuffer(batch["keys"][i].as_py(), dtype=kind)
            docs.append(d)
            keys.append(k.reshape(-1, wide) if wide > 1 else k)
            flags = batch["many"][i].as_py()
            many.append(np.unpackbits(np.frombuffer(flags, dtype=np.uint8), count=len(d)).astype(bool) if flags else np.zeros(len(d), dtype=bool))
    if keys:
        trim()
        out += [np.concatenate(keys), np.concatenate(docs), np.concatenate(many)]


def _told(wide: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, docs, kinds = [], [], []
        for batch in batches:
            for kind, k, d in zip(batch["kind"].to_pylist(), batch["keys"].to_pylist(), batch["docs"].to_pylist(), strict=True):
                docs.append(unpacked_ids(d))
                keys.append(np.frombuffer(k, dtype=np.uint64).reshape(-1, wide))
                kinds.append(np.full(len(docs[-1]), kind, dtype=np.int32))
        if not docs:
            return
        k, d, c = np.concatenate(keys), np.concatenate(docs), np.concatenate(kinds)
        del keys, docs, kinds
        order = np.lexsort((c, d))
        k, d, c = k[order], d[order], c[order]
        new = np.concatenate([[True], (d[1:] != d[:-1]) | (c[1:] != c[:-1])])
        at = np.flatnonzero(new)
        ends = np.append(at[1:], len(d))
        firsts = np.flatnonzero(np.concatenate([[True], d[at][1:] != d[at][:-1]]))
        lasts = np.append(firsts[1:], len(at))
        for i in range(0, len(firsts), 500):
            ids, told = [], []
            for a, b in zip(firsts[i : i + 500].tolist(), lasts[i : i + 500].tolist(), strict=True):
                ids.append(int(d[at[a]]))
                told.append([{"kind": int(c[at[j]]), "keys": k[at[j] : ends[j]].tobytes()} for j in range(a, b)])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(told, TOLD_ARROW.field("told").type)], schema=TOLD_ARROW)

    return run


def exchanged(frame: DataFrame, n: int, reduce) -> DataFrame:
    """Blocks brought together by part and reduced to blocks."""
    return frame.repartitionById(n, F.col("part")).mapInArrow(reduce, BLOCK)


def delivered(frame: DataFrame, n: int, wide: int = 1) -> DataFrame:
    """One row for each document that answers are addressed to: (doc_id, told)."""
    return frame.repartitionById(n, F.col("part")).mapInArrow(_told(wide), TOLD)
