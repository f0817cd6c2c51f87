"""Vectorised text kernels that work on Arrow batches, and the block exchange.

Text columns are handled as one UTF-8 byte buffer per batch. Rolling hashes
are Rabin-Karp polynomials modulo 2^64 over random byte values; prefix sums
give the hash of any substring in constant time.

A *block exchange* sends fixed-width values (hashes with the document they
come from) through one Spark shuffle as packed binary blocks, one for each
bucket and flush, in place of one row for each value.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from wavelake.shared import discard, expire, shared_dir, stored  # noqa: F401  (the operators take them from here)

U64 = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240611))
BYTE_A = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
BYTE_B = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
BASES = (0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1)
SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of text that a task gathers before it hashes and flushes them.
FLUSH_BYTES = 2 << 20


def powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of a base and of its inverse modulo 2^64."""
    # Kept with the process: functions travel by value and their globals with them.
    cache = sys.__dict__.setdefault("_wavelake_powers", {})
    have = cache.get(which)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        base = BASES[which]
        made = []
        for x in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, x, dtype=np.uint64)
            p[0] = 1
            made.append(np.cumprod(p, dtype=np.uint64))
        have = cache[which] = (made[0], made[1])
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Rolling:
    """Hashes of substrings of a sequence of values: bytes, or hashes of words."""

    def __init__(self, values: np.ndarray, which: int = 0):
        n = len(values)
        p, self.inverse = powers(n + 1, which)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(values * p[:n], dtype=np.uint64, out=self.sums[1:])

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.inverse[start]

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Mixed hash of values[start:end], which also depends on the length."""
        return mix(self.raw(start, end) ^ ((end - start).astype(np.uint64) * U64(0xA24BAED4963EE407)))

    def windows(self, k: int) -> np.ndarray:
        """Mixed hashes of all windows of k values, by start."""
        n = len(self.sums) - 1
        if n < k:
            return np.zeros(0, dtype=np.uint64)
        return mix((self.sums[k:] - self.sums[: n - k + 1]) * self.inverse[: n - k + 1])


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text or binary column and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32, count=len(column) + column.offset + 1)[column.offset :].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SEPARATOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in the bytes, and the first word of each row (one more than rows)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~separator[data]
    before, after = np.empty_like(word), np.empty_like(word)
    before[1:], after[:-1] = word[:-1], word[1:]
    full = offsets[1:] > offsets[:-1]
    before[offsets[:-1][full]] = False
    after[offsets[1:][full] - 1] = False
    starts = np.flatnonzero(word & ~before)
    ends = np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of range(s, s + n) over the pairs."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def runs(covered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true."""
    edge = np.diff(np.concatenate([[0], covered.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def spread(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n places some interval [s, s + width) covers."""
    delta = np.zeros(n + 1, dtype=np.int64)
    np.add.at(delta, starts, 1)
    np.add.at(delta, np.minimum(starts + width, n), -1)
    return np.cumsum(delta[:-1]) > 0


def trim() -> None:
    """Give freed memory back to the system: a worker lives on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def gathered(batches: Iterator[pa.RecordBatch], text: str, limit: int = FLUSH_BYTES) -> Iterator[pa.Table]:
    """Batches joined to tables of about `limit` bytes of text; a larger row comes alone."""
    held, size = [], 0
    for batch in batches:
        at = 0
        _, offsets = utf8(batch.column(batch.schema.get_field_index(text)))
        while at < batch.num_rows:
            # As many further rows as fit, one at least when nothing is held.
            stop = int(np.searchsorted(offsets, offsets[at] + limit - size, side="right")) - 1
            stop = min(max(stop, at + (not held)), batch.num_rows)
            if stop > at:
                held.append(batch.slice(at, stop - at))
                size += int(offsets[stop] - offsets[at])
                at = stop
            if at < batch.num_rows or size >= limit:
                yield pa.Table.from_batches(held)
                held, size = [], 0
                trim()
    if held:
        yield pa.Table.from_batches(held)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def arrow_limits(spark: SparkSession) -> None:
    """Keep Arrow batches small in bytes, whatever the length of the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def pack(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


def split_by(order_key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A stable order by key (0..n-1) and the bounds of each key in it."""
    small = order_key.astype(np.uint16) if n <= 65536 else order_key.astype(np.uint32)
    order = np.argsort(small, kind="stable")
    return order, np.searchsorted(small[order], np.arange(n + 1))


def binaries(columns: dict[str, list | np.ndarray], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def fresh(frame: DataFrame, name: str) -> str:
    """The name, with underscores after it as long as a column of the frame has it."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name
