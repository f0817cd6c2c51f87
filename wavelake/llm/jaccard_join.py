"""Exact Jaccard join of documents by their word n-grams, as a metric-space join.

First level. Documents that share nothing all lie at distance 1 from each
other, so with documents as pivots nearly all would be boundary documents of
every region. The first pivots are therefore shingles, as sets of one. A
document of n shingles may lack a = n - ceil(t n) of a linked partner's, so of
the a + 1 shingles that come first in one fixed order each of the two has one
that the other has among its own first ones. Every document is replicated to
the regions of those (its window). The order is by how often shingles occur,
rare ones first, as counted over all documents in a table of `BUCKETS` counts;
a common shingle is thus rarely a pivot, and any counts give a right result.

Signatures. In a region sets are first compared by their signatures, a bit for
each shingle at least, of which a shingle flips one. Signatures differ in no
more bits than sets in shingles, so pairs that differ in more bits than a link
allows are no links. What is left makes candidate clusters, each set being in
one; only their sets are read and compared.

Recursion. Clusters of up to `MOST` sets are joined in memory. In a larger one

1. pivot documents are drawn, and every member learns its distance to each of
   them; those within the threshold of a pivot link with it. What the pivots
   link makes classes, and members of the largest class need not search: a
   link between two of them joins nothing,
2. each member goes to the Voronoi cell of its nearest pivot. The others, who
   search, are replicated to every cell that may hold a partner: by the
   triangle inequality the distance to the cell's pivot is within the threshold
   of the distances that its members have, and at most two thresholds more than
   to the own pivot,
3. cells that are still too large, of members and searchers, are divided again
   by fresh pivots; the others are joined, the members in memory and searchers
   passing by one at a time. Below `LEVELS` divisions a cell is dealt to chunks
   by hash and its searchers meet every chunk, so the join ends and is exact
   for sets that no pivot tells apart too.

All links are found that join different components; of links inside a known
component not all are looked at, as the classes do not need them. Shingles are
64-bit hashes and sets are told apart by 128 bits; a link is judged on a pair's
own shingles, so a wrong one needs two of them to collide (about 10^-12 a pair).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavelake.llm.blocks import packed_ids, unpacked_ids
from wavelake.llm.components import components, united
from wavelake.llm.textkit import BYTE_A, LOWER, U64, Rolling, arrow_limits, discard, gathered, mix, partitions, ragged, stored, trim, utf8, words

#: Signatures of a region that one task compares, and shingles that they stand for.
SIGNED = 8192
SIGNED_SHINGLES = 200_000_000
#: Sets that are joined in one task's memory at once, and shingles that they may have together.
MOST = 1024
MOST_SHINGLES = 2_000_000
#: Pivots of a large group, and members of it that one task measures.
PIVOTS = 32
CHUNK = 2048
#: Divisions of a group by pivots; what is larger then is dealt to chunks by hash.
LEVELS = 4
#: Counts that order the shingles (1 MB), and slices that tasks send them in.
BUCKETS = 1 << 18
SLICES = 64
#: A shingle counted more often than this makes rows of its own, which Spark can split; others travel in packed blocks.
FREQUENT = 2_000
#: Packed entries that one task takes, about.
PART_ENTRIES = 1_000_000

FIRST = "doc_id bigint, n bigint, fp binary, sig binary, g bigint, x bigint, part int, keys binary, docs binary, sizes binary"
FIRST_ARROW = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("fp", pa.binary()), ("sig", pa.binary()), ("g", pa.int64()), ("x", pa.int64()), ("part", pa.int32()), ("keys", pa.binary()), ("docs", pa.binary()), ("sizes", pa.binary())])


def shingle_hashes(table: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct k-word shingle hashes of each row, sorted, joined; and where each row begins. Fewer words make one shingle."""
    data, offsets = utf8(table["text"])
    data = LOWER[data]
    starts, ends, first = words(data, offsets)
    hashes = Rolling(BYTE_A[data]).of(starts, ends)
    count = first[1:] - first[:-1]
    n = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
    at = ragged(first[:-1], n)
    all_ = Rolling(hashes, 1).of(at, at + np.repeat(np.minimum(count, k), n))
    bounds = np.concatenate([[0], np.cumsum(n)])
    sets = [np.unique(all_[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    return (np.concatenate(sets) if sets else all_), np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)


def missing(n: np.ndarray | int, share: tuple[int, int]) -> np.ndarray | int:
    """Shingles of n that a linked partner may lack."""
    return n + (-n * share[0] // share[1])


def print_of(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def signature(shingles: np.ndarray) -> bytes:
    """A power of two of bits, as many as shingles or more, flipped by each shingle at its own place."""
    bits = 1 << max(6, int(len(shingles) - 1).bit_length())
    return np.packbits(np.bincount((mix(shingles) & U64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).tobytes()


def size_code(n: np.ndarray) -> np.ndarray:
    """Sizes to an eighth of their natural logarithm, one byte."""
    return np.floor(np.log(np.maximum(n, 1)) * 8).astype(np.uint8)


def bucket(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> U64(64 - 18)).astype(np.int64)


def _counted(k: int):
    """How often shingles occur in what a task reads, by bucket, in slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for table in gathered(batches, "text"):
            total += np.bincount(bucket(shingle_hashes(table, k)[0]), minlength=BUCKETS)
        yield from _slices(total)

    return run


def _slices(total: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i, part in enumerate(total.reshape(SLICES, -1)):
        if part.any():
            kind = next(t for t in ("u1", "u2", "u4", "u8") if int(part.max()) < 1 << (8 * int(t[1])))
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([kind]), pa.array([part.astype(kind).tobytes()], pa.binary())], names=["slice", "kind", "counts"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((SLICES, BUCKETS // SLICES), dtype=np.int64)
    for batch in batches:
        for i, kind, counts in zip(*(batch[c].to_pylist() for c in ("slice", "kind", "counts")), strict=True):
            total[i] += np.frombuffer(counts, dtype=kind)
    yield from _slices(total.ravel())


def shingle_counts(docs: DataFrame, k: int) -> np.ndarray:
    """Counts of shingles over all docs, by bucket: BUCKETS numbers, whatever the input."""
    schema = "slice int, kind string, counts binary"
    sums = docs.select("text").mapInArrow(_counted(k), schema).repartition(SLICES, "slice").mapInArrow(_added, schema).toArrow().to_pylist()
    out = np.zeros((SLICES, BUCKETS // SLICES), dtype=np.int64)
    for r in sums:
        out[r["slice"]] += np.frombuffer(r["counts"], dtype=r["kind"]).astype(np.int64)
    return out.ravel()


def blocks(n_parts: int, keys: np.ndarray, part: np.ndarray, nodes: np.ndarray, sizes: np.ndarray) -> list[list]:
    """Columns part, keys, docs, sizes of packed blocks, by part."""
    order = np.lexsort((nodes, part))
    keys, part, nodes, sizes = keys[order], part[order], nodes[order], sizes[order]
    bounds = np.searchsorted(part, np.arange(n_parts + 1))
    out: list[list] = [[], [], [], []]
    for p in np.flatnonzero(np.diff(bounds)).tolist():
        a, b = bounds[p], bounds[p + 1]
        out[0].append(p)
        out[1].append(keys[a:b].astype(np.uint32).tobytes())
        out[2].append(packed_ids(nodes[a:b]))
        out[3].append(sizes[a:b].tobytes())
    return out


def _first(n_parts: int, k: int, share: tuple[int, int], counts: np.ndarray):
    """A row for each document; the windows of the sets that a task has read, each set once; rows of their own for frequent shingles."""
    places = np.minimum(counts, (1 << 24) - 1).astype(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches, "text"):
            shingles, bounds = shingle_hashes(table, k)
            m, size = table.num_rows, np.diff(bounds)
            ids = table["doc_id"].to_pylist()
            prints = [print_of(shingles[a:b]) if a < b else None for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            nodes = [int.from_bytes(f[:8], "little", signed=True) if f is not None else None for f in prints]
            none = pa.nulls
            at = list({f: i for i, f in enumerate(prints) if f is not None and ids[i] is not None}.values())
            signed: list[bytes | None] = [None] * m
            for i in at:
                signed[i] = signature(shingles[bounds[i] : bounds[i + 1]])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(size), pa.array(prints, pa.binary()), pa.array(signed, pa.binary()), none(m, pa.int64()), pa.array(nodes, pa.int64()), *(none(m, f.type) for f in list(FIRST_ARROW)[6:])], schema=FIRST_ARROW)
            if not at:
                continue
            chosen = np.zeros(m, dtype=bool)
            chosen[at] = True
            row = np.repeat(np.arange(m), size)
            mine = chosen[row]
            s, row = shingles[mine], row[mine]
            common = places[bucket(s)]
            # Rows stay together; within a row rare shingles come first, ties by hash.
            order = np.lexsort((s, common, row))
            s, row, common = s[order], row[order], common[order]
            begin = np.searchsorted(row, np.arange(m))
            window = np.arange(len(s)) - begin[row] <= missing(size, share)[row]
            s, row, common = s[window], row[window], common[window]
            node = np.array([x or 0 for x in nodes], dtype=np.int64)[row]
            # The top bits name the bucket; spread the others.
            s = s * U64(0x9E3779B97F4A7C15)
            s = s ^ (s >> U64(29))
            often = common > FREQUENT
            if often.any():
                g, x = s[often].view(np.int64), node[often]
                yield pa.RecordBatch.from_arrays([*(none(len(g), f.type) for f in list(FIRST_ARROW)[:4]), pa.array(g), pa.array(x), *(none(len(g), f.type) for f in list(FIRST_ARROW)[6:])], schema=FIRST_ARROW)
            if not often.all():
                s, x, n = s[~often], node[~often], size[row[~often]]
                packed = blocks(n_parts, s & U64(0xFFFFFFFF), ((s >> U64(32)) % U64(n_parts)).astype(np.int64), x, size_code(n))
                m = len(packed[0])
                yield pa.RecordBatch.from_arrays([*(none(m, f.type) for f in list(FIRST_ARROW)[:6]), *(pa.array(c, f.type) for c, f in zip(packed, list(FIRST_ARROW)[6:], strict=True))], schema=FIRST_ARROW)

    return run


MEMBER_ARROW = pa.schema([("g", pa.int64()), ("x", pa.int64())])


def _regions(share: tuple[int, int]):
    """Members of the regions that hold more than one set, where their sizes allow a link to another; named by the least member."""

    # Codes of linked sizes differ by no more.
    apart = int(8 * np.log(share[1] / share[0]) + 1)

    def joined(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        keys, nodes, sizes = (np.concatenate(x) for x in zip(*held, strict=True))
        # Only keys that occur twice need more work.
        order = np.argsort(keys, kind="stable")
        keys, nodes, sizes = keys[order], nodes[order], sizes[order].astype(np.int64)
        same = keys[1:] == keys[:-1]
        twice = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        if not twice.any():
            return
        keys, nodes, sizes = keys[twice], nodes[twice], sizes[twice]
        order = np.lexsort((nodes, sizes, keys))
        keys, nodes, sizes = keys[order], nodes[order], sizes[order]
        new = np.ones(len(keys), dtype=bool)
        new[1:] = (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])
        keys, nodes, sizes = keys[new], nodes[new], sizes[new]
        # In order of size a partner is next to a member, if there is one at all.
        near = (keys[1:] == keys[:-1]) & (sizes[1:] - sizes[:-1] <= apart)
        linked = np.concatenate([near, [False]]) | np.concatenate([[False], near])
        # A gap in size parts a region into two.
        start = np.concatenate([[True], ~near])[: len(keys)]
        keys, nodes, start = keys[linked], nodes[linked], np.cumsum(start)[linked]
        if not len(keys):
            return
        at = np.flatnonzero(np.concatenate([[True], start[1:] != start[:-1]]))
        g = np.repeat(np.minimum.reduceat(nodes, at), np.diff(np.append(at, len(nodes))))
        order = np.lexsort((nodes, g))
        g, nodes = g[order], nodes[order]
        new = np.concatenate([[True], (g[1:] != g[:-1]) | (nodes[1:] != nodes[:-1])])
        yield from pa.Table.from_arrays([pa.array(g[new]), pa.array(nodes[new])], schema=MEMBER_ARROW).to_batches(max_chunksize=5000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for part, k, d, s in zip(*(batch[c].to_pylist() for c in ("part", "keys", "docs", "sizes")), strict=True):
                held.setdefault(part, []).append((np.frombuffer(k, dtype=np.uint32), unpacked_ids(d), np.frombuffer(s, dtype=np.uint8)))
        for part in list(held):
            yield from joined(held.pop(part))
        trim()

    return run


def _near(share: tuple[int, int]):
    """Stars (u, v) of the sets of a region whose signatures allow links. Rows: g, x, n, sig, by g."""
    # A linked set is at most 1 / share times as large, and a signature twice as wide for each doubling begun.
    folds = max(1, (-(-share[1] // share[0]) - 1).bit_length())

    def stars(rows: list[dict]) -> Iterator[tuple[int, int]]:
        n = np.array([r["n"] for r in rows])
        width = np.array([len(r["sig"]) for r in rows])
        root = np.arange(len(rows))
        for w in np.unique(width).tolist():
            at = np.flatnonzero((width >= w) & (width <= w << folds))
            # Wider signatures are folded in two until they are as wide.
            sigs = np.zeros((len(at), w), dtype=np.uint8)
            for i, j in enumerate(at.tolist()):
                s = np.frombuffer(rows[j]["sig"], dtype=np.uint8)
                while len(s) > w:
                    s = s[: len(s) // 2] ^ s[len(s) // 2 :]
                sigs[i] = s
            sigs = sigs.view(np.uint64)
            own = np.flatnonzero(width[at] == w)
            for i in own.tolist():
                far = root[at] != root[at[i]]
                if not far.any():
                    continue
                other = np.flatnonzero(far)
                flips = np.bitwise_count(sigs[other] ^ sigs[i]).sum(axis=1, dtype=np.int64)
                both = n[at[other]] + n[at[i]]
                for j in at[other[flips * (share[0] + share[1]) <= both * (share[1] - share[0])]].tolist():
                    if root[j] != root[at[i]]:
                        root[root == root[j]] = root[at[i]]
        least: dict[int, int] = {}
        for r, c in zip(rows, root.tolist(), strict=True):
            least[c] = min(least.get(c, r["x"]), r["x"])
        return ((r["x"], least[c]) for r, c in zip(rows, root.tolist(), strict=True) if r["x"] != least[c])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import itertools

        found: list[tuple[int, int]] = []
        for _, rows in itertools.groupby(rows_of(batches), key=lambda r: r["g"]):
            found += stars(list(rows))
            if len(found) > 20_000:
                yield from flushed(found)
        yield from flushed(found)

    return run


SET_ARROW = pa.schema([("x", pa.int64()), ("rep", pa.int64()), ("n", pa.int64()), ("s", pa.binary())])


def _sets(k: int):
    """The sets of the documents whose text has the fingerprint asked for; a task gives each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for table in gathered(batches, "text"):
            shingles, bounds = shingle_hashes(table, k)
            out: list[list] = [[], [], [], []]
            for i, (x, rep, fp) in enumerate(zip(*(table[c].to_pylist() for c in ("x", "rep", "fp")), strict=True)):
                s = shingles[bounds[i] : bounds[i + 1]]
                if fp not in seen and print_of(s) == fp:
                    seen.add(fp)
                    for c, v in zip(out, (x, rep, len(s), s.tobytes()), strict=True):
                        c.append(v)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, SET_ARROW, strict=True)], schema=SET_ARROW)

    return run


class Coded:
    """Some sets over one alphabet: how much of each another set has, in one pass."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets], dtype=np.int64)
        self.alphabet, code = np.unique(np.concatenate(sets), return_inverse=True)
        who = np.repeat(np.arange(len(sets)), self.size)
        order = np.argsort(code, kind="stable")
        # The sets that have a shingle lie together.
        self.who, self.starts = who[order], np.searchsorted(code[order], np.arange(len(self.alphabet) + 1))

    def shared(self, s: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.alphabet, s)
        at[at == len(self.alphabet)] = 0
        at = at[self.alphabet[at] == s]
        return np.bincount(self.who[ragged(self.starts[at], self.starts[at + 1] - self.starts[at])], minlength=len(self.size))


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()
        trim()


def groups_of(batches: Iterator[pa.RecordBatch]) -> Iterator[Iterator[dict]]:
    """Rows of equal (g, chunk), one group after the other, each to be read to its end before the next."""
    import itertools

    for _, rows in itertools.groupby(rows_of(batches), key=lambda r: (r["g"], r["chunk"])):
        yield rows


LINK_ARROW = pa.schema([("u", pa.int64()), ("v", pa.int64())])
MEMBER, BOTH, SEARCHER = 1, 2, 3


def flushed(found: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    """Links as stars around least nodes; the list is empty afterwards."""
    some = [(x, c) for x, c in united(iter(found)).items() if x != c]
    found.clear()
    if some:
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in some], pa.int64()), pa.array([c for _, c in some], pa.int64())], schema=LINK_ARROW)


def _compared(share: tuple[int, int]):
    """Links between the members of a chunk, held in memory, and those who search, one at a time. Rows: g, chunk, role, rep, s, by role."""

    class Chunk:
        def __init__(self):
            self.sets: list[np.ndarray] = []
            self.reps: list[int] = []
            self.roles: list[int] = []
            self.known: set[tuple[int, int]] = set()

        def add(self, r: dict) -> None:
            # A set that was sent twice is one member.
            if (r["x"], r["rep"]) not in self.known:
                self.known.add((r["x"], r["rep"]))
                self.sets.append(np.frombuffer(r["s"], dtype=np.uint64))
                self.reps.append(r["rep"])
                self.roles.append(r["role"])

        def near(self, s: np.ndarray) -> np.ndarray:
            both = self.coded.shared(s)
            return share[1] * both >= share[0] * (self.coded.size + len(s) - both)

        def among(self, found: list) -> None:
            """Links of the members that search to the others; those of one component need no more."""
            self.coded, self.root = Coded(self.sets), np.arange(len(self.sets))
            for i, s in enumerate(self.sets):
                if self.roles[i] == BOTH and (self.root != self.root[i]).any():
                    for j in np.flatnonzero(self.near(s) & (self.root != self.root[i])).tolist():
                        if self.root[j] != self.root[i]:
                            found.append((self.reps[i], self.reps[j]))
                            self.root[self.root == self.root[j]] = self.root[i]

        def search(self, r: dict, found: list) -> None:
            at = np.flatnonzero(self.near(np.frombuffer(r["s"], dtype=np.uint64)))
            for j in at[np.unique(self.root[at], return_index=True)[1]].tolist():
                found.append((r["rep"], self.reps[j]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int]] = []
        for rows in groups_of(batches):
            chunk, ready = Chunk(), False
            for r in rows:
                if r["role"] != SEARCHER:
                    chunk.add(r)
                    continue
                if not chunk.sets:
                    break
                if not ready:
                    chunk.among(found)
                    ready = True
                chunk.search(r, found)
                if len(found) > 20_000:
                    yield from flushed(found)
            if chunk.sets and not ready:
                chunk.among(found)
            if len(found) > 20_000:
                yield from flushed(found)
        yield from flushed(found)

    return run


MEASURE = "kind int, g bigint, x bigint, n bigint, role int, p int, d float, far array<float>, u bigint, v bigint, c int"
MEASURE_ARROW = pa.schema([("kind", pa.int32()), ("g", pa.int64()), ("x", pa.int64()), ("n", pa.int64()), ("role", pa.int32()), ("p", pa.int32()), ("d", pa.float32()), ("far", pa.list_(pa.float32())), ("u", pa.int64()), ("v", pa.int64()), ("c", pa.int32())])
HOME, LINK, TIE = 0, 1, 2


def _measured(share: tuple[int, int]):
    """Distances of the members of a chunk, and of those who search there, to the group's pivots, which come first.

    Gives for each row its nearest pivot `p` (ties by hash), all distances and
    a pivot `c` that it links with (-1: none); links; and which pivots a member
    ties together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for rows in groups_of(batches):
            pivots: list[dict] = []
            coded, ties = None, {}
            for r in rows:
                if r["role"] == 0:
                    pivots.append(r)
                    continue
                if coded is None:
                    pivots.sort(key=lambda r: (r["x"], r["rep"]))
                    coded = Coded([np.frombuffer(p["s"], dtype=np.uint64) for p in pivots])
                s = np.frombuffer(r["s"], dtype=np.uint64)
                both = coded.shared(s)
                union = coded.size + len(s) - both
                near = np.flatnonzero(share[1] * both >= share[0] * union)
                d = (1 - both / union).astype(np.float32)
                ties_at = np.flatnonzero(d == d.min())
                p = int(ties_at[r["x"] % len(ties_at)])
                c = int(near[0]) if len(near) else -1
                out.append((HOME, r["g"], r["x"], len(s), r["role"], p, float(d[p]), d.tolist(), None, None, c))
                for j in near.tolist():
                    if pivots[j]["rep"] != r["rep"] and (j == c or (c, j) not in ties):
                        out.append((LINK, None, None, None, None, None, None, None, r["rep"], pivots[j]["rep"], None))
                    ties[c, j] = ties.get((c, j), 0) + 1
                if len(out) > 4000:
                    yield measures(out)
            out += [(TIE, rows_g, None, n, None, j, None, None, None, None, c) for rows_g in ([pivots[0]["g"]] if pivots else []) for (c, j), n in ties.items()]
        if out:
            yield measures(out)

    def measures(out: list[tuple]) -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), MEASURE_ARROW, strict=True)], schema=MEASURE_ARROW)
        out.clear()
        return batch

    return run


def _main_class(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pivots of each group's largest class, from rows (g, c, p, n): n members tie c and p. Sorted by g."""
    import itertools

    gs, mains = [], []
    for g, each in itertools.groupby(rows_of(rows), key=lambda r: r["g"]):
        each = list(each)
        of = united((r["c"], r["p"]) for r in each)
        weight: dict[int, int] = {}
        for r in each:
            if r["c"] == r["p"]:
                weight[of[r["c"]]] = weight.get(of[r["c"]], 0) + r["n"]
        best = max(weight, key=lambda c: (weight[c], -c))
        gs.append(g)
        mains.append([p for p, c in of.items() if c == best])
    if gs:
        yield pa.RecordBatch.from_arrays([pa.array(gs, pa.int64()), pa.array(mains, pa.list_(pa.int32()))], names=["g", "main"])


def divided(groups: DataFrame, share: tuple[int, int], pivots: int, n: int, with_sets, first: bool) -> tuple[DataFrame, DataFrame]:
    """One division of groups (g, x, role, m, sn): links (u, v), and rows (g, x, role, n) of the cells."""
    tau = 1 - share[0] / share[1]
    # No more pivots than fit a task's memory.
    room = F.greatest(F.lit(2), F.least(F.lit(pivots), F.floor(F.lit(2 * MOST_SHINGLES) * F.col("m") / F.greatest(F.col("sn"), F.lit(1)))))
    slot = F.pmod(F.xxhash64("x", "g"), room).alias("slot")
    drawn = groups.filter(F.col("role") != SEARCHER).groupBy("g", slot).agg(F.min_by("x", F.xxhash64("g", "x")).alias("x"), F.max("all").alias("all"))
    chunks = F.ceil(F.col("all") / CHUNK).cast("int")
    drawn = stored(drawn.select("g", "x", chunks.alias("chunks")), "jaccard-pivots")
    heads = drawn.select("g", "x", F.lit(0).alias("role"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    rest = groups.select("g", "x", "role", F.pmod(F.xxhash64("x"), chunks).cast("int").alias("chunk"))
    rows = with_sets(heads.unionByName(rest)).repartition(n, "g", "chunk").sortWithinPartitions("g", "chunk", "role")
    got = stored(rows.mapInArrow(_measured(share), MEASURE), "jaccard-distances")
    links = got.filter(F.col("kind") == LINK).select("u", "v")
    homes = got.filter(F.col("kind") == HOME).select("g", "x", "n", "role", "p", "d", "far", "c")
    if first:
        # Members of the largest class need not search any more.
        ties = got.filter(F.col("kind") == TIE).groupBy("g", "c", "p").agg(F.sum("n").alias("n"))
        main = stored(ties.repartition(n, "g").sortWithinPartitions("g").mapInArrow(_main_class, "g bigint, main array<int>"), "jaccard-main")
        homes = homes.join(main, "g", "left").withColumn("role", F.when(F.array_contains("main", F.col("c")), F.lit(MEMBER)).otherwise(F.lit(BOTH))).drop("main")
    homes = stored(homes, "jaccard-homes")
    own = homes.filter(F.col("role") != SEARCHER)
    cells = own.groupBy("g", "p").agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    cells = stored(cells.groupBy("g").agg(F.collect_list(F.struct("p", "lo", "hi")).alias("cells")), "jaccard-cells")
    slack = F.lit(tau + 1e-5)
    away = F.get("far", F.col("cell.p"))
    searching = homes.filter(F.col("role") != MEMBER).join(cells, "g").select("g", "x", "n", "role", "p", "far", F.explode("cells").alias("cell"))
    # A member that searches lies in its own cell already.
    searching = searching.filter(~((F.col("role") == BOTH) & (F.col("cell.p") == F.col("p"))))
    # No member of the cell is nearer to its pivot than lo or further than hi, and none is nearer to the searcher's nearest pivot than to its own.
    searching = searching.filter((away <= F.col("cell.hi") + slack) & (away >= F.col("cell.lo") - slack) & (away <= F.array_min("far") + 2 * slack))
    cell = lambda p: F.xxhash64("g", p).alias("g")
    moved = searching.select(cell(F.col("cell.p").cast("int")), "x", F.lit(SEARCHER).alias("role"), "n")
    rows = stored(own.select(cell(F.col("p")), "x", "role", "n").unionByName(moved), "jaccard-cells-rows")
    return links, rows


def jaccard_classes(docs: DataFrame, k: int = 5, share: tuple[int, int] = (4, 5), most: int = MOST, pivots: int = PIVOTS, signed: int = SIGNED) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs (doc_id, text).

    Two documents link when share[1] * intersection >= share[0] * union of
    their sets of k-word shingles (A-Z in lower case; words are
    `[^\\x20\\x09-\\x0D]+`; fewer than k words make one shingle). Null and empty
    texts have no shingle and link with nothing; texts of any length are read
    to their end. component_id is the least doc_id that links reach. Rows that
    repeat a doc_id are one document that has the links of each of its texts.
    Rows without a doc_id have their own n_shingles, link with nothing and have
    no component. doc_id must be a bigint or castable to it. Other columns of
    docs, whatever their names, are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    arrow_limits(spark)
    n = partitions(spark)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = shingle_counts(docs, k)
    window = 1 - share[0] / share[1]
    n_parts = max(n, int(counts.sum() * window / PART_ENTRIES) + 1)
    first = stored(docs.mapInArrow(_first(n_parts, k, share, counts), FIRST), "jaccard-sets")
    each = stored(first.filter("part is null and g is null").select("doc_id", "n", "fp", "sig", "x"), "jaccard-documents")
    # Equal sets are one from here on.
    reps = stored(each.filter("fp is not null and doc_id is not null").groupBy("fp", "x").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.max("sig").alias("sig")), "jaccard-reps")

    packed = first.filter("part is not null").select("part", "keys", "docs", "sizes").repartitionById(n_parts, F.col("part"))
    members = packed.mapInArrow(_regions(share), "g bigint, x bigint").unionByName(first.filter("g is not null").select("g", "x"))
    members = stored(members.distinct(), "jaccard-members")
    discard(first)
    several = stored(members.groupBy("g").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").drop("m"), "jaccard-groups")
    grouped = stored(members.join(several, "g").join(reps.select("x", "n", "sig").hint("merge"), "x"), "jaccard-signed")
    sizes = grouped.groupBy("g").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("sn"), F.min("x").alias("least"))
    huge = stored(sizes.filter((F.col("m") > signed) | (F.col("sn") > SIGNED_SHINGLES)).select("g", "least"), "jaccard-huge")
    stars, rest = None, grouped
    if not huge.isEmpty():
        # Too large for one task: a candidate cluster as it is.
        stars = grouped.join(huge, "g").select(F.col("x").alias("u"), F.col("least").alias("v"))
        rest = grouped.join(huge, "g", "left_anti")
    near = rest.select("g", "x", "n", "sig").repartition(n, "g").sortWithinPartitions("g").mapInArrow(_near(share), "u bigint, v bigint")
    clusters = stored(components(near if stars is None else near.unionByName(stars)), "jaccard-clusters")
    discard(members, grouped)
    wanted = reps.select("x", "fp", "rep").join(clusters.select(F.col("v").alias("x")), "x", "left_semi")
    sets = docs.join(wanted.hint("merge"), docs["doc_id"] == wanted["rep"]).select("x", "rep", "fp", "text").mapInArrow(_sets(k), "x bigint, rep bigint, n bigint, s binary")
    sets = stored(sets, "jaccard-active")
    grouped = clusters.select(F.col("c").alias("g"), F.col("v").alias("x")).join(sets.select("x", "n"), "x")

    def with_sets(rows: DataFrame) -> DataFrame:
        return rows.join(sets.hint("merge"), "x").select("g", "chunk", "role", "x", "rep", "s")

    def compared(rows: DataFrame) -> DataFrame:
        rows = with_sets(rows).repartition(n, "g", "chunk").sortWithinPartitions("g", "chunk", "role")
        return stored(rows.mapInArrow(_compared(share), "u bigint, v bigint"), "jaccard-links")

    def measure(rows: DataFrame) -> DataFrame:
        """Rows with the members and shingles of their group."""
        own = F.col("role") != SEARCHER
        sizes = rows.groupBy("g").agg(F.count_if(own).alias("m"), F.sum(F.when(own, F.col("n"))).alias("sn"), F.count(F.lit(1)).alias("all"), F.count_if(F.col("role") != MEMBER).alias("searchers"))
        sizes = stored(sizes.filter("m > 0 and searchers > 0"), "jaccard-sizes")
        return stored(rows.join(sizes, "g"), "jaccard-sized")

    def leaves(rows: DataFrame) -> DataFrame:
        """Cells dealt to chunks that fit a task, each of which all their searchers meet."""
        chunks = F.greatest(F.ceil(F.col("m") / most), F.ceil(F.col("sn") / MOST_SHINGLES)).cast("int")
        rows = rows.withColumn("chunks", chunks).withColumn("own", F.pmod(F.xxhash64("x"), F.col("chunks")).cast("int"))
        home = rows.filter(F.col("role") != SEARCHER).select("g", "x", "role", F.col("own").alias("chunk"))
        away = rows.filter(F.col("role") != MEMBER).select("g", "x", "role", "own", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
        away = away.filter((F.col("role") == SEARCHER) | (F.col("chunk") != F.col("own"))).select("g", "x", F.lit(SEARCHER).alias("role"), "chunk")
        return home.unionByName(away)

    fits = (F.col("m") <= most) & (F.col("sn") <= MOST_SHINGLES)
    rows = measure(grouped.select("g", "x", F.lit(BOTH).alias("role"), "n"))
    links = [compared(leaves(rows.filter(fits)))]
    level = 0
    while not (large := rows.filter(~fits)).isEmpty():
        if level == LEVELS:
            links.append(compared(leaves(large)))
            break
        tied, cells = divided(large, share, pivots, n, with_sets, level == 0)
        rows = measure(cells)
        links += [tied, compared(leaves(rows.filter(fits)))]
        level += 1
    edges = links[0]
    for x in links[1:]:
        edges = edges.unionByName(x)

    repeated = each.filter("doc_id is not null and fp is not null").groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).filter("a <> b").select("doc_id")
    repeated = stored(repeated, "jaccard-repeated")
    own = None
    if not repeated.isEmpty():
        # Ids that several texts have join the classes of their texts.
        named = each.join(repeated, "doc_id", "left_semi").join(reps, "fp").select("doc_id", "rep")
        edges = edges.unionByName(named.select(F.col("doc_id").alias("u"), F.col("rep").alias("v")))
    classes = stored(components(edges), "jaccard-classes")
    named = stored(reps.join(classes.withColumnRenamed("v", "rep"), "rep", "left").select("fp", F.coalesce("c", "rep").alias("c")), "jaccard-named")
    out = each.join(named, "fp", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id")).alias("component_id"))
    return out
