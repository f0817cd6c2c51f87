"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A document's features are the distinct character n-grams of its words (4 and 5
characters, blanks at the ends included), hashed to `SPACE` places. From a
bounded sample of labelled rows each feature gets r = log of its smoothed share
in toxic documents over that in the others, and a logistic regression with L2
penalty is fitted on presence times r, for all features that the sample holds.
The fit's products run in tasks over the sample's n-grams, stored by feature.
Scoring is one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavelake.llm.language_id import letter_table
from wavelake.llm.textkit import U64, arrow_limits, discard, gathered, mix, stored, trim

#: Labelled rows that the model is fitted on, at most, and the characters of their texts.
SAMPLE = 16_000
SAMPLE_CHARS = 64_000_000
SPACE = 1 << 20
SIZES = (4, 5)
SMOOTH = 1.0
PENALTY = 1.0
#: Tasks that count features of the sample and add up over them; each sends the driver 12 bytes a feature at most.
TASKS = 8

OUT_ARROW = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64())])
OUT = "doc_id bigint, held_out boolean, score double"


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Row and feature of each distinct n-gram of each text."""
    letters = letter_table()
    joined = "\x00".join((t or "").replace("\x00", " ") for t in texts).lower()
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ends = codes == 0
    c = np.where(letters[codes], codes, 1).astype(np.uint64)
    row = np.cumsum(ends)
    keep = np.ones(len(c), dtype=bool)
    if len(c):
        keep[1:] = (c[1:] != 1) | (c[:-1] != 1) | ends[1:]
    c, row = c[keep], row[keep]
    # A blank before and after all of it; texts are told apart by their rows.
    c = np.concatenate([[U64(1)], c, [U64(1)]]).astype(np.uint64)
    row = np.concatenate([[0], row, [row[-1] if len(row) else 0]])
    out_row, out_feature = [], []
    code = c
    for n in range(2, max(SIZES) + 1):
        if len(code) < 2:
            break
        code = code[:-1] * U64(0x9E3779B97F4A7C15) + c[n - 1 :]
        if n in SIZES:
            inner = np.zeros(len(code), dtype=bool)
            for j in range(1, n - 1):
                inner |= c[j : j + len(code)] == 1
            f = (mix(code) >> U64(44)).astype(np.int64)
            ok = np.flatnonzero(~inner)
            # An n-gram belongs to the text of its second character: the first may be the blank before it.
            out_row.append(row[ok + 1])
            out_feature.append(f[ok])
    if not out_row:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    both = np.unique(np.concatenate(out_row) * SPACE + np.concatenate(out_feature))
    return both // SPACE, both % SPACE


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = np.zeros((2, SPACE), dtype=np.int64)
    for table in gathered(batches, "text", 2 << 20):
        label = table["toxic"].to_numpy()
        row, feature = features(table["text"].to_pylist())
        for y in (0, 1):
            n[y] += np.bincount(feature[label[row] == y], minlength=SPACE)
    some = np.flatnonzero(n.sum(axis=0)).astype(np.uint32)
    yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (some, n[0, some].astype(np.uint32), n[1, some].astype(np.uint32))], names=["f", "n0", "n1"])


def _grouped(seen: np.ndarray):
    """Groups of rows by feature: places among the seen features, where each begins in the rows that have it, and these rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for k, table in enumerate(gathered(batches, "text", 1 << 20)):
            row, feature = features(table["text"].to_pylist())
            many = np.bincount(row, minlength=table.num_rows).astype(np.uint32)
            group = _by_feature(np.searchsorted(seen, feature).astype(np.uint32), many)
            label = table["toxic"].to_numpy().astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([task << 32 | k]), *(pa.array([x.tobytes()], pa.binary()) for x in (label, *group))], names=["id", "toxic", "f", "first", "row"])

    return run


def _by_feature(at: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of a group of rows, where each begins in the rows that have it, and these rows, at two bytes each where there are no more."""
    key = at.astype(np.uint64) << U64(32) | np.repeat(np.arange(len(many), dtype=np.uint64), many)
    key.sort()
    f = (key >> U64(32)).astype(np.uint32)
    first = np.flatnonzero(np.diff(f, prepend=f[0] + 1)) if len(f) else np.zeros(0, dtype=np.int64)
    return f[first], first.astype(np.uint32), key.astype(np.uint32).astype(np.min_scalar_type(len(many)))


def _margins(m: int, group: tuple, v: np.ndarray) -> np.ndarray:
    """Sums of v over the features of each of m rows."""
    f, first, row = group
    return np.bincount(row, np.repeat(v.take(f), np.diff(first, append=np.uint32(len(row)))), m)


def _add_columns(total: np.ndarray, group: tuple, u: np.ndarray) -> None:
    """Add to each feature the sum of u over the rows that have it."""
    f, first, row = group
    if len(f):
        total[f] += np.add.reduceat(u.take(row), first)


def newton(sweep: Callable, d: int, y: np.ndarray, penalty: float = PENALTY, steps: int = 30) -> tuple[np.ndarray, float]:
    """L2 logistic regression by Newton steps, each solved by conjugate gradients as far as it pays.

    sweep(v, u): with X the rows of d features and a one, X'(u * Xv) and Xv; without v, X'u and nothing.
    """
    n = len(y)
    ridge = np.append(np.full(d, penalty), 1e-6)

    # Sums in place of `@`, whose threads would wait busily between short products.
    def dot(a: np.ndarray, b: np.ndarray) -> float:
        return float((a * b).sum())

    def loss(v: np.ndarray, z: np.ndarray) -> float:
        return float(np.logaddexp(0, z).sum() - (y * z).sum() + 0.5 * (ridge * v * v).sum())

    w = np.zeros(d + 1)
    w[d] = np.log(y.sum() / (n - y.sum()))
    z = np.full(n, w[d])
    now = loss(w, z)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        g = sweep(None, p - y)[0] + ridge * w
        curve = p * (1 - p)
        x, r, step = np.zeros(d + 1), -g, np.zeros(n)
        q, rr = r.copy(), dot(r, r)
        enough = 0.1 * rr
        for _ in range(60):
            if rr <= enough:
                break
            hq, xq = sweep(q, curve)
            hq += ridge * q
            a = rr / dot(q, hq)
            x += a * q
            step += a * xq
            r -= a * hq
            new = dot(r, r)
            q, rr = r + (new / rr) * q, new
        t = 1.0
        while t > 1e-4 and (trial := loss(w + t * x, z + t * step)) > now:
            t /= 2
        if t <= 1e-4 or now - trial < 1e-6 * abs(now):
            break
        w, z, now = w + t * x, z + t * step, trial
    return w[:d], float(w[d])


def fit_logistic(parts: list[tuple[np.ndarray, np.ndarray]], ratio: np.ndarray, y: np.ndarray, penalty: float = PENALTY, steps: int = 30) -> tuple[np.ndarray, float]:
    """The fit of rows at hand, presence times ratio being the features' values.

    parts: the places of the present features and how many of them each row has, a group of rows each.
    """
    d = len(ratio)
    groups = [(len(many), _by_feature(at, many)) for at, many in parts]
    bounds = np.cumsum([m for m, _ in groups])[:-1]

    def sweep(v: np.ndarray | None, u: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        z = None
        if v is not None:
            z = np.concatenate([_margins(m, group, ratio * v[:d]) for m, group in groups]) + v[d]
            u = u * z
        total = np.zeros(d)
        for (_, group), part in zip(groups, np.split(u, bounds), strict=True):
            _add_columns(total, group, part)
        return np.append(ratio * total, u.sum()), z

    return newton(sweep, d, y, penalty, steps)


def _swept(shared, d: int):
    """A task's share of a sweep: Xv of each of its groups, and without an id the sum over the rows of its groups for each feature."""

    def run(groups: Iterator[tuple]) -> Iterator[tuple[int | None, bytes]]:
        scaled, bias, by_id = shared.value
        total = None
        for at, *parts in groups:
            u = by_id[at]
            kinds = (np.uint32, np.uint32, np.min_scalar_type(len(u)))
            group = tuple(np.frombuffer(x, kind) for x, kind in zip(parts, kinds, strict=True))
            if scaled is not None:
                z = _margins(len(u), group, scaled) + bias
                u = u * z
                yield at, z.tobytes()
            total = np.zeros(d) if total is None else total
            _add_columns(total, group, u)
        if total is not None:
            yield None, total.tobytes()
            trim()

    return run


def fit_stored(groups: DataFrame, ratio: np.ndarray, penalty: float = PENALTY, steps: int = 30) -> tuple[np.ndarray, float]:
    """The fit of a stored table of groups (id, toxic, f, first, row): each sweep is a job over it.

    The driver holds a few numbers for each row and each feature, and TASKS of
    them for each feature as it adds up a sweep; n-grams of rows stay with the tasks.
    """
    d, sc = len(ratio), groups.sparkSession.sparkContext
    label = {r["id"]: np.frombuffer(r["toxic"], dtype=np.uint8) for r in groups.select("id", "toxic").collect()}
    order = sorted(label)
    bounds = np.cumsum([len(label[k]) for k in order])[:-1]
    # Files may be read in many splits, of which one a file has rows. Kept, as some eighty sweeps read them, on disk to spare the executors' heap.
    held = groups.select("id", "f", "first", "row").coalesce(TASKS).rdd.map(tuple).persist(StorageLevel.DISK_ONLY)

    def sweep(v: np.ndarray | None, u: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        by_id = dict(zip(order, np.split(u, bounds), strict=True))
        shared = sc.broadcast((None, 0.0, by_id) if v is None else (ratio * v[:d], v[d], by_id))
        total, z = np.zeros(d), {}
        for at, x in held.mapPartitions(_swept(shared, d)).collect():
            if at is None:
                total += np.frombuffer(x)
            else:
                z[at] = np.frombuffer(x)
        shared.destroy()
        z = None if v is None else np.concatenate([z[k] for k in order])
        return np.append(ratio * total, u.sum() if v is None else (u * z).sum()), z

    try:
        return newton(sweep, d, np.concatenate([label[k] for k in order]).astype(float), penalty, steps)
    finally:
        held.unpersist()


def sampled(docs: DataFrame, labels: DataFrame, sample: int, chars: int) -> DataFrame:
    """(text, toxic) of whole labelled texts: at most `sample` rows and `chars` characters, in the order of a hash.

    A text that no longer fits is passed over. Rows equal in id and text count once.
    """
    ids = labels.filter("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("bigint").alias("toxic"))
    ids = stored(ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample), "toxic-ids")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # At most `sample` ids: safe to broadcast.
    rows = docs.select("doc_id", text.alias("text")).join(F.broadcast(ids), "doc_id")
    key = [F.col("doc_id"), F.xxhash64("text").alias("th")]
    rows = stored(rows.select(*key, "text", "toxic").dropDuplicates(["doc_id", "th"]), "toxic-rows")
    order = rows.select("doc_id", "th", F.char_length("text").alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id", "th").limit(sample)
    taken, left = [], chars
    for r in order.collect():
        if r["n"] <= left:
            left -= r["n"]
            taken.append((r["doc_id"], r["th"]))
    chosen = docs.sparkSession.createDataFrame(taken, rows.select("doc_id", "th").schema)
    return rows.join(F.broadcast(chosen), ["doc_id", "th"], "left_semi").select("text", "toxic")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, chars: int = SAMPLE_CHARS) -> tuple[np.ndarray, np.ndarray, float]:
    """Features of the sample, their weights and the bias, from docs (doc_id, text) and labels (doc_id, toxic).

    Labels that are neither 0 nor 1 are ignored; an id with both labels is
    toxic. Without any label all scores are 0.5; with labels of one kind, or
    texts without features, all are the share of toxic rows, 0.001 to 0.999.
    """
    nothing = np.zeros(0, dtype=np.int64), np.zeros(0)
    texts = stored(sampled(docs, labels, sample, chars).repartition(TASKS), "toxic-sample")
    docs_by = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
    if not docs_by:
        return *nothing, 0.0
    total = np.array([docs_by.get(0, 0), docs_by.get(1, 0)], dtype=float)
    seen, a = _counted(texts)
    if not len(seen) or not total.all():
        share = min(max(total[1] / total.sum(), 1e-3), 1 - 1e-3)
        return *nothing, float(np.log(share / (1 - share)))
    ratio = np.log((a[1] + SMOOTH) / (total[1] + 2 * SMOOTH)) - np.log((a[0] + SMOOTH) / (total[0] + 2 * SMOOTH))
    groups = stored(texts.mapInArrow(_grouped(seen), "id bigint, toxic binary, f binary, first binary, row binary"), "toxic-groups")
    w, bias = fit_stored(groups, ratio)
    discard(groups)
    trim()
    return seen, w * ratio, bias


def _counted(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Features of the sample and in how many of its rows of label 0 and 1 each is."""
    n = np.zeros((2, SPACE), dtype=np.uint32)
    for p in texts.repartition(TASKS).mapInArrow(_counts, "f binary, n0 binary, n1 binary").collect():
        f, n0, n1 = (np.frombuffer(p[k], dtype=np.uint32) for k in ("f", "n0", "n1"))
        n[0, f] += n0
        n[1, f] += n1
    seen = np.flatnonzero(n.any(axis=0))
    return seen, n[:, seen].astype(float)


def _weigh(chosen: np.ndarray, weights: np.ndarray, bias: float):
    def run(texts: list[str | None]) -> np.ndarray:
        dense = np.zeros(SPACE)
        dense[chosen] = weights
        row, feature = features(texts)
        z = np.bincount(row, weights=dense[feature], minlength=len(texts)) + bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    return run


def _score(chosen: np.ndarray, weights: np.ndarray, bias: float):
    scorer = _weigh(chosen, weights, bias)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches, "text", 1 << 20):
            yield pa.RecordBatch.from_arrays([table["doc_id"].combine_chunks(), table["held_out"].combine_chunks(), pa.array(scorer(table["text"].to_pylist()))], schema=OUT_ARROW)

    return run


def _pass_through(chosen: np.ndarray, weights: np.ndarray, bias: float, text: str, out: str):
    scorer = _weigh(chosen, weights, bias)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches, text, 1 << 20):
            yield from table.append_column(out, pa.array(scorer(table[text].to_pylist()))).combine_chunks().to_batches()

    return run


def with_score(docs: DataFrame, labels: DataFrame, held_out: Column, sample: int = SAMPLE, out: str = "_toxicity") -> DataFrame:
    """All rows and columns of docs (doc_id, text, ...) and the score; no shuffle of the texts."""
    arrow_limits(docs.sparkSession)
    model = train(docs, labels.filter(~held_out), sample)
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())])
    return docs.mapInArrow(_pass_through(*model, "text", out), schema)


def score(docs: DataFrame, labels: DataFrame, held_out: Column, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs (doc_id, text).

    The model is trained on labels of rows that are not held out. Null and
    empty texts have no features and score the bias alone. Rows that repeat a
    text score alike. A null id has a null held_out where that is told from the
    id, and is not learned from; rows that repeat an id score each by its own text.
    Texts of any length are scored whole; other columns are not read; an empty
    table gives no rows.
    """
    arrow_limits(docs.sparkSession)
    model = train(docs, labels.filter(~held_out), sample)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out.alias("held_out"), F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(_score(*model), OUT)
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, F.lit(1)).otherwise(F.lit(0)))
