"""Signal functions over whole captures whose windows are rows: what a window needs of those before it is carried, samples are not shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavelake.operators.ordered import numbered, states
from wavelake.operators.spectral import deinterleave
from wavelake.shared import stored

DOUBLES = T.ArrayType(T.DoubleType())


def by_length(columns: list[pa.Array], null: float = np.nan) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Places of the rows of one shape, with each column's values stacked; a null is an empty array, a null value is `null`. No row is an object of its own."""
    filled = lambda v: pc.fill_null(v.cast(pa.float64(), safe=False), null) if v.null_count else v
    values = [filled(c.flatten()).to_numpy(zero_copy_only=False).astype(np.float64, copy=False) for c in columns]
    lengths = [pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns]
    starts = [np.cumsum(n) - n for n in lengths]
    shapes, of = np.unique(np.stack(lengths, axis=1), axis=0, return_inverse=True)
    for k, shape in enumerate(shapes.tolist()):
        at = np.flatnonzero(of.ravel() == k)
        yield at, [v[s[at][:, None] + np.arange(n)] for v, s, n in zip(values, starts, shape, strict=True)]


def put(n: int, parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> pa.Array:
    """Rows of stacked results at their places."""
    held, lengths = list(parts), np.zeros(n, dtype=np.int64)
    for at, rows in held:
        lengths[at] = rows.shape[1]
    ends = np.cumsum(lengths)
    out = np.empty(int(lengths.sum()))
    for at, rows in held:
        out[(ends - lengths)[at][:, None] + np.arange(rows.shape[1])] = rows
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(out))


def once(function):
    """A function of columns that Spark computes once for a row: else a filter on its result, as an explode implies one, computes it again, in a second Python worker of the task."""
    return function.asNondeterministic()


@once
@F.arrow_udf(DOUBLES)
def interleaved_running(iq: pa.Array, before: pa.Array) -> pa.Array:
    """Running sums of I and of Q along a row, from the sums before it on."""

    def run(x: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.empty_like(x)
        for k in (0, 1):
            out[:, k::2] = np.cumsum(x[:, k::2], axis=1) + b[:, k : k + 1]
        return out

    return put(len(iq), ((at, run(*v)) for at, v in by_length([iq, before], 0.0)))


def running_phase(windows: DataFrame, keys: list[str], order: list[str], iq: str, out: str) -> DataFrame:
    """windows with `out`: running sums of I and Q, interleaved, over all windows of a capture in order.

    One row of two sums goes from window to window, in two levels; the order
    must tell windows apart. A null or empty window adds nothing, nor does a null value.
    """
    total = lambda parts: F.coalesce(F.aggregate(parts, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0))), F.lit(0.0))
    summed = windows.withColumn("_sums", F.array(*map(total, deinterleave(F.col(iq)))))
    return states(summed, keys, order, "_sums", 2, "_sums_before").withColumn(out, interleaved_running(iq, "_sums_before")).drop("_sums", "_sums_before")


def through(x: np.ndarray, z: np.ndarray, sections: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows through a cascade of second-order sections (b0, b1, b2, 1, a1, a2), transposed form; output and states after it."""
    y, z = np.array(x, dtype=np.float64), np.array(z, dtype=np.float64)
    for t in range(y.shape[1]):
        for k, (b0, b1, b2, _, a1, a2) in enumerate(sections):
            s = y[:, t].copy()
            v = b0 * s + z[:, 2 * k]
            z[:, 2 * k] = b1 * s - a1 * v + z[:, 2 * k + 1]
            z[:, 2 * k + 1] = b2 * s - a2 * v
            y[:, t] = v
    return y, z


def recursive_filter(windows: DataFrame, keys: list[str], order: list[str], x: str, sections: list[list[float]], out: str) -> DataFrame:
    """windows with `out`: samples x through second-order sections, without a break between the windows of a capture.

    A section takes a state of two numbers; what a window does to the states of
    all sections is an affine map, and the maps are composed along the capture
    (see ordered.states). Windows are gone through twice: from zeros for the
    map, then from the state that arrives.
    """
    rows = np.asarray(sections, dtype=np.float64)
    size = 2 * len(rows)

    @F.arrow_udf(DOUBLES)
    def end(col: pa.Array) -> pa.Array:
        return put(len(col), ((at, through(v, np.zeros((len(v), size)), rows)[1]) for at, (v,) in by_length([col])))

    @F.arrow_udf(DOUBLES)
    def matrix(col: pa.Array) -> pa.Array:
        # The states that a silent window of a length makes of unit states.
        made = lambda v: through(np.zeros((size, v.shape[1])), np.eye(size), rows)[1].T.ravel()
        return put(len(col), ((at, np.tile(made(v), (len(at), 1))) for at, (v,) in by_length([col])))

    @once
    @F.arrow_udf(DOUBLES)
    def filtered(col: pa.Array, state: pa.Array) -> pa.Array:
        return put(len(col), ((at, through(*v, rows)[0]) for at, v in by_length([col, state])))

    mapped = windows.withColumns({"_end": end(x), "_matrix": matrix(x)})
    return states(mapped, keys, order, "_end", size, "_state_before", "_matrix").withColumn(out, filtered(x, "_state_before")).drop("_end", "_matrix", "_state_before")


def convolved(windows: DataFrame, keys: list[str], order: list[str], x: str, taps: list[float], out: str) -> DataFrame:
    """windows with `out`: samples x through an FIR filter as one stream for each capture (overlap-save).

    A window gets the last samples of the windows before it by an equi-join on
    its number, as many as the taps reach back, zeros before a capture's
    first; rows of one length go through one FFT.
    """
    h = np.asarray(taps, dtype=np.float64)
    reach = len(h) - 1

    @once
    @F.arrow_udf(DOUBLES)
    def filtered(col: pa.Array, tail: pa.Array) -> pa.Array:
        def run(v: np.ndarray, before: np.ndarray) -> np.ndarray:
            held = np.zeros((len(v), reach + v.shape[1]))
            held[:, reach - before.shape[1] : reach] = before
            held[:, reach:] = v
            n = 1 << max(0, held.shape[1] + reach - 1).bit_length()
            return np.fft.irfft(np.fft.rfft(held, n) * np.fft.rfft(h, n), n)[:, reach : reach + v.shape[1]]

        return put(len(col), ((at, run(*v)) for at, v in by_length([col, tail])))

    length = F.coalesce(F.size(x), F.lit(0))
    rows = stored(numbered(windows.withColumn("_length", F.when(F.col(x).isNull(), 0).otherwise(length)), keys, order, "_number"), "numbered")
    least = rows.filter("_length > 0").agg(F.min("_length")).first()[0]
    if not reach or not least:
        return rows.withColumn(out, filtered(x, F.array().cast("array<double>"))).select(*windows.columns, out)
    back = -(-reach // least)
    tail = F.when(F.col("_length") > 0, F.slice(x, F.greatest(F.lit(1), F.col("_length") - reach + 1), F.lit(reach))).otherwise(F.array().cast("array<double>"))
    # Empty windows let those before them pass no further than `back`; they are left out of the numbers.
    sent = rows.filter("_length > 0").select(*keys, tail.alias("_tail"), "_number", F.explode(F.sequence(F.lit(1), F.lit(back))).alias("_back")).withColumn("_number", F.col("_number") + F.col("_back"))
    got = sent.groupBy(*keys, "_number").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("_back", "_tail")), asc=False), lambda s: s["_tail"])).alias("_tails"))
    got = got.withColumn("_tails", F.slice("_tails", F.greatest(F.lit(1), F.size("_tails") - reach + 1), F.lit(reach))).withColumnsRenamed({k: f"_of_{k}" for k in [*keys, "_number"]})
    same = F.lit(True)
    for k in [*keys, "_number"]:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    joined = rows.join(got, same, "left").withColumn(out, filtered(x, F.coalesce("_tails", F.array().cast("array<double>"))))
    return joined.select(*windows.columns, out)


def envelope_peak(lo: int, hi: int):
    """A function of an array column: the lag from lo to hi at which its autocorrelation, freed of the mean and divided by that at lag 0, is greatest, and its value there; null for fewer than hi + 1 values."""

    @F.arrow_udf("lag int, peak double")
    def run(x: pa.Array) -> pa.Array:
        lag, peak, short = np.zeros(len(x), dtype=np.int32), np.full(len(x), np.nan), np.ones(len(x), dtype=bool)
        for at, (v,) in by_length([x]):
            n = v.shape[1]
            if n <= hi:
                continue
            v = v - v.mean(axis=1, keepdims=True)
            spectrum = np.fft.rfft(v, 1 << (2 * n - 1).bit_length())
            r = np.fft.irfft(np.abs(spectrum) ** 2)[:, :n]
            r = r / (r[:, :1] + 1e-12)
            best = lo + np.argmax(r[:, lo : hi + 1], axis=1)
            lag[at], peak[at], short[at] = best, r[np.arange(len(at)), best], False
        return pa.StructArray.from_arrays([pa.array(lag, mask=short), pa.array(peak, mask=short)], ["lag", "peak"])

    return run


def assigned(points: DataFrame, centres: DataFrame, keys: list[str]) -> DataFrame:
    """points (keys, re, im, ...) with `k`, their nearest centre; centres are (keys, k, re, im), a few of each key."""
    held = centres.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("k", "re", "im"))).alias("_centres"))
    square = lambda c: (F.col("re") - c["re"]) * (F.col("re") - c["re"]) + (F.col("im") - c["im"]) * (F.col("im") - c["im"])
    near = F.array_min(F.transform("_centres", lambda c: F.struct(square(c).alias("d"), c["k"].alias("k"))))
    return points.join(held, keys).withColumn("k", near["k"]).drop("_centres")


def lloyd(points: DataFrame, seeds: DataFrame, keys: list[str], steps: int) -> DataFrame:
    """Centres (keys, k, re, im) after a number of Lloyd steps for all keys at once; a centre that no point is nearest to stays.

    A step is a join with one row of centres for each key, and means that are
    combined where the points are; each step's centres are written.
    """
    now = stored(seeds.select(*keys, "k", "re", "im"), "centres")
    for _ in range(steps):
        means = assigned(points, now, keys).groupBy(*keys, "k").agg(F.avg("re").alias("_re"), F.avg("im").alias("_im"))
        now = stored(now.join(means, [*keys, "k"], "left").select(*keys, "k", F.coalesce("_re", "re").alias("re"), F.coalesce("_im", "im").alias("im")), "centres")
    return now


def separation(centres: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, separation): the least distance between two centres of a key."""
    other = centres.select(*keys, F.col("k").alias("_k"), F.col("re").alias("_re"), F.col("im").alias("_im"))
    pairs = centres.join(other, keys).filter("k < _k")
    return pairs.groupBy(*keys).agg(F.min(F.sqrt(F.pow(F.col("re") - F.col("_re"), F.lit(2)) + F.pow(F.col("im") - F.col("_im"), F.lit(2)))).alias("separation"))


def percentile_of(values: Column, q: float) -> Column:
    """The q-percentile of an array column's values, between the two about it."""
    ordered = F.array_sort(values)
    place = F.lit(q) * (F.size(values) - 1)
    low = F.floor(place).cast("int")
    a, b = F.get(ordered, low), F.get(ordered, F.least(low + 1, F.size(values) - 1))
    return a + (b - a) * (place - low)


def audio_bandwidth(rate: float, down_db: float = 40.0):
    """A function of an array column of real samples: Hz between the first and the last bin of its spectrum's power at `down_db` below the peak or above; null for none."""

    @F.arrow_udf(T.DoubleType())
    def run(x: pa.Array) -> pa.Array:
        out = np.full(len(x), np.nan)
        for at, (v,) in by_length([x]):
            n = v.shape[1]
            if not n:
                continue
            db = 10 * np.log10(np.abs(np.fft.rfft(v)) ** 2 + 1e-12)
            loud = db >= db.max(axis=1, keepdims=True) - down_db
            last = loud.shape[1] - 1 - np.argmax(loud[:, ::-1], axis=1)
            out[at] = (last - np.argmax(loud, axis=1)) * rate / (2 * n)
        return pa.array(out, mask=np.isnan(out))

    return run
