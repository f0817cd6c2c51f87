"""Operators along an order and over whole captures, against NumPy on one long array, with borders, nulls and hot keys."""

import datetime as dt
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wavelake.functions import dsp
from wavelake.operators import captures, judging, ordered, spectral

WINDOWS = "capture string, at long, x array<double>"


def windows(seed, sizes, extra=()):
    """Rows of captures, each cut into windows of its sizes; captures are named, one by null."""
    r = np.random.default_rng(seed)
    rows, whole = [], {}
    for name, each in sizes.items():
        parts = [r.normal(size=n) for n in each]
        whole[name] = np.concatenate(parts)
        rows += [(name, k * 10, p.tolist()) for k, p in enumerate(parts)]
    r.shuffle(rows)
    return [(a, int(b), [float(v) for v in c] if c is not None else None) for a, b, c in [*rows, *extra]], whole


def joined(frame, column):
    out = {}
    for r in frame.orderBy("at").collect():
        out.setdefault(r.capture, []).extend(r[column] or [])
    return out


SIZES = {"hot": [8] * 200, "odd": [1, 30, 2, 7, 64, 3], None: [5, 5], "one": [4]}


def test_numbers_along_an_order(spark):
    rows = [(k, i, i % 3) for k, n in (("a", 300), (None, 5), ("b", 1)) for i in range(n)]
    frame = spark.createDataFrame(rows, "k string, i long, _n_ long").repartition(3)
    out = {(r.k, r.i): r.place for r in ordered.numbered(frame, ["k"], ["i"], "place").collect()}
    assert out == {(k, i): i for k, i, _ in rows}
    every = sorted((r.i, r.place) for r in ordered.numbered(frame.filter("k = 'a'"), [], ["i"], "place").collect())
    assert every == [(i, i) for i in range(300)]
    assert ordered.numbered(frame.limit(0), ["k"], ["i"], "place").count() == 0


def test_states_are_sums_and_affine_maps(spark):
    r = np.random.default_rng(1)
    rows = [(k, i, r.normal(size=2).tolist(), (r.normal(size=4) / 2).tolist()) for k in ("a", "b", None) for i in range(120)]
    frame = spark.createDataFrame(rows, "k string, i long, v array<double>, m array<double>").repartition(4)
    for matrix in (None, "m"):
        got = {(x.k, x.i): x.s for x in ordered.states(frame, ["k"], ["i"], "v", 2, "s", matrix).collect()}
        state = {}
        for k, i, v, m in rows:
            s = state.get(k, np.zeros(2))
            np.testing.assert_allclose(got[k, i], s, atol=1e-9)
            state[k] = (np.reshape(m, (2, 2)) @ s if matrix else s) + v


def test_running_phase_passes_windows(spark):
    rows, _ = windows(2, SIZES)
    rows = [(a, b, x * 2) for a, b, x in rows] + [("hot", 15, None), ("odd", 5, [])]
    out = captures.running_phase(spark.createDataFrame(rows, WINDOWS), ["capture"], ["at"], "x", "p")
    got = joined(out, "p")
    for name in SIZES:
        flat = np.concatenate([np.asarray(x) for a, b, x in sorted((r for r in rows if r[0] == name), key=lambda r: r[1]) if x])
        want = np.empty_like(flat)
        want[0::2], want[1::2] = np.cumsum(flat[0::2]), np.cumsum(flat[1::2])
        np.testing.assert_allclose(got[name], want, atol=1e-9)


def test_sums_need_no_python_and_windows_are_computed_once(spark, monkeypatch):
    """A task of the queries that explode a window has one Python worker; an explode's filter made it two."""
    from wavelake.plans import captures as plans

    plan = lambda f: f._jdf.queryExecution().executedPlan().toString()
    for name in ("fm_phase_capture", "iir_capture", "fir_capture", "fir_capture_long"):
        assert plan(getattr(plans, name)(spark, "/root/testdata/sf0.001")).count("ArrowEvalPython") == 1, name
    written, keep = [], ordered.stored
    monkeypatch.setattr(ordered, "stored", lambda f, name: written.append(plan(f)) or keep(f, name))
    rows = spark.createDataFrame([("a", k, [1.0, 2.0]) for k in range(50)], WINDOWS)
    assert {(r.at, tuple(r.s)) for r in ordered.states(rows, ["capture"], ["at"], "x", 2, "s").collect()} == {(k, (1.0 * k, 2.0 * k)) for k in range(50)}
    assert written and not any("Arrow" in p or "Python" in p for p in written)


def test_a_null_value_adds_nothing_to_the_phase(spark):
    rows = [("a", 0, [1.0, None, 2.0, 5.0]), ("a", 1, [None, 1.0]), ("a", 2, None), ("a", 3, [4.0, 2.0])]
    got = captures.running_phase(spark.createDataFrame(rows, WINDOWS), ["capture"], ["at"], "x", "p")
    assert joined(got, "p") == {"a": [1.0, 0.0, 3.0, 5.0, 3.0, 6.0, 7.0, 8.0]}


def test_a_batch_is_held_flat(spark):
    """Of a batch there are some flat copies, and no object for each row."""
    rng, width, n = np.random.default_rng(8), 64, 10_000
    x = rng.normal(size=(n, width)).astype(np.float32)
    held = lambda a: pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * a.shape[1], pa.int32()), pa.array(a.ravel()))
    iq, before = held(x), held(np.ones((n, 2)))
    tracemalloc.start()
    got = captures.interleaved_running.func(iq, before)
    made, peak = tracemalloc.take_snapshot(), tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(s.count for s in made.statistics("filename")) < 1000 and peak < 6 * 8 * n * width
    want = np.empty((n, width))
    for k in (0, 1):
        want[:, k::2] = 1 + np.cumsum(x[:, k::2].astype(float), axis=1)
    np.testing.assert_allclose(got.flatten().to_numpy().reshape(n, width), want)


@pytest.mark.parametrize("kept", [0, 1, 2, 3])
def test_rows_of_a_batch_by_length(kept):
    """Nulls, empty rows, null elements and slices of a batch."""
    rows = [[1.0, None], None, [], [3.0], [4.0, 5.0]]
    batch = pa.array(rows, pa.list_(pa.float32()))[kept:]
    got = captures.put(len(batch), ((at, v * 2) for at, (v,) in captures.by_length([batch]))).to_pylist()
    assert [[None if x != x else x for x in r] for r in got] == [[x and 2 * x for x in r or []] for r in rows[kept:]]
    assert captures.put(0, ((at, v) for at, (v,) in captures.by_length([batch[:0]]))).to_pylist() == []


SECTIONS = [[0.2, 0.4, 0.2, 1.0, -0.5, 0.3], [0.5, 0.25, 0.1, 1.0, 0.2, -0.15]]


def test_recursive_filter_is_one_filter_over_the_capture(spark):
    rows, whole = windows(3, SIZES, [("hot", 15, None), ("odd", 5, [])])
    got = joined(captures.recursive_filter(spark.createDataFrame(rows, WINDOWS).repartition(3), ["capture"], ["at"], "x", SECTIONS, "y"), "y")
    for name, x in whole.items():
        np.testing.assert_allclose(got[name], dsp.sections(np.asarray(SECTIONS), x), atol=1e-9)


@pytest.mark.parametrize("n", [1, 5, 33, 100])
def test_convolution_is_one_over_the_capture(spark, n):
    rows, whole = windows(4, SIZES)
    taps = np.random.default_rng(n).normal(size=n)
    got = joined(captures.convolved(spark.createDataFrame(rows, WINDOWS).repartition(3), ["capture"], ["at"], "x", taps.tolist(), "y"), "y")
    for name, x in whole.items():
        np.testing.assert_allclose(got[name], np.convolve(x, taps)[: len(x)], atol=1e-9)
    assert captures.convolved(spark.createDataFrame([], WINDOWS), ["capture"], ["at"], "x", [1.0, 2.0], "y").count() == 0


def test_envelope_peak_finds_a_period(spark):
    x = [float(np.cos(2 * np.pi * k / 9) + 2) for k in range(200)]
    rows = [("a", 0, x), ("b", 1, x[:5]), ("c", 2, None), ("d", 3, [1.0] * 50)]
    out = {r.capture: r.p for r in spark.createDataFrame(rows, WINDOWS).select("capture", captures.envelope_peak(4, 14)("x").alias("p")).collect()}
    assert out["a"].lag == 9 and 0.9 < out["a"].peak < 1 and (out["b"].lag, out["c"].lag) == (None, None) and abs(out["d"].peak) < 1e-6


def test_lloyd_steps_of_many_groups(spark):
    r = np.random.default_rng(5)
    points = [(g, n, *(r.normal(size=2) * 0.1 + [(n % 4) // 2 * 2 + g, n % 2 * 3])) for g in range(3) for n in range(80)]
    frame = spark.createDataFrame([(g, n, float(a), float(b)) for g, n, a, b in points], "g long, n long, re double, im double")
    seeds = frame.filter("n < 4").select("g", F.col("n").cast("int").alias("k"), "re", "im").unionByName(frame.filter("n = 0").select("g", F.lit(4).alias("k"), F.lit(1e6).alias("re"), F.lit(0.0).alias("im")))
    centres = captures.lloyd(frame, seeds, ["g"], 3)
    got = {(c.g, c.k): (c.re, c.im) for c in centres.collect()}
    for g in range(3):
        for k in range(4):
            np.testing.assert_allclose(got[g, k], np.mean([p[2:] for p in points if p[0] == g and p[1] % 4 == k], axis=0))
        assert got[g, 4] == (1e6, 0.0)  # nothing is near to it
    assert all(1.5 < s.separation < 3.1 for s in captures.separation(centres, ["g"]).collect())


@pytest.mark.parametrize("q", [0.0, 0.37, 0.5, 0.95, 1.0])
def test_percentiles_by_counts(spark, q):
    r = np.random.default_rng(6)
    groups = {"hot": r.normal(size=6000), "same": np.full(900, 2.5), "two": np.repeat([1.0, 7.0], 500), "wide": np.concatenate([r.random(900) * 1e-9, [1e300, -1e300]]), "one": np.array([3.0]), None: np.array([1.0, 2.0])}
    rows = [(k, float(v)) for k, x in groups.items() for v in x] + [("hot", None), ("none", None), ("hot", float("nan"))]
    got = {x.k: x.p for x in ordered.percentiles(spark.createDataFrame(rows, "k string, v double").repartition(3), ["k"], "v", q, "p", held=50, parts=8).collect()}
    assert set(got) == set(groups)
    for k, x in groups.items():
        place = q * (len(x) - 1)
        a, b = np.sort(x)[int(place)], np.sort(x)[min(int(place) + 1, len(x) - 1)]
        assert got[k] == a + (b - a) * (place - int(place))


def test_percentiles_with_infinite_values(spark):
    x = [float("-inf")] * 40 + [float("inf")] * 40 + [1.0, 2.0, 3.0] * 30
    frame = spark.createDataFrame([("a", v) for v in x], "k string, v double")
    assert ordered.percentiles(frame, ["k"], "v", 0.5, "p", held=5, parts=4).first().p == 2.0
    assert ordered.percentiles(frame.limit(0), ["k"], "v", 0.5, "p").count() == 0


def test_nearest_rows(spark):
    r = np.random.default_rng(7)
    left = [(i, None if i % 50 == 0 else int(x)) for i, x in enumerate(r.integers(-50, 400, 300))] + [(1000 + i, 77) for i in range(200)]
    right = [(int(k), f"r{k}") for k in sorted({*r.integers(0, 300, 40).tolist(), 70, 84})] + [(None, "no")]
    a, b = spark.createDataFrame(left, "i long, k long").repartition(3), spark.createDataFrame(right, "t long, name string").repartition(2)
    got = {x.i: (x.near_t, x.near_name) for x in ordered.nearest(a, b, "k", "t", ["name"]).collect()}
    there = [t for t, _ in right if t is not None]
    for i, k in left:
        assert got[i] == ((None, None) if k is None else (t := min(there, key=lambda t: (abs(t - k), t)), f"r{t}"))
    none = ordered.nearest(a, b.limit(0), "k", "t", ["name"])
    assert none.count() == len(left) and none.filter("near_t is not null").isEmpty()
    times = spark.createDataFrame([(1, dt.datetime(2026, 1, 1, 11))], "i long, k timestamp_ntz")
    days = spark.createDataFrame([(dt.datetime(2026, 1, d),) for d in (1, 2)], "t timestamp_ntz")
    assert ordered.nearest(times, days, "k", "t", []).first().near_t == dt.datetime(2026, 1, 1)


def functions():
    x = F.col("x")
    return {
        "softmax": judging.softmax(x), "unit_power": spectral.unit_power(x), "span_above": spectral.span_above(x, 0.5), "nrzi": spectral.nrzi(F.transform(x, lambda v: (v > 0).cast("int"))),
        "instantaneous_stats": spectral.instantaneous_stats(x, 48000.0), "walk_bandwidth": spectral.walk_bandwidth(None, "x", 0.5, 1.0),
    }


@pytest.mark.parametrize("name", ["instantaneous_stats", "nrzi", "softmax", "span_above", "unit_power", "walk_bandwidth"])
def test_array_functions_are_linear_in_the_window(spark, name):
    def took(n):
        rows = spark.range(60).withColumn("x", F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.sin((i * 37 + F.col("id")).cast("double"))))
        rows = rows.repartition(2).cache()
        rows.count()
        best = 1e9
        for _ in range(3):
            t = time.perf_counter()
            rows.select(functions()[name].alias("y")).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - t)
        rows.unpersist()
        return best

    # A quadratic function takes sixteen times as long; starting a job takes some time in both.
    assert took(8192) < 7 * took(2048) + 0.2
