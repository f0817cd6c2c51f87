"""Queries over whole captures: the embeddings of a label are a capture, its windows in order of vec_id."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from wavelake.operators import captures, ordered, spectral
from wavelake.plans.base import RATE, SAMPLES, case, query, sql_case, table
from wavelake.shared import expire, shared_dir
from wavelake.sources import cache
from wavelake.store import AuditStore

#: How events stand for issues.
SEVERITIES = [("click", "info"), ("error", "hard_fail"), ("purchase", "warning"), ("signup", "info"), ("view", "soft_fail")]

_RUN = "(PARTITION BY label ORDER BY vec_id, n ROWS UNBOUNDED PRECEDING)"


@query(f"WITH {SAMPLES}, c AS (SELECT vec_id, n, sum(re) OVER {_RUN} * 2 * pi() * 3000 / 32000 AS a, sum(im) OVER {_RUN} * 2 * pi() * 3000 / 32000 AS b FROM s) SELECT vec_id, n, round(cos(a), 5) AS re_i, round(sin(a), 5) AS im_i, round(cos(b), 5) AS re_q, round(sin(b), 5) AS im_q FROM c")
def fm_phase_capture(spark, sf_dir):
    """FM of I and of Q: the phase goes on over the windows of a capture."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    rows = captures.running_phase(e, ["label"], ["vec_id"], "embedding", "sums").select("vec_id", F.posexplode("sums").alias("p", "s"))
    angle = F.col("s") * F.lit(spectral.TWO_PI * 3000 / RATE)
    # The two parts of a sample come from one array, so they are brought together in the row.
    rows = rows.select("vec_id", F.floor(F.col("p") / 2).cast("int").alias("n"), (F.col("p") % 2).alias("part"), F.round(F.cos(angle), 5).alias("c"), F.round(F.sin(angle), 5).alias("s"))
    of = lambda c, part: F.max(F.when(F.col("part") == part, F.col(c)))
    return rows.groupBy("vec_id", "n").agg(of("c", 0).alias("re_i"), of("s", 0).alias("im_i"), of("c", 1).alias("re_q"), of("s", 1).alias("im_q"))


#: Two sections of a low-pass: b0, b1, b2, 1, a1, a2.
SECTIONS = [[0.2, 0.4, 0.2, 1.0, -0.5, 0.3], [0.5, 0.25, 0.1, 1.0, 0.2, -0.15]]


def _section(name: str, source: str, column: str, section: list[float]) -> str:
    b0, b1, b2, _, a1, a2 = (f"({x}::DOUBLE)" for x in section)
    x, y = f"s.{column}", f"({b0} * s.{column} + r.z1)"
    return f"""{name}(label, g, y, z1, z2) AS (SELECT label, 0::BIGINT, NULL::DOUBLE, 0::DOUBLE, 0::DOUBLE FROM (SELECT DISTINCT label FROM {source})
        UNION ALL SELECT r.label, s.g, {y}, {b1} * {x} - {a1} * {y} + r.z2, {b2} * {x} - {a2} * {y} FROM {name} r JOIN {source} s ON s.label IS NOT DISTINCT FROM r.label AND s.g = r.g + 1)"""


@query(f"""WITH RECURSIVE {SAMPLES}, g AS (SELECT vec_id, label, n, re, row_number() OVER (PARTITION BY label ORDER BY vec_id, n) AS g FROM s),
    {_section('one', 'g', 're', SECTIONS[0])}, {_section('two', 'one', 'y', SECTIONS[1])}
    SELECT g.vec_id, g.n, round(two.y, 6) + 0.0::DOUBLE AS y FROM g JOIN two ON two.label IS NOT DISTINCT FROM g.label AND two.g = g.g""")
def iir_capture(spark, sf_dir):
    """A recursive filter whose state passes from window to window."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", spectral.deinterleave(F.col("embedding"))[0].alias("x"))
    out = captures.recursive_filter(e, ["label"], ["vec_id"], "x", SECTIONS, "y")
    return out.select("vec_id", F.posexplode("y").alias("n", "y")).select("vec_id", "n", (F.round("y", 6) + F.lit(0.0)).alias("y"))


TAPS = {5: [0.1, 0.25, 0.3, 0.25, 0.1], 33: [(1 + min(k, 32 - k)) / 289 for k in range(33)]}


def _fir_sql(taps: list[float]) -> str:
    sums = " + ".join(f"{w!r}::DOUBLE * coalesce(lag(re, {k}) OVER w, 0.0::DOUBLE)" for k, w in enumerate(taps))
    return f"WITH {SAMPLES} SELECT vec_id, n, round({sums}, 6) + 0.0::DOUBLE AS y FROM s WINDOW w AS (PARTITION BY label ORDER BY vec_id, n)"


def _fir(spark, sf_dir, taps):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", spectral.deinterleave(F.col("embedding"))[0].alias("x"))
    out = captures.convolved(e, ["label"], ["vec_id"], "x", taps, "y")
    return out.select("vec_id", F.posexplode("y").alias("n", "y")).select("vec_id", "n", (F.round("y", 6) + F.lit(0.0)).alias("y"))


@query(_fir_sql(TAPS[5]))
def fir_capture(spark, sf_dir):
    """A filter of 5 taps over the windows of a capture as one stream."""
    return _fir(spark, sf_dir, TAPS[5])


@query(_fir_sql(TAPS[33]))
def fir_capture_long(spark, sf_dir):
    """33 taps, as many as a window has samples and one more."""
    return _fir(spark, sf_dir, TAPS[33])


#: Samples of a window that centres start from, and Lloyd steps.
SEEDS, STEPS = [0, 8, 16, 24], 8


def _lloyd_sql() -> str:
    step = lambda k: f"""a{k} AS (SELECT p.vec_id, n, p.re, p.im, arg_min(c.k, (power(p.re - c.re, 2) + power(p.im - c.im, 2), c.k)) AS k FROM p JOIN c{k} c USING (vec_id) GROUP BY ALL),
    c{k + 1} AS (SELECT c.vec_id, c.k, coalesce(m.re, c.re) AS re, coalesce(m.im, c.im) AS im FROM c{k} c LEFT JOIN (SELECT vec_id, k, avg(re) AS re, avg(im) AS im FROM a{k} GROUP BY 1, 2) m ON m.vec_id = c.vec_id AND m.k = c.k)"""  # noqa: E731
    seeds = " ".join(f"WHEN {n} THEN {k}" for k, n in enumerate(SEEDS))
    return f"""WITH {SAMPLES}, q AS (SELECT vec_id, quantile_cont(v, 0.95) + 1e-9 AS q FROM (SELECT vec_id, abs(re) AS v FROM s UNION ALL SELECT vec_id, abs(im) FROM s) GROUP BY 1),
    p AS (SELECT vec_id, n, re / q AS re, im / q AS im FROM s JOIN q USING (vec_id)), c0 AS (SELECT vec_id, CASE n {seeds} END AS k, re, im FROM p WHERE n IN ({', '.join(map(str, SEEDS))})),
    {', '.join(step(k) for k in range(STEPS + 1))},
    n AS (SELECT c.vec_id, c.k, count(a.n) AS n FROM c{STEPS} c LEFT JOIN a{STEPS} a ON a.vec_id = c.vec_id AND a.k = c.k GROUP BY 1, 2), b AS (SELECT vec_id, min(n) / max(n)::DOUBLE AS balance FROM n GROUP BY 1),
    d AS (SELECT x.vec_id, min(sqrt(power(x.re - y.re, 2) + power(x.im - y.im, 2))) AS separation FROM c{STEPS} x JOIN c{STEPS} y ON x.vec_id = y.vec_id AND x.k < y.k GROUP BY 1)
    SELECT vec_id, round(balance, 6) AS balance, round(separation, 6) AS separation FROM b JOIN d USING (vec_id)"""


@query(_lloyd_sql())
def kmeans_balance(spark, sf_dir):
    """Four clusters of each window's samples: balance of sizes and least distance of centres."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    scale = captures.percentile_of(F.transform("v", F.abs), 0.95) + F.lit(1e-9)
    long = spectral.samples(e.withColumn("q", scale), ["vec_id", "q"], "v")
    points = long.select("vec_id", "n", (F.col("re") / F.col("q")).alias("re"), (F.col("im") / F.col("q")).alias("im"))
    seed = F.array_position(F.array(*[F.lit(n) for n in SEEDS]), F.col("n")) - 1
    seeds = points.filter(F.col("n").isin(SEEDS)).select("vec_id", seed.cast("int").alias("k"), "re", "im")
    centres = captures.lloyd(points, seeds, ["vec_id"], STEPS)
    sizes = captures.assigned(points, centres, ["vec_id"]).groupBy("vec_id", "k").agg(F.count("*").alias("c"))
    sizes = centres.join(sizes, ["vec_id", "k"], "left").groupBy("vec_id").agg((F.min(F.coalesce("c", F.lit(0))) / F.max(F.coalesce("c", F.lit(0)))).alias("balance"))
    return sizes.join(captures.separation(centres, ["vec_id"]), "vec_id").select("vec_id", F.round("balance", 6).alias("balance"), F.round("separation", 6).alias("separation"))


@query("SELECT event_type, round(quantile_cont(value, 0.95), 9) AS p95, round(quantile_cont(value, 0.5), 9) AS median FROM events WHERE value IS NOT NULL GROUP BY 1")
def value_percentiles(spark, sf_dir):
    """Exact percentiles of large groups by counts, none of which is gathered."""
    e = table(spark, sf_dir, "events").select("event_type", "value")
    p95, median = (ordered.percentiles(e, ["event_type"], "value", q, name, held=512, parts=64) for q, name in ((0.95, "p95"), (0.5, "median")))
    return p95.join(median, "event_type").select("event_type", F.round("p95", 9).alias("p95"), F.round("median", 9).alias("median"))


_SHIFT = 8035


@query(f"""WITH e AS (SELECT event_id, ts - INTERVAL {_SHIFT} DAY AS t FROM events WHERE ts IS NOT NULL), o AS (SELECT o_orderdate AS d, count(*) AS orders FROM orders WHERE o_custkey % 10 = 0 AND o_orderdate IS NOT NULL GROUP BY 1),
    b AS (SELECT event_id, t, d, orders FROM e ASOF LEFT JOIN o ON e.t >= o.d), f AS (SELECT event_id, d, orders FROM e ASOF LEFT JOIN o ON e.t <= o.d)
    SELECT b.event_id, CASE WHEN b.d IS NULL OR f.d - b.t < b.t - b.d THEN f.d ELSE b.d END AS day, CASE WHEN b.d IS NULL OR f.d - b.t < b.t - b.d THEN f.orders ELSE b.orders END AS orders FROM b JOIN f USING (event_id)""")
def nearest_order_day(spark, sf_dir):
    """Each event with the nearest day on which some customers ordered."""
    e = table(spark, sf_dir, "events").filter("ts is not null").select("event_id", (F.col("ts") - F.expr(f"INTERVAL {_SHIFT} DAY")).alias("t"))
    days = table(spark, sf_dir, "orders").filter("o_custkey % 10 = 0").groupBy(F.col("o_orderdate").alias("day")).agg(F.count("*").alias("orders"))
    return ordered.nearest(e, days, "t", "day", ["orders"]).select("event_id", F.col("near_day").alias("day"), F.col("near_orders").alias("orders"))


@query(f"""WITH {SAMPLES}, x AS (SELECT vec_id, n, sqrt(re * re + im * im) - avg(sqrt(re * re + im * im)) OVER (PARTITION BY vec_id) AS v FROM s),
    l AS (SELECT a.vec_id, b.n - a.n AS lag, sum(a.v * b.v) AS r FROM x a JOIN x b ON a.vec_id = b.vec_id AND b.n - a.n BETWEEN 2 AND 12 GROUP BY 1, 2), z AS (SELECT vec_id, sum(v * v) + 1e-12 AS r0 FROM x GROUP BY 1)
    SELECT vec_id, arg_max(lag, (r, -lag))::INT AS lag, round(max(r / r0), 6) AS peak FROM l JOIN z USING (vec_id) GROUP BY 1""")
def envelope_period(spark, sf_dir):
    """The lag of the greatest normalised autocorrelation of each window's envelope."""
    i, q = spectral.deinterleave(F.col("embedding"))
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.zip_with(i, q, lambda a, b: F.sqrt(a * a + b * b)).alias("a"))
    return e.select("vec_id", captures.envelope_peak(2, 12)("a").alias("p")).select("vec_id", "p.lag", F.round("p.peak", 6).alias("peak"))


@query("""WITH e AS (SELECT *, ({kind}) AS severity FROM events)
    SELECT event_id, severity, CASE WHEN event_id % 3 < 2 AND user_id % 7 = 0 THEN 'event ' || event_id || ' | superseded by re-scan' ELSE 'event ' || event_id END AS description, coalesce(event_id % 3 < 2 AND user_id % 7 = 0, false) AS resolved
    FROM e WHERE NOT (severity = 'info' AND ts < TIMESTAMP '2024-01-10')""".replace("{kind}", sql_case("event_type", SEVERITIES)))
def audit_log_replay(spark, sf_dir):
    """Events as issues in a store: three appends, a re-scan before the last, a compaction, and a purge; what is there in the end."""
    e = table(spark, sf_dir, "events")
    rows = e.select("event_id", F.lit(1).cast("bigint").alias("project_id"), F.col("user_id").alias("block_id"), F.col("ts").cast("timestamp_ntz").alias("detected_at"), case(F.col("event_type"), SEVERITIES).alias("severity"), F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("description"), F.lit(False).alias("resolved"))
    root = f"{shared_dir(spark)}/audit-{uuid.uuid4().hex}"
    expire(spark, root)
    log = AuditStore(spark, root)
    for k in range(3):
        if k == 2:
            log.supersede(e.filter("user_id % 7 = 0").select(F.col("user_id").alias("block_id")).distinct())
        log.append("issues", rows.filter(F.col("event_id") % 3 == k).drop("event_id"))
    log.compact("issues")
    log.change("issues", lambda now: now.filter("severity = 'info' and detected_at < timestamp_ntz'2024-01-10'").withColumn("_gone", F.lit(True)))
    return log.read("issues").select(F.regexp_extract("description", "^event (\\d+)", 1).cast("bigint").alias("event_id"), "severity", "description", "resolved")


@query("SELECT 'label' || label AS key, count(*) AS windows, round(avg(list_sum(embedding)::DOUBLE), 4) AS mean FROM embeddings WHERE label IS NOT NULL GROUP BY 1")
def shard_cache(spark, sf_dir):
    """Windows by label through the shard cache: built once, then read with a check of each shard."""
    e = table(spark, sf_dir, "embeddings").filter("label is not null").select(F.lit("embeddings").alias("source"), F.concat(F.lit("label"), F.col("label").cast("string")).alias("key"), "vec_id", F.transform("embedding", lambda x: x.cast("float")).alias("iq"))
    root = f"{shared_dir(spark)}/cache-{uuid.uuid4().hex}"
    expire(spark, root)
    held = cache.ShardCache(spark, root, "vec_id bigint, iq array<float>")
    keys = e.select("source", "key").distinct()
    build = lambda todo: e.join(F.broadcast(todo.select("source", "key")), ["source", "key"])  # noqa: E731  one row for each label
    held.load(keys, build)
    rows = held.load(keys, lambda todo: todo.select("source", "key", F.raise_error(F.lit("built twice")).alias("vec_id"), F.array().cast("array<float>").alias("iq")))
    total = F.aggregate("iq", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return rows.groupBy("key").agg(F.count("*").alias("windows"), F.round(F.avg(total), 4).alias("mean"))


@query(f"""WITH {SAMPLES}, f AS (SELECT vec_id, k, 10 * log10(pow(sum(re * cos(2 * pi() * k * n / 32)), 2) + pow(sum(re * sin(2 * pi() * k * n / 32)), 2) + 1e-12) AS db FROM s, range(17) r(k) GROUP BY 1, 2),
    p AS (SELECT vec_id, max(db) AS top FROM f GROUP BY 1) SELECT vec_id, (max(k) - min(k)) * 32000.0::DOUBLE / 64 AS bandwidth FROM f JOIN p USING (vec_id) WHERE db >= top - 6 GROUP BY 1""")
def audio_bandwidth(spark, sf_dir):
    """The bandwidth of each window's I as audio, at 6 dB below the peak."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", spectral.deinterleave(F.col("embedding"))[0].alias("x"))
    return e.select("vec_id", captures.audio_bandwidth(RATE, 6.0)("x").alias("bandwidth"))
