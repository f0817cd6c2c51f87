"""Queries on windows, spectra and signal functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavelake import vocab
from wavelake.functions import dsp
from wavelake.operators import captures, ordered, spectral
from wavelake.plans.base import RATE, SAMPLES, SPECTRA, STEP, query, spectra, table

TARGETS = [-12000.0, -8000.0, -4000.0, -1000.0, 1000.0, 4000.0, 8000.0, 12000.0]
TAPS = [0.1, 0.25, 0.3, 0.25, 0.1]


@query(f"WITH {SAMPLES} SELECT vec_id, n, round(re, 6) AS re, round(im, 6) AS im FROM s")
def deinterleave(spark, sf_dir):
    long = spectral.samples(table(spark, sf_dir, "embeddings"), ["vec_id"], "embedding")
    return long.select("vec_id", "n", F.round("re", 6).alias("re"), F.round("im", 6).alias("im"))


@query("SELECT vec_id, w::INT AS w, round(avg(embedding[w * 16 + i + 1]::DOUBLE), 6) AS mean FROM embeddings, range(4) a(w), range(16) b(i) GROUP BY 1, 2")
def chunk_windows(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "v"))
    return rows.groupBy("vec_id", F.floor(F.col("pos") / 16).cast("int").alias("w")).agg(F.round(F.avg(F.col("v").cast("double")), 6).alias("mean"))


@query("""WITH c AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)
    SELECT n % 4 = 0 AS whole, count(*) AS orders, sum(n // 4)::BIGINT AS chunks FROM c GROUP BY 1""")
def chunk_length_check(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy((F.col("n") % 4 == 0).alias("whole")).agg(F.count(F.lit(1)).alias("orders"), F.sum(F.floor(F.col("n") / 4)).alias("chunks"))


@query(f"WITH {SAMPLES}, p AS (SELECT vec_id, greatest(avg(re * re + im * im), 1e-12) AS p FROM s GROUP BY 1) SELECT vec_id, round(p, 6) AS power, round(sum((re * re + im * im) / p) / 32, 6) AS after FROM s JOIN p USING (vec_id) GROUP BY 1, p")
def unit_power(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("u", spectral.unit_power(F.col("embedding")))
    return e.select("vec_id", F.round(spectral.power(F.col("embedding")), 6).alias("power"), F.round(spectral.power(F.col("u")), 6).alias("after"))


@query(f"WITH {SPECTRA} SELECT vec_id, bin, round(mag, 6) AS mag FROM f")
def dft_magnitude(spark, sf_dir):
    return spectral.bins(spectra(spark, sf_dir), ["vec_id"], "mags", STEP).select("vec_id", "bin", F.round("mag", 6).alias("mag"))


_AVERAGE = f"{SPECTRA}, a AS (SELECT label, bin, bin * 1000.0::DOUBLE AS hz, avg(mag) AS mag FROM f GROUP BY 1, 2)"


def _average(spark, sf_dir):
    return spectral.bins(spectra(spark, sf_dir), ["label"], "mags", STEP).groupBy("label", "bin", "hz").agg(F.avg("mag").alias("mag"))


@query(f"WITH {_AVERAGE} SELECT label, bin, round(mag, 6) AS mag FROM a")
def average_spectrum(spark, sf_dir):
    return _average(spark, sf_dir).select("label", "bin", F.round("mag", 6).alias("mag"))


@query(f"WITH {SPECTRA}, p AS (SELECT vec_id, max(mag) AS m FROM f GROUP BY 1) SELECT vec_id, ((max(bin) - min(bin) + 1) * 1000.0::DOUBLE) AS bandwidth FROM f JOIN p USING (vec_id) WHERE mag >= m * 0.5 GROUP BY 1")
def occupied_bandwidth(spark, sf_dir):
    return spectra(spark, sf_dir).select("vec_id", (spectral.span_above(F.col("mags"), 0.5) * F.lit(STEP)).alias("bandwidth"))


@query(f"""WITH {SPECTRA}, p AS (SELECT vec_id, max(mag) AS m FROM f GROUP BY 1), w AS (SELECT vec_id, label, (max(bin) - min(bin) + 1) * 1000.0::DOUBLE AS b FROM f JOIN p USING (vec_id) WHERE mag >= m * 0.5 GROUP BY 1, 2)
    SELECT label, round(quantile_cont(b, 0.95), 6) AS p95, quantile_cont(b, 0.95) <= 30000 AS ok FROM w GROUP BY 1""")
def bandwidth_p95_check(spark, sf_dir):
    b = spectra(spark, sf_dir).select("label", (spectral.span_above(F.col("mags"), 0.5) * F.lit(STEP)).alias("b"))
    return ordered.percentiles(b, ["label"], "b", 0.95, "p").select("label", F.round("p", 6).alias("p95"), (F.col("p") <= 30000).alias("ok"))


_TARGETS = "t(target) AS (VALUES " + ", ".join(f"({x}::DOUBLE)" for x in TARGETS) + ")"
_MATCH = f"""{_AVERAGE}, {_TARGETS}, l AS (SELECT label, max(mag) AS mx, median(mag) AS md FROM a GROUP BY 1),
    c AS (SELECT label, target, hz, mag FROM a JOIN t ON abs(hz - target) <= 1500 QUALIFY row_number() OVER (PARTITION BY label, target ORDER BY mag DESC, hz) = 1),
    found AS (SELECT label, target, hz, mag FROM c JOIN l USING (label) WHERE mag >= mx * 0.08 AND mag >= md * 1.02)"""


def _matched(spark, sf_dir):
    targets = vocab.frame(spark, [(x,) for x in TARGETS], "target double")
    return spectral.match_carriers(_average(spark, sf_dir), ["label"], targets, 1500.0, of_median=1.02)


@query(f"WITH {_MATCH} SELECT label, target, hz, round(mag, 6) AS mag FROM found")
def carrier_match(spark, sf_dir):
    return _matched(spark, sf_dir).select("label", "target", "hz", F.round("mag", 6).alias("mag"))


@query(f"""WITH {_MATCH}, g AS (SELECT label, hz - lag(hz) OVER (PARTITION BY label ORDER BY hz, target) AS gap FROM found)
    SELECT label, count(*) AS carriers, round(coalesce(avg(gap), 0.0), 6) AS spacing_mean, round(coalesce(stddev_pop(gap), 999.0), 6) AS spacing_std FROM g GROUP BY 1""")
def carrier_spacing(spark, sf_dir):
    return spectral.spacing(_matched(spark, sf_dir), ["label"]).select("label", "carriers", F.round("spacing_mean", 6).alias("spacing_mean"), F.round("spacing_std", 6).alias("spacing_std"))


@query(f"""WITH {SPECTRA}, p AS (SELECT vec_id, max(mag) AS m, arg_max(bin, (mag, -bin)) AS pk FROM f GROUP BY 1)
    SELECT vec_id, (coalesce(min(bin) FILTER (mag < m * 0.6 AND bin > pk), 15) - coalesce(max(bin) FILTER (mag < m * 0.6 AND bin < pk), -16)) * 1000.0::DOUBLE AS width FROM f JOIN p USING (vec_id) GROUP BY 1""")
def peak_bandwidth_walk(spark, sf_dir):
    s = spectra(spark, sf_dir)
    return s.select("vec_id", spectral.walk_bandwidth(s, "mags", 0.6, STEP).alias("width"))


@query(f"WITH {SPECTRA}, p AS (SELECT vec_id, max(mag) AS m FROM f GROUP BY 1) SELECT vec_id, ((max(bin) - min(bin)) * 1000.0::DOUBLE) AS total FROM f JOIN p USING (vec_id) WHERE mag >= m * 0.7 GROUP BY 1")
def total_bandwidth(spark, sf_dir):
    return spectra(spark, sf_dir).select("vec_id", ((spectral.span_above(F.col("mags"), 0.7) - 1) * F.lit(STEP)).alias("total"))


@query(f"""WITH {SAMPLES}, d AS (SELECT vec_id, n, atan2(im, re) - lag(atan2(im, re)) OVER (PARTITION BY vec_id ORDER BY n) AS d FROM s),
    h AS (SELECT vec_id, (d - 2 * pi() * floor((d + pi()) / (2 * pi()))) * 32000 / (2 * pi()) AS hz FROM d WHERE d IS NOT NULL) SELECT vec_id, round(stddev_pop(hz), 4) AS deviation, round(avg(hz), 4) AS mean_hz FROM h GROUP BY 1""")
def instantaneous_frequency(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", spectral.instantaneous_stats(F.col("embedding"), RATE).alias("s"))
    return rows.select("vec_id", F.round("s.deviation", 4).alias("deviation"), F.round("s.mean_hz", 4).alias("mean_hz"))


@query(f"WITH {SAMPLES} SELECT label, round(stddev_pop(sqrt(re * re + im * im)) / avg(sqrt(re * re + im * im)), 6) AS variation, round(pow(avg(sqrt(re * re + im * im)), 2) / var_pop(sqrt(re * re + im * im)), 6) AS carrier_ratio FROM s GROUP BY 1")
def envelope_variation(spark, sf_dir):
    a = F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im"))
    g = spectral.samples(table(spark, sf_dir, "embeddings"), ["label"], "embedding").groupBy("label")
    return g.agg(F.round(F.stddev_pop(a) / F.avg(a), 6).alias("variation"), F.round(F.pow(F.avg(a), F.lit(2)) / F.var_pop(a), 6).alias("carrier_ratio"))


@query("""WITH x AS (SELECT vec_id, i, embedding[i + 1]::DOUBLE AS v FROM embeddings, range(64) t(i)), l AS (SELECT a.vec_id, b.i - a.i AS lag, sum(a.v * b.v) AS r FROM x a JOIN x b ON a.vec_id = b.vec_id AND b.i - a.i BETWEEN 1 AND 8 GROUP BY 1, 2)
    SELECT vec_id, lag::INT AS lag, round(r, 6) AS r FROM l""")
def autocorrelation_lag(spark, sf_dir):
    x = F.transform("embedding", lambda v: v.cast("double"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", x.alias("x"), F.explode(F.sequence(F.lit(1), F.lit(8))).alias("lag"))
    return rows.select("vec_id", "lag", F.round(spectral.autocorrelation(F.col("x"), F.col("lag")), 6).alias("r"))


@query(f"WITH {SAMPLES} SELECT vec_id, n, round(re * cos(2 * pi() * 1500 / 32000 * n) - im * sin(2 * pi() * 1500 / 32000 * n), 6) AS re, round(re * sin(2 * pi() * 1500 / 32000 * n) + im * cos(2 * pi() * 1500 / 32000 * n), 6) AS im FROM s")
def freq_offset(spark, sf_dir):
    long = spectral.shifted(spectral.samples(table(spark, sf_dir, "embeddings"), ["vec_id"], "embedding"), 1500.0, RATE)
    return long.select("vec_id", "n", F.round("re", 6).alias("re"), F.round("im", 6).alias("im"))


@query(f"WITH {SAMPLES}, c AS (SELECT vec_id, n, sum(re) OVER (PARTITION BY vec_id ORDER BY n) * 2 * pi() * 3000 / 32000 AS ph FROM s) SELECT vec_id, n, round(cos(ph), 6) AS re, round(sin(ph), 6) AS im FROM c")
def fm_phase_cumsum(spark, sf_dir):
    # Sums within a row: nothing is shuffled.
    e = table(spark, sf_dir, "embeddings").select("vec_id", captures.interleaved_running("embedding", F.array(F.lit(0.0), F.lit(0.0))).alias("sums"))
    long = e.select("vec_id", F.posexplode("sums").alias("p", "s")).filter("p % 2 = 0")
    phase = F.col("s") * F.lit(spectral.TWO_PI * 3000 / RATE)
    return long.select("vec_id", (F.col("p") / 2).cast("int").alias("n"), F.round(F.cos(phase), 6).alias("re"), F.round(F.sin(phase), 6).alias("im"))


@query("""WITH b AS (SELECT vec_id, i, (embedding[i + 1] >= 0)::INT AS bit FROM embeddings, range(64) t(i))
    SELECT vec_id, i::INT AS n, (sum(1 - bit) OVER (PARTITION BY vec_id ORDER BY i) % 2)::INT AS level FROM b""")
def nrzi_encode(spark, sf_dir):
    bits = F.transform(F.col("embedding"), lambda v: (v >= 0).cast("int"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(spectral.nrzi(bits)).alias("n", "level"))


_TAPS = "h(k, w) AS (VALUES " + ", ".join(f"({k}, {w}::DOUBLE)" for k, w in enumerate(TAPS)) + ")"


@query(f"WITH {SAMPLES}, {_TAPS} SELECT vec_id, (n + k)::INT AS n, round(sum(re * w), 6) AS y FROM s, h GROUP BY 1, 2")
def fir_convolve(spark, sf_dir):
    re, _ = spectral.deinterleave(F.col("embedding"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(spectral.convolve(re, TAPS)).alias("n", "y")).select("vec_id", "n", F.round("y", 6).alias("y"))


@query("""WITH t AS (SELECT i, (i - 16) / 8.0::DOUBLE AS t FROM range(33) r(i)),
    r AS (SELECT i, CASE WHEN t = 0 THEN 1 WHEN abs(abs(2 * 0.2::DOUBLE * t) - 1) < 1e-9 THEN pi() / 4 * sin(pi() / (2 * 0.2::DOUBLE)) / (pi() / (2 * 0.2::DOUBLE)) ELSE sin(pi() * t) / (pi() * t) * cos(pi() * 0.2::DOUBLE * t) / (1 - pow(2 * 0.2::DOUBLE * t, 2)) END AS rc,
        exp(-0.5::DOUBLE * 2 * pi() * pi() / ln(2) * pow(0.5::DOUBLE * t, 2)) AS g FROM t)
    SELECT i::INT AS i, round(rc / sum(rc) OVER (), 6) + 0.0::DOUBLE AS rc, round(g / sum(g) OVER (), 6) AS gauss FROM r""")
def filter_taps(spark, sf_dir):
    # Taps depend on constants alone and are computed once, on the driver.
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(dsp.raised_cosine(8, 0.2, 4), dsp.gaussian(8, 0.5, 4), strict=True))]
    return vocab.frame(spark, rows, "i int, rc double, gauss double").select("i", (F.round("rc", 6) + F.lit(0.0)).alias("rc"), F.round("gauss", 6).alias("gauss"))


@query("SELECT vec_id, i::INT AS n, round(embedding[i // 4 + 1]::DOUBLE, 6) AS v FROM embeddings, range(256) t(i)")
def symbol_upsample(spark, sf_dir):
    up = F.flatten(F.transform("embedding", lambda x: F.array_repeat(x, 4)))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(up).alias("n", "v")).select("vec_id", "n", F.round(F.col("v").cast("double"), 6).alias("v"))


@query(f"""WITH {SAMPLES}, k AS (SELECT m, n AS j, sum(CASE WHEN q IN (0, 16) THEN 1 ELSE 2 END * cos(2 * pi() * q * (m / 64.0::DOUBLE - n / 32.0::DOUBLE))) / 32 AS w FROM range(64) a(m), range(32) b(n), range(17) c(q) GROUP BY 1, 2)
    SELECT vec_id, m::INT AS n, round(sum(re * w), 6) AS y FROM s JOIN k ON s.n = k.j GROUP BY 1, 2""")
def fft_resample(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", spectral.deinterleave(F.col("embedding"))[0].alias("x"))
    return e.select("vec_id", F.posexplode(resampled("x")).alias("n", "y")).select("vec_id", "n", F.round("y", 6).alias("y"))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def resampled(x: pd.Series) -> pd.Series:
    """Rows to twice their length, those of one length in one FFT."""
    out = x.copy()
    lengths = x.map(len).to_numpy()
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        rows = _fourier_resample(np.stack([np.asarray(x.iloc[i], dtype=float) for i in at]), 2 * int(n))
        for i, row in zip(at, rows, strict=True):
            out.iloc[i] = row
    return out


_fourier_resample = dsp.fourier_resample
