"""Window and spectrum operators on rows with arrays of interleaved I/Q samples.

Work that stays within a window is done in the row (array functions or one
Arrow function), so nothing is shuffled or exploded before a result needs it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavelake.functions import dsp
from wavelake.functions.dsp import spectrum as _row_spectrum
from wavelake.functions.dsp import to_complex as _to_complex

TWO_PI = 2 * np.pi


def _rows(values: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in values]) if len(values) else np.zeros((0, 2))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def fft_magnitudes(iq: pd.Series) -> pd.Series:
    """Magnitudes of the spectrum of interleaved I/Q, from the most negative frequency on. Windows of equal length go through one FFT."""
    out: list = [None] * len(iq)
    lengths = iq.map(lambda v: 0 if v is None else len(v)).to_numpy()
    for n in set(lengths.tolist()) - {0}:
        at = np.flatnonzero(lengths == n)
        for i, row in zip(at.tolist(), _row_spectrum(_to_complex(_rows(iq.iloc[at]))), strict=True):
            out[i] = row
    return pd.Series(out, dtype=object)


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once for the row, also where f uses it for each element of an array: what stands inside a lambda is computed for each call."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def deinterleave(iq: Column) -> tuple[Column, Column]:
    """I and Q arrays in double precision."""
    wide = F.transform(iq, lambda x: x.cast("double"))
    return F.filter(wide, lambda _, i: i % 2 == 0), F.filter(wide, lambda _, i: i % 2 == 1)


def power(iq: Column) -> Column:
    """Mean of I^2 + Q^2."""
    return F.aggregate(iq, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")) / (F.size(iq) / 2)


def unit_power(iq: Column) -> Column:
    return bound(F.sqrt(F.greatest(power(iq), F.lit(1e-12))), lambda scale: F.transform(iq, lambda x: x.cast("double") / scale))


def samples(rows: DataFrame, keys: list[str], iq: str) -> DataFrame:
    """Long form (keys, n, re, im)."""
    i, q = deinterleave(F.col(iq))
    return rows.select(*keys, F.posexplode(F.arrays_zip(i.alias("re"), q.alias("im"))).alias("n", "s")).select(*keys, "n", F.col("s.re").alias("re"), F.col("s.im").alias("im"))


def bins(rows: DataFrame, keys: list[str], mags: str, spacing: float) -> DataFrame:
    """Long form of spectra: (keys, bin, hz, mag), bins counted from the middle."""
    half = F.floor(F.size(mags) / 2)
    return rows.select(*keys, half.alias("_h"), F.posexplode(mags).alias("_p", "mag")).select(*keys, (F.col("_p") - F.col("_h")).cast("int").alias("bin"), ((F.col("_p") - F.col("_h")) * F.lit(spacing)).alias("hz"), "mag")


def span_above(mags: Column, share: float) -> Column:
    """Bins from the first to the last at `share` of the peak or above, both counted; null for an empty array."""
    at = bound(F.array_max(mags) * share, lambda level: F.transform(mags, lambda m, i: F.when(m >= level, i)))
    return F.array_max(at) - F.array_min(at) + 1


def match_carriers(spectra: DataFrame, keys: list[str], targets: DataFrame, tolerance: float, of_peak: float = 0.08, of_median: float = 2.5) -> DataFrame:
    """The strongest bin within `tolerance` of each target: (keys, target, hz, mag).

    spectra are (keys, hz, mag). The band join goes by buckets of the
    tolerance's width, each bin being offered to its own and the two beside,
    so it is an equi-join whatever the number of targets.
    """
    bucket = lambda c: F.floor(F.col(c) / tolerance).cast("long")
    limits = spectra.groupBy(*keys).agg(F.max("mag").alias("_max"), F.median("mag").alias("_median"))
    offered = spectra.withColumn("_b", F.explode(F.array(*[bucket("hz") + d for d in (-1, 0, 1)])))
    near = offered.join(targets.withColumn("_b", bucket("target")), "_b").filter(F.abs(F.col("hz") - F.col("target")) <= tolerance)
    best = near.groupBy(*keys, "target").agg(F.max(F.struct("mag", (-F.col("hz")).alias("low"))).alias("b"))
    return best.join(limits, keys).filter((F.col("b.mag") >= F.col("_max") * of_peak) & (F.col("b.mag") >= F.col("_median") * of_median)).select(*keys, "target", (-F.col("b.low")).alias("hz"), F.col("b.mag").alias("mag"))


def spacing(found: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and population deviation of the gaps between sorted carriers; 0 and 999 for fewer than two."""
    gap = F.col("hz") - F.lag("hz").over(Window.partitionBy(*keys).orderBy("hz"))
    gaps = found.withColumn("gap", gap).groupBy(*keys).agg(F.count(F.lit(1)).alias("carriers"), F.avg("gap").alias("m"), F.stddev_pop("gap").alias("s"))
    return gaps.select(*keys, "carriers", F.coalesce("m", F.lit(0.0)).alias("spacing_mean"), F.coalesce("s", F.lit(999.0)).alias("spacing_std"))


def walk_bandwidth(rows: DataFrame, mags: str, share: float, step: float) -> Column:
    """Hz between the bins that a walk from the peak stops at, on either side: the first below `share` of the peak, or the edge."""
    m = F.col(mags)

    def width(peak: Column, level: Column) -> Column:
        left = F.array_max(F.transform(m, lambda x, i: F.when((x < level) & (i < peak), i)))
        right = F.array_min(F.transform(m, lambda x, i: F.when((x < level) & (i > peak), i)))
        return F.coalesce(right, F.size(m) - 1) - F.coalesce(left, F.lit(0))

    found = F.struct((F.array_position(m, F.array_max(m)) - 1).alias("peak"), (F.array_max(m) * share).alias("level"))
    return bound(found, lambda b: width(b["peak"], b["level"])) * F.lit(step)


def instantaneous_stats(flat: Column, rate: float) -> Column:
    """Population deviation and mean (hz) of the wrapped phase steps of interleaved samples, within the row; null for fewer than two samples."""
    n = (F.size(flat) / 2).cast("int")
    at = lambda i: F.get(flat, i).cast("double")
    phases = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.atan2(at(2 * i + 1), at(2 * i)))
    # Phases are made once for the row, and so are their differences.
    steps = bound(phases, lambda phase: F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.get(phase, i) - F.get(phase, i - 1)))
    hz = F.transform(steps, lambda d: (d - TWO_PI * F.floor((d + np.pi) / TWO_PI)) * rate / TWO_PI)
    zero = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("m"), F.lit(0.0).alias("s"))

    def add(a: Column, x: Column) -> Column:
        k, off = a["n"] + 1, x - a["m"]
        m = a["m"] + off / k
        return F.struct(k.alias("n"), m.alias("m"), (a["s"] + off * (x - m)).alias("s"))

    return F.when(n > 1, F.aggregate(hz, zero, add, lambda a: F.struct(F.sqrt(a["s"] / a["n"]).alias("deviation"), a["m"].alias("mean_hz"))))


def instantaneous(long: DataFrame, keys: list[str], rate: float) -> DataFrame:
    """(keys, n, hz) from the unwrapped phase step of (keys, n, re, im)."""
    phase = F.atan2("im", "re")
    step = phase - F.lag(phase).over(Window.partitionBy(*keys).orderBy("n"))
    wrapped = step - TWO_PI * F.floor((step + np.pi) / TWO_PI)
    return long.select(*keys, "n", (wrapped * rate / TWO_PI).alias("hz")).filter("hz is not null")


def shifted(long: DataFrame, hz: float, rate: float) -> DataFrame:
    """A frequency offset on long samples."""
    a = F.lit(TWO_PI * hz / rate) * F.col("n")
    return long.withColumns({"re": F.col("re") * F.cos(a) - F.col("im") * F.sin(a), "im": F.col("re") * F.sin(a) + F.col("im") * F.cos(a)})


def autocorrelation(x: Column, lag: Column) -> Column:
    """Sum of x[i] x[i + lag] over an array column."""
    return F.aggregate(F.sequence(F.lit(0), F.size(x) - 1 - lag), F.lit(0.0), lambda a, i: a + F.get(x, i) * F.get(x, i + lag))


def convolve(x: Column, taps: list[float]) -> Column:
    """Full convolution of an array column with fixed taps."""
    h = F.array(*[F.lit(float(t)) for t in taps])
    k = len(taps)
    return F.transform(F.sequence(F.lit(0), F.size(x) + (k - 2)), lambda n: F.aggregate(F.sequence(F.greatest(F.lit(0), n - F.size(x) + 1), F.least(n, F.lit(k - 1))), F.lit(0.0), lambda a, j: a + F.get(x, n - j) * F.get(h, j)))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def nrzi(bits: pd.Series) -> pd.Series:
    """Levels of an array of bits: a zero toggles, a one holds, from 0 on. Rows of one length go through one running sum."""
    out: list = [None if v is None else [] for v in bits]
    lengths = bits.map(lambda v: 0 if v is None else len(v)).to_numpy()
    for n in set(lengths.tolist()) - {0}:
        at = np.flatnonzero(lengths == n)
        for i, row in zip(at.tolist(), np.cumsum(1 - _rows(bits.iloc[at]).astype(np.int64), axis=1) % 2, strict=True):
            out[i] = row
    return pd.Series(out, dtype=object)


def confidence_score(count: Column, mean: Column, std: Column, symbol: Column, qpsk: Column, width: Column) -> Column:
    """Weighted score of the multi-carrier checks, 0 to 1. Weights, targets and soft edges."""
    one, zero = F.lit(1.0), F.lit(0.0)
    clip = lambda c: F.greatest(zero, F.least(one, c))
    off = F.abs(mean - 1300.0)
    spaced = F.when(count < 2, zero).when((off <= 150.0) & (std <= 160.0), one).otherwise(F.greatest(zero, one - off / 150.0) * 0.5 + F.greatest(zero, one - std / 160.0) * 0.5)
    band = F.when((width >= 9000) & (width <= 12000), one).when((width >= 8000) & (width < 9000), (width - 8000) / 1000.0).when((width > 12000) & (width <= 13000), (F.lit(13000.0) - width) / 1000.0).otherwise(zero)
    total = clip(count / 8.0) * 0.40 + spaced * 0.25 + symbol / 8.0 * 0.20 + qpsk / 8.0 * 0.15
    return clip(total * F.when(band > 0.5, one).otherwise(F.lit(0.7)))
