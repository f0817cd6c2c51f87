"""Labelled synthetic windows: one row of a grid (class, SNR, number) is one window, whatever the partitioning."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavelake import vocab
from wavelake.functions.dsp import add_noise, butterworth, fm, gaussian, nrzi, polyphase_up, raised_cosine, root_raised_cosine, same, sections, shift, unit_power
from wavelake.functions.dsp import envelope_variation as _envelope
from wavelake.functions.dsp import instantaneous_frequency as _instantaneous
from wavelake.functions.dsp import occupied_bandwidth as _occupied
from wavelake.vocab import BANDWIDTH, CHUNK, FSK4, SNR_LEVELS, SYNTHETIC

RATE = 48_000.0
WIDE_RATE = 480_000.0
SCHEMA = "class string, family string, snr_db float, number long, i array<float>, q array<float>"
#: Deviation (Hz) and audio ceiling (Hz) of the narrow FM classes, and of the others their kind.
NBFM = {"NBFM_25": (2500.0, 800.0), "NBFM_50": (5000.0, 1500.0)}
SQUELCH = {"NFM_CTCSS": 2500.0, "NFM_DCS": 2500.0}
PSK = {"BPSK": 2, "QPSK": 4, "8PSK": 8}
GMSK = {"GMSK_BT05": (0.5, 4800.0), "GMSK_BT03": (0.3, 4800.0)}
AIR = {"AM_AIR_25K": 3400.0, "AM_AIR_833": 2500.0}


def audio(rng: np.random.Generator, n: int, low: float, high: float, rate: float) -> np.ndarray:
    """Band-limited noise of peak 1, after the filter has settled."""
    x = sections(butterworth(4, low, high, rate), rng.standard_normal((1, n + 512)))[0, 512:]
    return x / max(np.abs(x).max(), 1e-9)


def symbols_to_samples(levels: np.ndarray, taps: np.ndarray, sps: int, n: int) -> np.ndarray:
    held = np.zeros(len(levels) * sps, dtype=levels.dtype)
    held[::sps] = levels
    out = same(held, taps * sps)
    start = 4 * sps
    return out[start : start + n]


def clean(name: str, rng: np.random.Generator, n: int = CHUNK, rate: float = RATE) -> np.ndarray:
    """One noiseless window of a class."""
    if name in NBFM:
        deviation, ceiling = NBFM[name]
        return fm(audio(rng, n, 300.0, ceiling, rate), deviation * 0.5, rate)
    if name in SQUELCH:
        voice = audio(rng, n, 300.0, 1500.0, rate) * 0.6
        t = np.arange(n) / rate
        if name == "NFM_CTCSS":
            tone = 0.15 * np.sin(2 * np.pi * rng.uniform(67.0, 250.3) * t + rng.uniform(0, 2 * np.pi))
        else:
            bits = rng.integers(0, 2, int(n / rate * 134.4) + 2) * 2.0 - 1.0
            tone = 0.15 * bits[np.minimum((t * 134.4).astype(int), len(bits) - 1)]
        return fm(voice + tone, SQUELCH[name], rate)
    if name == "WBFM":
        low = audio(rng, n // 6 + 1, 50.0, 3500.0, rate / 6)
        return fm(polyphase_up(low[None], 6)[0, :n], 75_000.0 * 0.3, WIDE_RATE)
    if name in AIR:
        return (1 + 0.7 * audio(rng, n, 300.0, AIR[name], rate)).astype(complex)
    if name in PSK:
        m, sps = PSK[name], 8
        points = np.exp(2j * np.pi * (rng.integers(0, m, n // sps + 12) + 0.5) / m)
        return symbols_to_samples(points, root_raised_cosine(sps, 0.35, 8), sps, n)
    if name in FSK4:
        baud, inner, outer, pulse, alpha, span = FSK4[name]
        sps = int(rate / baud)
        taps = {"rc": raised_cosine, "rrc": root_raised_cosine, "gauss": gaussian}[pulse](sps, alpha, span)
        levels = np.array([-outer, -inner, inner, outer])[rng.integers(0, 4, n // sps + 12)]
        return fm(symbols_to_samples(levels, taps, sps, n), 1.0, rate)
    if name == "BELL202":
        bits = nrzi(rng.integers(0, 2, n // 40 + 2))
        tone = np.where(np.repeat(bits, 40)[:n] == 1, 1200.0, 2200.0)
        return fm(np.sin(np.cumsum(2 * np.pi * tone / rate)), 3000.0, rate)
    if name == "G3RUH":
        sps = 5
        bits = rng.integers(0, 2, n // sps + 12) * 2.0 - 1.0
        return fm(symbols_to_samples(bits, gaussian(sps, 0.5, 4), sps, n), 3000.0, rate)
    if name in GMSK:
        bt, baud = GMSK[name]
        sps = int(rate / baud)
        bits = rng.integers(0, 2, n // sps + 12) * 2.0 - 1.0
        return fm(symbols_to_samples(bits, gaussian(sps, bt, 4), sps, n), baud / 4, rate)
    raise ValueError(f"no generator for {name}")


def generator(seed: int, name: str, snr: float, number: int) -> np.random.Generator:
    return np.random.default_rng(np.random.SeedSequence([seed, zlib.crc32(name.encode()), int(snr) + 1000, number]))


def _windows(seed: int):
    def run(frames):
        for pdf in frames:
            out = []
            for name, family, snr, number in zip(pdf["class"], pdf["family"], pdf["snr_db"], pdf["number"], strict=True):
                rng = generator(seed, name, snr, number)
                rate = WIDE_RATE if name == "WBFM" else RATE
                x = add_noise(shift(clean(name, rng), rng.uniform(-200, 200), rate), float(snr), rng)
                x = unit_power(x).astype(np.complex64)
                out.append((name, family, snr, number, x.real, x.imag))
            yield pd.DataFrame(out, columns=["class", "family", "snr_db", "number", "i", "q"])

    return run


def grid(spark: SparkSession, classes: list[str] | None = None, per_snr: int = 1000, snrs: list[int] | None = None) -> DataFrame:
    """(class, family, snr_db, number): a row for each window to make."""
    families = {o: f for f, v in SYNTHETIC.items() for o in v}
    names = classes or sorted(families)
    unknown = [n for n in names if n not in families]
    if unknown:
        raise ValueError(f"unknown classes: {', '.join(unknown)}")
    pairs = vocab.frame(spark, [(n, families[n], float(s)) for n in names for s in (snrs or SNR_LEVELS)], "class string, family string, snr_db float")
    # A few hundred pairs against any number of windows.
    return spark.range(per_snr).withColumnRenamed("id", "number").crossJoin(F.broadcast(pairs)).select("class", "family", "snr_db", "number")


def generate(spark: SparkSession, classes: list[str] | None = None, per_snr: int = 1000, snrs: list[int] | None = None, seed: int = 42) -> DataFrame:
    return grid(spark, classes, per_snr, snrs).mapInPandas(_windows(seed), SCHEMA)


def check(name: str, x: np.ndarray, rate: float) -> list[str]:
    """What a clean reference fails: bandwidth, envelope and frequency bounds of its class. Fixed values."""
    failed = []
    if name not in PSK and name not in GMSK and name != "G3RUH" and name in BANDWIDTH and float(np.percentile(_occupied(x[None], rate), 95)) > BANDWIDTH[name]:
        failed.append("bandwidth")
    f = _instantaneous(x, rate)
    if name in FSK4:
        inner, outer = FSK4[name][1:3]
        failed += ["deviation"] * (not 0.3 * inner <= f.std() <= 3 * outer) + ["envelope"] * (_envelope(x) > 0.15)
    if name in GMSK:
        failed += ["deviation"] * (not 0.3 * 1200 <= f.std() <= 2.5 * 1200) + ["envelope"] * (_envelope(x) > 0.08)
    if name in SQUELCH or name == "BELL202":
        failed += ["envelope"] * (_envelope(x) > 0.05)
    if name == "P25":
        failed += ["deviation"] * (not 500 <= f.std() <= 1500)
    if name in SQUELCH or name == "BELL202":
        power = np.abs(np.fft.rfft(f)) ** 2
        hz = np.fft.rfftfreq(len(f), 1.0 / rate)
        at = lambda x: power[np.argmin(np.abs(hz - x))]
        top = lambda a, b: power[(hz >= a) & (hz <= b)].max()
        if name == "NFM_CTCSS":
            failed += ["tone"] * int(top(60, 260) < 0.02 * power.max())
        elif name == "NFM_DCS":
            failed += ["tone"] * int(top(20, 250) < 0.005 * power.max())
        else:
            failed += ["tones"] * int(min(at(1200), at(2200)) < 5 * at(100))
    if name == "G3RUH":
        failed += ["deviation"] * (not 800 <= f.std() <= 4500) + ["envelope"] * (_envelope(x) > 0.15)
    return failed


def verify(spark: SparkSession, classes: list[str] | None = None, seed: int = 42) -> DataFrame:
    """(class, failed): the checks that a clean window of each class fails; none should."""
    def run(frames):
        for pdf in frames:
            yield pd.DataFrame([(n, check(n, clean(n, generator(seed, n, 0, 0)), WIDE_RATE if n == "WBFM" else RATE)) for n in pdf["class"]], columns=["class", "failed"])

    return grid(spark, classes, 1, [0]).select("class").mapInPandas(run, "class string, failed array<string>")


def eight_carriers(n: int, rng: np.random.Generator, offsets: list[float] | None = None, baud: float = 900.0, rate: float = RATE) -> np.ndarray:
    """The sum of parallel QPSK carriers."""
    sps = int(round(rate / baud))
    out = np.zeros(n, dtype=complex)
    for hz in offsets if offsets is not None else vocab.CARRIERS:
        points = np.exp(2j * np.pi * (rng.integers(0, 4, n // sps + 14) + 0.5) / 4)
        out += shift(symbols_to_samples(points, root_raised_cosine(sps, 0.35, 8), sps, n), hz, rate)
    return unit_power(out)
