"""Custom-mode plugins: a validator of all windows of a capture, applied by group."""

from __future__ import annotations

from abc import ABC, abstractmethod

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from wavelake.functions.dsp import root_raised_cosine as _rrc
from wavelake.functions.dsp import spectrum as _spectrum
from wavelake.functions.dsp import two_means as _clusters
from wavelake.vocab import CARRIERS

RESULT = "path string, mode_id string, pass_overall boolean, confidence double, carrier_count int, spacing_mean double, spacing_std double, symbol_rates array<double>, symbol_pass array<boolean>, qpsk_pass array<boolean>, total_bandwidth double, carrier_widths array<double>, notes string"
#: Samples of a capture that a plugin looks at, at most.
LONGEST = 192_000


class Validator(ABC):
    """`mode_id` names it; `validate` takes complex samples, their rate and the sidecar's fields and gives the RESULT fields from pass_overall on."""

    mode_id = ""
    description = ""

    @abstractmethod
    def validate(self, samples: np.ndarray, rate: float, metadata: dict) -> dict: ...

    def describe(self) -> dict:
        return {"mode_id": self.mode_id, "description": self.description}


_REGISTRY: dict[str, Validator] = {}


def register(plugin: Validator) -> None:
    """The last registration of an id holds."""
    _REGISTRY[plugin.mode_id] = plugin


def get(mode_id: str) -> Validator | None:
    return _REGISTRY.get(mode_id)


def registered() -> list[str]:
    return sorted(_REGISTRY)


def apply(chunks: DataFrame, mode_id: str, rate: float = 48_000.0) -> DataFrame:
    """RESULT for each path of chunks (path, chunk_idx, i, q). A capture is bounded by the reader's size limit."""
    plugin = get(mode_id)
    if plugin is None:
        raise ValueError(f"no plugin {mode_id}")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk_idx")
        x = np.concatenate([np.asarray(i) + 1j * np.asarray(q) for i, q in zip(pdf["i"], pdf["q"], strict=True)])[:LONGEST]
        return pd.DataFrame([{"path": pdf["path"].iloc[0], "mode_id": plugin.mode_id} | plugin.validate(x, rate, {})])

    return chunks.groupBy("path").applyInPandas(run, RESULT)


#: Width of a carrier in Hz, least and most, where it has fallen to this share of its peak.
WIDTHS, FALLEN = (800.0, 1400.0), 10 ** (-6.0 / 10.0)


def _walk(hz: np.ndarray, mag: np.ndarray, centre: float) -> float:
    """Hz between the first bins on either side of the one nearest to `centre` that lie below its share, or the edges."""
    at = int(np.argmin(np.abs(hz - centre)))
    if mag[at] <= 0:
        return 0.0
    below = np.flatnonzero(mag < FALLEN * mag[at])
    left, right = below[below < at], below[below > at]
    return float(hz[right[0] if len(right) else len(hz) - 1] - hz[left[-1] if len(left) else 0])


class EightCarriers(Validator):
    """Eight parallel QPSK carriers, 900 baud each and 1300 Hz apart.

    `rate_mode` "reference" reports the lag whose rate is nearest to the target,
    as the reference does whatever the signal; "peak" reports the peak of the
    envelope's autocorrelation.
    """

    mode_id = "sleipnir_8qpsk"
    description = "Eight parallel QPSK carriers in one composite stream"

    def __init__(self, rate_mode: str = "reference"):
        self.rate_mode = rate_mode

    def validate(self, samples: np.ndarray, rate: float, metadata: dict) -> dict:
        windows = samples[: len(samples) // 1024 * 1024].reshape(-1, 1024)
        mag = _spectrum(windows).mean(axis=0)
        hz = (np.arange(1024) - 512) * rate / 1024
        peak, middle = mag.max(), np.median(mag)
        found = []
        for target in CARRIERS:
            near = np.flatnonzero(np.abs(hz - target) <= 200.0)
            best = near[np.argmax(mag[near])]
            if mag[best] >= 0.08 * peak and mag[best] >= 2.5 * middle:
                found.append(float(hz[best]))
        widths = [_walk(hz, mag, f) for f in found]
        narrow = all(WIDTHS[0] <= w <= WIDTHS[1] for w in widths)
        gaps = np.diff(np.sort(found))
        mean, std = (float(gaps.mean()), float(gaps.std())) if len(gaps) else (0.0, 999.0)
        within = hz[mag >= 0.1 * peak]
        width = float(within[-1] - within[0]) if len(within) > 1 else 0.0
        rates, symbol_ok, qpsk_ok = [], [], []
        for f in found:
            base = self._band(samples, f, rate)
            r = self._symbol_rate(base, rate)
            rates.append(r)
            symbol_ok.append(bool(abs(r - 900.0) <= 100.0))
            qpsk_ok.append(self._four_points(base, rate))
        spaced = abs(mean - 1300.0) <= 150.0 and std <= 160.0
        score = 1.0 if spaced else 0.5 * max(0.0, 1 - abs(mean - 1300.0) / 150.0) + 0.5 * max(0.0, 1 - std / 160.0)
        band = 1.0 if 9000 <= width <= 12000 else (width - 8000) / 1000 if 8000 <= width < 9000 else (13000 - width) / 1000 if 12000 < width <= 13000 else 0.0
        total = 0.40 * min(len(found) / 8, 1.0) + 0.25 * (score if len(found) > 1 else 0.0) + 0.20 * sum(symbol_ok) / 8 + 0.15 * sum(qpsk_ok) / 8
        confidence = float(np.clip(total * (1.0 if band > 0.5 else 0.7), 0, 1))
        ok = len(found) == 8 and spaced and narrow and sum(symbol_ok) >= 6 and sum(qpsk_ok) >= 6 and 9000 <= width <= 12000
        said = [(len(found) == 8, f"{len(found)} of 8 carriers"), (spaced, f"spacing {mean:.1f} Hz, deviation {std:.1f} Hz"), (narrow, "carrier width out of bounds"), (sum(symbol_ok) >= 6, f"symbol rate holds on {sum(symbol_ok)} carriers"), (sum(qpsk_ok) >= 6, f"four points on {sum(qpsk_ok)} carriers"), (9000 <= width <= 12000, f"total width {width:.0f} Hz")]
        notes = [text for fine, text in said if not fine]
        return {
            "pass_overall": bool(ok), "confidence": confidence, "carrier_count": len(found), "spacing_mean": mean, "spacing_std": std,
            "symbol_rates": rates, "symbol_pass": symbol_ok, "qpsk_pass": qpsk_ok, "total_bandwidth": width,
            "carrier_widths": widths, "notes": "; ".join(notes),
        }

    @staticmethod
    def _band(x: np.ndarray, centre: float, rate: float) -> np.ndarray:
        """The 550 Hz on either side of a carrier, brought down to zero."""
        s = np.fft.fft(x)
        s[np.abs(np.fft.fftfreq(len(x), 1 / rate) - centre) > 550.0] = 0
        return np.fft.ifft(s) * np.exp(-2j * np.pi * centre * np.arange(len(x)) / rate)

    def _symbol_rate(self, x: np.ndarray, rate: float) -> float:
        e = np.abs(x) - np.abs(x).mean()
        n = len(e)
        expected = int(round(rate / 900.0))
        reach = max(8, int(expected * 0.25))
        lags = np.arange(max(8, expected - reach), min(n - 1, expected + reach) + 1)
        if n < 256 or len(lags) < 2:
            return 0.0
        if self.rate_mode == "reference":
            return float(rate / lags[np.argmin(np.abs(rate / lags - 900.0))])
        size = 1 << int(np.ceil(np.log2(2 * n)))
        r = np.fft.irfft(np.abs(np.fft.rfft(e, size)) ** 2)
        return float(rate / lags[np.argmax(r[lags])])

    @staticmethod
    def _four_points(x: np.ndarray, rate: float) -> bool:
        sps = int(round(rate / 900.0))
        shaped = np.convolve(x, _rrc(sps, 0.35, 8, unit_energy=True))[: len(x)]
        points = shaped[4 * sps :: sps]
        if len(points) < 40:
            return False
        points = points[:: max(1, len(points) // 400)]
        p = np.stack([points.real, points.imag], axis=1)
        p = p / (np.percentile(np.abs(p), 95) + 1e-9)
        centres, label = _clusters(p, 4, 8, 42)
        n = np.bincount(label, minlength=4)
        d = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(axis=2))[np.triu_indices(4, 1)].min()
        return bool(n.min() / (n.max() + 1e-9) >= 0.25 and d >= 0.30)


register(EightCarriers())
