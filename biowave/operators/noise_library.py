"""Noise library: rows of (noise_type, subtype, idx, source, signal), each from its own seed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biowave.functions import kernels as K

SCHEMA = "noise_type string, subtype string, idx int, source string, signal array<double>"


def _unit(x: np.ndarray) -> np.ndarray:
    return x / x.std() if x.std() > 0 else x


def line(rng, n: int, rate: float, harmonics: int = 5, decay: float = 1.0, drift: float = 0.3) -> np.ndarray:
    """Power-line interference: a drifting fundamental of 50 or 60 Hz and harmonics that decay, at random phases."""
    f = rng.choice([50.0, 60.0]) + rng.uniform(-drift, drift)
    k = np.arange(1, harmonics + 1)[:, None]
    waves = np.sin(2 * np.pi * (k * f * np.arange(n) / rate + rng.random((harmonics, 1)))) / k**decay
    return _unit(waves.sum(axis=0))


def coloured(rng, n: int, rate: float, exponent: float) -> np.ndarray:
    """Noise with a power that falls as frequency to the exponent: 1 pink, 2 brown."""
    f = np.fft.rfftfreq(n, 1 / rate)
    f[0] = 1e-10
    return _unit(np.fft.irfft((rng.standard_normal(len(f)) + 1j * rng.standard_normal(len(f))) / f ** (exponent / 2), n))


def from_jobs(jobs: DataFrame, n: int, rate: float, seed: int = 42, low: float = 20.0, high: float = 500.0) -> DataFrame:
    """PLI, WGN and Color rows of jobs (noise_type, idx), band-passed; row k of a type has a seed of its own, so any task gives the same.

    The jobs are a table of any size. Every second coloured row is pink, the others brown; jobs of other types give no row.
    """

    def batch(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows, x = [], np.zeros((len(part), n))
            for at, (t, k) in enumerate(zip(part["noise_type"], part["idx"], strict=True)):
                rng = np.random.default_rng([seed, sum(map(ord, t)), int(k)])
                kind = ("pink", "brown")[k % 2] if t == "Color" else None
                x[at] = line(rng, n, rate) if t == "PLI" else rng.standard_normal(n) if t == "WGN" else coloured(rng, n, rate, 1.0 if kind == "pink" else 2.0)
                rows.append((t, kind, k, "synthetic"))
            out = pd.DataFrame(rows, columns=["noise_type", "subtype", "idx", "source"])
            yield out.assign(signal=list(K.band_pass(x, rate, low, min(high, rate / 2 * 0.99))) if len(x) else [])

    return jobs.where(F.col("noise_type").isin("PLI", "WGN", "Color")).select("noise_type", F.col("idx").cast("int").alias("idx")).mapInPandas(batch, SCHEMA)


def synthesize(spark: SparkSession, counts: dict[str, int], n: int, rate: float, seed: int = 42, low: float = 20.0, high: float = 500.0) -> DataFrame:
    """The rows of from_jobs for numbers of items by type."""
    jobs = [(t, k) for t, c in counts.items() for k in range(c)]
    return from_jobs(spark.createDataFrame(jobs, "noise_type string, idx int").repartition(max(1, len(jobs) // 8)), n, rate, seed, low, high)


def from_recordings(rows: DataFrame, noise_type: str, rate_in: float, rate: float, n: int, smooth: int = 0, notch_hz: float = 60.0, low: float = 20.0, high: float = 500.0) -> DataFrame:
    """Noise rows from recorded ones (source, idx, signal): notch, smoothing with every second sample, resampling, band, n samples.

    Flat recordings and those under 256 samples give no row. A longer one is cut at an offset from its key's hash.
    """

    def batch(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for source, idx, v in zip(part["source"], part["idx"], part["signal"], strict=True):
                x = np.zeros(0) if v is None else np.asarray(v, float)
                if len(x) < 256 or np.ptp(x) < 1e-9:
                    continue
                y, r = K.without_tone(x[None], rate_in, notch_hz, 30.0), rate_in
                if smooth:
                    y, r = np.convolve(y[0], np.ones(smooth) / smooth, "valid")[None, ::2], rate_in / 2
                y = K.band_pass(K.resample(y, r, rate), rate, low, min(high, rate / 2 * 0.99))[0]
                if len(y) > n:
                    start = np.random.default_rng([len(x), int(idx)]).integers(0, len(y) - n + 1)
                    y = y[start : start + n]
                out.append((noise_type, None, idx, source, np.resize(y, n)))
            yield pd.DataFrame(out, columns=["noise_type", "subtype", "idx", "source", "signal"])

    return rows.select("source", F.col("idx").cast("int").alias("idx"), "signal").mapInPandas(batch, SCHEMA)
