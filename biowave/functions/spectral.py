"""Arrow functions over array columns: segments of one length are worked on together, as a matrix."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from biowave.functions import kernels as K


TOGETHER = 1 << 19  # samples that are worked on as one matrix, about


def _lots(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Places of arrays of one length, of about TOGETHER samples, so that what their matrix takes doesn't grow with the rows of a batch."""
    for n in np.unique(sizes[sizes > 0]):
        at, rows = np.flatnonzero(sizes == n), max(1, TOGETHER // int(n))
        yield from (at[k : k + rows] for k in range(0, len(at), rows))


def by_length(columns: list[pd.Series], of, n_out: int) -> list[np.ndarray]:
    """of(matrices) for the rows of each length, put back in their places; null or empty arrays give NaN."""
    sizes = columns[0].map(lambda v: -1 if v is None else len(v)).to_numpy()
    out = [np.full(len(sizes), np.nan) for _ in range(n_out)]
    for at in _lots(sizes):
        values = of(*[np.stack(c.to_numpy()[at]).astype(float) for c in columns])
        for o, v in zip(out, values, strict=True):
            o[at] = v
    return out


def features(names: list[str], of, *columns: Column) -> Column:
    """A struct of doubles, one field a name; of takes a matrix per column and returns a dict."""

    @F.pandas_udf(", ".join(f"{n} double" for n in names))
    def run(*series: pd.Series) -> pd.DataFrame:
        got = by_length(list(series), lambda *m: [of(*m)[n] for n in names], len(names))
        return pd.DataFrame(dict(zip(names, got, strict=True)))

    return run(*columns)


def spectral(signal: Column, rate: float) -> Column:
    def of(x):
        return K.spectral_features(x, rate) | {"dominant": K.dominant_frequency(x, rate)}

    return features(["mnf", "mdf", "tp", "mp", "dominant"], of, signal)


def quality(signal: Column, rate: float, size: int, least: int) -> Column:
    return features(["smr_db", "spr_db", "shr_db", "ohm", "dpr_db"], lambda x: K.quality_metrics(x, rate, size, least), signal)


def hampel_energy(signal: Column, half: int, threshold: float) -> Column:
    return features(["removed"], lambda x: {"removed": K.hampel_energy(x, half, threshold)}, signal)["removed"]


def hampel_time(signal: Column, half: int, threshold: float) -> Column:
    """What the Hampel filter replaces in segments: how many values, and the result's sum and power."""

    def of(x):
        out, hit = K.hampel_replaced(x, half, threshold)
        return {"replaced": hit.sum(axis=1), "total": out.sum(axis=1), "power": (out**2).sum(axis=1)}

    return features(["replaced", "total", "power"], of, signal)


def spectral_errors(clean: Column, other: Column, rate: float, size: int, nfft: int, hop: int, low: float, high: float) -> Column:
    """Distances between two segments' spectra: LSD, and the differences of mean and median frequency of their windows."""

    def of(a, b):
        off = lambda f: np.sqrt(((f(a) - f(b)) ** 2).mean(axis=1))
        return {
            "lsd": K.log_spectral_distance(a, b, rate, nfft, hop, low, high),
            "rmse_mnf": off(lambda x: K.frame_mean_frequency(x, rate, size, 4 * size, low, high)),
            "rmse_mdf": off(lambda x: K.window_median_frequency(x, rate, size, 4 * size, low, high)),
        }

    return features(["lsd", "rmse_mnf", "rmse_mdf"], of, clean, other)


def interval_shrunk(signal: Column, by: float) -> Column:
    """Sum, power and runs of segments whose runs between sign changes are shrunk by a part of the universal threshold."""

    def of(x):
        out = np.stack([K.interval_soft(v, K.threshold_of(v) / by) for v in x])
        return {"total": out.sum(axis=1), "power": (out**2).sum(axis=1), "runs": 1.0 + (np.diff(x < 0, axis=1) != 0).sum(axis=1)}

    return features(["total", "power", "runs"], of, signal)


def mapped(signal: Column, of) -> Column:
    """An array column from a function of a matrix of segments."""

    @F.pandas_udf("array<double>")
    def run(series: pd.Series) -> pd.Series:
        out = [None] * len(series)
        sizes = series.map(lambda v: -1 if v is None else len(v)).to_numpy()
        for at in _lots(sizes):
            for k, row in zip(at, of(np.stack(series.to_numpy()[at]).astype(float)), strict=True):
                out[k] = row
        return pd.Series(out, dtype=object)

    return run(signal)
