"""What gesture trials go through before a classifier: channels as arrays, each on its own."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column

from biowave.functions import arrays as A
from biowave.functions import kernels as K
from biowave.functions import spectral as X


def from_raw(signal: Column, rate: int, target: int, low: float = 20.0, high: float = 500.0) -> Column:
    """Band-passed at its own rate, resampled to the target rate and scaled to 0 .. 1."""

    def of(x: np.ndarray) -> np.ndarray:
        y = K.resample(K.band_pass(x, rate, low, min(high, rate / 2 * 0.99)), rate, target)
        span = np.ptp(y, axis=1, keepdims=True)
        return (y - y.min(axis=1, keepdims=True)) / np.where(span < A.TINY, 1.0, span)

    return X.mapped(signal, of)


def from_denoised(signal: Column) -> Column:
    """A signal that has the target rate already: scaled to 0 .. 1."""
    return A.min_max(signal)


def sampled(normalized: Column, ratio: int) -> Column:
    """Of every `ratio` values the largest; with ratio 1 the signal itself, as for what is recorded at the output rate."""
    return normalized if ratio == 1 else A.decimated(normalized, ratio)
