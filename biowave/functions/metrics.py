"""Quality metrics of a processed segment against its clean one, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from biowave.functions import arrays as A

EPS = 1e-12


def difference(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda u, v: v - u)


def snr_of(clean_power: Column, error_power: Column) -> Column:
    """dB of one power over the other; 100 where there is no error."""
    return F.when(error_power < EPS, F.lit(100.0)).otherwise(10.0 * F.log10(clean_power / (error_power + EPS)))


def prd_of(clean_power: Column, error_power: Column) -> Column:
    return F.sqrt(error_power / (clean_power + EPS)) * 100.0


def snr(clean: Column, other: Column) -> Column:
    """dB of the clean signal's power over the difference's; 100 where they are alike."""
    return A.let(A.power(difference(clean, other)), lambda error: snr_of(A.power(clean), error))


def snr_gain(clean: Column, denoised: Column, noisy: Column) -> Column:
    return snr(clean, denoised) - snr(clean, noisy)


def rmse(clean: Column, other: Column) -> Column:
    return A.rms(difference(clean, other))


def prd(clean: Column, other: Column) -> Column:
    """Percent root difference."""
    return prd_of(A.power(clean), A.power(difference(clean, other)))


def windows(a: Column, size: int, tail: bool) -> Column:
    """Consecutive windows of a; a shorter last one only with tail."""
    n = (F.ceil if tail else F.floor)(F.size(a) / size).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.slice(a, k * size + 1, size))


def rmse_of(clean: Column, other: Column, size: int, feature, tail: bool = False) -> Column:
    """Root mean squared difference of a feature of corresponding windows."""
    one = F.transform(windows(clean, size, tail), feature)
    two = F.transform(windows(other, size, tail), feature)
    return rmse(one, two)


def mean_rectified(w: Column) -> Column:
    return A.mean(A.absolute(w))


def zero_crossing_rate(rate: float, size: int):
    return lambda w: A.sign_changes(w) / F.lit(size / rate)


def kurtosis(w: Column) -> Column:
    """Excess kurtosis of the population; 0 for a constant."""

    def of(e: Column) -> Column:
        fourth = A.mean(F.transform(w, lambda v: (v - e["m"]) * (v - e["m"]) * (v - e["m"]) * (v - e["m"])))
        return F.when(e["s"] > EPS, fourth / (e["s"] * e["s"] * e["s"] * e["s"]) - 3.0).otherwise(0.0)

    return A.let(F.struct(A.mean(w).alias("m"), A.std(w).alias("s")), of)
