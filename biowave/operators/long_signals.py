"""Filters, resampling and windows over recordings of any length, which are pieces (rec, start, signal) without gaps.

A recording is cut into blocks that have the samples about them that their result depends on. What comes out are pieces
again. Filters with a short memory are exact; a recursive one forgets what is further away than its reach, for which K.reach
states how large an error is left.
"""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biowave.functions import kernels as K
from biowave.functions import spectral as X

SIZE = 1 << 16  # samples of a block


def blocks(pieces: DataFrame, size: int = SIZE, before: int = 0, after: int = 0) -> DataFrame:
    """(rec, block, signal, own): block b has the samples from b * size - before to (b + 1) * size + after that there are; its own
    begin at place `own`. Pieces may be of any lengths; a recording with a gap is an error."""
    n = F.size("signal")
    least = F.greatest(F.floor((F.col("start") - after) / size), F.lit(0))
    most = F.ceil((F.col("start") + n + before) / size) - 1
    put = pieces.where(n > 0).select("rec", "start", "signal", F.explode(F.sequence(least, most)).alias("block"))
    first = F.greatest(F.col("start"), F.col("block") * size - before)
    last = F.least(F.col("start") + n, (F.col("block") + 1) * size + after)
    cut = put.where(last > first).select("rec", "block", first.alias("at"), F.slice("signal", (first - F.col("start") + 1).cast("int"), (last - first).cast("int")).alias("part"))
    # at most size + before + after samples
    met = cut.groupBy("rec", "block").agg(F.sort_array(F.collect_list(F.struct("at", "part"))).alias("_parts"))
    begin, end = F.col("_parts")[0]["at"], F.element_at("_parts", -1)
    whole = F.flatten(F.transform("_parts", lambda p: p["part"]))
    met = met.select("rec", "block", whole.alias("signal"), (F.col("block") * size - begin).cast("int").alias("own"), (end["at"] + F.size(end["part"]) - begin).alias("_n"))
    sound = F.when(F.size("signal") == F.col("_n"), F.col("signal")).otherwise(F.raise_error(F.concat(F.lit("recording with a gap or an overlap: "), F.col("rec").cast("string"))))
    return met.where(F.col("_n") > F.col("own")).select("rec", "block", sound.alias("signal"), "own")


def mapped(pieces: DataFrame, of: Callable[[np.ndarray], np.ndarray], before: int, after: int, size: int = SIZE) -> DataFrame:
    """Pieces of `size` samples of what `of` (a matrix to one of its shape) makes of the whole recordings, if no sample of
    its result depends on more than `before` samples before and `after` after it."""
    cut = blocks(pieces, size, before, after).withColumn("_y", X.mapped(F.col("signal"), of))
    return cut.select("rec", (F.col("block") * size).alias("start"), F.slice("_y", F.col("own") + 1, F.lit(size)).alias("signal"))


def zero_phase(pieces: DataFrame, b: np.ndarray, a: np.ndarray, size: int = SIZE, error: float = 1e-10) -> DataFrame:
    """K.zero_phase over whole recordings, off by at most `error` times the largest magnitude of a recording."""
    halo = K.reach(b, a, error)
    return mapped(pieces, lambda x: K.zero_phase(b, a, x), halo, halo, max(size, halo))


def band_pass(pieces: DataFrame, rate: float, low: float, high: float, order: int = 4, size: int = SIZE) -> DataFrame:
    return zero_phase(pieces, *K.butterworth(order, K.band_edges(rate, low, high), "band"), size)


def high_pass(pieces: DataFrame, rate: float, cutoff: float, order: int = 4, size: int = SIZE) -> DataFrame:
    return zero_phase(pieces, *K.butterworth(order, K.edge(rate, cutoff), "high"), size)


def low_pass(pieces: DataFrame, rate: float, cutoff: float, order: int = 4, size: int = SIZE) -> DataFrame:
    return zero_phase(pieces, *K.butterworth(order, K.edge(rate, cutoff), "low"), size)


def without_tone(pieces: DataFrame, rate: float, centre: float, quality: float = 5.0, size: int = SIZE) -> DataFrame:
    return zero_phase(pieces, *K.notch(centre, quality, rate), size) if 0 < centre < rate / 2 else pieces


def resampled(pieces: DataFrame, rate_in: float, rate_out: float, size: int = SIZE, exact: bool = False) -> DataFrame:
    """K.resample over whole recordings: its taps are few, so blocks that begin at whole periods of the ratio are exact."""
    ratio = Fraction(rate_out) / Fraction(rate_in)
    ratio = ratio if exact else ratio.limit_denominator(1000)
    up, down = ratio.numerator, ratio.denominator
    size = -(-size // down) * down
    halo = -(-(10 * max(up, down) // up + 2) // down) * down
    cut = blocks(pieces, size, halo, halo).withColumn("_y", X.mapped(F.col("signal"), lambda x: K.resample(x, rate_in, rate_out, exact)))
    # the last block ends with the recording, the others before their halo
    own = F.least(F.lit(size), F.size("signal") - F.col("own"))
    n_out = F.ceil(own * up / down).cast("int")
    first = (F.col("own") / down).cast("int") * up
    return cut.select("rec", (F.col("block") * (size // down * up)).alias("start"), F.slice("_y", first + 1, n_out).alias("signal"))


def hampel_windows(pieces: DataFrame, rate: float, seconds: float = 2.0, hop: float = 1.0, size: int = SIZE) -> DataFrame:
    """(rec, n, largest, mean): the share of energy that the Hampel filter takes from windows of whole recordings; recordings shorter
    than a window give no row. A window belongs to the block that it begins in."""
    width, step = round(seconds * rate), max(1, round(hop * rate))
    size = -(-size // step) * step
    cut = blocks(pieces, size, 0, width - 1)

    def of(x: np.ndarray) -> np.ndarray:
        starts = np.arange(0, min(size, x.shape[1] - width + 1), step)
        windows = np.lib.stride_tricks.sliding_window_view(x, width, axis=1)[:, starts] if len(starts) else np.zeros((len(x), 0, width))
        return K.hampel_energy(windows.reshape(-1, width)).reshape(len(x), -1)

    shares = cut.where(F.size("signal") >= width).select("rec", F.explode(X.mapped(F.col("signal"), of)).alias("share"))
    return shares.groupBy("rec").agg(F.count("share").alias("n"), F.max("share").alias("largest"), F.avg("share").alias("mean"))


def pieces_of(samples: DataFrame, value: Column, size: int = SIZE, index: str = "i") -> DataFrame:
    """Samples (rec, index from 0 without gaps) as pieces."""
    rows = samples.select("rec", F.floor(F.col(index) / size).alias("_k"), F.struct(F.col(index).alias("i"), value.alias("x")).alias("_s"))
    met = rows.groupBy("rec", "_k").agg(F.sort_array(F.collect_list("_s")).alias("_s"))
    return met.select("rec", F.col("_s")[0]["i"].cast("bigint").alias("start"), F.transform("_s", lambda s: s["x"]).alias("signal"))
