"""Electrocardiogram items of a noise library, from records at 128 samples a second."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biowave.functions import kernels as K
from biowave.operators import draws
from biowave.sources import ranged

RATE = 128
LEVEL = 1e-6  # spread and magnitude that a slice has at least


def prepared(x: np.ndarray, rate: float, size: int, notch_hz: float | None = 60.0, low: float = 20.0, high: float = 500.0) -> np.ndarray:
    """Rows of slices at the library's rate: notch, low-pass at 200 Hz, band, `size` samples (repeated where short)."""
    y = K.resample(x, RATE, rate)
    y = K.without_tone(y, rate, notch_hz, 30.0) if notch_hz else y
    y = K.band_pass(K.low_pass(y, rate, 200.0), rate, low, min(high, rate / 2 * 0.99))
    return np.stack([np.resize(v, size) for v in y]) if len(y) else np.zeros((0, size))


def measured(path: str, seconds: float, rate: float):
    """A function for draws.first_accepted: reads the slices' bytes, prepares them and says which hold a signal."""
    n, size = int(seconds * RATE), int(seconds * rate)

    def of(todo: DataFrame) -> DataFrame:
        slices = ranged.read_slices(path, todo.select("record", "start", F.lit(n).alias("n")).distinct()).drop("bytes")

        def batch(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                x = [np.resize(np.asarray(v, float), n) for v in part["signal"]]  # a slice at a record's end is short
                y = prepared(np.stack(x), rate, size) if len(x) else np.zeros((0, size))
                spread = y.std(axis=1)
                ok = (spread > LEVEL) & (np.abs(y).max(axis=1, initial=0.0) > LEVEL) & np.isfinite(spread)
                yield part[["record", "start"]].assign(signal=list(y), ok=ok)

        got = slices.mapInPandas(batch, "record string, start bigint, signal array<double>, ok boolean")
        return todo.join(got, ["record", "start"], "left").withColumn("ok", F.coalesce("ok", F.lit(False)))

    return of


def items(path: str, records: DataFrame, slots: DataFrame, seconds: float, rate: float, attempts: int = 10, hours: int = 24, per_hour: int = 1) -> tuple[DataFrame, DataFrame]:
    """(library rows, manifest) of ECG slices: records (record, length, split), slots (split, slot, hourly).

    A slot has up to `attempts` attempts; the first slice that isn't flat after preparation is its item.
    """
    plan = draws.slice_plan(records, slots, attempts, int(seconds * RATE), 3600 * RATE, hours, per_hour)
    made = draws.manifest(draws.first_accepted(plan, attempts, measured(path, seconds, rate)))
    library = made.where("status = 'accepted'").select("split", F.lit("ECG").alias("noise_type"), F.lit(None).cast("string").alias("subtype"), F.col("idx").cast("int").alias("idx"), F.col("record").alias("source"), "signal")
    told = made.select("split", "index", "slot", "attempt", "hour", "record", "start", F.when(F.col("ok"), 0).otherwise(1).alias("flagged"), "status")
    return library, told
