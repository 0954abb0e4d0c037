"""Summary tables with margins that pool rows, never averages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def summary(value: str = "value") -> list[Column]:
    """Mean, sample standard deviation (0 for one row) and number."""
    return [
        F.avg(value).alias("mean"),
        F.when(F.count(value) == 1, F.lit(0.0)).otherwise(F.stddev_samp(value)).alias("std"),
        F.count(value).alias("n"),
    ]


def cube_summary(rows: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Every combination of keys and its margins; a margin's key is `Avg`."""
    named = rows.where(finite(F.col(value))).select(*[F.col(k).cast("string").alias(k) for k in keys], value)
    return named.cube(*keys).agg(*summary(value), *[F.grouping(k).alias(f"_g{k}") for k in keys]).select(
        *[F.when(F.col(f"_g{k}") == 1, "Avg").otherwise(F.col(k)).alias(k) for k in keys], "mean", "std", "n"
    )


def pivoted(rows: DataFrame, key: str, across: str, values: list[str], value: str = "value", prefix: str = "") -> DataFrame:
    """Means of key x across with an Avg row and column, both over rows."""
    cubed = cube_summary(rows, [key, across], value)
    wide = cubed.groupBy(key).pivot(across, [*values, "Avg"]).agg(F.first("mean"))
    return wide.select(key, *[F.col(f"`{v}`").alias(f"{prefix}{v}" if v != "Avg" else "avg") for v in values], F.col("Avg").alias("avg"))


def label_table(rows: DataFrame, label: str, metrics: list[str], order: tuple[str, ...]) -> DataFrame:
    """Mean, spread and number of every metric by label, with each label's place: that in `order`, the others after it."""
    named = {"mean": 0, "std": 1, "n": 2}
    parts = [summary(f"_{m}")[k].alias(f"{m}_{s}") for m in metrics for s, k in named.items()]
    whole = rows.select(label, *[F.when(finite(F.col(m)), F.col(m)).alias(f"_{m}") for m in metrics]).groupBy(label).agg(*parts)
    at = F.array_position(F.array(*map(F.lit, order)), F.col(label)).cast("int")
    return whole.withColumn("place", F.when(at > 0, at).otherwise(len(order) + 1))
