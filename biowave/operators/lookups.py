"""Joins of the workflow: splits, recordings, passing sets, coverage and differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_split(index: DataFrame, splits: DataFrame, test_dataset: str) -> DataFrame:
    """index (dataset, subject, ...) with its split; a subject without one tests if its dataset does, else goes."""
    joined = index.join(splits.select("subject", "split"), "subject", "left")
    return joined.withColumn("split", F.coalesce("split", F.when(F.col("dataset") == test_dataset, "test"))).where("split IS NOT NULL")


def first_of(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("_place", place).where("_place = 1").drop("_place")


def coverage(wanted: DataFrame, have: DataFrame, keys: list[str], by: str) -> DataFrame:
    """How many of the wanted keys are there and how many are missing, by a column."""
    hit = wanted.join(have.select(*keys).distinct().withColumn("_hit", F.lit(1)), keys, "left")
    return hit.groupBy(by).agg(F.count("_hit").alias("matched"), (F.count(F.lit(1)) - F.count("_hit")).alias("missing"))


def without_pairs(rows: DataFrame, pairs: list[tuple[int, int]], first: str, second: str) -> DataFrame:
    """rows whose (first, second) isn't one of the listed pairs, a handful of constants; a null is in no pair."""
    listed = F.lit(False)
    for a, b in pairs:
        listed = listed | ((F.col(first) == a) & (F.col(second) == b))
    return rows.where(~F.coalesce(listed, F.lit(False)))


def nearest_choice(rows: DataFrame, items: DataFrame, group: str, index: Column) -> DataFrame:
    """Each row with the item of its group that has the index: items are (group, idx, ...)."""
    return rows.withColumn("idx", index).join(items, [group, "idx"])


def deltas(results: DataFrame, key: str, baseline: str, values: list[str]) -> DataFrame:
    """Each row's values less those of the baseline row; of several the least, and without one the differences are null."""
    base = results.where(F.col(key) == baseline).agg(*[F.min(v).alias(f"_b_{v}") for v in values])  # one row
    return results.join(F.broadcast(base)).select("*", *[(F.col(v) - F.col(f"_b_{v}")).alias(f"d_{v}") for v in values]).drop(*[f"_b_{v}" for v in values])
