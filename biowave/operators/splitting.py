"""Subject-level splits, folds and deterministic samples: choices come from ranks and hashes of keys, never from row order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from biowave.operators import scans

RANGE_BITS = 12  # of the hash, by which a label is cut into ranges


def key_number(*keys: Column, salt: str = "", digits: int = 8) -> Column:
    """A number of the keys' MD5, the same on every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[k.cast("string") for k in keys], F.lit(salt))), 1, digits), 16, 10).cast("bigint")


def subject_split(subjects: DataFrame, test_dataset: str, train_ratio: float = 0.8, least_valid: int = 2) -> DataFrame:
    """subjects (dataset, subject, segments) with split: one dataset tests; of each other every so-manieth subject by size validates.

    Of n ranked subjects (ascending segments, then name) n_valid evenly spaced ones are taken; a single one trains.
    """
    ranked = _ranked(subjects)
    wanted = F.bround((1.0 - F.lit(train_ratio)) * F.col("_n")).cast("int")
    ranked = ranked.withColumn("_v", F.least(F.greatest(wanted, F.lit(least_valid)), F.col("_n") - 1).cast("int"))
    # place k of linspace(0, n - 1, v), cut to whole numbers; a rank can only be that of a k next to its quotient
    last = F.greatest(F.col("_v") - 1, F.lit(0))
    step = (F.col("_n") - 1) / F.greatest(F.col("_v") - 1, F.lit(1))
    near = F.floor(F.col("_rank") / step)
    taken = F.lit(False)
    for k in (near - 1, near, near + 1, near + 2):
        taken = taken | ((k >= 0) & (k <= last) & (F.floor(k * step) == F.col("_rank")))
    split = F.when(F.col("dataset") == test_dataset, "test").when((F.col("_n") > 1) & taken, "valid").otherwise("train")
    return ranked.withColumn("split", split).drop("_rank", "_n", "_v")


def _ranked(subjects: DataFrame) -> DataFrame:
    """subjects with _rank from 0 (by segments, then name) and _n, the number of their dataset's.

    A dataset is ranked in ranges of its segments, moved by the sizes of the ranges before, so that none is one task.
    """
    width = F.greatest(F.ceil((F.col("_most") - F.col("_least") + 1) / (1 << RANGE_BITS)), F.lit(1))
    subjects = scans.written(subjects)
    ends = subjects.groupBy("dataset").agg(F.min("segments").alias("_least"), F.max("segments").alias("_most"))  # a row a dataset
    ends = ends.select(F.col("dataset").alias("_of"), "_least", width.alias("_width"))
    # subjects without a number of segments come first
    parted = subjects.join(ends, F.col("dataset").eqNullSafe(F.col("_of"))).withColumn("_range", F.coalesce(F.floor((F.col("segments") - F.col("_least")) / F.col("_width")), F.lit(-1).cast("bigint"))).drop("_of", "_least", "_width")
    by = Window.partitionBy("_of").orderBy("_at")  # at most 2 ** RANGE_BITS rows a dataset, and one
    sizes = parted.groupBy(F.col("dataset").alias("_of"), F.col("_range").alias("_at")).agg(F.count(F.lit(1)).alias("_in"))
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_of", "_at", F.coalesce(F.sum("_in").over(before), F.lit(0)).alias("_start"), F.sum("_in").over(Window.partitionBy("_of")).alias("_n"))
    own = Window.partitionBy("dataset", "_range").orderBy("segments", "subject")
    numbered = parted.withColumn("_row", F.row_number().over(own) - 1)
    numbered = numbered.join(starts, F.col("dataset").eqNullSafe(F.col("_of")) & (F.col("_range") == F.col("_at")))
    return numbered.withColumn("_rank", F.col("_start") + F.col("_row")).drop("_range", "_row", "_of", "_at", "_start")


def split_summary(split: DataFrame) -> DataFrame:
    """Subjects and segments of each split."""
    return split.groupBy("split").agg(F.count(F.lit(1)).alias("subjects"), F.sum("segments").alias("segments"))


def split_report(split: DataFrame, test_dataset: str) -> str:
    """The datasets of a subject split as text, those that had too few subjects to validate, and the splits' sizes; counts come to the driver."""
    by = split.groupBy("dataset").agg(F.count(F.lit(1)).alias("subjects"), F.sum("segments").alias("segments")).orderBy("dataset").collect()
    sizes = {r["split"]: (r["subjects"], r["segments"]) for r in split_summary(split).collect()}
    few = [f"  {r['dataset']}: subjects {r['subjects']}, none validates" for r in by if r["dataset"] != test_dataset and r["subjects"] <= 1]
    lines = ["Subject split", "", *[f"  {r['dataset']}: subjects {r['subjects']}, segments {r['segments']}" for r in by], *(["", "too few", *few] if few else []), ""]
    return "\n".join(lines + [f"{s}: subjects {sizes.get(s, (0, 0))[0]}, segments {sizes.get(s, (0, 0))[1]}" for s in ("train", "valid", "test")]) + "\n"


def stratified_folds(rows: DataFrame, key: str, label: str, folds: int, salt: str = "fold") -> DataFrame:
    """rows with a fold each: every label's rows are dealt in turn, in the order of a hash of the key.

    A label is numbered in ranges of the hash, moved by the sizes of the ranges before, so that no label is one task.
    """
    parted = rows.withColumn("_number", key_number(F.col(key), salt=salt)).withColumn("_range", F.shiftright("_number", 32 - RANGE_BITS))
    before = Window.partitionBy("_label").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)  # at most 2 ** RANGE_BITS rows a label
    sizes = parted.groupBy(F.col(label).alias("_label"), F.col("_range").alias("_of")).agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select("_label", "_of", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = Window.partitionBy(label, "_range").orderBy("_number", key)
    numbered = parted.withColumn("_row", F.row_number().over(own) - 1)
    numbered = numbered.join(starts, F.col(label).eqNullSafe(F.col("_label")) & (F.col("_range") == F.col("_of")))
    return numbered.withColumn("fold", ((F.col("_start") + F.col("_row")) % folds).cast("int")).drop("_number", "_range", "_row", "_label", "_of", "_start")


def keyed_sample(rows: DataFrame, by: list[str], key: str, n: int, salt: str = "sample") -> DataFrame:
    """n rows of each group, those with the smallest hashes of the key."""
    order = Window.partitionBy(*by).orderBy(key_number(F.col(key), salt=salt), key)
    return rows.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= n).drop("_place")
