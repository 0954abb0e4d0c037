"""Exact order statistics of groups of any size: ranges of values are narrowed by histograms until few values are left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from biowave.operators import scans

BINS = 1024
FEW = 4096  # values of a range that are sorted


def quantile(rows: DataFrame, by: list[str], value: Column, q: float) -> DataFrame:
    """(by, n, quantile): of each group the q-quantile of its values, linear between neighbours, exact; nulls don't count.

    Each round counts the values of a group's range in BINS bins, partially where they are read, and keeps the bin with the wanted
    rank and the extremes of what is really in it; a round's output is a row for each bin. Ranges with at most FEW values
    are sorted. So no task holds a group's values or a map of them. Groups without values give no row. NaN is above all numbers,
    as in sorting; -0.0 is 0.0.
    """
    names = [f"_by{k}" for k in range(len(by))] or ["_all"]
    keys = [F.col(c) for c in by] or [F.lit(0)]
    data = rows.select(*[c.alias(n) for c, n in zip(keys, names, strict=True)], (value.cast("double") + F.lit(0.0)).alias("_v")).where("_v IS NOT NULL")
    state = scans.written(data.groupBy(*names).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high")))
    state = state.withColumn("_rank", F.floor((F.col("_n") - 1) * F.lit(q)).cast("bigint")).withColumn("_below", F.lit(0).cast("bigint")).withColumn("_inside", F.col("_n"))
    ready = None
    while True:
        done = (F.col("_low") == F.col("_high")) | (F.col("_inside") <= FEW)
        found = state.where(done)
        ready = found if ready is None else ready.unionByName(found)
        left = state.where(~done)
        if left.isEmpty():
            break
        state = scans.written(_narrowed(data, left, names))
    ready = scans.written(ready)
    # of what is left the value of the rank and the next one: within the range, or the least value above it
    met = _beside(data, ready, names)
    above = F.min(F.when(F.col("_v") > F.col("_high"), F.col("_v")))
    inside = F.when((F.col("_low") < F.col("_high")) & F.col("_v").between(F.col("_low"), F.col("_high")), F.col("_v"))
    own = [*names, "_n", "_low", "_high", "_rank", "_below", "_inside"]
    last = met.groupBy(*own).agg(F.sort_array(F.collect_list(inside)).alias("_few"), above.alias("_above"))  # FEW at most
    place = (F.col("_rank") - F.col("_below")).cast("int")
    equal = F.col("_low") == F.col("_high")
    first = F.when(equal, F.col("_low")).otherwise(F.get("_few", place))
    second = F.when(place + 1 >= F.col("_inside"), F.col("_above")).when(equal, F.col("_low")).otherwise(F.get("_few", place + 1))
    share = (F.col("_n") - 1) * F.lit(q) - F.col("_rank")
    out = F.when(share > 0, first + (second - first) * share).otherwise(first)
    return last.select(*[F.col(n).alias(c) for c, n in zip(by, names, strict=False)], F.col("_n").alias("n"), out.alias("quantile"))


def _beside(data: DataFrame, state: DataFrame, names: list[str]) -> DataFrame:
    """data with its group's state; rows of a group with all values are split by adaptive execution."""
    other = state.withColumnsRenamed({n: f"_g{n}" for n in names})
    same = F.lit(True)
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(f"_g{n}"))
    return data.join(other, same).drop(*[f"_g{n}" for n in names])


def _narrowed(data: DataFrame, left: DataFrame, names: list[str]) -> DataFrame:
    met = _beside(data, left, names).where(F.col("_v").between(F.col("_low"), F.col("_high")))
    # halves of the ends, for a range that is wider than the largest number; without a width that counts, all but the ends are one bin
    part = F.try_divide(F.col("_v") / 2 - F.col("_low") / 2, F.col("_high") / 2 - F.col("_low") / 2)
    part = F.when(F.col("_v") == F.col("_low"), 0.0).when(F.col("_v") == F.col("_high"), 1.0).otherwise(F.nanvl(F.coalesce(part, F.lit(0.5)), F.lit(0.5)))
    bin_ = F.least(F.floor(part * BINS), F.lit(BINS - 1))
    kept = [*names, "_n", "_rank", "_below"]
    bins = met.groupBy(*kept, bin_.alias("_bin")).agg(F.count(F.lit(1)).alias("_inside"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    before = Window.partitionBy(*kept).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)  # BINS rows a group
    bins = bins.withColumn("_start", F.col("_below") + F.coalesce(F.sum("_inside").over(before), F.lit(0)))
    hit = bins.where((F.col("_rank") >= F.col("_start")) & (F.col("_rank") < F.col("_start") + F.col("_inside")))
    return hit.select(*names, "_n", "_low", "_high", "_rank", F.col("_start").alias("_below"), "_inside")
