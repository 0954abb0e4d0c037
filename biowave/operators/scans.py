"""Ordered scans over recordings that are too long for one task.

Rows have a recording (rec), an order, and _part, the stretch of the recording that they lie in. Windows are by (rec, _part);
what a stretch must know of the ones before it is worked out from one summary row a stretch, in a first pass over the
rows that is written, and comes to it as a row of its own, a seam, that sorts before (or after) the stretch's rows and is
dropped when the window has passed it on. So the longest sort is one stretch, and the only window over a whole
recording is that over its summaries, one for PART samples.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART = 65_536  # samples of a stretch, about
KEY = ["rec", "_part"]


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the folder that spark.checkpoint.dir names; in a temporary one only where none is set, as in tests."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = tempfile.mkdtemp(prefix="biowave-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base}/biowave/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parted(rows: DataFrame, index: str = "i") -> DataFrame:
    """rows with their stretches, by a number that counts a recording's samples."""
    return rows.withColumn("_part", F.floor(F.col(index) / PART))


def parted_by_time(rows: DataFrame, time: str) -> DataFrame:
    """rows with their stretches, where only a time (bigint) orders them: a recording with over PART rows is cut into equal times, about
    PART rows each. Recordings below that, and rows without one, are one stretch."""
    size = rows.groupBy("rec").agg(F.count(F.lit(1)).alias("_n"), F.min(time).alias("_lo"), F.max(time).alias("_hi")).where(F.col("_n") > PART)
    width = F.ceil((F.col("_hi") - F.col("_lo") + 1) / F.ceil(F.col("_n") / PART))
    cut = rows.join(size.select("rec", "_lo", width.alias("_width")), "rec", "left")
    return cut.withColumn("_part", F.coalesce(F.floor((F.col(time) - F.col("_lo")) / F.col("_width")), F.lit(0).cast("bigint"))).drop("_lo", "_width")


def beside(rows: DataFrame, levels: DataFrame) -> DataFrame:
    """rows with what levels has of their recordings, one row each; rows without a recording are one, too."""
    return rows.join(levels.withColumnRenamed("rec", "_rec"), F.col("rec").eqNullSafe(F.col("_rec"))).drop("_rec")


def _before() -> Window:
    return Window.partitionBy("rec").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)


def _stretches(order: list) -> Window:
    return Window.partitionBy(*KEY).orderBy(F.col("_own").asc(), *order)


def _with_seams(rows: DataFrame, seams: DataFrame) -> DataFrame:
    """rows, of which _own is true, and the seams, which lack most columns and sort before them."""
    return rows.withColumn("_own", F.lit(True)).unionByName(seams.withColumn("_own", F.lit(False)), allowMissingColumns=True)


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with their place from 0 in their recording: places in a stretch, moved by the rows of the stretches before."""
    sizes = written(rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_n")))
    seams = sizes.select(*KEY, F.sum("_n").over(_before()).alias("_base")).where("_base > 0")
    both = _with_seams(rows, seams)
    in_order = _stretches([F.col(c) for c in order])
    place = F.sum(F.when(F.col("_own"), 1).otherwise(F.col("_base"))).over(in_order.rowsBetween(Window.unboundedPreceding, 0)) - 1
    return both.withColumn(name, place).where("_own").drop("_own", "_base")


def previous(rows: DataFrame, value: str, name: str, order: str = "i") -> DataFrame:
    """rows with the value of the row before in their recording."""
    lasts = written(rows.groupBy(*KEY).agg(F.max_by(value, order).alias(value)))
    seams = lasts.select(*KEY, F.lag(value).over(Window.partitionBy("rec").orderBy("_part")).alias(value))
    return _with_seams(rows, seams).withColumn(name, F.lag(value).over(_stretches([F.col(order)]))).where("_own").drop("_own")


def runs(rows: DataFrame, name: str, index: str = "i") -> DataFrame:
    """rows with the index at which their run of consecutive indices begins."""
    here = Window.partitionBy(*KEY).orderBy(index)
    starts = F.when(F.coalesce(F.lag(index).over(here) + 1 != F.col(index), F.lit(True)), F.col(index))
    ends = rows.withColumn("_start", starts).groupBy(*KEY).agg(F.min(index).alias("_first"), F.max(index).alias("_last"), F.max("_start").alias("_start"))
    ends = written(ends).withColumn("_met", F.lag("_last").over(Window.partitionBy("rec").orderBy("_part")) + 1 == F.col("_first"))
    # a stretch that is one run, and goes on with the one before, begins none
    begun = F.when(~(F.coalesce("_met", F.lit(False)) & (F.col("_start") == F.col("_first"))), F.col("_start"))
    seams = ends.withColumn("_carried", F.max(begun).over(_before())).where("_met").select(*KEY, (F.col("_first") - 1).alias(index), "_carried")
    both = _with_seams(rows, seams)
    order = _stretches([F.col(index)])
    start = F.when(~F.col("_own"), F.col("_carried")).when(F.coalesce(F.lag(index).over(order) + 1 != F.col(index), F.lit(True)), F.col(index))
    found = both.withColumn("_start", start).withColumn(name, F.max("_start").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return found.where("_own").drop("_own", "_carried", "_start")


def changes(rows: DataFrame, value: str, name: str, order: str = "i") -> DataFrame:
    """rows with the number of times that value has changed in their recording so far."""
    differs = lambda before: F.when(F.col(value) != before, 1).otherwise(0)
    here = Window.partitionBy(*KEY).orderBy(order)
    ends = rows.withColumn("_n", differs(F.lag(value).over(here))).groupBy(*KEY).agg(
        F.min_by(value, order).alias("_first"), F.max_by(value, order).alias(value), F.sum("_n").alias("_n")
    )
    by_part = Window.partitionBy("rec").orderBy("_part")
    ends = written(ends).withColumn("_before", F.lag(value).over(by_part)).withColumn("_part_before", F.lag("_part").over(by_part))
    total = F.sum(F.col("_n") + F.when(F.col("_first") != F.col("_before"), 1).otherwise(0)).over(_before())
    seams = ends.select(*KEY, F.col("_before").alias(value), total.alias("_base"), "_part_before").where("_part_before IS NOT NULL").drop("_part_before")
    in_order = _stretches([F.col(order)])
    step = F.when(~F.col("_own"), F.col("_base")).otherwise(differs(F.lag(value).over(in_order)))
    found = _with_seams(rows, seams).withColumn("_step", step)
    return found.withColumn(name, F.sum("_step").over(in_order.rowsBetween(Window.unboundedPreceding, 0))).where("_own").drop("_own", "_base", "_step")


def with_nearest_marks(rows: DataFrame, mark: str, time: str) -> DataFrame:
    """rows in stretches, with in each stretch copies of the last mark (a struct that begins with its time) before it and the first after it."""
    ends = written(rows.groupBy(*KEY).agg(F.min(mark).alias("_least"), F.max(mark).alias("_most")))
    by_part = Window.partitionBy("rec").orderBy("_part")
    after = F.min("_least").over(by_part.rowsBetween(1, Window.unboundedFollowing))
    ends = ends.select(*KEY, F.array(F.max("_most").over(_before()), after).alias("_marks"))
    met = ends.select(*KEY, F.explode("_marks").alias(mark)).where(F.col(mark).isNotNull())
    return rows.unionByName(met.withColumn(time, F.col(mark).getField(rows.schema[mark].dataType.names[0])), allowMissingColumns=True)


def with_margins(rows: DataFrame, reach: int, index: str = "i") -> DataFrame:
    """rows, of which _own is true, and copies of those within reach of a stretch in it, for windows of samples about each one."""
    near = F.sequence(F.floor((F.col(index) - reach) / PART), F.floor((F.col(index) + reach) / PART))
    put = rows.withColumn("_home", F.col("_part")).withColumn("_part", F.explode(near))
    return put.withColumn("_own", F.col("_part") == F.col("_home")).drop("_home")


def neighbour_counts(rows: DataFrame, value: str, count: dict[str, Column], before: str, order: str = "i") -> DataFrame:
    """For each recording how many rows fulfil each condition over value and column `before`, the value of the row before: one pass."""
    here = Window.partitionBy(*KEY).orderBy(order)
    inside = rows.withColumn(before, F.lag(value).over(here)).groupBy(*KEY).agg(
        F.min_by(value, order).alias("_first"), F.max_by(value, order).alias("_last"), *[F.count_if(c).alias(f"_{n}") for n, c in count.items()]
    )
    by_part = Window.partitionBy("rec").orderBy("_part")
    seams = inside.withColumn(before, F.lag("_last").over(by_part)).withColumn(value, F.col("_first"))
    return seams.groupBy("rec").agg(*[(F.sum(f"_{n}") + F.count_if(c)).alias(n) for n, c in count.items()])
