"""The driver's tables seen as recordings, segments and subjects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biowave.operators import scans

#: Label of each event type; 0 is rest.
LABELS = {"error": 0, "view": 1, "click": 2, "purchase": 3, "signup": 4}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def label_of(event_type):
    out = F.lit(0)
    for name, label in LABELS.items():
        out = F.when(event_type == name, label).otherwise(out)
    return out


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long recordings (rec, i, x, label, us): one per user, sampled at the user's events in time order."""
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("rec"), F.col("value").alias("x"), label_of(F.col("event_type")).alias("label"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id",
    )
    numbered = scans.numbered(scans.parted_by_time(rows, "us"), ["us", "event_id"], "i")
    return numbered.select("rec", F.col("i").cast("int").alias("i"), "x", "label", "us")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed windows (seg, dataset, signal): stored as floats, computed with as doubles."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("seg"), F.col("label").alias("dataset"), F.col("embedding").cast("array<double>").alias("signal")
    )


#: The same views for the SQL twins.
SIGNALS_SQL = """
sig AS (
    SELECT user_id AS rec, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, value AS x,
           CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 ELSE 0 END AS label,
           epoch_us(ts) AS us
    FROM events)"""
SAMPLES_SQL = """
smp AS (
    SELECT vec_id AS seg, label AS dataset, unnest(range(0, len(embedding))) AS i, unnest(embedding)::DOUBLE AS x
    FROM embeddings)"""
