"""Windowed features of live recordings with Structured Streaming: late samples are waited for by the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed(samples: DataFrame, size: str, step: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Features of event-time windows of samples (rec, ts, x, label), streaming or not."""
    window = F.window("ts", size, step) if step else F.window("ts", size)
    return samples.withWatermark("ts", late).groupBy("rec", window.alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs("x")).alias("arv"), F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"), F.max("label").alias("label")
    )


def drain(spark: SparkSession, features: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Run a streaming query over what there is and return its table."""
    query = features.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(features.schema).parquet(out)
