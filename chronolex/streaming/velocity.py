"""Velocity of dated events as a stream: an extension, as the batch operators need none."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def daily_counts(events: DataFrame, late: str = "2 days") -> DataFrame:
    """event_type, day, n: tumbling days; events later than the watermark are left out."""
    days = events.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return days.select("event_type", F.to_date(F.col("window.start")).alias("day"), "n")
