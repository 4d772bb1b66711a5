"""Windowed counts of arriving events, with late rows dropped behind a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of the Parquet files of a folder."""
    reader = spark.readStream.schema(SCHEMA)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def windowed_depth(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """``(start, event_type, n, users, total)`` by tumbling window; works on streams and tables alike.

    Users are counted approximately, which keeps a stream's state small.
    """
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    w = F.window("ts", window)
    return events.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("user_id").alias("users"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "users", "total")


def node_growth(steps: DataFrame, late: str = "2 hours") -> DataFrame:
    """First arrivals of nodes in a stream ``(ts, node_id, len)``: each node once within the watermark."""
    return steps.withWatermark("ts", late).dropDuplicatesWithinWatermark(["node_id"])
