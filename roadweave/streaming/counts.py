"""Streaming forms of interval counts and sessions; batch and stream results agree once the watermark has passed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def interval_counts(events: DataFrame, time: str, keys: list[str], interval: str = "60 seconds", late: str = "2 minutes") -> DataFrame:
    """Counts by tumbling interval; rows later than the watermark are left out in a stream."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.window(time, interval).alias("w"), *keys).agg(F.count(F.lit(1)).alias("count")).select(F.col("w.start").alias("interval_start"), *keys, "count")


def sessions(events: DataFrame, time: str, keys: list[str], gap: str = "12 seconds", late: str = "2 minutes") -> DataFrame:
    """Runs of events with no longer pause than the gap: platoons at a stop line."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("vehicles")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "vehicles")
