"""Structured Streaming form of the benchmark: an extension, for score rows that keep arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_benchmark(scores: DataFrame, time: str = "ts", window: str = "1 day", delay: str = "2 hours") -> DataFrame:
    """Mean score and rows by grade, subject and event-time window; rows later than `delay` are dropped by the watermark."""
    held = scores.withWatermark(time, delay)
    out = held.groupBy(F.window(time, window).alias("w"), "grade", "subject").agg(F.avg("score").alias("state"), F.count("score").alias("units"))
    return out.select(F.col("w.start").alias("since"), F.col("w.end").alias("until"), "grade", "subject", "state", "units")


def sessions(events: DataFrame, key: str = "user_id", time: str = "ts", gap: str = "1 day", delay: str = "2 days") -> DataFrame:
    """The streaming form of gap groups: session windows by key."""
    held = events.withWatermark(time, delay)
    out = held.groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("since"), F.col("w.end").alias("until"), "n")
