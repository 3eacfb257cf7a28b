"""Structured Streaming counterparts of the bucketed and session aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly_counts(events: DataFrame, time: str = "ts", late: str = "1 hour") -> DataFrame:
    """(bucket, event_type, n) in tumbling hours; works on batch and streaming frames."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.window(time, "1 hour"), "event_type").agg(F.count("*").alias("n")).select(F.unix_seconds("window.start").alias("bucket"), "event_type", "n")


def session_counts(events: DataFrame, time: str = "ts", late: str = "1 hour") -> DataFrame:
    """(user_id, start_t, end_t, n) of sessions that end after 30 idle minutes."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.session_window(time, "30 minutes"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.unix_seconds("session_window.start").alias("start_t"), F.unix_seconds("session_window.end").alias("end_t"), "n")
