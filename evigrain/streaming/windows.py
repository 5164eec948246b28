"""Windowed counts on event streams. These are an extension, not part of the surveyed operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str | None = None, at: str = "ts", kind: str = "event_type") -> DataFrame:
    """Counts and sums by tumbling window and type; with `late`, rows older than the watermark are dropped on streams."""
    rows = events if late is None else events.withWatermark(at, late)
    counted = rows.groupBy(F.window(at, size).alias("w"), kind).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("w.start").alias("window_start"), kind, "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", key: str = "user_id", at: str = "ts") -> DataFrame:
    """Sessions of each key, ended by a gap."""
    return events.groupBy(F.session_window(at, gap).alias("s"), key).agg(F.count("*").alias("n")).select(key, F.col("s.start").alias("session_start"), "n")
