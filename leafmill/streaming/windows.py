"""Windows over events by their own time, the same for tables and for streams with late events.

On a stream the watermark says how late an event may come; windows are given out once it has passed their end. On a table
nothing is late.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def watermarked(events: DataFrame, late: str, time: str = "ts") -> DataFrame:
    """A stream's events with a watermark; a table's as they are. Null times are left out."""
    held = events.where(F.col(time).isNotNull())
    return held.withWatermark(time, late) if events.isStreaming else held


def measured(value: Column) -> list[Column]:
    """Events, and sum of values in hundredths (exact, whatever order events come in)."""
    return [F.count("*").alias("events"), F.coalesce(F.sum(F.round(value * 100).cast("long")), F.lit(0)).alias("hundredths")]


def sliding(events: DataFrame, width: str, slide: str, by: str = "event_type", late: str = "10 minutes") -> DataFrame:
    """start, stop, by, events, hundredths of each sliding window."""
    window = F.window("ts", width, slide).alias("w")
    found = watermarked(events, late).groupBy(window, by).agg(*measured(F.col("value")))
    return found.select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), by, "events", "hundredths")


def sessions(events: DataFrame, gap: str, by: str = "user_id", late: str = "10 minutes") -> DataFrame:
    """start, stop (the last event and the gap), by, events, hundredths of each session: events less than `gap` apart."""
    window = F.session_window("ts", gap).alias("w")
    found = watermarked(events, late).groupBy(window, by).agg(*measured(F.col("value")))
    return found.select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), by, "events", "hundredths")
