"""Responses per step from a stream of events, by the same rule as from a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def binned(events: DataFrame, step: str = "6 hours", late: str = "1 day") -> DataFrame:
    """(subject, parcel, start, y, n) of events (ts, event_type, user_id, value): means per
    subject, parcel and step. On a stream, a step is closed, and its state dropped, once
    events are later than it by ``late``; on a table all rows count."""
    d = events.withColumn("ts", F.col("ts").cast("timestamp"))
    d = d.withWatermark("ts", late) if d.isStreaming else d
    by = [F.window("ts", step).alias("step"), F.col("event_type").alias("subject"), (F.col("user_id") % 5).alias("parcel")]
    return d.groupBy(*by).agg(F.avg("value").alias("y"), F.count("*").alias("n")).select("subject", "parcel", F.col("step.start").alias("start"), "y", "n")
