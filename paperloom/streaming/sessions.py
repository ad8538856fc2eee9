"""Reading sessions from a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reading_sessions(events: DataFrame, gap: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Sessions by user: events less than ``gap`` apart, at least 5 s long; batch or stream.

    The reference has no rule for late events; here those later than ``late`` are dropped.
    """
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        e = e.withWatermark("ts", late)
    s = e.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("events"), F.max("ts").alias("last"))
    seconds = F.unix_timestamp("last") - F.unix_timestamp("w.start")
    return s.select("user_id", F.col("w.start").alias("start_time"), F.col("last").alias("end_time"), "events", seconds.cast("long").alias("duration_seconds"))
