"""Counts over streams of turns: the same aggregations as in batch, by event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def codes_by_window(events: DataFrame, length: str = "1 hour", late: str = "2 hours", time: str = "ts", code: str = "event_type") -> DataFrame:
    """start, code and count of each window of time; rows later than that are left out, and state of windows past it goes."""
    rows = events.withColumn("at", F.col(time).cast("timestamp")).withWatermark("at", late)
    out = rows.groupBy(F.window("at", length).alias("w"), F.col(code).alias("code")).agg(F.count(F.lit(1)).alias("count"))
    return out.select(F.col("w.start").alias("start"), "code", "count")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours", time: str = "ts", user: str = "user_id") -> DataFrame:
    """start, end, user and number of events of each session: events with no longer gap between them."""
    rows = events.withColumn("at", F.col(time).cast("timestamp")).withWatermark("at", late)
    out = rows.groupBy(F.session_window("at", gap).alias("w"), F.col(user).alias("user")).agg(F.count(F.lit(1)).alias("count"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user", "count")
