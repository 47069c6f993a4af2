"""Weekly popularity and visits over a stream of events: an addition, as the batch operators have no stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def weekly_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events by type in weeks that start on Wednesdays (1970-01-07 was one); later than ``late`` they are dropped."""
    week = F.window("ts", "7 days", "7 days", "6 days")
    counted = events.withWatermark("ts", late).groupBy(week.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("w.start").alias("week_start"), "event_type", "n", "total")


def distinct_events(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events once for each event_id, as long as repeats come within ``late``."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def visits(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Runs of a user's events with no gap of ``gap`` between them."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
