"""The time-tiled operators on endless streams (event times are timestamps)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glimmer.operators.series import KEY


def second_means(points: DataFrame, late: str = "10 minutes", width: str = "1 second") -> DataFrame:
    """points (video_id, ts, value) as (video_id, start, value): tumbling means; rows later than `late` are dropped by the watermark."""
    timed = points.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(KEY, F.window("ts", width)).agg(F.avg("value").alias("value")).select(KEY, F.col("window.start").alias("start"), "value")


def merged_events(events: DataFrame, gap: str = "3 seconds", late: str = "10 minutes") -> DataFrame:
    """events (video_id, ts) as (video_id, start, end, n): runs of events with less than `gap` between."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    grouped = timed.groupBy(KEY, F.session_window("ts", gap)).agg(F.count("*").alias("n"))
    return grouped.select(KEY, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
