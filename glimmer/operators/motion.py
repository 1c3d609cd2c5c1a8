"""Motion from per-frame scalars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glimmer.operators import series
from glimmer.operators.series import KEY


def sampled(frames: DataFrame, step: int) -> DataFrame:
    """Every step-th frame; all of them for a step up to 1."""
    return frames.where(F.pmod("frame_index", F.lit(step)) == 0) if step > 1 else frames


def sampled_by_rate(frames: DataFrame, videos: DataFrame, per_second: float) -> DataFrame:
    """Every max(1, fps // per_second)-th frame of its video."""
    step = F.greatest(F.lit(1).cast("long"), F.floor(F.col("fps") / F.lit(per_second)).cast("long"))
    rates = videos.select(KEY, step.alias("step"))
    return frames.join(rates, KEY).where(F.pmod("frame_index", F.col("step")) == 0).drop("step")


def differences(frames: DataFrame) -> DataFrame:
    """Absolute change from the frame before (of those that are there), at the later one's time."""
    before = F.lag("value").over(series.by_video("frame_index"))
    return frames.select(KEY, "frame_index", "time", F.abs(F.col("value") - before).alias("value")).where(F.col("value").isNotNull())


def mean_difference(a: Column, b: Column) -> Column:
    """Mean absolute difference of two frames' pixels (arrays of one size); 0 without pixels."""
    apart = F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    return F.when(F.size(apart) > 0, F.aggregate(apart, F.lit(0.0), lambda acc, x: acc + x) / F.size(apart)).otherwise(F.lit(0.0))


def moving_fraction(magnitudes: Column, threshold: float = 0.1) -> Column:
    """Share of a frame's pixels whose flow exceeds this part of the largest; 0 where nothing moves."""
    top = F.array_max(magnitudes)
    moving = F.size(F.filter(magnitudes, lambda x: x / top > threshold)) / F.size(magnitudes)
    return F.when((F.size(magnitudes) > 0) & (top > 0), moving).otherwise(F.lit(0.0))


def pixel_differences(frames: DataFrame) -> DataFrame:
    """frames (video_id, frame_index, time, pixels) as (video_id, frame_index, time, value): mean change from the frame before."""
    before = F.lag("pixels").over(series.by_video("frame_index"))
    pairs = frames.select(KEY, "frame_index", "time", "pixels", before.alias("before")).where(F.col("before").isNotNull())
    return pairs.select(KEY, "frame_index", "time", mean_difference(F.col("before"), F.col("pixels")).alias("value"))


def heatmap(changes: DataFrame, videos: DataFrame) -> DataFrame:
    """(video_id, second, value): mean change per second, dense, scaled to 0..1; empty seconds count as 0 first."""
    return series.min_max(series.fill_gaps(series.second_means(changes), videos))


def sparse_heatmap(changes: DataFrame) -> DataFrame:
    """(video_id, second, value): mean per observed second, divided by the largest."""
    return series.by_max(series.second_means(changes))


def summary(heat: DataFrame) -> DataFrame:
    return heat.groupBy(KEY).agg(F.avg("value").alias("mean"), F.max("value").alias("max"), F.count("*").alias("seconds"))
