"""Shots and scenes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glimmer.operators.series import KEY, by_video


def dissimilarity(a: Column, b: Column) -> Column:
    """1 - the correlation of two arrays, clamped to 0..1; null without two arrays of one length and of numbers, 0 where the
    correlation is undefined and both are equal.

    One fold over five sums, of entries less the arrays' first ones, so that a constant array has no spread at all.
    """
    names = ("x", "y", "xx", "yy", "xy")

    def add(acc: Column, pair: Column) -> Column:
        x, y = pair["p"] - F.get(a, 0).cast("double"), pair["q"] - F.get(b, 0).cast("double")
        return F.struct(*[(acc[c] + v).alias(c) for c, v in zip(names, (x, y, x * x, y * y, x * y), strict=True)])

    def finish(acc: Column) -> Column:
        n = F.size(a).cast("double")
        up = acc["xy"] - acc["x"] * acc["y"] / n
        down = F.sqrt((acc["xx"] - acc["x"] * acc["x"] / n) * (acc["yy"] - acc["y"] * acc["y"] / n))
        r = F.when(down > 0, up / down).otherwise(F.when(a == b, F.lit(1.0)).otherwise(F.lit(0.0)))
        return F.when(up.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - r)))

    pairs = F.zip_with(a, b, lambda p, q: F.struct(p.cast("double").alias("p"), q.cast("double").alias("q")))
    return F.when(F.size(a) > 0, F.aggregate(pairs, F.struct(*[F.lit(0.0).alias(c) for c in names]), add, finish)).when((F.size(a) == 0) & (F.size(b) == 0), F.lit(0.0))


def shot_scores(histograms: DataFrame) -> DataFrame:
    """histograms (video_id, time, hist) as (video_id, time, score): change against the histogram before."""
    pairs = histograms.select(KEY, "time", "hist", F.lag("hist").over(by_video("time")).alias("before")).where(F.col("before").isNotNull())
    return pairs.select(KEY, "time", dissimilarity(F.col("before"), F.col("hist")).alias("score"))


def accepted_cuts(candidates: Column, min_length: float) -> Column:
    """Of ascending times: 0, then each that lies min_length or more after the last accepted one."""
    start = F.array(F.lit(0.0))
    return F.aggregate(candidates, start, lambda acc, t: F.when(t - F.element_at(acc, -1) >= min_length, F.concat(acc, F.array(t))).otherwise(acc))


def shot_boundaries(scores: DataFrame, threshold: float, min_length: float) -> DataFrame:
    """(video_id, time): 0 and the cuts whose score reaches the threshold, min_length apart."""
    times = F.array_sort(F.collect_list(F.when(F.col("score") >= threshold, F.col("time"))))
    return scores.groupBy(KEY).agg(times.alias("t")).select(KEY, F.explode(accepted_cuts(F.col("t"), min_length)).alias("time"))


def shot_summary(scores: DataFrame) -> DataFrame:
    return scores.groupBy(KEY).agg(F.avg("score").alias("mean"), F.max("score").alias("max"))


def adaptive_ratio(deltas: DataFrame, reach: int = 2, least_delta: float = 15.0, cap: float = 255.0) -> DataFrame:
    """deltas (video_id, time, value) with ratio: the delta over the mean of its neighbours (reach to each side).

    Without neighbouring change the ratio is the cap if the delta reaches least_delta, else 0.
    """
    order = by_video("time")
    near = order.rowsBetween(-reach, reach)
    around = (F.sum("value").over(near) - F.col("value")) / F.greatest(F.count("value").over(near) - 1, F.lit(1))
    ratio = F.when(around > 1e-5, F.least(F.col("value") / around, F.lit(cap))).when(F.col("value") >= least_delta, F.lit(cap)).otherwise(F.lit(0.0))
    return deltas.withColumn("ratio", ratio)


def adaptive_cuts(deltas: DataFrame, ratio: float = 3.0, least_delta: float = 15.0, min_length: float = 0.6) -> DataFrame:
    """(video_id, time): 0 and the times whose ratio and delta reach both limits, min_length apart."""
    scored = adaptive_ratio(deltas, least_delta=least_delta)
    hit = F.when((F.col("ratio") >= ratio) & (F.col("value") >= least_delta), F.col("time"))
    return scored.groupBy(KEY).agg(F.array_sort(F.collect_list(hit)).alias("t")).select(KEY, F.explode(accepted_cuts(F.col("t"), min_length)).alias("time"))


def content_cuts(deltas: DataFrame, threshold: float = 27.0, min_length: float = 0.6) -> DataFrame:
    """(video_id, time): 0 and the times whose delta reaches the threshold, min_length apart."""
    hit = F.when(F.col("value") >= threshold, F.col("time"))
    return deltas.groupBy(KEY).agg(F.array_sort(F.collect_list(hit)).alias("t")).select(KEY, F.explode(accepted_cuts(F.col("t"), min_length)).alias("time"))


def scenes_between(cuts: DataFrame, videos: DataFrame) -> DataFrame:
    """(video_id, index, start, end): from each cut to the next, the last to the end of the video."""
    ends = cuts.join(videos.select(KEY, "duration"), KEY).withColumn("end", F.coalesce(F.lead("time").over(by_video("time")), "duration"))
    return numbered(ends.select(KEY, F.col("time").alias("start"), "end").where(F.col("end") >= F.col("start")))


def numbered(scenes: DataFrame) -> DataFrame:
    index = (F.row_number().over(by_video("start", "end")) - 1).cast("int")
    return scenes.select(KEY, index.alias("index"), "start", "end")


def long_enough(scenes: DataFrame, videos: DataFrame, min_length: float) -> DataFrame:
    """Scenes of min_length or more; all of a video's where none is; one (0, 0) scene for a video without scenes."""
    fits = F.col("end") - F.col("start") >= min_length
    kept = scenes.withColumn("fits", fits).withColumn("any", F.count_if("fits").over(by_video())).where(F.col("fits") | (F.col("any") == 0))
    none = videos.select(KEY).join(scenes, KEY, "left_anti").select(KEY, F.lit(0.0).alias("start"), F.lit(0.0).alias("end"))
    return numbered(kept.select(KEY, "start", "end").unionByName(none))


def from_zero(scenes: DataFrame) -> DataFrame:
    """Scenes preceded by one from 0 to the first start, where that lies later."""
    first = scenes.groupBy(KEY).agg(F.min("start").alias("end")).where(F.col("end") > 0).select(KEY, F.lit(0.0).alias("start"), "end")
    return numbered(scenes.select(KEY, "start", "end").unionByName(first))


def boundaries(scenes: DataFrame) -> DataFrame:
    return scenes.select(KEY, F.col("start").alias("time")).distinct()


def summary(scenes: DataFrame) -> DataFrame:
    length = F.greatest(F.lit(0.0), F.col("end") - F.col("start"))
    return scenes.groupBy(KEY).agg(F.count("*").alias("count"), F.avg(length).alias("mean_length"), F.max(length).alias("max_length"))


