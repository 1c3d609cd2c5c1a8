"""Peaks, candidate windows, snapping, suppression, merging: from interest to highlights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glimmer.config import EngineConfig
from glimmer.functions.expressions import bound, count_before, nearest
from glimmer.operators.series import KEY, by_video, everything


def quantiles(timeline: DataFrame, q: float) -> DataFrame:
    """(video_id, threshold): the exact, interpolated quantile of interest."""
    return timeline.groupBy(KEY).agg(F.percentile("interest", q).alias("threshold"), F.count("*").alias("points"))


def interest_peaks(timeline: DataFrame, q: float) -> DataFrame:
    """(video_id, time, interest): inner points at or over the quantile that no neighbour exceeds; of three points at least."""
    order, all_ = by_video("time"), everything()
    sided = timeline.select(
        KEY, "time", "interest", F.lag("interest").over(order).alias("l"), F.lead("interest").over(order).alias("r"),
        F.percentile("interest", q).over(all_).alias("threshold"), F.count("*").over(all_).alias("points"),
    )
    return sided.where((F.col("points") >= 3) & (F.col("interest") >= F.col("threshold")) & (F.col("interest") >= F.col("l")) & (F.col("interest") >= F.col("r"))).select(KEY, "time", "interest")


def boundary_arrays(boundaries: DataFrame) -> DataFrame:
    """(video_id, marks): a video's boundaries as one sorted array."""
    return boundaries.where(F.col("time").isNotNull()).groupBy(KEY).agg(F.array_sort(F.collect_set("time")).alias("marks"))


def snapped(t: Column, marks: Column, window: float, inclusive: bool) -> Column:
    """The nearest mark if it lies within the window, else t."""
    near = nearest(marks, t)
    close = F.abs(near - t) <= window if inclusive else F.abs(near - t) < window
    return F.when(close, near).otherwise(t)


def snap_to_marks(points: DataFrame, marks: DataFrame, window: float, inclusive: bool, time_col: str = "time") -> DataFrame:
    """points with `snapped` and `near`: the nearest mark (the earlier on ties; null without any), and it or else the time itself.

    Points and marks are one union, sorted by time in either direction; no array rides on the points.
    """
    row = F.struct(*[F.col(c) for c in points.columns])
    both = points.select(KEY, F.col(time_col).alias("t"), row.alias("row")).unionByName(marks.where(F.col("time").isNotNull()).select(KEY, F.col("time").alias("t")), allowMissingColumns=True)
    mark, after = F.when(F.col("row").isNull(), F.col("t")), F.col("row").isNotNull()
    low = F.last(mark, ignorenulls=True).over(by_video("t", after).rowsBetween(Window.unboundedPreceding, 0))
    high = F.last(mark, ignorenulls=True).over(by_video(F.desc("t"), after).rowsBetween(Window.unboundedPreceding, 0))
    held = both.withColumn("low", low).withColumn("high", high).where(after)
    t, near = F.col("t"), F.when(F.col("low").isNull() | (F.col("high") - F.col("t") < F.col("t") - F.col("low")), F.col("high")).otherwise(F.col("low"))
    close = F.abs(near - t) <= window if inclusive else F.abs(near - t) < window
    return held.select("row.*", F.when(close, near).otherwise(t).alias("snapped"), near.alias("near"))


def window_around(peak: Column, duration: Column, config: EngineConfig) -> tuple[Column, Column]:
    """(start, end): the least duration, centred on the peak, shifted and cut to fit into the video."""
    d = config.min_highlight
    end = F.least(duration, F.greatest(F.lit(0.0), peak - d / 2) + d)
    start = F.greatest(F.lit(0.0), end - d)
    return start, F.least(end, start + max(config.max_highlight, d))


def candidates(peaks: DataFrame, videos: DataFrame, marks: DataFrame, config: EngineConfig) -> DataFrame:
    """(video_id, peak, start, end): a window around each peak, both ends snapped to marks unless the config says not to."""
    start, end = window_around(F.col("time"), F.col("duration"), config)
    placed = peaks.join(videos.select(KEY, "duration"), KEY).select(KEY, F.col("time").alias("peak"), start.alias("start"), end.alias("end"))
    held = placed.join(marks, KEY, "left").withColumn("marks", F.coalesce("marks", F.array(F.lit(0.0))))
    return held.select(KEY, "peak", *[_placed(F.col(c), config).alias(c) for c in ("start", "end")])


def _placed(t: Column, config: EngineConfig) -> Column:
    return snapped(t, F.col("marks"), config.snap_window, True) if config.snap_to_scenes else t


def interest_arrays(timeline: DataFrame) -> DataFrame:
    """(video_id, points): time, interest and its running sum as one sorted array per video, as long as the video."""
    return with_sums(timeline.select(KEY, "time", "interest")).groupBy(KEY).agg(_points().alias("points"))


def with_sums(timeline: DataFrame) -> DataFrame:
    return timeline.withColumn("upto", F.sum("interest").over(by_video("time").rowsBetween(Window.unboundedPreceding, 0)))


def _points() -> Column:
    return F.array_sort(F.collect_list(F.struct("time", "interest", "upto")))


def mean_in_window(points: Column, start: Column, end: Column) -> Column:
    """Mean interest from start to end, both included; 0 without points. Two bisections and two running sums."""
    time = lambda p: p["time"]
    ends = F.struct(count_before(points, start, time).alias("a"), count_before(points, end, time, inclusive=True).alias("b"))
    upto = lambda i: F.coalesce(F.get(points, i - 1)["upto"], F.lit(0.0))
    return bound(ends, lambda e: F.when(e["b"] > e["a"], (upto(e["b"]) - upto(e["a"])) / (e["b"] - e["a"])).otherwise(F.lit(0.0)))


def best_window(timeline: DataFrame, videos: DataFrame, width: float) -> DataFrame:
    """(video_id, start, end, score): the first of the windows from a grid time on with the highest mean.

    Without one that fits: from 0 to the width or the duration, score 0.
    """
    mean = F.expr(f"avg(interest) OVER (PARTITION BY {KEY} ORDER BY time RANGE BETWEEN CURRENT ROW AND {float(width)}D FOLLOWING)")
    means = timeline.select(KEY, "time", mean.alias("score")).join(videos.select(KEY, "duration"), KEY).where(F.col("time") + width <= F.col("duration"))
    best = means.groupBy(KEY).agg(F.max(F.struct("score", (-F.col("time")).alias("k"))).alias("b"))
    joined = videos.join(timeline.select(KEY).distinct(), KEY, "left_semi").join(best, KEY, "left")
    start, fits = -F.col("b.k"), F.col("b").isNotNull()
    return joined.select(KEY, F.when(fits, start).otherwise(F.lit(0.0)).alias("start"), F.when(fits, start + width).otherwise(F.least("duration", F.lit(width))).alias("end"), F.when(fits, F.greatest(F.col("b.score"), F.lit(0.0))).otherwise(F.lit(0.0)).alias("score"))


def greedy(ranked: Column, top_k: int) -> Column:
    """Of (k = -score, peak, start, end) in order: (start, end, score) of those that overlap none taken before, top_k at most."""
    empty = F.array().cast("array<struct<start: double, end: double, score: double>>")

    def take(acc: Column, c: Column) -> Column:
        meets = F.exists(acc, lambda s: ~((c["end"] <= s["start"]) | (c["start"] >= s["end"])))
        one = F.array(F.struct(c["start"].alias("start"), c["end"].alias("end"), (-c["k"]).alias("score")))
        return F.when((F.size(acc) >= top_k) | meets, acc).otherwise(F.concat(acc, one))

    return F.aggregate(ranked, empty, take)


def suppressed(scored: DataFrame, top_k: int) -> DataFrame:
    """(video_id, start, end, score): by falling score (ties: earlier peak), those that overlap none taken before."""
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("k"), "peak", "start", "end")))
    return scored.groupBy(KEY).agg(greedy(ranked, top_k).alias("kept")).select(KEY, F.inline("kept"))


def merged(items: DataFrame, arrays: DataFrame, gap: float) -> DataFrame:
    """Intervals at most `gap` apart become one, whose score is the mean over all of it; others keep theirs."""
    order = by_video("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = items.withColumn("new", F.when(reach.isNull() | (F.col("start") > reach + gap), 1).otherwise(0))
    islands = opened.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    grouped = islands.groupBy(KEY, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n"), F.min("score").alias("score"))
    held = grouped.join(arrays, KEY)
    score = F.when(F.col("n") == 1, F.col("score")).otherwise(mean_in_window(F.col("points"), F.col("start"), F.col("end")))
    return held.select(KEY, "start", "end", score.alias("score"))


def _found(timeline: DataFrame, videos: DataFrame, boundaries: DataFrame, config: EngineConfig, spare: bool) -> DataFrame:
    """(video_id, points, found): the scored windows (k = -score, peak, start, end) of videos with three points at least.

    The timeline is read once: neighbours and running sums come from one sort, then a video's points become one array.
    spare: a video without a peak gets the first window with the highest mean.
    """
    q, width = config.peak_quantile, config.min_highlight
    order = by_video("time")
    sided = with_sums(timeline.select(KEY, "time", "interest")).withColumn("l", F.lag("interest").over(order)).withColumn("r", F.lead("interest").over(order))
    top = F.when((F.col("interest") >= F.col("l")) & (F.col("interest") >= F.col("r")), F.struct("time", "interest"))
    arrays = sided.groupBy(KEY).agg(_points().alias("points"), F.array_sort(F.collect_list(top)).alias("tops"), F.percentile("interest", q).alias("threshold"))
    rows = arrays.where(F.size("points") >= 3).join(videos.select(KEY, "duration"), KEY)
    if config.snap_to_scenes:
        rows = rows.join(boundary_arrays(boundaries), KEY, "left").withColumn("marks", F.coalesce("marks", F.array(F.lit(0.0))))
    points = F.col("points")
    rows = rows.withColumn("peaks", F.transform(F.filter("tops", lambda p: p["interest"] >= F.col("threshold")), lambda p: p["time"]))

    def item(peak: Column, start: Column, end: Column, score: Column) -> Column:
        return F.struct((-score).alias("k"), peak.alias("peak"), start.alias("start"), end.alias("end"))

    def around(peak: Column) -> Column:
        start, end = (_placed(t, config) for t in window_around(peak, F.col("duration"), config))
        return bound(F.struct(start.alias("start"), end.alias("end")), lambda w: item(peak, w["start"], w["end"], mean_in_window(points, w["start"], w["end"])))

    found = F.transform("peaks", around)
    if spare:
        tried = F.transform(F.filter(points, lambda p: p["time"] + width <= F.col("duration")), lambda p: F.struct((-mean_in_window(points, p["time"], p["time"] + width)).alias("k"), p["time"].alias("t")))

        def window(best: Column) -> Column:
            ends = F.coalesce(best["t"], F.lit(0.0)), F.coalesce(best["t"] + width, F.least("duration", F.lit(width)))
            return item(F.lit(0.0), *[_placed(t, config) for t in ends], F.greatest(F.coalesce(-best["k"], F.lit(0.0)), F.lit(0.0)))

        found = F.when(F.size("peaks") > 0, found).otherwise(F.array(bound(F.array_min(tried), window)))
    return rows.select(KEY, "points", found.alias("found"))


def scored_candidates(timeline: DataFrame, videos: DataFrame, boundaries: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """(video_id, peak, start, end, score): the window of each peak with its mean interest."""
    out = _found(timeline, videos, boundaries, config, spare=False).select(KEY, F.inline("found"))
    return out.select(KEY, "peak", "start", "end", (-F.col("k")).alias("score"))


def highlights(timeline: DataFrame, videos: DataFrame, boundaries: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """(video_id, start, end, type, score) of videos with three points at least.

    Peaks, windows, scores, suppression and merging are expressions on one array per video.
    """
    rows = _found(timeline, videos, boundaries, config, spare=True)
    points = F.col("points")
    rows = rows.withColumn("kept", F.array_sort(greedy(F.array_sort("found"), config.top_k)))

    def join(acc: Column, c: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        end = F.greatest(last["end"], c["end"])
        wide = F.struct(last["start"].alias("start"), end.alias("end"), mean_in_window(points, last["start"], end).alias("score"))
        near = (F.size(acc) > 0) & (c["start"] <= F.try_element_at(acc, F.lit(-1))["end"] + config.merge_gap)
        return F.when(near, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(wide))).otherwise(F.concat(acc, F.array(c)))

    empty = F.array().cast("array<struct<start: double, end: double, score: double>>")
    return rows.select(KEY, F.inline(F.aggregate("kept", empty, join))).select(KEY, "start", "end", F.lit("top_interest").alias("type"), "score")
