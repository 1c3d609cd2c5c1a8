"""Irregular series per video: validation, aggregation, grids, normalisation, smoothing, interpolation.

Everything is partitioned by video_id; a video's series is as long as the video, so one window is bounded by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = "video_id"


def by_video(*order: str | Column) -> Window:
    window = Window.partitionBy(KEY)
    return window.orderBy(*order) if order else window


def everything() -> Window:
    return by_video().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def valid_points(points: DataFrame, time_col: str = "time", value_col: str = "value", keep_nan: bool = True) -> DataFrame:
    """(video_id, time, value) as doubles; rows whose time or value is missing or can't be read as a number go."""
    out = points.select(KEY, F.col(time_col).try_cast("double").alias("time"), F.col(value_col).try_cast("double").alias("value"))
    return out.where(F.col("time").isNotNull() & F.col("value").isNotNull()) if keep_nan else out.dropna(subset=["time", "value"])


def zipped_points(rows: DataFrame, times: str, values: str) -> DataFrame:
    """(video_id, time, value) of two arrays side by side; what the longer one has more is left out."""
    n = F.least(F.size(times), F.size(values))
    pairs = F.when(n > 0, F.arrays_zip(F.slice(times, F.lit(1), n).alias("time"), F.slice(values, F.lit(1), n).alias("value")))
    return rows.select(KEY, F.inline(pairs))


def second_means(points: DataFrame) -> DataFrame:
    """(video_id, second, value): the mean of each second that has points; partial sums are made before the shuffle."""
    return points.groupBy(KEY, F.floor("time").cast("long").alias("second")).agg(F.avg("value").alias("value"))


def grid(videos: DataFrame, step: float = 1.0) -> DataFrame:
    """(video_id, slot, slots, time): 0, step, ... up to the duration; none for an unknown or negative one."""
    last = F.floor(F.col("duration") / F.lit(step)).cast("long")
    known = videos.where(F.col("duration") >= 0)
    slots = known.select(KEY, (last + 1).alias("slots"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("slot"))
    return slots.select(KEY, "slot", "slots", (F.col("slot") * F.lit(step)).alias("time"))


def fill_gaps(means: DataFrame, videos: DataFrame) -> DataFrame:
    """Every second of videos of known duration, 0 where there is none; observed seconds only of the others.

    One union and one partitioning by video serve the grid, the means and what is known of each video.
    """
    none = {"second": "long", "value": "double", "dense": "boolean", "open": "boolean"}

    def rows(df: DataFrame, **given: Column) -> DataFrame:
        return df.select(KEY, *[given.get(c, F.lit(None).cast(kind)).alias(c) for c, kind in none.items()])

    grid_rows = rows(grid(videos, 1.0), second=F.col("slot"), dense=F.lit(True))
    both = grid_rows.unionByName(rows(videos, open=F.col("duration").isNull())).unionByName(rows(means, second=F.col("second"), value=F.col("value")))
    held = both.repartition(KEY).groupBy(KEY, "second").agg(F.max("value").alias("value"), F.max("dense").alias("dense"), F.max("open").alias("open"))
    held = held.withColumn("open", F.max("open").over(by_video()))
    dense = F.coalesce("dense", F.lit(False))
    return held.where(F.col("second").isNotNull() & (dense | F.coalesce("open", F.lit(False)))).select(KEY, "second", F.coalesce("value", F.when(dense, F.lit(0.0))).alias("value"))


def min_max(df: DataFrame, column: str = "value") -> DataFrame:
    """0 to 1 over the video; 0 throughout where the range is 1e-8 at most."""
    low, span = F.min(column).over(by_video()), F.max(column).over(by_video()) - F.min(column).over(by_video())
    return df.withColumn(column, F.when(span > 1e-8, (F.col(column) - low) / span).otherwise(F.lit(0.0)))


def by_max(df: DataFrame, column: str = "value") -> DataFrame:
    """Divided by the video's maximum; 0 throughout where that isn't positive."""
    top = F.max(column).over(by_video())
    return df.withColumn(column, F.when(top > 0, F.col(column) / top).otherwise(F.lit(0.0)))


def unit_range(column: Column, eps: float = 1e-8) -> Column:
    """(v - min) / max(range, eps), clipped; over the video."""
    low, high = F.min(column).over(by_video()), F.max(column).over(by_video())
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (column - low) / F.greatest(high - low, F.lit(eps))))


def smoothed(column: str, points: int, *order: str) -> Column:
    """Centred moving mean that counts what lies outside the series as 0; unchanged for fewer than three points."""
    if points < 3:
        return F.col(column)
    frame = by_video(*order).rowsBetween(-(points // 2), (points - 1) // 2)
    return F.sum(column).over(frame) / F.lit(float(points))


def interpolate_all(signals: dict[str, DataFrame], targets: DataFrame) -> DataFrame:
    """targets (video_id, time, ...) with a column per signal: its points linearly interpolated at each time.

    0 outside the points' range and without points; a single point holds everywhere. Points of one time are averaged
    first. All signals take one union, one partitioning by video and one sort per direction: the points before and
    after each target are carried along the sorted series.
    """
    names = list(signals)
    columns = [c for c in targets.columns if c not in (KEY, "time")]
    value = {n: f"value_{k}" for k, n in enumerate(names)}
    points = None
    for name, rows in signals.items():
        own = rows.select(KEY, "time", *[(F.col("value") if n == name else F.lit(None).cast("double")).alias(value[n]) for n in names])
        points = own if points is None else points.unionByName(own)
    points = points.groupBy(KEY, "time").agg(*[F.avg(v).alias(v) for v in value.values()])
    wanted = targets.select(KEY, "time", F.struct(*[F.col(c) for c in columns], F.lit(True).alias("wanted")).alias("rest"), *[F.lit(None).cast("double").alias(v) for v in value.values()])
    rows = wanted.unionByName(points.withColumn("rest", F.lit(None).cast(wanted.schema["rest"].dataType)))
    # points stand before the target of the same time in either direction
    seen = carried(rows, list(value.values()), F.col("rest").isNotNull())
    found = [interpolated(v).alias(n) for n, v in value.items()]
    return seen.where(F.col("rest").isNotNull()).select(KEY, "time", *[F.col(f"rest.`{c}`").alias(c) for c in columns], *found)


def carried(rows: DataFrame, values: list[str], *after: Column) -> DataFrame:
    """rows (video_id, time, values) with what interpolated() needs: of each column the points before and after, their count, their maximum."""
    back = by_video("time", *after).rowsBetween(Window.unboundedPreceding, 0)
    ahead = by_video(F.desc("time"), *after).rowsBetween(Window.unboundedPreceding, 0)
    point = {v: F.when(F.col(v).isNotNull(), F.struct(F.col("time").alias("t"), F.col(v).alias("v"))) for v in values}
    seen = rows.withColumns({f"{v}_p": F.last(x, ignorenulls=True).over(back) for v, x in point.items()})
    seen = seen.withColumns({f"{v}_q": F.last(x, ignorenulls=True).over(ahead) for v, x in point.items()})
    return seen.withColumns({f"{v}_{k}": f(v).over(everything()) for v in values for k, f in (("n", F.count), ("m", F.max))})


def interpolated(v: str) -> Column:
    """Of a row of carried(): the column's value at its time; 0 outside the points, a single one holds everywhere."""
    p, q = F.col(f"{v}_p"), F.col(f"{v}_q")
    span = q["t"] - p["t"]
    between = F.when(span == 0, p["v"]).otherwise(p["v"] + (q["v"] - p["v"]) / span * (F.col("time") - p["t"]))
    return F.coalesce(F.when(F.col(f"{v}_n") == 1, F.col(f"{v}_m")).when(p.isNotNull() & q.isNotNull(), between), F.lit(0.0))


def interpolate(points: DataFrame, targets: DataFrame, name: str = "value") -> DataFrame:
    """interpolate_all() of one signal."""
    return interpolate_all({name: points}, targets)


def safe_mean(points: DataFrame, value_col: str = "value") -> DataFrame:
    """(video_id, mean) of the values that are numbers; 0 if there are none."""
    return points.groupBy(KEY).agg(F.coalesce(F.avg(F.col(value_col).try_cast("double")), F.lit(0.0)).alias("mean"))
