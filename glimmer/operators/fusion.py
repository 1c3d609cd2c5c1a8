"""All signals of a video on one time grid, and their weighted sum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glimmer.config import EngineConfig
from glimmer.functions.expressions import clip, slot_of
from glimmer.operators import series
from glimmer.operators.series import KEY, by_video


def event_flags(events: DataFrame, sizes: DataFrame, step: float) -> DataFrame:
    """(video_id, slot, has_laughter, has_loud_sound) of slots with an event; sizes: (video_id, slots)."""
    placed = events.where(F.col("time").isNotNull()).join(sizes, KEY).select(KEY, slot_of(F.col("time"), step, F.col("slots")).alias("slot"), "type")
    return placed.groupBy(KEY, "slot").agg(F.max(F.coalesce(F.col("type").contains("laughter"), F.lit(False))).alias("has_laughter"), F.max(F.coalesce(F.col("type").contains("loud"), F.lit(False))).alias("has_loud_sound"))


def boundary_flags(boundaries: DataFrame, sizes: DataFrame, step: float) -> DataFrame:
    """(video_id, slot, is_scene_boundary) of slots with a boundary."""
    placed = boundaries.where(F.col("time").isNotNull()).join(sizes, KEY)
    return placed.select(KEY, slot_of(F.col("time"), step, F.col("slots")).alias("slot")).distinct().withColumn("is_scene_boundary", F.lit(True))


def coverage(segments: DataFrame, slots: DataFrame, step: float) -> DataFrame:
    """slots (video_id, slot, slots) with covered: some segment reaches over the slot, both ends included.

    A sweep: +1 where a segment begins, -1 after it ends, running sum. Segments without length don't count.
    """
    sizes = slots.select(KEY, "slots").distinct()
    placed = segments.where(F.col("end") > F.col("start")).join(sizes, KEY).select(KEY, slot_of(F.col("start"), step, F.col("slots")).alias("a"), slot_of(F.col("end"), step, F.col("slots")).alias("b"))
    steps = placed.select(KEY, F.col("a").alias("slot"), F.lit(1).alias("d")).unionByName(placed.select(KEY, (F.col("b") + 1).alias("slot"), F.lit(-1).alias("d")))
    steps = steps.groupBy(KEY, "slot").agg(F.sum("d").alias("d"))
    joined = slots.join(steps, [KEY, "slot"], "left")
    return joined.select(KEY, "slot", "slots", (F.sum(F.coalesce("d", F.lit(0))).over(by_video("slot")) > 0).alias("covered"))


def score_or_sentiment(points: DataFrame) -> DataFrame:
    """(video_id, time, value): the score of each point; where there is no such column, what is named `sentiment`.

    A point whose score is null or no number has a null value, which no signal takes, whatever its sentiment is.
    """
    name = "score" if "score" in points.columns else "sentiment"
    return points.select(KEY, "time", F.col(name).try_cast("double").alias("value"))


def timeline(
    videos: DataFrame, motion: DataFrame, audio: DataFrame, sentiment: DataFrame, humor: DataFrame, events: DataFrame,
    boundaries: DataFrame, segments: DataFrame, config: EngineConfig = EngineConfig(),
) -> DataFrame:
    """The fused timeline of videos with a positive duration.

    motion: (video_id, time, value). audio: (video_id, time, loudness, speech_probability). sentiment: (video_id,
    time, score or sentiment). humor: (video_id, time, score). events: (video_id, time, type). boundaries: (video_id,
    time). segments: (video_id, start, end). Every signal is interpolated on the grid, scaled, weighted and summed.
    Dialogue is what the speech probability says where there is any, else what segments cover.

    Grid, points, events, boundaries and the ends of segments are one union, partitioned by video once and brought
    down to a row per time; flags are columns of that row, coverage a running sum over it.
    """
    step = config.step
    signals = {
        "motion": motion.select(KEY, "time", "value"),
        "sentiment": score_or_sentiment(sentiment),
        "humor": humor.select(KEY, "time", F.col("score").alias("value")),
    }
    number = lambda c: F.nanvl(F.col(c).try_cast("double"), F.lit(None).cast("double"))
    heard = audio.select(KEY, number("time").alias("time"), number("loudness").alias("audio_loudness"), number("speech_probability").alias("speech"))
    names = ("motion", "audio_loudness", "speech", "sentiment", "humor")
    flags = ("has_laughter", "has_loud_sound", "is_scene_boundary")
    # at: what belongs to the slot nearest to it; later: so many slots on
    kinds = {"time": "double", "slot": "long", "slots": "long", "at": "double", "later": "long", "delta": "long"} | dict.fromkeys(flags, "boolean") | dict.fromkeys(names, "double")

    def rows(df: DataFrame, **given: Column) -> DataFrame:
        return df.select(KEY, *[given.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in kinds.items()])

    told = lambda kind: F.coalesce(F.col("type").contains(kind), F.lit(False))
    ends = F.array(*[F.struct(F.col(c).cast("double").alias("at"), F.lit(k).alias("later"), F.lit(1 - 2 * k).alias("delta")) for k, c in enumerate(("start", "end"))])
    reach = segments.where(F.col("end") > F.col("start")).select(KEY, F.explode(ends).alias("reach")).select(KEY, "reach.*")
    parts = [
        rows(series.grid(videos.where(F.col("duration") > 0), step), time=F.col("time"), slot=F.col("slot"), slots=F.col("slots")),
        *[rows(series.valid_points(v, keep_nan=False), time=F.col("time"), **{k: F.col("value")}) for k, v in signals.items()],
        rows(heard.where(F.col("time").isNotNull() & F.coalesce("audio_loudness", "speech").isNotNull()), **{c: F.col(c) for c in ("time", "audio_loudness", "speech")}),
        rows(events, at=F.col("time"), has_laughter=told("laughter"), has_loud_sound=told("loud")),
        rows(boundaries, at=F.col("time"), is_scene_boundary=F.lit(True)),
        rows(reach, **{c: F.col(c) for c in ("at", "later", "delta")}),
    ]
    together = parts[0]
    for part in parts[1:]:
        together = together.unionByName(part)
    placed = together.where(F.col("time").isNotNull() | F.col("at").isNotNull()).repartition(KEY).withColumn("slots", F.max("slots").over(by_video())).where(F.col("slots").isNotNull())
    place = slot_of(F.col("at"), step, F.col("slots")) + F.coalesce("later", F.lit(0))
    placed = placed.withColumn("time", F.coalesce("time", place * F.lit(step)))
    one = placed.groupBy(KEY, "time").agg(F.max("slot").alias("slot"), F.sum("delta").alias("delta"), *[F.max(c).alias(c) for c in flags], *[F.avg(c).alias(c) for c in names])
    over = F.sum(F.coalesce("delta", F.lit(0))).over(by_video("time").rowsBetween(Window.unboundedPreceding, 0))
    seen = series.carried(one.withColumn("covered", over > 0), list(names)).where(F.col("slot").isNotNull())
    on_grid = seen.select(KEY, "slot", "time", "covered", *flags, *[series.interpolated(c).alias(c) for c in names])
    spoken = F.when(F.max("speech").over(by_video()) > 0, F.col("speech") >= config.dialogue_threshold).otherwise(F.col("covered"))
    rows_ = on_grid.select(
        KEY, "slot", "time", series.unit_range(F.col("motion")).alias("motion"), series.unit_range(F.col("audio_loudness")).alias("audio_loudness"),
        "sentiment", clip(F.col("humor")).alias("humor"), *[F.coalesce(c, F.lit(False)).alias(c) for c in flags], F.coalesce(spoken, F.lit(False)).alias("is_dialogue"),
    )
    w = config.weights()
    loud = clip(config.laughter_boost * F.col("has_laughter").cast("double") + config.loud_boost * F.col("has_loud_sound").cast("double"))
    interest = w["motion"] * F.col("motion") + w["audio"] * F.col("audio_loudness") + w["sentiment"] * clip(F.abs("sentiment")) + w["humor"] * F.col("humor") + w["events"] * loud
    return rows_.select(KEY, "slot", "time", clip(interest).alias("interest"), "motion", "audio_loudness", "sentiment", "humor", *flags, "is_dialogue")
