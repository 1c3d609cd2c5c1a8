"""Chapters from topics, scene boundaries and the timeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glimmer.config import EngineConfig
from glimmer.functions.expressions import capitalize
from glimmer.operators.intervals import boundary_arrays, snapped
from glimmer.operators.series import KEY

# Titles and descriptions of the default language.
TOPIC_NAMES = {
    "silence": "Пауза",
    "general": "Общий контент",
    "intro": "Вступление",
    "dialog": "Диалог",
    "action": "Экшн",
    "comedy": "Комедия",
}
CHAPTER = "Глава"
WHOLE_VIDEO = ("Полное видео", "Весь контент")
LIVELY, FUNNY, MOVING, SPOKEN = "высокая активность", "юмористический контент", "эмоциональные моменты", "диалоги"
WITH_PARTS, WITHOUT_PARTS, WITHOUT_POINTS = "Сегмент с ", "Спокойный контент", "Контент без особенностей"


def snapped_topics(topics: DataFrame, boundaries: DataFrame, window: float) -> DataFrame:
    """Topics whose ends move to a boundary closer than the window, each end for itself."""
    held = topics.join(boundary_arrays(boundaries), KEY, "left").withColumn("marks", F.coalesce("marks", F.array(F.lit(0.0))))
    return held.select(KEY, "block", *[snapped(F.col(c), F.col("marks"), window, False).alias(c) for c in ("start", "end")], "topic")


def absorbed(topics: DataFrame, least: float) -> DataFrame:
    """(video_id, chapter, start, end, topic): a segment shorter than `least` takes in the next one; the last may stay short."""
    row = "struct<start: double, end: double, topic: string>"
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("block", "start", "end", "topic"))), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["topic"].alias("topic")))
    start = F.struct(F.array().cast(f"array<{row}>").alias("done"), F.lit(None).cast(row).alias("open"))

    def step(acc: Column, s: Column) -> Column:
        now = acc["open"]
        longer = F.struct(now["start"].alias("start"), s["end"].alias("end"), F.concat(now["topic"], F.lit("_"), s["topic"]).alias("topic"))
        emitted = F.struct(F.concat(acc["done"], F.array(now)).alias("done"), s.alias("open"))
        return F.when(now.isNull(), F.struct(acc["done"].alias("done"), s.alias("open"))).when(now["end"] - now["start"] < least, F.struct(acc["done"].alias("done"), longer.alias("open"))).otherwise(emitted)

    folded = topics.groupBy(KEY).agg(F.aggregate(ordered, start, step, lambda acc: F.concat(acc["done"], F.array(acc["open"]))).alias("all"))
    return folded.select(KEY, F.posexplode("all").alias("k", "s")).select(KEY, (F.col("k") + 1).alias("chapter"), "s.start", "s.end", "s.topic")


def title(number: Column, topic: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in TOPIC_NAMES.items() for x in pair])
    joined = F.array_join(F.slice(F.split(topic, "_"), 1, 2), " ")
    name = F.when(topic.contains("_"), joined).otherwise(F.coalesce(F.try_element_at(names, topic), capitalize(topic)))
    return F.concat(F.lit(f"{CHAPTER} "), number.cast("string"), F.lit(": "), name)


def chapter_stats(parts: DataFrame, timeline: DataFrame, bucket: float = 60.0) -> DataFrame:
    """parts (video_id, chapter, start, end, and what else they have) with n, motion, humor, sentiment, dialogue of the points within, ends included.

    The range join is an equi-join on time buckets: a chapter is repeated for the buckets it reaches over, and its rows are
    brought together again by one aggregate, without a join back.
    """
    number = lambda t: F.floor(t / F.lit(bucket)).cast("long")
    own = [c for c in parts.columns if c not in (KEY, "chapter")]
    spread = parts.select(KEY, "chapter", F.struct(*own).alias("part"), F.explode(F.sequence(number(F.col("start")), F.greatest(number(F.col("start")), number(F.col("end"))))).alias("bucket"))
    points = timeline.select(KEY, number(F.col("time")).alias("bucket"), "time", "motion", "humor", "sentiment", "is_dialogue")
    inside = (F.col("time") >= F.col("part.start")) & (F.col("time") <= F.col("part.end"))
    held = lambda value: F.when(inside, value)
    stats = spread.join(points, [KEY, "bucket"], "left").groupBy(KEY, "chapter").agg(
        F.first("part").alias("part"), F.count_if(inside).alias("n"), F.avg(held(F.col("motion"))).alias("motion"), F.avg(held(F.col("humor"))).alias("humor"),
        F.avg(held(F.abs("sentiment"))).alias("sentiment"), F.max(held(F.col("is_dialogue"))).alias("dialogue"),
    )
    return stats.select(KEY, "chapter", "part.*", "n", "motion", "humor", "sentiment", "dialogue")


def description() -> Column:
    """Of a row of chapter_stats()."""
    parts = F.array_compact(F.array(
        F.when(F.col("motion") > 0.5, F.lit(LIVELY)), F.when(F.col("humor") > 0.3, F.lit(FUNNY)),
        F.when(F.col("sentiment") > 0.4, F.lit(MOVING)), F.when(F.col("dialogue"), F.lit(SPOKEN)),
    ))
    told = F.when(F.size(parts) > 0, F.concat(F.lit(WITH_PARTS), F.array_join(parts, ", "))).otherwise(F.lit(WITHOUT_PARTS))
    return F.when(F.col("n") == 0, F.lit(WITHOUT_POINTS)).otherwise(told)


def chapters(topics: DataFrame, videos: DataFrame, boundaries: DataFrame, timeline: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """(video_id, chapter, start, end, title, description); one chapter over all of a video without topics."""
    parts = absorbed(snapped_topics(topics, boundaries, config.chapter_snap), config.min_chapter)
    told = chapter_stats(parts, timeline).select(KEY, "chapter", "start", "end", title(F.col("chapter"), F.col("topic")).alias("title"), description().alias("description"))
    plain = videos.join(topics.select(KEY).distinct(), KEY, "left_anti").select(KEY, F.lit(1).alias("chapter"), F.lit(0.0).alias("start"), F.coalesce("duration", F.lit(0.0)).alias("end"), F.lit(WHOLE_VIDEO[0]).alias("title"), F.lit(WHOLE_VIDEO[1]).alias("description"))
    return told.unionByName(plain)
