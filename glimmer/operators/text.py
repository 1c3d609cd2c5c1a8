"""Transcripts: cleaning, sentiment, humor, topics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glimmer.functions.expressions import signed_confidence, strip
from glimmer.operators.series import KEY, by_video


@dataclass(frozen=True)
class Language:
    """Word lists and alphabet of a language."""

    laugh: tuple[str, ...]
    casual: tuple[str, ...]
    stop_words: tuple[str, ...]
    letters: str


# Marker words, stop words and the alphabet of the default language.
RUSSIAN = Language(
    laugh=("смеется", "смех в зале", "смех", "смешно", "шутка", "прикол"),
    casual=("аха", "ха-ха", "лол", "чувак", "ой", "блин", "капец"),
    stop_words=("и", "в", "на", "с", "по", "для", "от", "до", "при", "о", "об", "что", "как", "где", "когда", "почему", "который", "которая", "которое"),
    letters="а-яё",
)
ENGLISH = Language(
    laugh=("laughs", "laughter", "laugh", "funny", "joke", "prank"),
    casual=("haha", "ha-ha", "lol", "dude", "oh", "damn", "wow"),
    stop_words=("the", "and", "for", "from", "that", "this", "with", "are", "was", "what", "how", "where", "when", "why", "which", "you", "not", "but", "his"),
    letters="a-z",
)


def speech_segments(segments: DataFrame, least: float) -> DataFrame:
    """Segments with text, white space at its ends removed, that last longer than `least`."""
    clean = segments.withColumn("text", strip(F.col("text")))
    return clean.where((F.length("text") > 0) & (F.col("end") - F.col("start") > least))


def usable_segments(segments: DataFrame) -> DataFrame:
    """Segments with text and a numeric start; a missing end is the start."""
    typed = segments.withColumn("start", F.col("start").try_cast("double")).withColumn("end", F.coalesce(F.col("end").try_cast("double"), F.col("start").try_cast("double")))
    return typed.where((F.length(strip(F.col("text"))) > 0) & F.col("start").isNotNull())


def midpoint() -> Column:
    return (F.col("start") + F.col("end")) / 2


def full_transcript(segments: DataFrame) -> DataFrame:
    """(video_id, transcript): the texts in order of position, one space between."""
    parts = F.array_sort(F.collect_list(F.struct("pos", "text")))
    return segments.groupBy(KEY).agg(F.array_join(F.transform(parts, lambda s: s["text"]), " ").alias("transcript"))


def speech_summary(segments: DataFrame) -> DataFrame:
    length = F.col("end") - F.col("start")
    sums = segments.groupBy(KEY).agg(F.count("*").alias("total_segments"), F.coalesce(F.sum(F.when(length > 0, length)), F.lit(0.0)).alias("total_speech_duration"))
    return sums.join(full_transcript(segments), KEY).select(KEY, "total_segments", F.length("transcript").cast("long").alias("total_characters"), "total_speech_duration")


def rule_sentiment(segments: DataFrame) -> DataFrame:
    """(video_id, time, score): neutral, at each usable segment's middle."""
    return usable_segments(segments).select(KEY, midpoint().alias("time"), F.lit(0.0).alias("score"))


def model_sentiment(outputs: DataFrame) -> DataFrame:
    """outputs (video_id, time, label, confidence) as (video_id, time, score)."""
    return outputs.select(KEY, "time", signed_confidence(F.col("label"), F.col("confidence")).alias("score"))


def sentiment_summary(scores: DataFrame) -> DataFrame:
    return scores.groupBy(KEY).agg(F.coalesce(F.avg("score"), F.lit(0.0)).alias("mean"), F.coalesce(F.max(F.abs("score")), F.lit(0.0)).alias("max_abs"))


def humor_score(text: Column, language: Language) -> Column:
    """0.8 for each laugh marker and 0.3 for each casual one that the lower-cased text contains, 1 at most."""
    low, total = F.lower(text), F.lit(0.0)
    for markers, points in ((language.laugh, 0.8), (language.casual, 0.3)):
        for marker in markers:
            total = total + F.when(low.contains(marker), F.lit(points)).otherwise(F.lit(0.0))
    return F.least(total, F.lit(1.0))


def humor(segments: DataFrame, language: Language = RUSSIAN) -> DataFrame:
    """(video_id, pos, time, score) at the segments' middles."""
    return segments.select(KEY, "pos", midpoint().alias("time"), humor_score(F.col("text"), language).alias("score"))


def in_time_order(scores: DataFrame) -> DataFrame:
    """scores with `place`, from 1: by time, those of one time in order of position."""
    return scores.withColumn("place", F.row_number().over(by_video("time", "pos")))


def humor_summary(scores: DataFrame, threshold: float) -> DataFrame:
    return scores.groupBy(KEY).agg(F.coalesce(F.avg("score"), F.lit(0.0)).alias("mean"), F.coalesce(F.max("score"), F.lit(0.0)).alias("max"), F.count_if(F.col("score") > threshold).alias("count_positive"))


def blocks(videos: DataFrame, length: float) -> DataFrame:
    """(video_id, block, start, end): tiles of `length` up to the duration, the last one shorter."""
    n = F.ceil(F.col("duration") / F.lit(length)).cast("int")
    tiles = videos.where(F.col("duration") > 0).select(KEY, "duration", F.explode(F.sequence(F.lit(0), n - 1)).alias("block"))
    return tiles.select(KEY, "block", (F.col("block") * F.lit(length)).alias("start"), F.least((F.col("block") + 1) * F.lit(length), F.col("duration")).alias("end"))


def in_blocks(segments: DataFrame, tiles: DataFrame, length: float) -> DataFrame:
    """Segments that lie wholly in one tile, with its number; an equi-join on the tile of the start."""
    own = segments.select(KEY, "pos", F.col("start").alias("s"), F.col("end").alias("e"), "text", F.floor(F.col("start") / F.lit(length)).cast("int").alias("block"))
    return own.join(tiles, [KEY, "block"]).where((F.col("s") >= F.col("start")) & (F.col("e") <= F.col("end"))).select(KEY, "block", "pos", "text")


def topics(segments: DataFrame, videos: DataFrame, length: float, language: Language = RUSSIAN, words: int = 2) -> DataFrame:
    """(video_id, block, start, end, topic) of videos with segments.

    A block's topic is its most frequent meaningful words (ties: first used first), joined by an underscore;
    `general` without such words, `silence` without text. Words are runs of letters, digits and underscores, and
    count when all of them are letters of the language, more than two, and no stop word.
    """
    tiles = blocks(videos.join(segments.select(KEY).distinct(), KEY, "left_semi"), length)
    held = in_blocks(segments, tiles, length)
    tokens = held.select(KEY, "block", "pos", F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))).alias("k", "word"))
    counted = tokens.where(F.col("word").rlike(f"^[{language.letters}]+$") & (F.length("word") > 2) & ~F.col("word").isin(*language.stop_words))
    counted = counted.groupBy(KEY, "block", "word").agg(F.count("*").alias("n"), F.min(F.struct("pos", "k")).alias("first"))
    best = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "first", "word")))
    named = counted.groupBy(KEY, "block").agg(F.array_join(F.transform(F.slice(best, 1, words), lambda w: w["word"]), "_").alias("name"))
    spoken = held.groupBy(KEY, "block").agg(F.max(F.length(strip(F.col("text"))) > 0).alias("spoken"))
    joined = tiles.join(spoken, [KEY, "block"], "left").join(named, [KEY, "block"], "left")
    topic = F.when(~F.coalesce("spoken", F.lit(False)), F.lit("silence")).otherwise(F.coalesce("name", F.lit("general")))
    return joined.select(KEY, "block", "start", "end", topic.alias("topic"))


def topic_summary(segments: DataFrame) -> DataFrame:
    return segments.groupBy(KEY).agg(F.count("*").alias("total_segments"), F.countDistinct("topic").alias("unique_topics"))


def timed_by_length(texts: DataFrame, per_second: float) -> DataFrame:
    """texts (video_id, pos, text) as segments: each starts where the one before ends and lasts by its length."""
    size = F.coalesce(F.length("text"), F.lit(0))
    upto = F.sum(size).over(by_video("pos"))
    return texts.select(KEY, "pos", ((upto - size) / F.lit(per_second)).alias("start"), (upto / F.lit(per_second)).alias("end"), F.coalesce("text", F.lit("")).alias("text"))
