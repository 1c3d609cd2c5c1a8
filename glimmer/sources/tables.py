"""Signals of videos from the tables at hand.

An event stream stands in for what a decoder would give: a user's events are one video, an hour is a second, an
event's value is the frame's scalar and the audio level. Conversations are transcripts, timed by their lengths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glimmer.operators.series import KEY
from glimmer.operators.text import timed_by_length

ORIGIN = "2024-01-01 00:00:00"
HOUR = 3_600_000_000
CHARS_PER_SECOND = 15.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video_id, event_id, time, value, event_type) of all events."""
    events = table(spark, sf_dir, "events")
    micros = F.timestamp_diff("MICROSECOND", F.lit(ORIGIN).cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz"))
    return events.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias(KEY), "event_id", (micros / F.lit(float(HOUR))).alias("time"), "value", "event_type")


def frames(rows: DataFrame) -> DataFrame:
    """(video_id, frame_index, time, value): signals numbered by time."""
    index = F.row_number().over(Window.partitionBy(KEY).orderBy("time", "event_id")) - 1
    return rows.select(KEY, index.cast("long").alias("frame_index"), "time", "value")


def videos(rows: DataFrame) -> DataFrame:
    """(video_id, fps, frame_count, duration, file_size_bytes) of signals."""
    out = rows.groupBy(KEY).agg(F.count("*").alias("frame_count"), F.ceil(F.max("time")).cast("double").alias("duration"))
    return out.select(KEY, F.lit(25.0).alias("fps"), "frame_count", "duration", F.lit(0).cast("long").alias("file_size_bytes"))


def transcripts(spark: SparkSession, sf_dir: str, prefix: str = "c") -> DataFrame:
    """(video_id, pos, start, end, text) of conversations."""
    turns = table(spark, sf_dir, "conversations")
    return timed_by_length(turns.select(F.concat(F.lit(prefix), F.col("conv_id").cast("string")).alias(KEY), F.col("turn").alias("pos"), "text"), CHARS_PER_SECOND)


def transcript_videos(segments: DataFrame) -> DataFrame:
    out = segments.groupBy(KEY).agg(F.max("end").alias("duration"))
    return out.select(KEY, F.lit(25.0).alias("fps"), F.lit(None).cast("long").alias("frame_count"), "duration", F.lit(0).cast("long").alias("file_size_bytes"))


def histograms(spark: SparkSession, sf_dir: str, per_video: int = 50, fps: float = 2.0) -> DataFrame:
    """(video_id, time, hist): embeddings in order of their ids, per_video of one label's neighbourhood each."""
    rows = table(spark, sf_dir, "embeddings").where(F.col("embedding").isNotNull())
    video = F.concat(F.lit("e"), F.floor(F.col("vec_id") / per_video).cast("string"))
    return rows.select(video.alias(KEY), (F.pmod("vec_id", F.lit(per_video)) / F.lit(fps)).alias("time"), F.col("embedding").alias("hist"))


def byte_frames(spark: SparkSession, sf_dir: str, width: int = 12, height: int = 6, channels: int = 3, fps: float = 25.0, text: Column | None = None) -> DataFrame:
    """(video_id, frame_index, time, width, height, pixels): the bytes of each document's text (or of what is made of it), cut into frames."""
    size = width * height * channels
    raw = F.encode(F.col("text") if text is None else text, "utf-8")
    rows = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias(KEY), raw.alias("raw")).where(F.octet_length("raw") >= size)
    cut = rows.select(KEY, "raw", F.explode(F.sequence(F.lit(0), F.floor(F.octet_length("raw") / size).cast("int") - 1)).alias("k"))
    return cut.select(KEY, F.col("k").cast("long").alias("frame_index"), (F.col("k") / F.lit(fps)).alias("time"), F.lit(width).alias("width"), F.lit(height).alias("height"), F.substring("raw", F.col("k") * size + 1, F.lit(size)).alias("pixels"))


def letter_sound(spark: SparkSession, sf_dir: str, rate: int = 22050, chunk: int = 4096) -> DataFrame:
    """(video_id, chunk, start, rate, samples): each document's letters as samples, by their codes modulo 256."""
    rows = table(spark, sf_dir, "documents").where(F.length("text") > 0).select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias(KEY), "text")
    cut = rows.select(KEY, "text", F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / chunk).cast("int"))).alias("chunk"))
    letters = F.split(F.substring("text", F.col("chunk") * chunk + 1, F.lit(chunk)), "(?s)(?<=.)(?=.)")
    samples = F.transform(letters, lambda c: (F.pmod(F.ascii(c), F.lit(256)) - 128) / F.lit(128.0))
    return cut.select(KEY, F.col("chunk").cast("long").alias("chunk"), (F.col("chunk") * chunk).cast("long").alias("start"), F.lit(rate).alias("rate"), samples.alias("samples"))
