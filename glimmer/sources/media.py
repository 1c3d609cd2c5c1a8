"""Files and decoders.

Decoding is a plug-in: a Decoder turns one file into rows of a fixed schema, in the executors, a file at a time.
No decoder is part of this package; frames, samples and transcripts may as well come from tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glimmer.operators.series import KEY

#: The label that counts neither way.
NEUTRAL = "NEUTRAL"
#: path -> rows of the decoder's schema, without video_id.
Decoder = Callable[[str], Iterator[pd.DataFrame]]


def files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(video_id, path, file_size_bytes) of the files under a path, without reading them."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return found.select(F.element_at(F.split("path", "/"), -1).alias(KEY), "path", F.col("length").alias("file_size_bytes"))


def one_file(spark: SparkSession, path: str | None) -> DataFrame:
    """files() of a single file; a missing or empty path, one that leads nowhere and a folder are errors."""
    if not path:
        raise ValueError("no path is given")
    try:
        found = files(spark, path)
        rows = found.select("path").limit(2).collect()
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(path) from error
        raise
    named = path.rstrip("/").split("://")[-1].split("/")[-1]
    if len(rows) != 1 or rows[0]["path"].split("/")[-1] != named:
        raise IsADirectoryError(path)
    return found


def video_info(rows: DataFrame) -> DataFrame:
    """rows (video_id, fps, frame_count, file_size_bytes) with usable fps (25 unless positive and finite) and the duration.

    A frame count that isn't positive is unknown, and so is then the duration.
    """
    fps = F.col("fps")
    good = fps.isNotNull() & ~F.isnan(fps) & (fps > 0) & (fps < float("inf"))
    clean = rows.withColumn("fps", F.when(good, fps).otherwise(F.lit(25.0))).withColumn("frame_count", F.when(F.col("frame_count") > 0, F.col("frame_count").cast("long")))
    return clean.select(KEY, "fps", "frame_count", (F.col("frame_count") / F.col("fps")).alias("duration"), "file_size_bytes")


def decoded(found: DataFrame, decoder: Decoder, schema: str) -> DataFrame:
    """What the decoder gives for each file of (video_id, path); schema begins with video_id. A file is one task's unit."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                for part in decoder(row.path):
                    part.insert(0, KEY, getattr(row, KEY))
                    yield part

    return found.select(KEY, "path").mapInPandas(run, schema)


def transcribed(audio: DataFrame, load: Callable[[], Any], transcribe: Callable[[Any, str], list[tuple[float, float, str]]]) -> DataFrame:
    """(video_id, pos, start, end, text) of (video_id, path): a model is loaded once per worker; a failing file gives no rows, a failing load fails."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for batch in batches:
            for row in batch.itertuples():
                model = load() if model is None else model
                try:
                    parts = transcribe(model, row.path)
                except Exception:  # a broken file is an empty transcript
                    continue
                yield pd.DataFrame([(getattr(row, KEY), k, *p) for k, p in enumerate(parts)], columns=[KEY, "pos", "start", "end", "text"])

    return audio.select(KEY, "path").mapInPandas(run, "video_id string, pos long, start double, end double, text string")


def classified(segments: DataFrame, load: Callable[[], Callable[[list[str]], list[tuple[str, float]]]], batch: int = 8, most_words: int = 256) -> DataFrame:
    """(video_id, time, label, confidence) of usable segments (video_id, start, end, text), `batch` texts at a time.

    A model gets the first most_words words of a text. Where it can't be loaded every segment is neutral, as by the rule.
    """

    def neutral(texts: list[str]) -> list[tuple[str, float]]:
        return [(NEUTRAL, 0.0)] * len(texts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for rows in batches:
            if model is None:
                try:
                    model = load()
                except Exception:  # no such model or library here: the rule holds
                    model = neutral
            texts = rows["text"].tolist()
            found = [x for k in range(0, len(rows), batch) for x in model(texts[k : k + batch])]
            yield pd.DataFrame({KEY: rows[KEY], "time": rows["time"], "label": [x[0] for x in found], "confidence": [float(x[1]) for x in found]})

    words = F.slice(F.split(F.trim("text"), r"\s+"), 1, most_words)
    timed = segments.select(KEY, ((F.col("start") + F.col("end")) / 2).alias("time"), F.when(F.size(F.split(F.trim("text"), r"\s+")) > most_words, F.array_join(words, " ")).otherwise(F.col("text")).alias("text"))
    return timed.mapInPandas(run, "video_id string, time double, label string, confidence double")


def write_documents(documents: DataFrame, path: str) -> None:
    """One JSON object a line, non-ASCII text as it is."""
    documents.write.mode("overwrite").json(path)
