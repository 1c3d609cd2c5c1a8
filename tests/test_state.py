"""Stateful streams against the batch operators on the same rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from glimmer.operators import intervals, scenes
from glimmer.streaming import state

ORIGIN = "2024-01-01"
LATE = "60 seconds"


def micros(seconds):
    """A timestamp so many seconds after the origin."""
    return F.timestamp_micros(F.unix_micros(F.lit(ORIGIN).cast("timestamp")) + F.round(F.col(seconds) * 1e6).cast("long"))


def shuffled(rng, times, late):
    """An order in which each row comes before the others are `late` ahead of it."""
    return np.argsort(times + rng.uniform(0, late, len(times)), kind="stable")


def streamed(spark, rows, folder, parts):
    """A stream of rows in their order, some of them a batch."""
    for k, part in enumerate(np.array_split(np.arange(len(rows)), parts)):
        spark.createDataFrame([rows[i] for i in part], rows_schema(rows)).coalesce(1).write.mode("append").parquet(f"{folder}/{k:03d}")
    return f"{folder}/*", rows_schema(rows)


def rows_schema(rows):
    return "video_id string, seconds double, " + ("score double" if len(rows[0]) == 3 else "kind int, until double, score double")


def run(spark, stream, name):
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)


@pytest.fixture
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_cuts_in_any_order_are_those_of_the_batch(spark, tmp_path, few_partitions):
    rng = np.random.default_rng(0)
    times = np.sort(rng.uniform(0, 600, 300))
    rows = [(f"v{k % 3}", float(np.round(times[k], 6)), float(rng.random())) for k in shuffled(rng, times, 55)]
    path, schema = streamed(spark, [*rows, ("end", 10_000.0, 0.0)], tmp_path / "in", 6)
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    found = run(spark, state.shot_boundaries(source.select("video_id", micros("seconds").alias("ts"), "score"), 0.7, 4.0, ORIGIN, LATE), "cuts")
    batch = scenes.shot_boundaries(spark.createDataFrame(rows, schema).withColumnRenamed("seconds", "time"), 0.7, 4.0)
    want = sorted((r["video_id"], r["time"]) for r in batch.collect())
    assert len(want) > 50 and sorted((r["video_id"], r["time"]) for r in found.where("video_id <> 'end'").collect()) == want


def test_rows_behind_the_watermark_are_dropped(spark, tmp_path, few_partitions):
    rows = [("v", 1.0, 1.0), ("v", 500.0, 1.0), ("v", 505.0, 1.0), ("v", 10.0, 1.0), ("v", 5000.0, 0.0)]
    path, schema = streamed(spark, rows, tmp_path / "in", 5)
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    found = run(spark, state.shot_boundaries(source.select("video_id", micros("seconds").alias("ts"), "score"), 0.5, 1.0, ORIGIN, LATE), "late_cuts")
    assert sorted(r["time"] for r in found.collect()) == [0.0, 1.0, 500.0, 505.0]


def test_merged_intervals_are_those_of_the_batch(spark, tmp_path, few_partitions):
    rng = np.random.default_rng(1)
    rows = []
    for v in ("a", "b"):
        rows += [(v, float(t), 0, 0.0, float(np.round(rng.random(), 3))) for t in range(0, 900, 2)]
        starts = np.round(np.sort(rng.uniform(0, 880, 45)), 3)
        rows += [(v, float(s), 1, float(np.round(s + rng.uniform(1, 14), 3)), float(np.round(rng.random(), 3))) for s in starts]
    order = shuffled(rng, np.array([r[1] for r in rows]), 55)
    rows = [rows[k] for k in order]
    path, schema = streamed(spark, [*rows, ("end", 10_000.0, 0, 0.0, 0.0)], tmp_path / "in", 5)
    source = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    spans = source().where("kind = 1").select("video_id", micros("seconds").alias("ts"), micros("until").alias("end_ts"), "score")
    points = source().where("kind = 0").select("video_id", micros("seconds").alias("ts"), F.col("score").alias("interest"))
    found = run(spark, state.merged(spans, points, 3.0, ORIGIN, LATE), "spans")
    df = spark.createDataFrame(rows, schema)
    items = df.where("kind = 1").select("video_id", F.col("seconds").alias("start"), F.col("until").alias("end"), "score")
    arrays = intervals.interest_arrays(df.where("kind = 0").select("video_id", F.col("seconds").alias("time"), F.col("score").alias("interest")))
    as_rows = lambda d: sorted((r["video_id"], r["start"], r["end"], round(r["score"], 9)) for r in d.collect())
    want = as_rows(intervals.merged(items, arrays, 3.0))
    assert 10 < len(want) < 80 and as_rows(found) == want
