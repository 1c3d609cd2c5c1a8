"""Registered queries against their SQL, the stage chain, and streams."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from glimmer.config import EngineConfig
from glimmer.plans import stages
from glimmer.plans.oracles import ORACLES
from glimmer.plans.queries import QUERIES
from glimmer.sources import tables
from glimmer.streaming import windows

DATA = "/root/testdata/sf0.001"


def plain(value):
    return round(value, 5) if isinstance(value, float) and not math.isnan(value) else value


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for name in ("events", "documents", "embeddings", "labels", "conversations"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


#: Models that go from frame to frame; tests/test_frames.py holds them against plain loops.
WITHOUT_SQL = {"w2_optical_flow", "w3_background_model"}


def test_every_query_has_sql():
    assert set(QUERIES) - WITHOUT_SQL == set(ORACLES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_is_its_sql(spark, database, name):
    df = QUERIES[name](spark, DATA)
    wanted = database.sql(ORACLES[name])
    names = sorted(df.columns)
    assert sorted(wanted.columns) == names
    rows = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    other = sorted((tuple(plain(r[wanted.columns.index(c)]) for c in names) for r in wanted.fetchall()), key=repr)
    assert rows == other


def test_stage_chain(spark):
    rows = tables.signals(spark, DATA)
    videos = tables.videos(rows)
    levels = rows.groupBy("video_id", "time").agg(F.avg("value").alias("rms"))
    cuts = rows.where("value > 200").select("video_id", "time")
    talk = tables.transcripts(spark, DATA, prefix="u")
    have = stages.Analysis(EngineConfig(loud_min_gap=20.0)).run(videos=videos, frames=tables.frames(rows), levels=levels, cuts=cuts, transcripts=talk)
    assert have["document"].count() == videos.count()
    assert stages.summary(have).where("highlights > 0").count() > 0


def test_streams(spark, tmp_path):
    source = tmp_path / "in"
    rows = spark.sql("SELECT 'v' AS video_id, timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id * 2) AS ts, CAST(id AS DOUBLE) AS value FROM range(4) UNION ALL SELECT 'v', timestamp'2024-01-01 01:00:00', 9D")
    rows.write.parquet(str(source))
    for frame, name, wanted in (
        (windows.second_means, "means", 4),
        (windows.merged_events, "runs", 1),
    ):
        stream = frame(spark.readStream.schema(rows.schema).parquet(str(source)), late="1 second")
        query = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        assert spark.table(name).count() == wanted


def sql_of(name, folder):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    return sorted(con.sql(ORACLES[name]).fetchall())


def test_windows_of_equal_scores_merge_as_in_sql(spark, tmp_path):
    # two windows of one mean, which running sums and plain means tell apart in the sixteenth place, in either order
    spark.read.parquet("/root/testdata/sf0.1/events.parquet").where("user_id = 1073").write.parquet(f"{tmp_path}/events.parquet")
    assert sorted(map(tuple, QUERIES["w17_merge"](spark, str(tmp_path)).collect())) == sql_of("w17_merge", tmp_path) != []


def test_a_video_without_peaks_has_nothing_to_merge(spark, tmp_path):
    # interest rises to its last point
    rows = [(k, f"2024-01-01 0{k}:00:00", 1, "view", x) for k, x in enumerate((1.0, 5.0, 9.0, 20.0), 1)]
    spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/events.parquet")
    assert QUERIES["j11_fusion_timeline"](spark, str(tmp_path)).count() == 5
    assert [tuple(r) for r in QUERIES["w17_merge"](spark, str(tmp_path)).collect()] == sql_of("w17_merge", tmp_path) == []
