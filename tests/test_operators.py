"""Operators on small fixtures whose results follow from the rules by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from glimmer.config import EngineConfig
from glimmer.functions.expressions import capitalize, nearest, signed_confidence, slot_of
from glimmer.operators import audio, chapters, document, fusion, intervals, motion, scenes, series, text
from glimmer.operators.series import KEY
from glimmer.sources import media


def points(spark, *rows):
    return spark.createDataFrame([("v", float(t), None if x is None else float(x)) for t, x in rows], "video_id string, time double, value double")


def video(spark, duration, name="v"):
    return spark.createDataFrame([(name, 25.0, None, duration, 0)], "video_id string, fps double, frame_count long, duration double, file_size_bytes long")


def column(df, name, *order):
    return [r[name] for r in df.orderBy(*order or ("time",)).collect()]


@pytest.mark.parametrize(
    ("rows", "last", "wanted"),
    [([(0.5, 10), (3.5, 40)], 5, [0, 15, 25, 35, 0, 0]), ([(2, 7)], 3, [7, 7, 7, 7]), ([], 2, [0, 0, 0]), ([(1, 2), (1, 4), (2, 5)], 3, [0, 3, 5, 0])],
)
def test_interpolation(spark, rows, last, wanted):
    grid = series.grid(video(spark, float(last))).select(KEY, "slot", "time")
    assert column(series.interpolate(points(spark, *rows), grid), "value") == wanted


def test_interpolation_is_numpys(spark):
    rng = np.random.default_rng(0)
    t, v = np.sort(rng.uniform(0, 50, 40)), rng.normal(size=40)
    grid = series.grid(video(spark, 55.0)).select(KEY, "slot", "time")
    found = column(series.interpolate(points(spark, *zip(t, v, strict=True)), grid), "value")
    assert np.allclose(found, np.interp(np.arange(56.0), t, v, left=0, right=0), atol=1e-12)


def test_valid_points(spark):
    raw = spark.createDataFrame([("v", "1", "2"), ("v", "2", None), ("v", "x", "3"), ("v", "0", "5")], "video_id string, time string, value string")
    assert [(r["time"], r["value"]) for r in series.valid_points(raw).orderBy("time").collect()] == [(0.0, 5.0), (1.0, 2.0)]
    assert series.safe_mean(raw).first()["mean"] == pytest.approx(10 / 3)


@pytest.mark.parametrize(("rows", "duration", "wanted"), [([(0, 4), (2, 8)], 3.5, [0.5, 0, 1, 0]), ([(0, 4), (1, 4)], 1.2, [0, 0]), ([(0, 4), (2, 8)], None, [0, 1])])
def test_heatmap(spark, rows, duration, wanted):
    assert column(motion.heatmap(points(spark, *rows), video(spark, duration)), "value", "second") == wanted


def test_other_scalings(spark):
    assert column(series.by_max(points(spark, (0, 2), (1, 4))), "value") == [0.5, 1]
    assert column(series.by_max(points(spark, (0, 0), (1, -1))), "value") == [0, 0]
    assert column(points(spark, (0, 1), (1, 3)).withColumn("value", series.unit_range(F.col("value"))), "value") == [0, 1]


@pytest.mark.parametrize("k", [1, 3, 4, 5])
def test_smoothing_is_a_zero_padded_convolution(spark, k):
    found = column(points(spark, *enumerate([1, 2, 3, 4, 5])).withColumn("value", series.smoothed("value", k, "time")), "value")
    assert found == pytest.approx(np.convolve([1, 2, 3, 4, 5], np.ones(k) / k, mode="same") if k >= 3 else [1, 2, 3, 4, 5])


def test_speech_is_half_at_the_median(spark):
    frames = points(spark, (0, 1), (1, 2), (2, 4)).withColumnRenamed("value", "rms")
    found = audio.features(frames, 1, 0.15).orderBy("time").collect()
    assert found[1]["speech_probability"] == 0.5 and found[0]["loudness"] == 0 and found[2]["energy"] == 1
    assert found[2]["speech_probability"] == pytest.approx(1 / (1 + math.exp(-(1 - 1 / 3) / 0.15)))


def test_weights():
    assert list(EngineConfig().weights().values()) == pytest.approx([1 / 3, 1 / 4, 1 / 6, 1 / 12, 1 / 6])
    with pytest.raises(ValueError):
        EngineConfig(weight_motion=-3).weights()


def test_slots_round_half_to_even_and_stay_inside(spark):
    rows = spark.createDataFrame([(0, 0.5), (1, 1.5), (2, 2.5), (3, -3.0), (4, 99.0)], "k int, t double")
    assert column(rows.withColumn("s", slot_of(F.col("t"), 1.0, F.lit(5).cast("long"))), "s", "k") == [0, 2, 2, 0, 4]


def test_coverage(spark):
    segments = spark.createDataFrame([("v", 1.0, 2.0), ("v", 4.0, 4.0)], "video_id string, start double, end double")
    slots = series.grid(video(spark, 5.0)).select(KEY, "slot", "slots")
    assert column(fusion.coverage(segments, slots, 1.0), "covered", "slot") == [False, True, True, False, False, False]


def test_snapping(spark):
    rows = spark.createDataFrame([(2.5, [0.0, 5.0, 10.0]), (15.0, [10.0])], "t double, marks array<double>")
    near = [r[0] for r in rows.orderBy("t").select(nearest(F.col("marks"), F.col("t"))).collect()]
    assert near == [0, 10]
    for inclusive, wanted in ((True, 10.0), (False, 15.0)):
        assert rows.where("t = 15").select(intervals.snapped(F.col("t"), F.col("marks"), 5.0, inclusive).alias("s")).first()["s"] == wanted


def test_suppression_and_merging(spark):
    rows = spark.createDataFrame([("v", 15.0, 0.0, 30.0, 0.9), ("v", 35.0, 20.0, 50.0, 0.8), ("v", 46.0, 32.0, 60.0, 0.7)], "video_id string, peak double, start double, end double, score double")
    kept = intervals.suppressed(rows, 6)
    assert [(r["start"], r["end"]) for r in kept.orderBy("start").collect()] == [(0, 30), (32, 60)]
    assert intervals.suppressed(rows, 1).count() == 1
    line = points(spark, (10, 1), (40, 3), (75, 8)).withColumnRenamed("value", "interest")
    items = kept.unionByName(spark.createDataFrame([("v", 70.0, 80.0, 0.5)], kept.schema))
    assert [tuple(r)[1:] for r in intervals.merged(items, intervals.interest_arrays(line), 3.0).orderBy("start").collect()] == [(0, 60, 2.0), (70, 80, 0.5)]


def test_cuts(spark):
    found = spark.range(1).select(scenes.accepted_cuts(F.array(*[F.lit(x) for x in (0.2, 0.6, 0.9, 1.4)]), 0.5).alias("c")).first()["c"]
    assert found == [0, 0.6, 1.4]


def test_dissimilarity(spark):
    rows = spark.createDataFrame([([1.0, 2.0, 3.0], [2.0, 4.0, 6.0]), ([1.0, 2.0, 3.0], [3.0, 2.0, 1.0]), ([1.0, 1.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert [r[0] for r in rows.select(scenes.dissimilarity(F.col("a"), F.col("b"))).collect()] == pytest.approx([0, 1, 0])


@pytest.mark.parametrize(("lengths", "wanted"), [([3, 12], [(0, 3, 15)]), ([3, 4], [(0, 0, 3), (1, 3, 7)]), ([], [(0, 0, 0)])])
def test_scene_filter(spark, lengths, wanted):
    ends = np.cumsum(lengths)
    rows = [("v", 0, float(e - n), float(e)) for e, n in zip(ends, lengths, strict=True)]
    found = scenes.long_enough(spark.createDataFrame(rows, "video_id string, index int, start double, end double"), video(spark, 20.0), 10.0)
    assert [tuple(r)[1:] for r in found.orderBy("index").collect()] == wanted


def test_scenes_from_zero(spark):
    rows = spark.createDataFrame([("v", 0, 5.0, 20.0), ("v", 1, 20.0, 40.0)], "video_id string, index int, start double, end double")
    found = scenes.from_zero(rows)
    assert [tuple(r)[1:] for r in found.orderBy("index").collect()] == [(0, 0, 5), (1, 5, 20), (2, 20, 40)]
    assert column(scenes.boundaries(found), "time") == [0, 5, 20]


def segments(spark, *rows):
    return spark.createDataFrame([("v", k, float(a), float(b), t) for k, (t, a, b) in enumerate(rows)], "video_id string, pos long, start double, end double, text string")


def test_transcript_filter(spark):
    found = text.speech_segments(segments(spark, ("  ", 0, 1), (" a ", 0, 0.1), (" b\n", 0, 0.2)), 0.1).collect()
    assert [(r["text"], r["start"], r["end"]) for r in found] == [("b", 0, 0.2)]


def test_labels(spark):
    rows = spark.createDataFrame([("POSITIVE", 0.9), ("negative", 0.8), ("LABEL_0", 0.7), ("LABEL_1", 0.6), ("LABEL_2", 1.4), ("OTHER", 0.5)], "label string, c double")
    assert [r[0] for r in rows.select(signed_confidence(F.col("label"), F.col("c"))).collect()] == [0.9, -0.8, -0.7, 0, 1, 0]


def test_humor(spark):
    found = text.humor(segments(spark, ("Смех в зале", 0, 1), ("какой", 1, 2), ("нет", 2, 3)))
    assert column(found, "score", "pos") == [1.0, 0.3, 0.0]
    assert text.humor_summary(found, 0.5).first()["count_positive"] == 1


def test_topics(spark):
    rows = segments(spark, ("кот дом кот и лес лес", 0, 10), ("потеряно", 40, 50), ("the only english", 50, 60))
    found = text.topics(rows, video(spark, 100.0), 45.0).orderBy("block").collect()
    assert [(r["start"], r["end"], r["topic"]) for r in found] == [(0, 45, "кот_лес"), (45, 90, "general"), (90, 100, "silence")]
    assert text.topics(rows.limit(0), video(spark, 100.0), 45.0).count() == 0
    assert text.topic_summary(text.topics(rows, video(spark, 100.0), 45.0)).first()["unique_topics"] == 3


def test_absorption_and_titles(spark):
    topics = spark.createDataFrame([("v", 0, 0.0, 20.0, "a"), ("v", 1, 20.0, 45.0, "b"), ("v", 2, 45.0, 90.0, "c"), ("v", 3, 90.0, 100.0, "d")], "video_id string, block int, start double, end double, topic string")
    assert [tuple(r)[1:] for r in chapters.absorbed(topics, 30.0).orderBy("chapter").collect()] == [(1, 0, 45, "a_b"), (2, 45, 90, "c"), (3, 90, 100, "d")]
    rows = spark.createDataFrame([(1, "silence"), (2, "a_b_c"), (3, "хОР")], "n int, topic string")
    assert [r[0] for r in rows.select(chapters.title(F.col("n"), F.col("topic"))).collect()] == ["Глава 1: Пауза", "Глава 2: a b", "Глава 3: Хор"]
    assert spark.range(1).select(capitalize(F.lit("aBC"))).first()[0] == "Abc"


def scored(spark, *values, step=1.0):
    return spark.createDataFrame([("v", k * step, float(x)) for k, x in enumerate(values)], "video_id string, time double, score double")


def test_simple_peaks_and_extents(spark):
    assert column(audio.simple_peaks(scored(spark, 0.1, 0.8, 0.8, 0.2), 0.75), "time") == [1]
    loud = scored(spark, 0.1, 0.7, 0.8, 0.7, 0.1, step=0.1)
    found = audio.extents(loud, audio.simple_peaks(loud, 0.75), 0.75, 0.2).first()
    assert (found["start"], found["end"]) == pytest.approx((0, 0.4))


def test_prominent_peaks(spark):
    line = scored(spark, 0, 0.9, 0.9, 0.9, 0.1, 0.8, 0.75, 0.95, 0.2, 0.5, 0.45, 1.0, 0)
    # the flat top counts at its middle; 0.8 rises by 0.05 only; 0.5 is too low
    assert column(audio.prominent_peaks(line, 0.6, 1.0, 0.15), "time") == [2, 7, 11]
    # four samples apart: 0.95 is too near to 1.0
    assert column(audio.prominent_peaks(line, 0.6, 5.0, 0.15), "time") == [2, 11]


def timeline(spark, values):
    rows = [("v", k, float(k), float(x), 0.0, 0.0, 0.0, 0.0, False, False, False, False) for k, x in enumerate(values)]
    names = "video_id string, slot long, time double, interest double, motion double, audio_loudness double, sentiment double, humor double, has_laughter boolean, has_loud_sound boolean, is_scene_boundary boolean, is_dialogue boolean"
    return spark.createDataFrame(rows, names)


def test_interest_peaks(spark):
    assert column(intervals.interest_peaks(timeline(spark, [0, 1, 1, 0]), 0.5), "time") == [1, 2]
    assert intervals.interest_peaks(timeline(spark, [1, 0, 1]), 0.9).count() == 0
    assert intervals.quantiles(timeline(spark, [1, 2, 4]), 0.9).first()["threshold"] == pytest.approx(3.6)


def test_highlights_without_peaks_fall_back(spark):
    none = spark.createDataFrame([], "video_id string, time double")
    line = timeline(spark, [1, *[0] * 40])
    found = intervals.highlights(line, video(spark, 40.0), none).collect()
    assert [(r["start"], r["end"]) for r in found] == [(0.0, 30.0)] and found[0]["score"] == pytest.approx(1 / 31)
    assert intervals.best_window(timeline(spark, [0, 1, 0]), video(spark, 10.0), 30.0).first()[1:] == (0, 10, 0)
    assert intervals.highlights(timeline(spark, [0, 1]), video(spark, 2.0), none).count() == 0


def test_truncation(spark):
    def cut(n):
        return spark.range(1).select(document.truncated(F.sequence(F.lit(1), F.lit(n)), 10).alias("t")).first()["t"]

    assert cut(12).asDict() == {"truncated": True, "total_length": 12, "first_items": [1, 2, 3, 4, 5], "last_items": [8, 9, 10, 11, 12]}
    assert cut(10)["first_items"] == list(range(1, 11)) and not cut(10)["truncated"]


def test_video_info(spark):
    rows = spark.createDataFrame([("a", float("nan"), 50, 1), ("b", 0.0, 0, 1), ("c", 10.0, 5, 1)], "video_id string, fps double, frame_count long, file_size_bytes long")
    assert [tuple(r)[1:4] for r in media.video_info(rows).orderBy(KEY).collect()] == [(25.0, 50, 2.0), (25.0, None, None), (10.0, 5, 0.5)]


def test_decoders_and_models_are_plugged_in(spark, tmp_path):
    import pandas as pd

    (tmp_path / "x.bin").write_bytes(b"abcd")
    found = media.files(spark, str(tmp_path))
    assert found.first()["file_size_bytes"] == 4
    frames = media.decoded(found, lambda path: iter([pd.DataFrame({"frame_index": [0, 1], "time": [0.0, 0.04], "value": [1.0, 2.0]})]), "video_id string, frame_index long, time double, value double")
    assert column(motion.differences(frames), "value") == [1.0]
    heard = media.transcribed(found, lambda: "model", lambda model, path: [(0.0, 1.0, model)])
    assert heard.first()["text"] == "model"
    told = media.classified(heard, lambda: lambda texts: [("POSITIVE", 0.5)] * len(texts))
    assert text.model_sentiment(told).first()["score"] == 0.5


def test_a_model_that_cannot_be_loaded_is_neutral_and_long_texts_are_cut(spark):
    def broken():
        raise ImportError("no such library")

    rows = segments(spark, ("one two  three", 0, 2), ("x", 2, 4))
    told = media.classified(rows, broken)
    assert [r["score"] for r in text.model_sentiment(told).collect()] == [0, 0] == [r["score"] for r in text.rule_sentiment(rows).collect()]
    seen = media.classified(rows, lambda: lambda texts: [(t, 1.0) for t in texts], most_words=2)
    assert sorted(r["label"] for r in seen.collect()) == ["one two", "x"]


def test_one_file(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"abcd")
    assert media.one_file(spark, str(tmp_path / "x.bin")).first()["file_size_bytes"] == 4
    for path, error in ((None, ValueError), ("", ValueError), (str(tmp_path / "none"), FileNotFoundError), (str(tmp_path), IsADirectoryError)):
        with pytest.raises(error):
            media.one_file(spark, path)


def test_settings_come_from_a_file_and_the_environment(tmp_path, monkeypatch):
    (tmp_path / "s.env").write_text("# settings\nGLIMMER_TOP_K=3\nGLIMMER_STEP = '0.5'\nGLIMMER_SNAP_TO_SCENES=no\nOTHER=1\n")
    monkeypatch.setenv("GLIMMER_TOP_K", "4")
    found = EngineConfig.from_env(str(tmp_path / "s.env"))
    assert (found.top_k, found.step, found.snap_to_scenes, found.merge_gap) == (4, 0.5, False, 3.0)
    assert EngineConfig(weight_motion=2.0, normalize_weights=False).weights()["motion"] == 2.0


def test_documents_are_written_as_json_lines(spark, tmp_path):
    docs = document.document(video(spark, 2.0), {"transcript": spark.createDataFrame([("v", "привет")], "video_id string, transcript string")})
    media.write_documents(docs, str(tmp_path / "out"))
    assert "привет" in "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "out").glob("*.json"))


def test_zipped_points_and_scores(spark):
    rows = spark.createDataFrame([("v", [1.0, 2.0, 3.0], [5.0, 6.0]), ("w", None, [1.0]), ("x", [], [1.0])], "video_id string, a array<double>, b array<double>")
    assert [tuple(r) for r in series.zipped_points(rows, "a", "b").collect()] == [("v", 1.0, 5.0), ("v", 2.0, 6.0)]
    mixed = spark.createDataFrame([("v", 0.0, 0.5, None), ("v", 1.0, None, 0.2)], "video_id string, time double, score double, sentiment double")
    assert column(fusion.score_or_sentiment(mixed), "value") == [0.5, None]  # a score that is null is none, whatever the sentiment is
    assert column(fusion.score_or_sentiment(mixed.drop("score")), "value") == [None, 0.2]


def test_snapping_to_marks_without_arrays(spark):
    marks = spark.createDataFrame([("v", 0.0), ("v", 5.0), ("v", 10.0), ("v", None)], "video_id string, time double")
    rows = spark.createDataFrame([("v", 2.5, 1), ("v", 7.6, 2), ("v", 15.0, 3), ("v", 5.0, 4), ("w", 1.0, 5)], "video_id string, time double, row int")
    found = {r["row"]: (r["near"], r["snapped"]) for r in intervals.snap_to_marks(rows, marks, 5.0, False).collect()}
    assert found == {1: (0.0, 0.0), 2: (10.0, 10.0), 3: (10.0, 15.0), 4: (5.0, 5.0), 5: (None, 1.0)}


def test_means_by_running_sums_are_those_of_the_points(spark):
    rng = np.random.default_rng(1)
    t, x = np.sort(rng.uniform(0, 100, 300)), rng.random(300)
    line = points(spark, *zip(t, x, strict=True)).withColumnRenamed("value", "interest")
    ends = [(float(a), float(b)) for a, b in rng.uniform(-10, 110, (60, 2))] + [(float(t[3]), float(t[9])), (200.0, 300.0)]
    held = spark.createDataFrame([("v", a, b) for a, b in ends], "video_id string, a double, b double").join(intervals.interest_arrays(line), KEY)
    for r in held.select("a", "b", intervals.mean_in_window(F.col("points"), F.col("a"), F.col("b")).alias("m")).collect():
        inside = x[(t >= r["a"]) & (t <= r["b"])]
        assert r["m"] == pytest.approx(inside.mean() if len(inside) else 0, abs=1e-12)


def test_pixels(spark):
    rows = spark.createDataFrame([("v", 0, 0.0, [0, 4]), ("v", 1, 1.0, [2, 0]), ("v", 2, 2.0, [])], "video_id string, frame_index long, time double, pixels array<int>")
    assert column(motion.pixel_differences(rows.where("frame_index < 2")), "value") == [3.0]
    flow = spark.createDataFrame([(1, [0.0, 1.0, 0.05, 0.2]), (2, [0.0, 0.0]), (3, [])], "k int, m array<double>")
    assert column(flow.select("k", motion.moving_fraction(F.col("m")).alias("f")), "f", "k") == [0.5, 0.0, 0.0]
