"""Queries over the tables at hand, one per operator or chain of operators; figures are rounded to six places.

Series that later meet a threshold are rounded before it, so that the same comparison holds in any engine.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glimmer.config import EngineConfig
from glimmer.functions.expressions import signed_confidence
from glimmer.operators import audio, chapters, document, frames, fusion, intervals, motion, scenes, series, text
from glimmer.operators.series import KEY
from glimmer.sources import media, scratch, tables, video

Query = Callable[[SparkSession, str], DataFrame]
CONFIG = EngineConfig(loud_threshold=0.6, min_highlight=30.0)


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c) + F.lit(0.0), places) for c in columns})


def rounded_means(df: DataFrame, column: str = "score") -> DataFrame:
    """Means of figures with six places, of which halves are common: a billionth more decides them all alike."""
    return df.withColumn(column, F.round(F.col(column) + F.lit(1e-9), 6))


# ---- stand-in relations


def _signals(spark: SparkSession, d: str) -> DataFrame:
    return tables.signals(spark, d)


def _frames(spark: SparkSession, d: str) -> DataFrame:
    return tables.frames(_signals(spark, d))


def _videos(spark: SparkSession, d: str) -> DataFrame:
    return tables.videos(_signals(spark, d))


def _heat(spark: SparkSession, d: str) -> DataFrame:
    return rounded(motion.heatmap(motion.differences(_frames(spark, d)), _videos(spark, d)), "value")


def _levels(spark: SparkSession, d: str) -> DataFrame:
    # partitioned by video at once, as what follows needs it
    return _signals(spark, d).select(KEY, "time", "value").repartition(KEY).groupBy(KEY, "time").agg(F.avg("value").alias("rms"))


def _features(spark: SparkSession, d: str) -> DataFrame:
    return rounded(audio.features(_levels(spark, d), 5, 0.15), "loudness", "energy", "speech_probability")


def _loud(spark: SparkSession, d: str) -> DataFrame:
    return rounded(audio.loud_score(_features(spark, d)), "score")


def _hist_scores(spark: SparkSession, d: str) -> DataFrame:
    return rounded(scenes.shot_scores(tables.histograms(spark, d)), "score")


def _hist_videos(spark: SparkSession, d: str) -> DataFrame:
    return tables.histograms(spark, d).groupBy(KEY).agg((F.max("time") + 0.5).alias("duration"))


def _shots(spark: SparkSession, d: str) -> DataFrame:
    return scenes.shot_boundaries(_hist_scores(spark, d), 0.9, 2.0)


def _scenes(spark: SparkSession, d: str) -> DataFrame:
    return scenes.scenes_between(_shots(spark, d).where("time > 0"), _hist_videos(spark, d))


def _segments(spark: SparkSession, d: str) -> DataFrame:
    return rounded(text.speech_segments(tables.transcripts(spark, d), CONFIG.min_speech), "start", "end")


def _segment_videos(spark: SparkSession, d: str) -> DataFrame:
    return tables.transcript_videos(_segments(spark, d))


def _topics(spark: SparkSession, d: str) -> DataFrame:
    return _topics_of(_segments(spark, d))


def _topics_of(segments: DataFrame) -> DataFrame:
    return text.topics(segments, tables.transcript_videos(segments), CONFIG.block_duration, text.ENGLISH)


def _events(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", F.lit("loud_event")).otherwise(F.lit("laughter"))
    return _signals(spark, d).where(F.col("event_type").isin("error", "signup") & (F.col("value") > 150)).select(KEY, "time", kind.alias("type"))


def _marks(spark: SparkSession, d: str) -> DataFrame:
    return _signals(spark, d).where((F.col("event_type") == "purchase") & (F.col("value") > 100)).select(KEY, "time")


def _spans(spark: SparkSession, d: str) -> DataFrame:
    """Stand-in segments of the event videos: from each view event, for a tenth of its value."""
    return _signals(spark, d).where(F.col("event_type") == "view").select(KEY, F.col("event_id").alias("pos"), F.col("time").alias("start"), (F.col("time") + F.col("value") / 10).alias("end"))


def _scores(spark: SparkSession, d: str, kind: str, low: float) -> DataFrame:
    score = F.round(F.greatest(F.lit(low), F.least(F.lit(1.0), (F.col("value") - 60) / 60)), 6)
    return _signals(spark, d).where(F.col("event_type") == kind).select(KEY, "time", score.alias("score"))


def _timeline(spark: SparkSession, d: str) -> DataFrame:
    heat = _heat(spark, d).select(KEY, F.col("second").cast("double").alias("time"), "value")
    out = fusion.timeline(_videos(spark, d), heat, _features(spark, d), _scores(spark, d, "click", -1.0), _scores(spark, d, "signup", 0.0), _events(spark, d), _marks(spark, d), _spans(spark, d), CONFIG)
    return rounded(out, "interest", "motion", "audio_loudness", "sentiment", "humor")


# ---- queries


def a1_second_mean(spark: SparkSession, d: str) -> DataFrame:
    return rounded(series.second_means(_signals(spark, d)), "value")


def a4_max_normalized_heatmap(spark: SparkSession, d: str) -> DataFrame:
    return rounded(motion.sparse_heatmap(motion.differences(_frames(spark, d))), "value")


def a5_unit_range(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_levels(spark, d).select(KEY, "time", series.unit_range(F.col("rms")).alias("value")), "time", "value")


def a6_motion_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(motion.summary(_heat(spark, d)), "mean", "max")


def p1_frame_sampling_diff(spark: SparkSession, d: str) -> DataFrame:
    return rounded(motion.differences(motion.sampled(_frames(spark, d), 3)), "time", "value")


def p2_rate_sampling(spark: SparkSession, d: str) -> DataFrame:
    return rounded(motion.sampled_by_rate(_frames(spark, d), _videos(spark, d), 4.0), "time").select(KEY, "frame_index", "time", "value")


def p7_valid_points(spark: SparkSession, d: str) -> DataFrame:
    raw = tables.table(spark, d, "events").select(F.col("user_id").cast("string").alias(KEY), F.get_json_object("props", "$.k").alias("time"), F.when(F.col("value") > 50, F.col("value").cast("string")).otherwise(F.lit("none")).alias("value"))
    return rounded(series.valid_points(raw), "value")


def a19_safe_mean(spark: SparkSession, d: str) -> DataFrame:
    raw = tables.table(spark, d, "events").select(F.col("event_type").alias(KEY), F.when(F.col("value") > 50, F.col("value").cast("string")).otherwise(F.lit("none")).alias("value"))
    return rounded(series.safe_mean(raw), "mean")


def s2_video_info(spark: SparkSession, d: str) -> DataFrame:
    fps = F.when(F.col("event_id") % 3 == 0, F.lit(0.0)).when(F.col("event_id") % 3 == 1, F.lit(float("nan"))).otherwise(F.round("value", 2))
    rows = tables.table(spark, d, "events").select(F.col("event_id").cast("string").alias(KEY), fps.alias("fps"), (F.col("event_id") % 100 - 10).alias("frame_count"), F.lit(1).cast("long").alias("file_size_bytes"))
    return rounded(media.video_info(rows), "fps", "duration")


def w7_smoothing_zero_pad(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_levels(spark, d).select(KEY, "time", series.smoothed("rms", 5, "time").alias("value")), "time", "value")


def w8_speech_probability(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_features(spark, d), "time")


def a12_window_rms(spark: SparkSession, d: str) -> DataFrame:
    samples = _frames(spark, d).select(KEY, F.col("frame_index").alias("index"), "value")
    return rounded(audio.window_rms(samples, 8, 4), "rms")


def j2_interp_to_grid(spark: SparkSession, d: str) -> DataFrame:
    points = _signals(spark, d).where(F.col("value") > 100).select(KEY, "time", "value")
    return rounded(series.interpolate(points, series.grid(_videos(spark, d)).select(KEY, "slot", "time")), "value")


def f4_loud_score(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_loud(spark, d), "time").select(KEY, "time", "score")


def a15_sampling_interval(spark: SparkSession, d: str) -> DataFrame:
    return rounded(audio.sampling_interval(_levels(spark, d)), "dt")


def w9_peaks_distance_prominence(spark: SparkSession, d: str) -> DataFrame:
    return rounded(audio.prominent_peaks(_loud(spark, d), 0.3, 60.0, 0.15), "time", "score")


def w10_peak_fallback(spark: SparkSession, d: str) -> DataFrame:
    return rounded(audio.simple_peaks(_loud(spark, d), CONFIG.loud_threshold), "time").select(KEY, "time", "score")


def w11_peak_extent(spark: SparkSession, d: str) -> DataFrame:
    loud = _loud(spark, d)
    return rounded(audio.extents(loud, audio.simple_peaks(loud, CONFIG.loud_threshold), CONFIG.loud_threshold, 5.0), "start", "end", "time", "confidence", "peak_value")


def a11_shot_score(spark: SparkSession, d: str) -> DataFrame:
    return _hist_scores(spark, d)


def a25_shot_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(scenes.shot_summary(_hist_scores(spark, d)), "mean", "max")


def w5_shot_boundaries(spark: SparkSession, d: str) -> DataFrame:
    return _shots(spark, d)


def w6_adaptive_ratio(spark: SparkSession, d: str) -> DataFrame:
    deltas = _hist_scores(spark, d).select(KEY, "time", F.col("score").alias("value"))
    return rounded(scenes.adaptive_ratio(deltas, least_delta=0.5), "ratio")


def p6_scene_filter(spark: SparkSession, d: str) -> DataFrame:
    return scenes.long_enough(_scenes(spark, d), _hist_videos(spark, d), 3.0)


def u1_scene_boundaries(spark: SparkSession, d: str) -> DataFrame:
    return scenes.from_zero(scenes.long_enough(_scenes(spark, d), _hist_videos(spark, d), 3.0))


def a16_scene_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(scenes.summary(u1_scene_boundaries(spark, d)), "mean_length", "max_length")


def p5_transcript_filter(spark: SparkSession, d: str) -> DataFrame:
    return _segments(spark, d)


def a20_speech_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(text.speech_summary(_segments(spark, d)), "total_speech_duration")


def a22_full_transcript(spark: SparkSession, d: str) -> DataFrame:
    return text.full_transcript(_segments(spark, d))


def p8_usable_segments(spark: SparkSession, d: str) -> DataFrame:
    raw = _segments(spark, d).withColumn("end", F.when(F.col("pos") % 2 == 0, F.col("end")))
    return text.usable_segments(raw).select(KEY, "pos", "start", "end")


def f2_rule_sentiment(spark: SparkSession, d: str) -> DataFrame:
    return rounded(text.rule_sentiment(_segments(spark, d)), "time", places=7)


def _outputs(spark: SparkSession, d: str) -> DataFrame:
    docs = tables.table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    name = F.when(F.col("toxic") == 1, F.lit("negative")).when(F.col("quality") == 0, F.lit("LABEL_0")).when(F.col("doc_id") % 5 == 0, F.lit("LABEL_1")).when(F.col("doc_id") % 7 == 0, F.lit("LABEL_2")).otherwise(F.lit("POSITIVE"))
    joined = docs.join(tables.table(spark, d, "labels"), "doc_id")
    return joined.select(F.col("lang").alias(KEY), "doc_id", F.col("doc_id").cast("double").alias("time"), name.alias("label"), (F.pmod("n_chars", F.lit(130)) / F.lit(100.0)).alias("confidence"))


def p10_label_score(spark: SparkSession, d: str) -> DataFrame:
    return _outputs(spark, d).select(KEY, "doc_id", F.round(signed_confidence(F.col("label"), F.col("confidence")), 6).alias("score"))


def a17_sentiment_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(text.sentiment_summary(text.model_sentiment(_outputs(spark, d))), "mean", "max_abs")


def f1_humor_score(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rounded(text.humor(_segments(spark, d), _MARKERS), "score"), "time", places=7)


def a18_humor_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(text.humor_summary(rounded(text.humor(_segments(spark, d), _MARKERS), "score"), 0.5), "mean", "max")


#: Markers that occur in the conversations at hand.
_MARKERS = text.Language(laugh=("explain", "summar"), casual=("the", "and", "please"), stop_words=text.ENGLISH.stop_words, letters="a-z")


def w16_j5_topic_blocks(spark: SparkSession, d: str) -> DataFrame:
    segments = _segments(spark, d)
    return text.in_blocks(segments, text.blocks(_segment_videos(spark, d), CONFIG.block_duration), CONFIG.block_duration).select(KEY, "block", "pos")


def f3_k6_topics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_topics(spark, d), "start", "end")


def a21_unique_topics(spark: SparkSession, d: str) -> DataFrame:
    return text.topic_summary(_topics(spark, d))


def j8_event_flags(spark: SparkSession, d: str) -> DataFrame:
    sizes = series.grid(_videos(spark, d)).select(KEY, "slots").distinct()
    return fusion.event_flags(_events(spark, d), sizes, 1.0)


def j9_scene_flags(spark: SparkSession, d: str) -> DataFrame:
    sizes = series.grid(_videos(spark, d)).select(KEY, "slots").distinct()
    return fusion.boundary_flags(_marks(spark, d), sizes, 1.0)


def j10_coverage(spark: SparkSession, d: str) -> DataFrame:
    return fusion.coverage(_spans(spark, d), series.grid(_videos(spark, d)).select(KEY, "slot", "slots"), 1.0).select(KEY, "slot", "covered")


def j1_a3_motion_heatmap(spark: SparkSession, d: str) -> DataFrame:
    return _heat(spark, d)


def j11_fusion_timeline(spark: SparkSession, d: str) -> DataFrame:
    return _timeline(spark, d)


def a14_quantile(spark: SparkSession, d: str) -> DataFrame:
    return rounded(intervals.quantiles(_timeline(spark, d), CONFIG.peak_quantile), "threshold")


def _peaks(timeline: DataFrame) -> DataFrame:
    return intervals.interest_peaks(timeline, 0.9)


def w12_interest_peaks(spark: SparkSession, d: str) -> DataFrame:
    return _peaks(_timeline(spark, d))


def w13_best_window(spark: SparkSession, d: str) -> DataFrame:
    heat = _heat(spark, d).select(KEY, F.col("second").cast("double").alias("time"), (F.floor(F.col("value") * 64) / 64.0).alias("interest"))
    return rounded(intervals.best_window(heat, _videos(spark, d), 24.0), "score")


def j3_snap_inclusive(spark: SparkSession, d: str) -> DataFrame:
    return _snap(spark, d, True)


def j4_snap_strict(spark: SparkSession, d: str) -> DataFrame:
    return _snap(spark, d, False)


def _snap(spark: SparkSession, d: str, inclusive: bool) -> DataFrame:
    points = _signals(spark, d).select(KEY, "event_id", F.floor("time").cast("double").alias("t"))
    marks = _marks(spark, d).select(KEY, F.floor("time").cast("double").alias("time"))
    found = intervals.snap_to_marks(points, marks, 5.0, inclusive, "t").where(F.col("near").isNotNull())
    return found.select(KEY, "event_id", "snapped", "near")


def f9_candidates(spark: SparkSession, d: str) -> DataFrame:
    found = intervals.candidates(_peaks(_timeline(spark, d)), _videos(spark, d), intervals.boundary_arrays(_marks(spark, d)), CONFIG)
    return rounded(found, "peak", "start", "end")


def _scored_of(timeline: DataFrame, spark: SparkSession, d: str) -> DataFrame:
    return rounded_means(rounded(intervals.scored_candidates(timeline, _videos(spark, d), _marks(spark, d), CONFIG), "start", "end"))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return _scored_of(_timeline(spark, d), spark, d)


def j6_window_mean(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d)


def k4_nms_topk(spark: SparkSession, d: str) -> DataFrame:
    return intervals.suppressed(_scored(spark, d), CONFIG.top_k)


def w17_merge(spark: SparkSession, d: str) -> DataFrame:
    """Windows are ranked by their rounded scores: equal means stay equal, and the earlier peak comes first."""
    line = scratch.shared(_timeline(spark, d).select(KEY, "time", "interest"), "timeline")
    kept = intervals.suppressed(_scored_of(line, spark, d), 50)
    return rounded_means(rounded(intervals.merged(kept, intervals.interest_arrays(line), 24.0), "start", "end"))


def highlights(spark: SparkSession, d: str) -> DataFrame:
    return rounded_means(rounded(intervals.highlights(_timeline(spark, d), _videos(spark, d), _marks(spark, d), CONFIG), "start", "end"))


def _pauses(segments: DataFrame) -> DataFrame:
    return segments.where(F.col("pos") % 2 == 1).select(KEY, F.col("start").alias("time"))


def _absorbed(spark: SparkSession, d: str) -> DataFrame:
    return chapters.absorbed(chapters.snapped_topics(_topics(spark, d), _pauses(_segments(spark, d)), CONFIG.chapter_snap), 60.0)


def w18_absorb_short(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_absorbed(spark, d), "start", "end")


def _talk_timeline(segments: DataFrame) -> DataFrame:
    """A stand-in timeline of transcripts: a point per segment; sums of such binary fractions are exact."""
    size = F.length("text")
    return segments.select(KEY, F.col("start").alias("time"), (F.pmod(size, F.lit(64)) / 64.0).alias("motion"), (F.pmod(size, F.lit(7)) / 8.0).alias("humor"), (F.pmod(size, F.lit(16)) / 8.0 - 1.0).alias("sentiment"), (F.pmod(size, F.lit(3)) == 0).alias("is_dialogue"))


def j12_chapter_stats(spark: SparkSession, d: str) -> DataFrame:
    parts = _absorbed(spark, d).select(KEY, "chapter", "start", "end")
    return rounded(chapters.chapter_stats(parts, _talk_timeline(_segments(spark, d))), "start", "end", "motion", "humor", "sentiment")


def _chapters_of(segments: DataFrame, topics: DataFrame, videos: DataFrame) -> DataFrame:
    return rounded(chapters.chapters(topics, videos, _pauses(segments), _talk_timeline(segments), EngineConfig(min_chapter=60.0)), "start", "end")


def f10_f11_chapters(spark: SparkSession, d: str) -> DataFrame:
    segments = scratch.shared(_segments(spark, d), "segments")
    topics = scratch.shared(_topics_of(segments), "topics")
    return _chapters_of(segments, topics, tables.transcript_videos(segments))


def s11_truncate(spark: SparkSession, d: str) -> DataFrame:
    lists = _segments(spark, d).groupBy(KEY).agg(F.array_sort(F.collect_list("pos")).alias("items"))
    cut = lists.select(KEY, document.truncated(F.col("items"), 3).alias("t"))
    return cut.select(KEY, "t.truncated", "t.total_length", F.array_join(F.transform("t.first_items", lambda x: x.cast("string")), ",").alias("first_items"), F.array_join(F.transform("t.last_items", lambda x: x.cast("string")), ",").alias("last_items"))


_DOCUMENT = """video_info struct<duration_seconds: double>, transcript string, segments array<struct<pos: long, start: double, text: string>>,
  topics array<struct<block: int, topic: string>>, chapters array<struct<chapter: int, start: double, end: double, title: string>>"""


def f12_document(spark: SparkSession, d: str) -> DataFrame:
    """The JSON document of each transcript, field by field as it reads back."""
    segments = scratch.shared(_segments(spark, d), "segments")
    topics, videos = scratch.shared(_topics_of(segments), "topics"), scratch.shared(tables.transcript_videos(segments), "videos")
    sections = {
        "segments": document.listed(segments, "segments", "pos"),
        "transcript": text.full_transcript(segments),
        "topics": document.listed(topics, "topics", "block"),
        "chapters": document.listed(_chapters_of(segments, topics, videos), "chapters", "chapter"),
    }
    read = document.as_json(document.document(videos, sections)).select(KEY, F.from_json("json", _DOCUMENT).alias("doc"))

    def joined(section: str, field: str, mark: str) -> Column:
        return F.array_join(F.transform(F.col(f"doc.{section}"), lambda x: x[field].cast("string")), mark)

    seconds = F.aggregate("doc.chapters", F.lit(0.0), lambda acc, c: acc + (c["end"] - c["start"]))
    starts = F.aggregate("doc.segments", F.lit(0.0), lambda acc, x: acc + x["start"])
    out = read.select(
        KEY, F.col("doc.video_info.duration_seconds").alias("duration"), F.col("doc.transcript").alias("transcript"), joined("segments", "pos", ",").alias("positions"), joined("segments", "text", "|").alias("texts"),
        starts.alias("sum_of_starts"), joined("topics", "topic", "|").alias("topics"), joined("chapters", "title", "|").alias("titles"), seconds.alias("chapter_seconds"),
    )
    return rounded(out, "duration", "sum_of_starts", "chapter_seconds", places=4)


def _pixels(spark: SparkSession, d: str) -> DataFrame:
    """Stand-in frames of whole numbers, so that sums are exact."""
    grey = F.transform("hist", lambda x: F.floor(F.abs(x.cast("double")) * 100).cast("int"))
    return tables.histograms(spark, d).select(KEY, (F.col("time") * 2).cast("long").alias("frame_index"), "time", grey.alias("pixels"))


def a7_pixel_difference(spark: SparkSession, d: str) -> DataFrame:
    return rounded(motion.pixel_differences(_pixels(spark, d)), "value")


def a8_moving_fraction(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_pixels(spark, d).select(KEY, "frame_index", motion.moving_fraction(F.col("pixels"), 0.3).alias("value")), "value")


def _deltas(spark: SparkSession, d: str) -> DataFrame:
    return _hist_scores(spark, d).select(KEY, "time", F.col("score").alias("value"))


def w6_content_cuts(spark: SparkSession, d: str) -> DataFrame:
    return scenes.content_cuts(_deltas(spark, d), 0.9, 1.5)


def w6_adaptive_cuts(spark: SparkSession, d: str) -> DataFrame:
    return scenes.adaptive_cuts(_deltas(spark, d), ratio=1.02, least_delta=0.5, min_length=1.5)


def j13_energy_on_loudness(spark: SparkSession, d: str) -> DataFrame:
    rows = _signals(spark, d)
    loud = rows.where(F.col("event_type") != "view").select(KEY, "time", "value")
    energy = rows.where(F.col("event_type") == "view").select(KEY, "time", (F.col("value") * F.col("value")).alias("value"))
    return rounded(audio.on_loudness_times(loud, energy), "time", "energy", places=4)


def j14_zipped_points(spark: SparkSession, d: str) -> DataFrame:
    lists = _segments(spark, d).groupBy(KEY).agg(F.array_sort(F.collect_list("start")).alias("starts"), F.array_sort(F.collect_list(F.when(F.col("pos") % 3 != 2, F.col("pos")))).alias("positions"))
    return series.zipped_points(lists, "starts", "positions")


def k2_time_order(spark: SparkSession, d: str) -> DataFrame:
    coarse = text.humor(_segments(spark, d), _MARKERS).withColumn("time", F.floor(F.col("time") / 20).cast("double"))
    return text.in_time_order(coarse).select(KEY, "pos", "time", "place")


def p11_scene_starts(spark: SparkSession, d: str) -> DataFrame:
    return scenes.boundaries(u1_scene_boundaries(spark, d))


def p15_score_or_sentiment(spark: SparkSession, d: str) -> DataFrame:
    """Points with a score, some of which are null, and points that have a sentiment alone."""
    rows = _signals(spark, d).select(KEY, "event_id", "time", F.when(F.col("value") > 100, F.col("value")).alias("score"), (F.col("value") / 2).alias("sentiment"))
    scored = fusion.score_or_sentiment(rows.where(F.col("event_id") % 2 == 0))
    named = fusion.score_or_sentiment(rows.where(F.col("event_id") % 2 == 1).drop("score"))
    return rounded(series.valid_points(scored.unionByName(named)), "time", "value")


def f8_covered_dialogue(spark: SparkSession, d: str) -> DataFrame:
    """Dialogue where the audio tells nothing: what segments cover."""
    silent = _features(spark, d).withColumn("speech_probability", F.lit(0.0))
    none = _scores(spark, d, "none", 0.0)
    heat = _heat(spark, d).select(KEY, F.col("second").cast("double").alias("time"), "value")
    out = fusion.timeline(_videos(spark, d), heat, silent, none, none, _events(spark, d), _marks(spark, d), _spans(spark, d), replace(CONFIG, normalize_weights=False))
    return rounded(out, "interest").select(KEY, "slot", "is_dialogue", "interest")


def f9_unsnapped(spark: SparkSession, d: str) -> DataFrame:
    found = intervals.scored_candidates(_timeline(spark, d), _videos(spark, d), _marks(spark, d), replace(CONFIG, snap_to_scenes=False))
    return rounded(found.select(KEY, "peak", "start", "end"), "start", "end")


# ---- frames and sound: documents' bytes stand in for pixels, their letters for samples


def p3_grey_resized(spark: SparkSession, d: str) -> DataFrame:
    small = frames.grey(tables.byte_frames(spark, d), 8)
    return small.select(KEY, "frame_index", "width", "height", F.hex("pixels").alias("pixels"))


def _colours(spark: SparkSession, d: str) -> DataFrame:
    return frames.histograms(tables.byte_frames(spark, d), (6, 3))


def a10_colour_histogram(spark: SparkSession, d: str) -> DataFrame:
    bins = _colours(spark, d).select(KEY, "frame_index", F.posexplode("hist").alias("bin", "value"))
    return rounded(bins.where(F.col("value") > 0), "value")


def _colour_scores(spark: SparkSession, d: str) -> DataFrame:
    return rounded(scenes.shot_scores(_colours(spark, d)), "score")


def w4_colour_scores(spark: SparkSession, d: str) -> DataFrame:
    return _colour_scores(spark, d)


def w5_colour_cuts(spark: SparkSession, d: str) -> DataFrame:
    return scenes.shot_boundaries(_colour_scores(spark, d), 0.35, 0.2)


def a9_opened_fraction(spark: SparkSession, d: str) -> DataFrame:
    """Masks: some letters are shadow, all others foreground."""
    masks = tables.byte_frames(spark, d, channels=1, text=F.regexp_replace("text", "[aeiou ]", chr(127)))
    return rounded(frames.opened_fraction(masks), "value").select(KEY, "frame_index", "value")


def w3_background_model(spark: SparkSession, d: str) -> DataFrame:
    shots = tables.byte_frames(spark, d)
    videos = shots.select(KEY, F.lit(25.0).alias("fps")).distinct()
    return rounded(frames.foreground(shots, videos, width=8, step=2, history=12), "time", "value")


def w2_optical_flow(spark: SparkSession, d: str) -> DataFrame:
    """What A8 makes of the flow between neighbouring frames."""
    return rounded(frames.flow_changes(tables.byte_frames(spark, d), width=0, window=5), "value")


def _scanned(spark: SparkSession, d: str, step: int) -> DataFrame:
    """Every step-th frame of video files that are written first: a file per document."""
    folder = scratch.new_folder(spark, "frames")
    named = tables.byte_frames(spark, d, channels=1).withColumn(KEY, F.concat(KEY, F.lit(".y4m")))
    video.write_frames(named, folder).write.format("noop").mode("overwrite").save()
    return video.frames(spark, folder, step, segment=64).withColumn(KEY, F.regexp_replace(KEY, r"\.y4m$", ""))


def s4_frame_scan(spark: SparkSession, d: str) -> DataFrame:
    return frames.grey(_scanned(spark, d, 3).where(F.col("frame_index") >= 3), 0).select(KEY, "frame_index", "width", "height", F.hex("pixels").alias("pixels"))


def s5_scan_differences(spark: SparkSession, d: str) -> DataFrame:
    return rounded(frames.differences(_scanned(spark, d, 2), 0, 2, 16), "value").select(KEY, "frame_index", "value")


def s6_resampled_levels(spark: SparkSession, d: str) -> DataFrame:
    """Levels of sound that is brought to another rate first."""
    return rounded(audio.window_rms(audio.sample_rows(audio.resampled(tables.letter_sound(spark, d), 16000, crossings=4)), 1600, 800), "rms")


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    a1_second_mean, a4_max_normalized_heatmap, a5_unit_range, a6_motion_summary, a11_shot_score, a12_window_rms, a14_quantile, a15_sampling_interval,
    a16_scene_summary, a17_sentiment_summary, a18_humor_summary, a19_safe_mean, a20_speech_summary, a21_unique_topics, a22_full_transcript, a25_shot_summary,
    f1_humor_score, f2_rule_sentiment, f3_k6_topics, f4_loud_score, f9_candidates, f10_f11_chapters, f12_document, highlights, j1_a3_motion_heatmap,
    j2_interp_to_grid, j3_snap_inclusive, j4_snap_strict, j6_window_mean, j8_event_flags, j9_scene_flags, j10_coverage, j11_fusion_timeline, j12_chapter_stats,
    k4_nms_topk, p1_frame_sampling_diff, p2_rate_sampling, p5_transcript_filter, p6_scene_filter, p7_valid_points, p8_usable_segments, p10_label_score, s2_video_info, s11_truncate, u1_scene_boundaries,
    w5_shot_boundaries, w6_adaptive_ratio, w7_smoothing_zero_pad, w8_speech_probability, w9_peaks_distance_prominence, w10_peak_fallback, w11_peak_extent,
    w12_interest_peaks, w13_best_window, w16_j5_topic_blocks, w17_merge, w18_absorb_short,
    a7_pixel_difference, a8_moving_fraction, f8_covered_dialogue, f9_unsnapped, j13_energy_on_loudness, j14_zipped_points, k2_time_order, p11_scene_starts, p15_score_or_sentiment,
    w6_content_cuts, w6_adaptive_cuts,
    p3_grey_resized, a9_opened_fraction, a10_colour_histogram, s4_frame_scan, s5_scan_differences, s6_resampled_levels, w2_optical_flow, w3_background_model, w4_colour_scores, w5_colour_cuts,
)}
