"""An analysis as a chain of stages."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glimmer.config import EngineConfig
from glimmer.operators import audio, chapters, document, fusion, intervals, motion, scenes, text
from glimmer.operators.series import KEY
from glimmer.sources import scratch

#: Takes the relations so far and gives new ones; a stage of one's own is any such function.
Stage = Callable[[Mapping[str, DataFrame], EngineConfig], Mapping[str, DataFrame]]


def motion_stage(have: Mapping[str, DataFrame], config: EngineConfig) -> Mapping[str, DataFrame]:
    changes = motion.differences(motion.sampled(have["frames"], config.motion_frame_step))
    heat = motion.heatmap(changes, have["videos"]).select(KEY, F.col("second").cast("double").alias("time"), "value")
    return {"motion": heat, "motion_summary": motion.summary(heat)}


def audio_stage(have: Mapping[str, DataFrame], config: EngineConfig) -> Mapping[str, DataFrame]:
    features = audio.features(have["levels"], config.smoothing_points, config.sigmoid_width)
    scored = audio.loud_score(features)
    peaks = audio.prominent_peaks(scored, config.loud_threshold, config.loud_min_gap, config.loud_prominence)
    return {"audio": features, "events": audio.extents(scored, peaks, config.loud_threshold, config.loud_min_duration)}


def scene_stage(have: Mapping[str, DataFrame], config: EngineConfig) -> Mapping[str, DataFrame]:
    found = scenes.from_zero(scenes.long_enough(scenes.scenes_between(have["cuts"], have["videos"]), have["videos"], config.min_scene_duration))
    return {"scenes": found, "boundaries": scenes.boundaries(found), "scene_summary": scenes.summary(found)}


def text_stage(have: Mapping[str, DataFrame], config: EngineConfig, language: text.Language = text.RUSSIAN) -> Mapping[str, DataFrame]:
    spoken = text.speech_segments(have["transcripts"], config.min_speech)
    return {
        "segments": spoken,
        "sentiment": text.rule_sentiment(spoken),
        "humor": text.humor(spoken, language),
        "topics": text.topics(spoken, have["videos"], config.block_duration, language),
    }


def fusion_stage(have: Mapping[str, DataFrame], config: EngineConfig) -> Mapping[str, DataFrame]:
    return {"timeline": fusion.timeline(*[have[k] for k in ("videos", "motion", "audio", "sentiment", "humor", "events", "boundaries", "segments")], config)}


def highlight_stage(have: Mapping[str, DataFrame], config: EngineConfig) -> Mapping[str, DataFrame]:
    return {"highlights": intervals.highlights(have["timeline"], have["videos"], have["boundaries"], config)}


def chapter_stage(have: Mapping[str, DataFrame], config: EngineConfig) -> Mapping[str, DataFrame]:
    return {"chapters": chapters.chapters(have["topics"], have["videos"], have["boundaries"], have["timeline"], config)}


def document_stage(have: Mapping[str, DataFrame], config: EngineConfig) -> Mapping[str, DataFrame]:
    orders = {"motion": ["time"], "audio": ["time"], "segments": ["pos"], "sentiment": ["time"], "humor": ["time", "pos"], "topics": ["block"], "events": ["time"], "boundaries": ["time"], "timeline": ["time"], "highlights": ["start"], "chapters": ["chapter"]}
    sections = {k: document.listed(have[k], k, *order) for k, order in orders.items()}
    return {"document": document.document(have["videos"], sections)}


STAGES: tuple[Stage, ...] = (motion_stage, audio_stage, scene_stage, text_stage, fusion_stage, highlight_stage, chapter_stage, document_stage)


#: Relations that more than one stage, or a stage and the document, consume.
SHARED = ("motion", "audio", "events", "scenes", "boundaries", "segments", "topics", "timeline", "highlights", "chapters")


@dataclass(frozen=True)
class Analysis:
    """videos, frames, levels (video_id, time, rms), cuts (video_id, time) and transcripts in; every relation out.

    Relations with several consumers are worked out once, as they come up, and read from a shared folder after that
    (share=False: nothing is worked out before it is asked for, and as often as it is).
    """

    config: EngineConfig = EngineConfig()
    stages: tuple[Stage, ...] = STAGES
    share: bool = True

    def run(self, **relations: DataFrame) -> dict[str, DataFrame]:
        have = dict(relations)
        for stage in self.stages:
            found = stage(have, self.config)
            have.update({k: scratch.shared(v, k) if self.share and k in SHARED else v for k, v in found.items()})
        return have


def summary(have: Mapping[str, DataFrame]) -> DataFrame:
    """One row per video: counts of what was found."""
    out = have["videos"].select(KEY, "duration")
    for name in ("scenes", "segments", "events", "highlights", "chapters"):
        out = out.join(have[name].groupBy(KEY).agg(F.count("*").alias(name)), KEY, "left")
    return out.na.fill(0, ["scenes", "segments", "events", "highlights", "chapters"])
