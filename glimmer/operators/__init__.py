"""Operators on relations of videos, by topic."""

from glimmer.operators import audio, chapters, document, fusion, intervals, motion, scenes, series, text
from glimmer.operators.chapters import chapters as build_chapters
from glimmer.operators.fusion import timeline as fuse
from glimmer.operators.intervals import highlights as find_highlights
from glimmer.operators.motion import heatmap as motion_heatmap
from glimmer.operators.text import topics as find_topics

__all__ = ["audio", "build_chapters", "chapters", "document", "find_highlights", "find_topics", "fuse", "fusion", "intervals", "motion", "motion_heatmap", "scenes", "series", "text"]
