"""Settings of an analysis; values become literals of the plans."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields
from pathlib import Path


@dataclass(frozen=True)
class EngineConfig:
    """Defaults of every stage. from_env() reads a file and GLIMMER_<NAME> variables over them."""

    motion_frame_step: int = 1
    smoothing_points: int = 5
    sigmoid_width: float = 0.15
    loud_threshold: float = 0.75
    loud_min_gap: float = 0.8
    loud_prominence: float = 0.15
    loud_min_duration: float = 0.2
    min_scene_duration: float = 10.0
    min_speech: float = 0.1
    block_duration: float = 45.0
    humor_threshold: float = 0.5
    step: float = 1.0
    weight_motion: float = 0.4
    weight_audio: float = 0.3
    weight_sentiment: float = 0.2
    weight_humor: float = 0.1
    weight_events: float = 0.2
    normalize_weights: bool = True
    dialogue_threshold: float = 0.5
    laughter_boost: float = 0.5
    loud_boost: float = 0.3
    min_highlight: float = 30.0
    max_highlight: float = 90.0
    top_k: int = 6
    peak_quantile: float = 0.9
    snap_to_scenes: bool = True
    snap_window: float = 5.0
    merge_gap: float = 3.0
    min_chapter: float = 30.0
    chapter_snap: float = 5.0

    @classmethod
    def from_env(cls, file: str | None = None) -> EngineConfig:
        """GLIMMER_<NAME> variables over those of a file of NAME=value lines, over the defaults; other names play no part."""
        lines = Path(file).read_text(encoding="utf-8").splitlines() if file else []
        pairs = [line.split("=", 1) for line in lines if "=" in line and not line.lstrip().startswith("#")]
        given = {name.strip().upper(): value.strip().strip("\"'") for name, value in pairs} | dict(os.environ)

        def read(kind: type, value: str) -> object:
            return value.strip().lower() in ("1", "true", "yes", "on") if kind is bool else kind(value)

        return cls(**{f.name: read(type(f.default), given[name]) for f in fields(cls) if (name := f"GLIMMER_{f.name.upper()}") in given})

    def weights(self) -> dict[str, float]:
        """The signals' shares, divided by their sum unless that is 1 already, or they are to be taken as given."""
        given = {k: float(getattr(self, f"weight_{k}")) for k in ("motion", "audio", "sentiment", "humor", "events")}
        total = sum(given.values())
        if total <= 0:
            raise ValueError("weights have to have a positive sum")
        return given if not self.normalize_weights or abs(total - 1) <= 1e-6 else {k: v / total for k, v in given.items()}
