"""Temporal interest analytics on Spark."""

from glimmer.config import EngineConfig
from glimmer.plans.stages import STAGES, Analysis, Stage, summary

__all__ = ["STAGES", "Analysis", "EngineConfig", "Stage", "summary"]
