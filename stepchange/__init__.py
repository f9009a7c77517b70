"""Measure what changed after a known date, on Spark."""

from stepchange.config import StudyConfig

__all__ = ["StudyConfig"]
