"""scenegrade: grading of nested JSON assessments with Spark DataFrames."""

from scenegrade.session import configure

__all__ = ["configure"]
