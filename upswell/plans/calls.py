"""Calls of outside services from tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame


class ServiceUnavailable(Exception):
    """Raised by a user's function when its service is down: the work is left for later."""


def tasks_for(df: DataFrame, calls: int, calls_at_once: int | None) -> int:
    """One task per call that may run at the same time, no more than there are calls."""
    limit = calls_at_once or df.sparkSession.sparkContext.defaultParallelism
    return max(1, min(limit, calls))
