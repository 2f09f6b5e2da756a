"""Kinds of failure from status and message."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.fetching import BLOCKED, TIMEOUT, UNSAFE


def failure_kind(status: Column, error: Column) -> Column:
    """Column form of the fetching rule: the first that holds."""
    error = F.coalesce(error, F.lit(""))
    return (
        F.when(status.isin(404, 410), "not_found")
        .when(status.isin(401, 403, 429) | error.rlike(f"(?i){BLOCKED.pattern}"), "blocked")
        .when(error.rlike("(?i)exceeds"), "too_large")
        .when(error.rlike(f"(?i){UNSAFE.pattern}"), "unsafe_url")
        .when(error.rlike(f"(?i){TIMEOUT.pattern}"), "timeout")
        .when(status > 0, "http")
        .otherwise("fetch")
    )
