"""Structured Streaming over event frames: the batch operators' counterparts where rows arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_reduce(events: DataFrame, time: str, width: str, late: str, by: list[str], aggs: dict) -> DataFrame:
    """Tumbling event-time windows with a watermark: (start, by..., aggregates). Works on streams and on tables."""
    out = events.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(*(c.alias(n) for n, c in aggs.items()))
    return out.select(F.col("window.start").alias("start"), *by, *aggs)


def running_counts(events: DataFrame, by: list[str]) -> DataFrame:
    """Counts per key so far, for complete or update output."""
    return events.groupBy(*by).agg(F.count("*").alias("n"))
