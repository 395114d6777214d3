"""Streams of observations: running votes, windows of events, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_votes(obs: DataFrame, point: str = "pid", label: str = "label") -> DataFrame:
    """Votes of each (point, label) so far, for output modes update and complete. The state is a counter for each pair seen."""
    return obs.where(F.col(label).isNotNull()).groupBy(point, label).agg(F.count("*").alias("votes"))


def windowed_votes(obs: DataFrame, time: str, late: str, width: str, point: str = "pid", label: str = "label") -> DataFrame:
    """Votes within windows of event time; state older than the watermark is dropped, so append mode works."""
    return obs.withWatermark(time, late).where(F.col(label).isNotNull()).groupBy(F.window(time, width), point, label).agg(F.count("*").alias("votes")).select(F.col("window.start").alias("start"), point, label, "votes")


def tumbling(events: DataFrame, time: str, width: str, by: str, late: str | None = None) -> DataFrame:
    """Counts of each window and group."""
    rows = events.withWatermark(time, late) if late else events
    return rows.groupBy(F.window(time, width), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")


def sessions(events: DataFrame, time: str, gap: str, by: str, late: str | None = None) -> DataFrame:
    """Sessions of each group: rows less than a gap apart, with their first time, end (last time plus gap) and count."""
    rows = events.withWatermark(time, late) if late else events
    return rows.groupBy(F.session_window(time, gap), by).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("finish"), by, "n")
