"""Streaming forms of the queue and the event counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def enqueue(events: DataFrame, key: str, within: str = "1 hour") -> DataFrame:
    """Accepts the first item of a process; later ones within the watermark are refused."""
    return events.withWatermark("ts", within).dropDuplicatesWithinWatermark([key])


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events of each type in tumbling windows; events later than the watermark don't count."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"))
