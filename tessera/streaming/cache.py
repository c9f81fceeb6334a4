"""Cache entries as streams: the first entry of a key within its time to live, and hits by window.

State is bounded by the watermark: a key is forgotten, and a window closed, once event
time has passed it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_within_ttl(events: DataFrame, key: str, time: str = "ts", ttl: str = "1 day") -> DataFrame:
    """``events`` without entries whose key was seen within ``ttl`` before."""
    return events.withWatermark(time, ttl).dropDuplicatesWithinWatermark([key])


def hits_by_window(events: DataFrame, kind: str, value: str, time: str = "ts", late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Hits and their mean value by kind in windows of event time; rows later than ``late`` are left out."""
    grouped = events.withWatermark(time, late).groupBy(F.window(time, window), kind)
    return grouped.agg(F.count("*").alias("n"), F.avg(value).alias("mean")).select(F.col("window.start").alias("start"), kind, "n", "mean")
