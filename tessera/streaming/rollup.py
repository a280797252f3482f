"""Structured Streaming extension: windowed counts of an event stream with late data, and files loaded once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, at: str, key: str, value: str, window: str, late: str) -> DataFrame:
    """Tumbling windows per key; events more than ``late`` behind the newest are left to a later reload. Works on streams and tables."""
    rows = events.withColumn("__at", F.col(at).cast("timestamp"))
    rows = rows.withWatermark("__at", late) if events.isStreaming else rows
    counts = rows.groupBy(F.window("__at", window).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 4).alias("total"))
    return counts.select(F.col("w.start").cast("string").alias("window_start"), key, "n", "total")


def deduplicated(events: DataFrame, at: str, keys: list[str], late: str) -> DataFrame:
    """Every event once while its redelivery comes within ``late``; the state is bounded by the watermark."""
    rows = events.withColumn("__at", F.col(at).cast("timestamp"))
    return (rows.withWatermark("__at", late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else rows.dropDuplicates(keys)).drop("__at")
