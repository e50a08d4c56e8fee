"""Bars from a tick stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LATENESS = "10 minutes"  # ours


def bar_stream(ticks: DataFrame, size: str = "1 hour", lateness: str = LATENESS) -> DataFrame:
    """Tumbling OHLCV per symbol; emitted once the watermark passes the window's end."""
    at = F.struct("ts", "seq")
    b = ticks.withWatermark("ts", lateness).groupBy("sym", F.window("ts", size).alias("w")).agg(
        F.min_by("px", at).alias("open"), F.max("px").alias("high"), F.min("px").alias("low"),
        F.max_by("px", at).alias("close"), F.sum("q").alias("volume"))
    return b.select("sym", F.col("w.start").alias("dt"), "open", "high", "low", "close", "volume")
