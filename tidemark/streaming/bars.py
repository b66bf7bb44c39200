"""Bars from a stream of trades: closed periods only, late rows within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def closed_bars(events: DataFrame, minutes: int, late: str = "10 minutes", value: str = "value", volume: str | None = None) -> DataFrame:
    """(start, end, open, high, low, close, volume) of periods anchored at the epoch.

    events (ts, event_id, value) may be a stream; in append mode a period comes out once no row of it can come any more,
    which is when a back-test may see it.
    """
    at = F.struct("ts", "event_id")
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", f"{minutes} minutes").alias("w"))
    out = grouped.agg(
        F.min_by(value, at).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, at).alias("close"),
        (F.sum(volume) if volume else F.count(F.lit(1)).cast("double")).alias("volume"),
    )
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "open", "high", "low", "close", "volume")
