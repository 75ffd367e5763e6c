"""Per-minute counters over an event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def minute_counters(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """``ts, counter, n`` to one row per counter and minute.

    In append mode a minute is emitted once the watermark has passed its end;
    later events for it are dropped by the watermark, so choose the delay by
    the lateness to be kept. State holds open minutes only.
    """
    return (
        events.withWatermark("ts", delay)
        .groupBy(F.window("ts", "1 minute"), "counter")
        .agg(F.sum("n").alias("n"))
        .select("counter", F.col("window.start").alias("minute"), "n")
    )
