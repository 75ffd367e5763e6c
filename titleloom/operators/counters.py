"""Record counts, stage counters and per-minute history."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titleloom import fixed_values as V
from titleloom.functions.predicates import at


def record_counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("records")).select(
            F.lit(name).alias("table_name"), "records"
        )
        out = one if out is None else out.unionByName(one)
    return out


def link_tally(link_results: DataFrame) -> DataFrame:
    """Items resolved and missed by a link batch."""
    hit = F.col("catalog_id").isNotNull()
    return link_results.agg(
        F.count_if(hit).alias("resolved"), F.count_if(~hit).alias("missed")
    )


def pack_tally(status: DataFrame) -> DataFrame:
    """Outputs created; packs without any count as missed, and as resolved too once a list was seen."""
    return status.agg(
        F.coalesce(F.sum("outputs"), F.lit(0)).alias("outputs_created"),
        F.count_if(F.col("completed")).alias("packs_resolved"),
        F.count_if(F.col("outputs") == 0).alias("packs_missed"),
    )


def stage_counters(df: DataFrame, as_of: datetime | str, **counts: Column) -> DataFrame:
    """(ts, counter, n) rows of a stage, one per named aggregate of its result."""
    one = df.agg(*[F.coalesce(c, F.lit(0)).cast("bigint").alias(n) for n, c in counts.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("counter"), F.col(n).alias("n")) for n in counts])
    return one.select(at(as_of).alias("ts"), F.inline(pairs))


def counter_totals(events: DataFrame) -> DataFrame:
    return events.groupBy("counter").agg(F.sum("n").alias("total"))


def distinct_keys(df: DataFrame, key: str) -> DataFrame:
    return df.agg(F.count_distinct(key).alias("unique_keys"))


def minute_points(events: DataFrame) -> DataFrame:
    """Per counter and minute. Everything below starts from this small table."""
    return events.groupBy("counter", F.date_trunc("minute", "ts").alias("minute")).agg(
        F.sum("n").alias("n")
    )


def _slot(minute: Column, as_of: datetime | str) -> Column:
    """Minutes between a point and the last point at ``as_of`` (0 = last)."""
    last = F.date_trunc("minute", at(as_of))
    return ((F.unix_seconds(last) - F.unix_seconds(minute)) / 60).cast("int")


def last_n_minutes(points: DataFrame, as_of: datetime | str, windows=(1, 5, 30, 60)) -> DataFrame:
    """Sum of the last 1, 5, 30 and 60 points per counter: conditional sums, no window sort.

    A counter silent in all of them stays, with zeros.
    """
    slot = _slot(F.col("minute"), as_of)
    return points.groupBy("counter").agg(*[
        F.coalesce(F.sum(F.when((slot >= 0) & (slot < n), F.col("n"))), F.lit(0)).alias(f"last_{n}")
        for n in windows
    ])


def rolling_sum(points: DataFrame, minutes: int) -> DataFrame:
    """At every point, the sum of the trailing ``minutes`` points.

    Each point adds to the minutes it falls into, so a long-lived counter is
    spread over (counter, minute) groups instead of one window per counter.
    """
    ahead = F.explode(F.sequence(F.lit(0), F.lit(minutes - 1))).alias("ahead")
    shifted = points.select(
        "counter", "minute", "n", ahead
    ).select(
        "counter",
        F.timestamp_seconds(F.unix_seconds("minute") + F.col("ahead") * 60).alias("minute"),
        F.col("n"),
        (F.col("ahead") == 0).alias("own"),
    )
    return (
        shifted.groupBy("counter", "minute")
        .agg(F.sum("n").alias("rolling"), F.max("own").alias("own"))
        .where("own")
        .select("counter", "minute", "rolling")
    )


def zero_filled_history(
    points: DataFrame,
    as_of: datetime | str,
    counters: list[str] | None = None,
    size: int = V.HISTORY_MINUTES,
) -> DataFrame:
    """Per counter: the last ``size`` points with zeros for silence, the running total, the last point.

    The array is one conditional sum per slot, so its size is fixed and no
    group is collected. Named counters without any event appear with zeros.
    """
    slot = _slot(F.col("minute"), as_of)
    past = points.where(slot >= 0)
    if counters is not None:
        zero = points.sparkSession.createDataFrame([(c,) for c in counters], "counter string")
        past = past.where(F.col("counter").isin(counters)).select("counter", "minute", "n").unionByName(
            zero.select("counter", F.date_trunc("minute", at(as_of)).alias("minute"), F.lit(0).cast("bigint").alias("n"))
        )
    cells = [
        F.coalesce(F.sum(F.when(slot == size - 1 - i, F.col("n"))), F.lit(0)) for i in range(size)
    ]
    return past.groupBy("counter").agg(
        F.array(*cells).alias("points"),
        F.sum("n").alias("total"),
        cells[-1].alias("last"),
    )
