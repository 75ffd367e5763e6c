"""Places of rows in sorted groups, without a task that sees a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from titleloom.llm.common import store


def positions(df: DataFrame, group: str, order: list[str], label: str) -> DataFrame:
    """The rows with pos (from 0, by ``order`` inside their group) and n (rows of the group).

    All groups are sorted as one range-partitioned table, so a hot group is spread over
    partitions. What is left is a sum over (partition, group) pairs, of which there are about
    as many as partitions and groups. ``order`` has to end in a column that tells equal
    rows apart, or these cannot be spread. ``group`` must not be NULL.
    """
    dealt = df.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    dealt = store(dealt.withColumn("_at", F.monotonically_increasing_id()), label)
    part = F.shiftright("_at", 33)
    runs = dealt.groupBy(F.col(group).alias("_run"), part.alias("_part")).agg(F.min("_at").alias("first"), F.count("*").alias("rows"))
    whole = Window.partitionBy("_run")
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")
    runs = store(runs.select("_run", "_part", shift.alias("_shift"), F.sum("rows").over(whole).alias("n")), f"{label}-runs")
    met = dealt.join(runs, (F.col(group) == F.col("_run")) & (part == F.col("_part")))
    return met.withColumn("pos", F.col("_at") + F.col("_shift")).drop("_at", "_shift", "_run", "_part")
