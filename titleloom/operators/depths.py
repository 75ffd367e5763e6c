"""Queue depths kept as signed changes: a batch adds what its rows moved, a reader adds up a few rows.

A row of a queue counts as completed, unresolved or exhausted. A batch knows the rows it touched before
and after, so it logs per stage how many left each class and how many entered it: three rows at most. Counts are
sums over the log; the tables are never read for them. A batch written again replaces its
own rows (``sources.tables.append_changes``), and ``fold`` lets ``compact`` shorten the log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from titleloom import fixed_values as V

DEPTH_LOG = T.StructType([T.StructField("stage", T.StringType()), T.StructField("depth", T.StringType()), T.StructField("change", T.LongType())])
CLASSES = ("completed", "unresolved", "exhausted")


def depth_of(max_attempts: int) -> Column:
    open_ = F.when(F.col("attempts") < max_attempts, "unresolved").otherwise("exhausted")
    return F.when(F.col("completed"), "completed").otherwise(open_).alias("depth")


def depth_changes(before: DataFrame | None, after: DataFrame, stage: str, max_attempts: int = V.MAX_ATTEMPTS) -> DataFrame:
    """Rows of the log for the same rows before and after a batch (None: they are new)."""
    moved = after.select(depth_of(max_attempts), F.lit(1).alias("change"))
    if before is not None:
        moved = moved.unionByName(before.select(depth_of(max_attempts), F.lit(-1).alias("change")))
    sums = moved.groupBy("depth").agg(F.sum("change").alias("change")).where("change <> 0")
    return sums.select(F.lit(stage).alias("stage"), "depth", "change")


def depths(log: DataFrame) -> DataFrame:
    """stage, completed, unresolved, exhausted."""
    cells = [F.coalesce(F.sum(F.when(F.col("depth") == c, F.col("change"))), F.lit(0)).alias(c) for c in CLASSES]
    return log.groupBy("stage").agg(*cells)


def fold(log: DataFrame) -> DataFrame:
    """For ``tables.compact``: one row per stage and class."""
    return log.groupBy("stage", "depth").agg(F.sum("change").alias("change"), F.max("batch_id").alias("batch_id"))
