"""Session settings the operators count on."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Hot keys: AQE splits the oversized shuffle partition of a join by map output.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName("titleloom")
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    All executors must reach it, so that a lost executor does not lose data.
    Only a session that runs inside one process gets a folder of its own where
    the setting is missing; any session with separate executors is refused.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to a table in the checkpoint folder and go on from there.

    Unlike ``checkpoint()`` this computes the rows once, and the plan behind it
    knows their size.
    """
    path = f"{checkpoint_root(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(stored: DataFrame, rows: int, *keys: str) -> DataFrame:
    """A stored table dealt by keys in partitions of about ``rows`` rows, for work that makes much of each.

    A partition count that is asked for is kept, whereas adaptive execution joins small partitions by their
    size before such work and so lets tasks grow with the table.
    """
    return stored.repartition(max(1, -(-stored.count() // rows)), *keys)
