"""Tables stored by hash bucket, of which a batch rewrites the buckets its keys hit.

The bucket number is a partition column, so the buckets of a batch are partition filters: no other file
is listed for reading or replaced. A batch first stores the new rows of its buckets beside the
table under its id (the write-ahead copy), then overwrites the buckets from there. If the driver dies in between,
the same batch finds its finished copy and only repeats the second step, so a bucket that was
half replaced comes back whole, and rows are never folded twice. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from titleloom.session import cut_lineage

BUCKET = "_bucket"


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias(BUCKET)


def create(df: DataFrame, path: str, key: str, buckets: int) -> None:
    """Write a new table. Fails if the folder exists."""
    df.select("*", bucket_of(key, buckets)).repartition(BUCKET).write.mode("errorifexists").partitionBy(BUCKET).parquet(path)


def read(spark: SparkSession, path: str, schema: T.StructType, only: list[int] | None = None) -> DataFrame:
    """The table, or the buckets named by ``only``."""
    whole = spark.read.schema(T.StructType([*schema.fields, T.StructField(BUCKET, T.IntegerType())])).parquet(path)
    return (whole if only is None else whole.where(F.col(BUCKET).isin(only))).drop(BUCKET)


def _place(spark: SparkSession, path: str) -> tuple[Any, Any]:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _finished(spark: SparkSession, folder: str) -> bool:
    done, files = _place(spark, f"{folder}/_SUCCESS")
    return files.exists(done)


def hit_buckets(changes: DataFrame, key: str, buckets: int) -> list[int]:
    """Numbers of the buckets with changes, ``buckets`` at most."""
    return sorted(r[0] for r in changes.select(bucket_of(key, buckets)).distinct().collect())


def apply(
    changes: DataFrame,
    path: str,
    schema: T.StructType,
    key: str,
    buckets: int,
    batch_id: int,
    fold: Callable[[DataFrame, DataFrame], DataFrame],
    report: Callable[[DataFrame, DataFrame], None] | None = None,
) -> list[int]:
    """Replace the buckets that ``changes`` hit by ``fold(rows of these buckets, changes)``; their numbers.

    ``report`` sees the rows of these buckets before and after, once per computed batch; what it
    writes under the batch id is there before the table changes.
    """
    spark = changes.sparkSession
    copy = f"{path}-batches/{int(batch_id)}"
    full = T.StructType([*schema.fields, T.StructField(BUCKET, T.IntegerType())])
    if not _finished(spark, copy):
        mine = cut_lineage(changes)
        hit = hit_buckets(mine, key, buckets)
        before = read(spark, path, schema, hit)
        after = fold(before, mine).select(*schema.fieldNames())
        new = cut_lineage(after.select("*", bucket_of(key, buckets)))
        if report:
            report(before, new.drop(BUCKET))
        new.write.mode("overwrite").parquet(copy)
    stored = spark.read.schema(full).parquet(copy)
    hit = sorted(r[0] for r in stored.select(BUCKET).distinct().collect())
    by_bucket = stored.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    by_bucket.partitionBy(BUCKET).parquet(path)
    _forget(spark, f"{path}-batches", int(batch_id))
    return hit


def _forget(spark: SparkSession, folder: str, keep: int) -> None:
    """Drop the copies of earlier batches, whose buckets are in the table."""
    place, files = _place(spark, folder)
    for status in files.listStatus(place):
        if int(status.getPath().getName()) < keep:
            files.delete(status.getPath(), True)
