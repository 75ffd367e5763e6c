"""Newest-first pages of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from titleloom import fixed_values as V
from titleloom.session import cut_lineage

MOST_PARTS = 1000  # partitions of a stored order


def clamp(page: int | None, per_page: int | None) -> tuple[int, int]:
    number = max(1 if page is None else page, 1)
    size = min(max(V.PAGE_DEFAULT if per_page is None else per_page, 1), V.PAGE_LARGEST)
    return number, size


def page(
    table: DataFrame,
    keys: list[str],
    number: int | None = None,
    per_page: int | None = None,
    order: str = "last_processed",
) -> DataFrame:
    """Rows of one page. Plans as a top-k of page * size rows, never a full sort."""
    number, size = clamp(number, per_page)
    return (
        table.orderBy(F.col(order).desc(), *[F.col(k).asc_nulls_first() for k in keys])
        .offset((number - 1) * size)
        .limit(size)
    )


def deep_page(
    table: DataFrame,
    keys: list[str],
    number: int,
    per_page: int | None = None,
    order: str = "last_processed",
    partitions: int = 200,
) -> DataFrame:
    """The same rows as ``page``, for page numbers whose top-k would not fit one task.

    The sort columns are range-partitioned in page order and stored, so a place in the
    whole order is the rows of the partitions before plus the place inside one. Counts per
    partition tell which partitions reach the page; only those are ranked. Rows
    sharing one time are spread by their keys. ``keys`` must tell rows apart.
    """
    number, size = clamp(number, per_page)
    skip = (number - 1) * size
    wanted = [F.col(order).desc_nulls_last(), *[F.col(k).asc_nulls_first() for k in keys]]
    slim = table.select(order, *keys)
    dealt = cut_lineage(slim.repartitionByRange(partitions, *wanted).withColumn("_part", F.spark_partition_id()))
    behind = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))  # one row per partition
    counts = counts.withColumn("_before", F.coalesce(F.sum("_rows").over(behind), F.lit(0)))
    reach = counts.where((F.col("_before") < skip + size) & (F.col("_before") + F.col("_rows") > skip))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*wanted))
    placed = dealt.join(reach, "_part").withColumn("_place", F.col("_before") + inside)
    names = [order, *keys]
    chosen = placed.where((F.col("_place") > skip) & (F.col("_place") <= skip + size)).select(*[F.col(c).alias(f"_{c}") for c in names])
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in names]
    return table.join(chosen, same, "left_semi")


def page_total(table: DataFrame, number: int | None = None, per_page: int | None = None) -> DataFrame:
    """One row: total, page, per_page. Counts without reading any column."""
    number, size = clamp(number, per_page)
    return table.agg(F.count(F.lit(1)).alias("total")).select(
        "total", F.lit(number).alias("page"), F.lit(size).alias("per_page")
    )


def page_after(
    table: DataFrame,
    keys: list[str],
    last: dict | None,
    per_page: int | None = None,
    order: str = "last_processed",
) -> DataFrame:
    """The page behind a known last row: the filter reaches the scan, so depth costs nothing."""
    if last is not None:
        at = last[order]
        # Times descend with NULL last, keys ascend with NULL first.
        behind = F.lit(False) if at is None else F.col(order).isNull() | (F.col(order) < F.lit(at))
        same = F.col(order).eqNullSafe(F.lit(at))
        for k in keys:
            later = F.col(k).isNotNull() if last[k] is None else F.col(k) > F.lit(last[k])
            behind = behind | (same & later)
            same = same & F.col(k).eqNullSafe(F.lit(last[k]))
        table = table.where(behind)
    return page(table, keys, 1, per_page, order)


def store_order(
    table: DataFrame, keys: list[str], path: str, order: str = "last_processed", partition_rows: int = 100_000, most_parts: int = MOST_PARTS
) -> None:
    """Write the rows range-partitioned in page order, and how many rows lie before each partition.

    Partitions hold about ``partition_rows`` rows, more where there would be over ``most_parts`` of them: the driver
    holds a sample for each. ``keys`` must tell rows apart.
    """
    parts = max(1, min(most_parts, -(-table.count() // partition_rows)))
    dealt = table.repartitionByRange(parts, *_wanted(keys, order)).withColumn("_part", F.spark_partition_id())
    dealt.write.mode("errorifexists").partitionBy("_part").parquet(f"{path}/rows")
    rows = _stored(table.sparkSession, path, table.schema).groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    behind = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    rows.withColumn("_before", F.coalesce(F.sum("_rows").over(behind), F.lit(0))).write.parquet(f"{path}/counts")


def _stored(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(StructType([*schema.fields, StructField("_part", IntegerType())])).parquet(f"{path}/rows")


def _wanted(keys: list[str], order: str) -> list[Column]:
    return [F.col(order).desc_nulls_last(), *[F.col(k).asc_nulls_first() for k in keys]]


def reached(spark: SparkSession, path: str, number: int | None, per_page: int | None) -> tuple[list[int], int]:
    """(partitions of a stored order that hold rows of the page, rows before the first of them)."""
    number, size = clamp(number, per_page)
    skip = (number - 1) * size
    counts = spark.read.parquet(f"{path}/counts")
    reach = counts.where((F.col("_before") < skip + size) & (F.col("_before") + F.col("_rows") > skip)).collect()
    return sorted(r["_part"] for r in reach), min((r["_before"] for r in reach), default=0)


def stored_page(
    spark: SparkSession,
    path: str,
    schema: StructType,
    keys: list[str],
    number: int | None = None,
    per_page: int | None = None,
    order: str = "last_processed",
) -> DataFrame:
    """The rows of ``page`` from a stored order: only the partitions that hold the page are read, at any depth."""
    parts, before = reached(spark, path, number, per_page)
    number, size = clamp(number, per_page)
    rows = _stored(spark, path, schema).where(F.col("_part").isin(parts)).drop("_part")
    return rows.orderBy(*_wanted(keys, order)).offset((number - 1) * size - before).limit(size)
