"""Reading and writing the tables.

Two forms. A *snapshot* is a whole table state in a folder of its own; a new
state never overwrites the one being read. A *change log* is an append-only
folder with one sub-folder per micro-batch: writing a batch again replaces only
its own folder, so replays are harmless and a batch costs what it holds, not
what the table holds. Readers fold the log. ``compact`` folds what a log holds so far into a
table beside it, and readers then take that table and the batches written since: their
cost follows the state and the tail, not the history.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from titleloom import schemas


def read_table(spark: SparkSession, name: str, path: str) -> DataFrame:
    return spark.read.schema(schemas.TABLES[name]).parquet(path)


def read_containers(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Binary files, keyed by file name without its ending."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    name = F.substring_index("path", "/", -1)
    return files.select(F.regexp_replace(name, r"\.[^.]*\z", "").alias("key"), "content")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """HTML files below a folder as ``source, html``; the source is the path inside the folder."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    full = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return files.select(
        F.substring_index(full, path.rstrip("/") + "/", -1).alias("source"),
        F.col("value").alias("html"),
    )


def write_snapshot(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> str:
    """Write a new state. Fails if the folder exists, so no state is ever overwritten.

    Queue tables partitioned by ``completed`` let pending scans skip finished rows.
    """
    df.write.mode("errorifexists").partitionBy(*partition_by).parquet(path)
    return path


def write_bucketed(df: DataFrame, table: str, path: str, key: str, buckets: int) -> None:
    """Write a state bucketed and sorted by its key.

    All tables keyed by the item hash share one bucket count, so joins and
    upserts between them read co-located buckets without a shuffle.
    """
    (
        df.repartition(buckets, key)
        .write.mode("errorifexists")
        .bucketBy(buckets, key)
        .sortBy(key)
        .option("path", path)
        .saveAsTable(table)
    )


def append_changes(df: DataFrame, path: str, batch_id: int) -> None:
    """Write one micro-batch of the log; the same batch written twice counts once."""
    df.write.mode("overwrite").parquet(f"{path}/batch_id={int(batch_id)}")


def read_changes(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The whole log with its ``batch_id``; empty when nothing was written yet.

    What was compacted comes from the newest compaction, older batches are not read.
    """
    folded = _compactions(spark, path)
    if not folded:
        return _batches(spark, path, schema)
    low, high = folded[-1]
    batch = F.col("batch_id")
    tail = _batches(spark, path, schema).where((batch > high) | (batch < low))
    return spark.read.schema(_logged(schema)).parquet(_compacted(path, low, high)).unionByName(tail)


def compact(
    spark: SparkSession, path: str, schema: T.StructType, fold: Callable[[DataFrame], DataFrame], low: int, high: int
) -> None:
    """Fold the batches from ``low`` to ``high`` (retry passes count down from -1) and all compacted before.

    ``fold`` takes and returns rows of the log with their ``batch_id``, such that folding
    its result with later rows gives what folding all rows gives. No batch in the range may
    be running. Batch folders in the range are not needed for reading any more.
    """
    inside = (F.col("batch_id") >= low) & (F.col("batch_id") <= high)
    rows = fold(read_changes(spark, path, schema).where(inside))
    rows.select(*_logged(schema).fieldNames()).write.mode("errorifexists").parquet(_compacted(path, low, high))


def _logged(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])


def _compacted(path: str, low: int, high: int) -> str:
    return f"{path}-compacted/{low}to{high}"


def _compactions(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """(low, high) of finished compactions, widest last."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}-compacted")
    files = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(hadoop):
        return []
    found = []
    for status in files.listStatus(hadoop):
        done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
        if files.exists(done):
            low, high = status.getPath().getName().split("to")
            found.append((int(low), int(high)))
    return sorted(found, key=lambda r: r[1] - r[0])


def _batches(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    full = _logged(schema)
    try:
        return spark.read.schema(full).option("basePath", path).parquet(path)
    except Exception as problem:  # the folder appears with the first batch
        if "PATH_NOT_FOUND" not in str(problem):
            raise
        return spark.createDataFrame([], full)
