"""Sharding by a two-pass external shuffle.

First pass: a seeded hash of each record scatters the records uniformly into
buckets sized for memory; the number of buckets follows from the bytes of the
whole input. Second pass: a Fisher-Yates shuffle of each bucket. Spark's
``shuffle`` is a Fisher-Yates shuffle of an array; here it permutes the positions of
a bucket, so a task holds one number per record of the bucket, never the records, and
those are sorted within their bucket with spilling. Bucket after bucket the
shuffled positions form one order of all records, which is dealt to the shards in
turn: counts differ by one at most (law ``rows``), and slots have no gaps.

Reruns agree: buckets and the order before the shuffle come from hashes, and the
random numbers of a bucket from the seed and the partition the bucket's number
leads to. Built-in functions only.

Defined cases: NULL text has 8 bytes and the checksum of the empty text; NULL ids are
hashed like any value; equal rows share a bucket and are interchangeable; an
empty table gives an empty result. Input columns named like an added one are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from titleloom.llm.common import kept_names, packed, store, text_of, unpacked

SHARDS = 24
SEED = 29
BUCKET_BYTES = 16 << 20
LEAST_BUCKETS = 256  # so that small inputs spread over a cluster too
ADDED = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
LAW = "rows"


def record_bytes(text: Column) -> Column:
    return (F.octet_length(text) + 8).cast("long")


def shuffled_positions(counts: DataFrame, seed: int, parts: int) -> DataFrame:
    """bucket, first (place of the bucket in the whole order), places (its shuffled positions).

    The one window without partitions sees a row per bucket. The shuffle runs
    over a fixed number of sorted partitions, which fixes its random numbers.
    """
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumn("first", F.coalesce(F.sum("count").over(before), F.lit(0)))
    dealt = placed.repartition(parts, "bucket").sortWithinPartitions("bucket")
    places = F.shuffle(F.sequence(F.lit(0), (F.col("count") - 1).cast("int")), seed)
    return dealt.select("bucket", "first", places.alias("places"))


def shuffle_to_shards(
    docs: DataFrame,
    shards: int = SHARDS,
    seed: int = SEED,
    bucket_bytes: int = BUCKET_BYTES,
    least_buckets: int = LEAST_BUCKETS,
) -> DataFrame:
    """The documents with size, text_crc32, law, shard, slot and grown_shard (NULL under this law)."""
    names = kept_names(docs, *ADDED)
    text = text_of()
    total = docs.agg(F.sum(record_bytes(text))).first()[0] or 0
    buckets = max(least_buckets, math.ceil(total / bucket_bytes))
    mark = F.xxhash64(F.lit(seed), F.col("doc_id"), text)
    bucket = F.pmod(mark, F.lit(buckets)).cast("int").alias("bucket")
    rows = docs.select(
        packed(docs, *ADDED).alias("row"),
        F.col("doc_id").alias("id"),
        mark.alias("mark"),
        record_bytes(text).alias("size"),
        F.crc32(text).alias("text_crc32"),
        bucket,
    )
    counts = docs.select(bucket).groupBy("bucket").count()
    places = store(shuffled_positions(counts, seed, min(buckets, 10_000)), "shard-places")
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy("mark", "id")) - 1
    ranked = rows.withColumn("rank", rank).join(places, "bucket")
    place = F.col("first") + F.get("places", F.col("rank"))
    ranked = ranked.withColumn("place", place)
    return unpacked(
        ranked,
        names,
        F.col("size"),
        F.col("text_crc32"),
        F.lit(LAW).alias("law"),
        (F.col("place") % shards).cast("int").alias("shard"),
        F.expr(f"place div {shards}").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(sharded: DataFrame, path: str, shards: int = SHARDS) -> None:
    """One folder per shard, records by slot. Shards are equal, so no task is larger than another."""
    dealt = sharded.repartition(shards, "shard").sortWithinPartitions("shard", "slot")
    dealt.write.partitionBy("shard").parquet(path)
