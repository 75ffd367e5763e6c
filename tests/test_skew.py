"""One key with a third of all rows and more: same results as a plain computation."""

import pytest
from pyspark.sql import functions as F

from titleloom.operators import linkage, routing, upsert

N = 60_000


@pytest.fixture(scope="module")
def hot_key(spark):
    """Every second candidate belongs to one key."""
    i = F.col("id")
    key = F.when(i % 2 == 0, F.lit("film|2001|any")).otherwise(F.concat(F.lit("k"), (i % 997).cast("string"), F.lit("|0|any")))
    return spark.range(N).select(
        key.alias("lookup_key"),
        F.lit("a_movie").alias("list"),
        i.cast("int").alias("pos"),
        F.concat(F.lit("tt"), i.cast("string")).alias("id"),
        F.when(i == 41_000, "Film").otherwise(F.concat(F.lit("Nothing "), i.cast("string"))).alias("name"),
        F.lit(None).cast("int").alias("year"),
        F.lit(None).cast("string").alias("qid"),
    )


def test_hot_lookup_key(spark, hot_key):
    keys = spark.createDataFrame([("film|2001|any", "film", 2001, None), ("k1|0|any", "k1", None, None)], "lookup_key string, lookup_title string, lookup_year int, hint string")
    got = {r.lookup_key: r.catalog_id for r in linkage.resolve(keys, hot_key, prune=True).collect()}
    assert got == {"film|2001|any": "tt41000", "k1|0|any": None}


def test_hot_file_list(spark):
    i = F.col("id")
    files = spark.range(N).select(
        F.when(i % 3 == 0, "hot").otherwise(F.concat(F.lit("h"), (i % 5_000).cast("string"))).alias("key"),
        F.concat(F.lit("E0"), (i % 9 + 1).cast("string"), F.lit(".mkv")).alias("path"),
        i.alias("size"),
        i.cast("int").alias("file_index"),
        (i % 6 / 3).cast("int").alias("rank"),
    )
    won = routing.first_nonempty_source(files)
    hot = won.where("key = 'hot'")
    assert hot.agg(F.count("*"), F.max("rank")).first() == (N // 6, 0)
    packs = spark.createDataFrame([("hot", "tt1", 1)], "item_hash string, catalog_id string, season int")
    out = routing.expand_packs(packs, won)
    assert out.count() == N // 6
    assert out.agg(F.min("season"), F.max("episode")).first() == (1, 7)


def test_hot_key_in_changes(spark):
    i = F.col("id")
    changes = spark.range(N).select(
        F.when(i % 3 > 0, "hot").otherwise(i.cast("string")).alias("item_hash"), i.cast("int").alias("pos"), i.alias("size_bytes")
    )
    last = upsert.latest_per_key(changes, ["item_hash"], ["pos"])
    assert last.count() == N // 3 + 1
    assert last.where("item_hash = 'hot'").first().size_bytes == N - 1
