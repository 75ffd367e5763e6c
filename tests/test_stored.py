"""Stored tables that cost what a batch or a page touches, and tiers that ask for open keys only."""

import os
import random
import shutil
import tempfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from titleloom import schemas
from titleloom.operators import depths, linkage, pages, queue, routing, upsert
from titleloom.sources import buckets, tables

AS_OF = "2024-05-01 12:00:00"
SOURCES = "name string, completed boolean, attempts int, last_processed timestamp"


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def queue_rows(spark, n, first=0):
    return spark.range(first, first + n).select(
        F.concat(F.lit("n"), "id").alias("name"), (F.col("id") % 5 == 0).alias("completed"), (F.col("id") % 4).cast("int").alias("attempts"),
        F.timestamp_seconds(F.col("id") % 97).alias("last_processed"),
    )


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def files_by_bucket(path):
    return {d: sorted(f for f in os.listdir(f"{path}/{d}") if f.endswith(".parquet")) for d in os.listdir(path) if d.startswith(buckets.BUCKET)}


def test_a_batch_touches_its_buckets_only(spark, folder):
    path, n = f"{folder}/t", 32
    buckets.create(queue_rows(spark, 500), path, "name", n)
    before = files_by_bucket(path)
    marks = spark.createDataFrame([("n3",), ("n77",), ("n3",)], "name string")
    fold = lambda target, done: queue.apply_marks(target, "name", AS_OF, completed=done)
    want = rows(fold(buckets.read(spark, path, schemas.SOURCES), marks))
    hit = buckets.apply(marks, path, schemas.SOURCES, "name", n, 1, fold)
    after = files_by_bucket(path)
    assert hit == buckets.hit_buckets(marks, "name", n) and 1 <= len(hit) <= 2
    assert {b for b in before if before[b] != after[b]} == {f"{buckets.BUCKET}={b}" for b in hit}
    assert rows(buckets.read(spark, path, schemas.SOURCES)) == want
    plan = buckets.read(spark, path, schemas.SOURCES, hit)._jdf.queryExecution().executedPlan().toString()
    assert f"{buckets.BUCKET}" in plan.split("PartitionFilters:")[1].split("]")[0]


def test_a_crash_between_two_buckets_loses_nothing(spark, folder):
    path, n = f"{folder}/t", 8
    buckets.create(queue_rows(spark, 200), path, "name", n)
    more = queue_rows(spark, 100, 1000)
    calls = []

    def fold(target, new):
        calls.append(1)
        return target.unionByName(new)

    buckets.apply(more, path, schemas.SOURCES, "name", n, 5, fold)
    whole = rows(buckets.read(spark, path, schemas.SOURCES))
    assert len(whole) == 300
    shutil.rmtree(f"{path}/{buckets.BUCKET}=3")  # deleted, its new rows not yet in place
    buckets.apply(more, path, schemas.SOURCES, "name", n, 5, fold)
    assert rows(buckets.read(spark, path, schemas.SOURCES)) == whole and len(calls) == 1
    buckets.apply(more.limit(1), path, schemas.SOURCES, "name", n, 6, lambda target, _: target)
    assert os.listdir(f"{path}-batches") == ["6"]
    assert buckets.apply(more.limit(0), path, schemas.SOURCES, "name", n, 7, fold) == []
    assert rows(buckets.read(spark, path, schemas.SOURCES)) == whole


def test_stored_pages_read_few_partitions(spark, folder):
    for n in (700, 3000):
        table, path = queue_rows(spark, n), f"{folder}/{n}"
        pages.store_order(table, ["name"], path, partition_rows=150)
        for number, size in ((1, 100), (4, 100), (n // 100, 100), (n // 100 + 1, 100), (2, 7)):
            assert rows(pages.stored_page(spark, path, schemas.SOURCES, ["name"], number, size)) == rows(pages.page(table, ["name"], number, size))
            assert len(pages.reached(spark, path, number, size)[0]) <= 3
    pages.store_order(queue_rows(spark, 0), ["name"], f"{folder}/none")
    assert pages.stored_page(spark, f"{folder}/none", schemas.SOURCES, ["name"], 1, 10).collect() == []


def test_depths_follow_every_change(spark, folder):
    path, log = f"{folder}/t", f"{folder}/log"
    first = queue_rows(spark, 300)
    buckets.create(first, path, "name", 8)
    tables.append_changes(depths.depth_changes(None, first, "sources", 3), log, 0)

    def batch(number, changes, fold):
        report = lambda before, after: tables.append_changes(depths.depth_changes(before, after, "sources", 3), log, number)
        buckets.apply(changes, path, schemas.SOURCES, "name", 8, number, fold, report)

    def same():
        state = buckets.read(spark, path, schemas.SOURCES)
        cells = [F.count_if(depths.depth_of(3) == c).alias(c) for c in depths.CLASSES]
        kept = depths.depths(tables.read_changes(spark, log, depths.DEPTH_LOG)).drop("stage")
        assert rows(kept) == rows(state.agg(*cells))

    same()
    new = queue_rows(spark, 50, 500)
    batch(1, new, lambda target, more: target.unionByName(more))
    same()
    some = new.select("name").unionByName(first.limit(40).select("name"))
    for number in (2, 2, 3):
        batch(number, some, lambda target, keys: queue.apply_marks(target, "name", AS_OF, touched=keys, completed=keys.where("name LIKE '%3'")))
        same()
    batch(4, some, lambda target, _: queue.reset_attempts(target, "sources", AS_OF))
    same()
    tables.compact(spark, log, depths.DEPTH_LOG, depths.fold, 0, 3)
    same()


def test_tiers_ask_for_open_keys_only(spark):
    rng = random.Random(3)
    names = [f"Title {i}" for i in range(60)]
    parsed = spark.createDataFrame(
        [(f"h{i}", rng.choice(names), rng.choice([None, 1999, 2005]), rng.choice([None, 1]), rng.choice([None, 2])) for i in range(300)],
        "item_hash string, title string, year int, season int, episode int",
    )
    keys, _ = linkage.keys_of(parsed)
    asked = [r.lookup_key for r in keys.collect()]
    table = [
        (k, which, p, rng.choice([f"tt{p}", "nm1"]), rng.choice([k.split("|")[0].title(), "Other Thing", rng.choice(names)]), rng.choice([None, 1999, 2005]), rng.choice([None, "movie", "tvSeries"]))
        for k in [*asked, "nobody|0|any"]
        for which in [*linkage.PROVIDER_A, *linkage.PROVIDER_B]
        for p in range(rng.randint(0, 3))
    ]
    candidates = spark.createDataFrame(table, schemas.CANDIDATES)
    seen = []
    assert rows(linkage.resolve_in_tiers(keys, candidates, seen)) == rows(linkage.resolve(keys, candidates))
    per_list = candidates.where("lookup_key <> 'nobody|0|any'").count() / 4
    assert seen[0] > 0 and max(seen[1:]) < 0.8 * per_list and sum(seen) < 0.75 * 4 * per_list


def test_sources_in_tiers(spark):
    frame = lambda data: spark.createDataFrame(data, "key string, path string")
    lists = [frame([("a", "1"), ("a", "2")]), frame([("a", "x"), ("b", "3")]), frame([("b", "y"), ("c", "4"), ("z", "5")])]
    seen = []
    found = routing.first_nonempty_in_tiers(frame([(k, "") for k in "aabcd"]), lists, seen=seen)
    assert rows(found.select("key", "path", "rank")) == [("a", "1", 0), ("a", "2", 0), ("b", "3", 1), ("c", "4", 2)]
    assert seen == [2, 1, 1]


def test_a_stored_order_has_a_bounded_number_of_partitions(spark, tmp_path):
    rows = [(f"n{i:03d}", False, 0, datetime(2024, 1, 1) + timedelta(minutes=i % 50)) for i in range(200)]
    table = spark.createDataFrame(rows, schemas.SOURCES)
    pages.store_order(table, ["name"], f"{tmp_path}/order", partition_rows=10, most_parts=4)
    assert spark.read.parquet(f"{tmp_path}/order/counts").count() <= 4
    for number in (1, 3, 10):
        got = pages.stored_page(spark, f"{tmp_path}/order", schemas.SOURCES, ["name"], number, 20).collect()
        assert got == pages.page(table, ["name"], number, 20).collect()
