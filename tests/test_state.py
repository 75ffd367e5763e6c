"""Stages with state: restarts, timers, forgetting."""

import tempfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from titleloom import schemas
from titleloom.operators import counters
from titleloom.sources import tables
from titleloom.streaming import stages as S
from titleloom.streaming import state

DAY = datetime(2024, 5, 1)


@pytest.fixture
def paths():
    return S.Paths(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))


def put(spark, rows, schema, folder):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def stream(spark, schema, folder):
    return spark.readStream.schema(schema).parquet(folder)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_claims_survive_restarts(spark, paths):
    """New keys at once, failed ones after their cooldown; done and exhausted ones never."""
    src, schema = f"{paths.root}/marks", "item_hash string, cost int, done boolean, ts timestamp"
    at = lambda minutes: DAY + timedelta(minutes=minutes)

    def run():
        marks = stream(spark, schema, src)
        state.claims(marks, paths, once=True, max_attempts=3, cooldown_minutes=20, delay="0 seconds").awaitTermination()
        return rows(spark.read.parquet(paths.log("claims")), "item_hash", "attempts", "due_at")

    put(spark, [("new", 0, False, at(0)), ("tired", 3, False, at(0)), ("done", 1, True, at(0)), ("failed", 1, False, at(1)), ("twice", 1, False, at(2)), ("twice", 1, False, at(2))], schema, src)
    first = [("new", 1, at(0))]
    assert run() == first
    # Time passes with marks of other keys; the timers of the first run go off.
    put(spark, [("done", 1, False, at(30)), ("other", 1, True, at(30))], schema, src)
    second = sorted([*first, ("failed", 2, at(21)), ("new", 2, at(20)), ("twice", 3, at(22))], key=str)
    assert run() == second
    # A mark restarts the cooldown; a key that used up its attempts waits no more.
    put(spark, [("failed", 0, False, at(45)), ("other", 1, True, at(60))], schema, src)
    assert run() == sorted([*second, ("new", 3, at(50))], key=str)
    put(spark, [("other", 1, True, at(500))], schema, src)
    assert run() == sorted([*second, ("new", 3, at(50)), ("failed", 3, at(65))], key=str)


def test_memo_forgets_misses_only(spark, paths):
    parsed = lambda names, ts: [(n, "f", n, 2001, None, None, "x", ts) for n in names]
    src = f"{paths.root}/parsed"
    candidates = lambda ids: spark.createDataFrame(
        [(f"{t.lower()}|2001|any", "a_movie", 0, i, t, 2001, None) for t, i in ids.items()], schemas.CANDIDATES
    )

    def run(ids):
        log = S.stream_log(spark, src, schemas.PARSED_LOG)
        state.link(log, candidates(ids), paths, miss_minutes=60, once=True).awaitTermination()
        looked_up = tables.read_changes(spark, paths.log("memo"), schemas.MEMO).where("batch_id >= 0")
        return rows(looked_up, "batch_id", "lookup_key", "catalog_id"), rows(S.mappings(spark, paths), "item_hash", "catalog_id")

    now = datetime.now()
    put(spark, parsed(["Alpha", "Beta"], now), schemas.PARSED_LOG, src)
    asked, mapped = run({"Alpha": "tt1"})
    assert asked == [(0, "alpha|2001|any", "tt1"), (0, "beta|2001|any", None)] and mapped == [("Alpha", "tt1")]
    # A young miss is not asked again, though there is an answer by now; the hit stays although it is gone.
    put(spark, [(f"{h}2", *r) for h, *r in parsed(["Alpha", "Beta"], now + timedelta(minutes=5))], schemas.PARSED_LOG, src)
    asked, mapped = run({"Beta": "tt2"})
    assert len(asked) == 2 and mapped == [("Alpha", "tt1"), ("Alpha2", "tt1")]
    put(spark, [(f"{h}3", *r) for h, *r in parsed(["Alpha", "Beta"], now + timedelta(minutes=120))], schemas.PARSED_LOG, src)
    asked, mapped = run({"Beta": "tt2"})
    assert [a[1:] for a in asked[2:]] == [("beta|2001|any", "tt2")]
    assert mapped == [("Alpha", "tt1"), ("Alpha2", "tt1"), ("Alpha3", "tt1"), ("Beta3", "tt2")]


def test_names_enter_once(spark, paths):
    src = f"{paths.root}/listing"

    def run():
        query = state.discover(stream(spark, schemas.LISTING, src), paths, once=True)
        query.awaitTermination()
        return rows(spark.read.parquet(paths.log("names")), "name"), query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"]

    put(spark, [(n, "blob") for n in ["a.html", "b.html", "a.html", "index.html"]], schemas.LISTING, src)
    assert run() == ([("a.html",), ("b.html",)], 2)
    put(spark, [(n, "blob") for n in ["b.html", "c.html", "c.html"]], schemas.LISTING, src)
    assert run() == ([("a.html",), ("b.html",), ("c.html",)], 3)


def test_history_holds_zeros_for_silence(spark, paths):
    src = f"{paths.root}/events"
    at = lambda minutes, s=0: DAY + timedelta(minutes=minutes, seconds=s)
    schema = schemas.COUNTER_EVENTS

    def run():
        state.history(stream(spark, schema, src), paths, once=True, delay="0 seconds").awaitTermination()
        told = spark.read.parquet(paths.log("history"))
        last = told.groupBy("counter").agg(F.max_by(F.struct("as_of", "points", "total", "last"), "as_of").alias("h")).select("counter", "h.*")
        return {r.counter: (r.as_of, list(r.points), r.total, r.last) for r in last.collect()}

    def want(events, as_of):
        df = spark.createDataFrame(events, schema).where(F.col("ts") < F.lit(as_of + timedelta(minutes=1)))
        return {r.counter: (as_of, list(r.points), r.total, r.last) for r in counters.zero_filled_history(counters.minute_points(df), as_of).collect()}

    events = [(at(0), "a", 3), (at(0, 30), "a", 4), (at(2), "b", 5), (at(70), "a", 1), (at(71, 1), "b", 2)]
    put(spark, events, schema, src)
    assert run() == want(events, at(70))
    more = [(at(90, 5), "a", 7), (at(99, 59), "a", 8)]
    put(spark, more, schema, src)
    assert run() == want(events + more, at(98))


def test_queue_state_is_held_by_bucket(spark, paths):
    """A call of the store for each item took the time of the whole query."""
    at = datetime(2024, 1, 1)
    rows = [(f"i{n}", 0, n % 7 == 0, at + timedelta(minutes=n % 3)) for n in range(300)] + [("late", 0, False, at + timedelta(hours=2))]
    path = f"{paths.root}/many-marks"
    spark.createDataFrame(rows, "item_hash string, cost int, done boolean, ts timestamp").coalesce(1).write.parquet(path)
    marks = spark.readStream.schema("item_hash string, cost int, done boolean, ts timestamp").parquet(path)
    query = state.claims(marks, paths, once=True, max_attempts=3, cooldown_minutes=20, delay="0 seconds", buckets=4)
    query.awaitTermination()
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) <= 4 * 4  # the value, its timer and the timer's indexes
    got = sorted((r.item_hash, r.attempts) for r in spark.read.parquet(paths.log("claims")).collect())
    open_ = [r[0] for r in rows if not r[2]]
    assert got == sorted([(i, 1) for i in open_] + [(i, 2) for i in open_ if i != "late"])


def test_relink_stores_what_is_due_once(spark, paths):
    at = datetime(2024, 1, 1)
    tables.append_changes(spark.createDataFrame([("a", 2, False, at), ("b", 2, False, at)], schemas.MARKS), paths.log("link_marks"), 0)
    parsed = spark.createDataFrame([("a", "Some 1", 2001, None, None), ("b", "Other 2", None, None, None)], "item_hash string, title string, year int, season int, episode int")
    none = spark.createDataFrame([], "lookup_key string, list string, pos bigint, id string, name string, year int, qid string")
    state.relink(parsed, none, paths, once=True, cooldown_minutes=0, delay="0 seconds").awaitTermination()
    assert sorted(r.item_hash for r in spark.read.parquet(paths.log("due")).collect()) == ["a", "b"]
    again = tables.read_changes(spark, paths.log("link_marks"), schemas.MARKS).where("batch_id < 0")
    assert sorted((r.item_hash, r.cost, r.done) for r in again.collect()) == [("a", 2, False), ("b", 2, False)]
