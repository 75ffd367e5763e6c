"""Upserts, queue, routing, reads and counters."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from titleloom import schemas
from titleloom.functions import display, predicates as P
from titleloom.operators import counters, pages, queue, routing, upsert
from titleloom.plans import stages

NOW = datetime(2024, 5, 1, 12, 0)
QUEUE = "completed boolean, attempts int, last_processed timestamp"
ITEMS = f"item_hash string, filename string, size_bytes bigint, {QUEUE}"


def before(minutes):
    return NOW - timedelta(minutes=minutes)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*(columns or df.columns)).collect()), key=str)


def test_eligible(spark):
    df = spark.createDataFrame(
        [
            ("new", False, 0, NOW),
            ("early", False, 1, before(19)),
            ("exact", False, 1, before(20)),
            ("late", False, 1, before(21)),
            ("spent", False, 5, before(99)),
            ("done", True, 0, before(99)),
        ],
        f"name string, {QUEUE}",
    )
    assert rows(queue.pending(df, NOW, 5, 20), "name") == [("late",), ("new",)]
    assert [r.name for r in queue.pending_batch(df, "name", 1, NOW, 5, 20).collect()] == ["late"]


def test_upsert_keeps_the_queue(spark):
    old = spark.createDataFrame([("a", "x", 1, True, 3, before(5)), ("b", "y", 2, False, 1, before(6))], ITEMS)
    new = spark.createDataFrame(
        [(0, "s1", 0, "a", "n1", 10), (0, "s1", 1, "a", "n2", 11), (0, "s0", 9, "a", "n0", 9), (0, "s1", 0, "c", "z", 3)],
        "batch int, source string, pos int, item_hash string, filename string, size_bytes bigint",
    )
    got = rows(upsert.upsert_items(old, new, NOW))
    assert got == [
        ("a", "n2", 11, True, 3, before(5)),
        ("b", "y", 2, False, 1, before(6)),
        ("c", "z", 3, False, 0, NOW),
    ]
    # doing it again changes nothing
    again = upsert.upsert_items(upsert.upsert_items(old, new, NOW), new, NOW + timedelta(1))
    assert rows(again) == got


def test_insert_if_absent(spark):
    have = spark.createDataFrame([("a", True, 3, NOW)], f"name string, {QUEUE}")
    new = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "name string")
    got = rows(upsert.insert_if_absent(have, new, "name", upsert.new_queue_columns(NOW)))
    assert got == [("b", False, 0, NOW)]


OUT = "item_hash string, catalog_id string, output_type string, size_bytes bigint, file_index int, season int, episode int"


def test_outputs_with_null_index(spark):
    old = spark.createDataFrame(
        [("a", "tt1", "movie", 1, None, None, None, before(9)), ("a", "tt1", "series", 1, 0, 1, 1, before(8))],
        OUT + ", created_at timestamp",
    )
    new = spark.createDataFrame(
        [("a", "tt2", "movie", 5, None, None, None), ("a", "tt2", "series", 6, 0, 1, None), ("b", "tt3", "movie", 7, None, None, None)], OUT
    )
    got = rows(upsert.upsert_outputs(old, new, NOW), "item_hash", "file_index", "size_bytes", "episode", "created_at")
    assert got == [
        ("a", 0, 6, None, before(8)),
        ("a", None, 5, None, before(9)),
        ("b", None, 7, None, NOW),
    ]
    double = upsert.upsert_outputs(old, new, NOW, nulls_distinct=True)
    assert rows(double, "item_hash", "file_index", "size_bytes") == [("a", 0, 6), ("a", None, 1), ("a", None, 5), ("b", None, 7)]


def test_marks(spark):
    df = spark.createDataFrame([(k, False, 1, before(30)) for k in "abcd"], f"name string, {QUEUE}")
    keys = lambda s: spark.createDataFrame([(c,) for c in s], "name string")
    assert rows(queue.touch(df, keys("aa"), "name", NOW))[:2] == [("a", False, 2, NOW), ("b", False, 1, before(30))]
    assert rows(queue.complete(df, keys("b"), "name", NOW))[1] == ("b", True, 1, NOW)
    assert rows(queue.mark_failure(df, keys("c"), "name", NOW, failure_cost=3))[2] == ("c", False, 4, NOW)
    both = queue.apply_marks(df, "name", NOW, touched=keys("abc"), completed=keys("a"), failed=keys("bb"))
    assert rows(both) == [("a", True, 2, NOW), ("b", False, 3, NOW), ("c", False, 2, NOW), ("d", False, 1, before(30))]


def test_reset(spark):
    df = spark.createDataFrame([("a", False, 4, before(9)), ("b", True, 4, before(9)), ("c", False, 0, before(9))], f"name string, {QUEUE}")
    assert rows(queue.reset_attempts(df, "items", NOW)) == [("a", False, 0, NOW), ("b", True, 4, before(9)), ("c", False, 0, before(9))]
    assert queue.count_resettable(df, "items").first()[0] == 1
    assert rows(queue.reset_attempts(df, "outputs", NOW)) == rows(df)
    assert queue.count_resettable(df, "outputs").first()[0] == 0


def test_media_filter(spark):
    files = [
        ("info.nfo", 5, False),
        ("subs.srt", 5, False),
        ("Sample/sample.mkv", 50_000_000, False),
        ("The.Sample.Movie.mkv", 1_500_000_000, True),
        ("sample.mkv", 100_000_000, True),
        ("A.MKV", 1, True),
        ("mkv", 1, False),
    ]
    df = spark.createDataFrame(files, "path string, size bigint, want boolean")
    assert df.where(P.media_file(F.col("path"), F.col("size")) != F.col("want")).count() == 0


def test_routing(spark):
    parsed = spark.createDataFrame(
        [("m", None, None), ("e", 1, 2), ("p", 3, None), ("u", None, None), ("q", 1, None), ("n", 2, None)],
        "item_hash string, season int, episode int",
    )
    mappings = spark.createDataFrame(
        [
            (h, "tt" + h, t, False, 0, NOW)
            for h, t in [("m", "movie"), ("e", "series"), ("p", "series"), ("u", "series"), ("q", "series"), ("n", "series")]
        ],
        f"item_hash string, catalog_id string, content_type string, {QUEUE}",
    )
    items = spark.createDataFrame([(h, h + ".mkv", 100, False, 0, NOW) for h in "mepuqn"], ITEMS)
    singles = routing.singles(mappings, items, parsed, NOW)
    assert rows(singles, "item_hash", "season", "episode") == [("e", 1, 2), ("m", None, None)]
    packs = routing.packs(mappings, items, parsed, NOW)
    assert rows(packs, "item_hash", "season") == [("n", 2), ("p", 3), ("q", 1)]
    assert rows(routing.unrouted(mappings, parsed), "item_hash") == [("u",)]

    first = spark.createDataFrame(
        [("p", "S03E01.mkv", 500_000_000, 0), ("p", "d/E05.mp4", 500_000_000, 1), ("p", "sample.mkv", 10, 2), ("p", "bonus.avi", 7, 4), ("q", "a.nfo", 1, 0)],
        "key string, path string, size bigint, file_index int",
    )
    second = spark.createDataFrame([("p", "other.mkv", 1, 0)], "key string, path string, size bigint, file_index int")
    files = routing.first_nonempty_source([first, second])
    assert files.where("path = 'other.mkv'").count() == 0
    outputs = routing.expand_packs(packs, files)
    assert rows(outputs, "item_hash", "size_bytes", "file_index", "season", "episode") == [
        ("p", 500_000_000, 0, 3, 1),
        ("p", 500_000_000, 1, 3, 5),
        ("p", 7, 4, 3, None),
    ]
    status = routing.pack_status(packs, files)
    assert rows(status) == [("n", 0, False), ("p", 3, True), ("q", 0, True)]
    assert tuple(counters.pack_tally(status).first()) == (3, 2, 2)

    empty = spark.createDataFrame([], OUT + ", created_at timestamp")
    after = stages.route_packs(mappings, items, parsed, empty, files, NOW)
    assert rows(after["mappings"].where("attempts = 1"), "item_hash", "completed") == [("n", False), ("p", True), ("q", True)]
    after = stages.route_singles(mappings, items, parsed, empty, NOW)
    assert rows(after["outputs"], "item_hash", "output_type", "size_bytes") == [("e", "series", 100), ("m", "movie", 100)]
    assert rows(after["mappings"].where("completed"), "item_hash") == [("e",), ("m",)]


def test_stage_chain(spark):
    """Discover, extract, parse, link: states feed one another."""
    from tests_support import CHAIN_MARKER, chain_documents

    listing = spark.createDataFrame([("a.html", "blob"), ("b.html", "blob"), ("index.html", "blob")], "path string, type string")
    no_sources = spark.createDataFrame([], f"name string, {QUEUE}")
    sources = stages.discover(listing, no_sources, before(60))
    documents = spark.createDataFrame(chain_documents(), "source string, html string")
    step = stages.extract(sources, documents, spark.createDataFrame([], ITEMS), CHAIN_MARKER, before(50))
    assert rows(step["sources"], "name", "completed", "attempts") == [("a.html", True, 1), ("b.html", False, 1)]
    assert rows(step["errors"], "source") == [("b.html",)]
    no_parsed = spark.createDataFrame([], f"item_hash string, title string, year int, season int, episode int, {QUEUE}")
    parsed = stages.parse(step["items"], no_parsed, before(40))
    assert rows(parsed["items"], "item_hash", "completed", "attempts") == [("h1", True, 1), ("h2", True, 1), ("h3", True, 1)]
    assert rows(parsed["unparsed"], "item_hash") == [("h3",)]
    candidates = spark.createDataFrame(
        [("show|0|series", "a_series", 0, "tt1", "Show", None, None)],
        "lookup_key string, list string, pos int, id string, name string, year int, qid string",
    )
    no_mappings = spark.createDataFrame([], f"item_hash string, catalog_id string, content_type string, {QUEUE}")
    linked = stages.link(parsed["parsed_items"], candidates, no_mappings, before(30))
    assert rows(linked["mappings"], "item_hash", "catalog_id", "content_type") == [("h1", "tt1", "series")]
    # a hit costs one attempt, a miss two
    assert rows(linked["parsed_items"], "item_hash", "completed", "attempts") == [("h1", True, 1), ("h2", False, 2)]


@pytest.mark.parametrize("given,want", [((None, None), (1, 50)), ((0, 500), (1, 200)), ((3, 0), (3, 1)), ((-5, 20), (1, 20))])
def test_page_clamp(given, want):
    assert pages.clamp(*given) == want


def test_pages(spark):
    df = spark.createDataFrame([(f"k{i:03d}", before(i // 2)) for i in range(101)], "name string, last_processed timestamp")
    names = lambda d: [r.name for r in d.orderBy(F.col("last_processed").desc(), "name").collect()]
    want = [f"k{i:03d}" for i in range(101)]
    assert names(pages.page(df, ["name"], 2, 30)) == want[30:60]
    assert names(pages.page(df, ["name"], 4, 30)) == want[90:]
    assert names(pages.page(df, ["name"], 9, 30)) == []
    for number in range(1, 12):
        assert names(pages.deep_page(df, ["name"], number, 10, partitions=7)) == want[number * 10 - 10 : number * 10]
    last = {"name": "k029", "last_processed": before(14)}
    assert names(pages.page_after(df, ["name"], last, 30)) == want[30:60]
    assert tuple(pages.page_total(df, 2, 30).first()) == (101, 2, 30)


def test_pages_with_null_keys_and_times(spark):
    """Every page behind every row, NULLs and ties included; deep pages give the same rows."""
    times = [before(1), before(1), before(1), before(1), before(2), None, None, None]
    data = [("x", None), ("x", 0), ("x", 1), ("y", None), ("x", None), ("a", None), ("a", 0), (None, None)]
    df = spark.createDataFrame([(*d, t) for d, t in zip(data, times)], "k string, i int, created_at timestamp")
    first = lambda v: (v is not None, v if v is not None else 0)
    order = sorted(df.collect(), key=lambda r: (r.created_at is None, -(r.created_at.timestamp() if r.created_at else 0), r.k is not None, r.k or "", first(r.i)))
    same = lambda rows: sorted(map(str, rows))
    for at, row in enumerate(order):
        got = pages.page_after(df, ["k", "i"], row.asDict(), 3, "created_at").collect()
        assert same(got) == same(order[at + 1 : at + 4])
    for number in (1, 2, 3, 4):
        assert same(pages.deep_page(df, ["k", "i"], number, 3, "created_at", partitions=3).collect()) == same(order[number * 3 - 3 : number * 3])


def test_repeated_keys_in_changes_are_stored_once(spark):
    out = spark.createDataFrame([("h", "c", "series", 1, 0, 1, 1, before(5))], schemas.OUTPUTS)
    names = ["item_hash", "catalog_id", "output_type", "size_bytes", "file_index", "season", "episode", "pos"]
    new = [("h", "c", "series", 7, 0, 1, 1, 1), ("h", "c", "series", 9, 0, 1, 1, 0), ("n", "c", "movie", 3, None, None, None, 0), ("n", "c", "movie", 4, None, None, None, 1)]
    rows = spark.createDataFrame(new, "item_hash string, catalog_id string, output_type string, size_bytes bigint, file_index int, season int, episode int, pos int")
    assert rows.columns == names
    got = sorted((r.item_hash, r.size_bytes) for r in upsert.upsert_outputs(out, rows, before(0)).collect())
    assert got == [("h", 7), ("n", 4)]
    apart = upsert.upsert_outputs(out, rows, before(0), nulls_distinct=True).collect()
    assert sorted((r.item_hash, r.size_bytes) for r in apart) == [("h", 7), ("n", 3), ("n", 4)]


@pytest.mark.parametrize(
    "size,want",
    [
        (None, "0 B"), (0, "0 B"), (1, "0 KB"), (512, "1 KB"), (1023, "1 KB"), (1536, "2 KB"), (2560, "3 KB"),
        (1048576, "1.0 MB"), (1048576 * 5 // 4, "1.3 MB"), (1073741824, "1.00 GB"), (1073741824 * 9 // 8, "1.13 GB"),
        (1468614656, "1.37 GB"), (5 * 2**40, "5120.00 GB"), (1073741823, "1024.0 MB"),
    ],
)
def test_size_text(spark, size, want):
    df = spark.createDataFrame([(size,)], "s bigint")
    assert df.select(display.size_text(F.col("s"))).first()[0] == want


def test_times_and_percent(spark):
    df = spark.sql("SELECT timestamp'2024-01-01 00:00:00' a, timestamp'2024-01-01 00:00:00.5' b, timestamp'1969-12-31 23:59:59.000001' c")
    assert tuple(df.select(*[display.rfc3339(F.col(c)) for c in "abc"]).first()) == (
        "2024-01-01T00:00:00+00:00",
        "2024-01-01T00:00:00.500+00:00",
        "1969-12-31T23:59:59.000001+00:00",
    )
    pct = lambda *v: spark.range(1).select(display.completion_percent(*[F.lit(x) for x in v])).first()[0]
    assert (pct(1, 1, 0), pct(0, 0, 0), pct(1, 199, 0), pct(2, 1, 0)) == (50, 0, 1, 67)


def test_history(spark):
    at = lambda m: datetime(2024, 1, 1, 10, 0, 5) + timedelta(minutes=m)
    events = spark.createDataFrame(
        [(at(0), "a", 1), (at(0), "a", 2), (at(3), "a", 5), (at(70), "a", 7), (at(-10), "b", 9)], "ts timestamp, counter string, n bigint"
    )
    points = counters.minute_points(events)
    out = {r.counter: r for r in counters.zero_filled_history(points, at(3), ["a", "b", "c"]).collect()}
    assert (out["a"].total, out["a"].last, out["a"].points[-4:]) == (8, 5, [3, 0, 0, 5])
    assert (out["b"].total, out["b"].last, out["b"].points[46:48]) == (9, 0, [9, 0])
    assert (out["c"].total, len(out["c"].points), set(out["c"].points)) == (0, 60, {0})
    got = {r.counter: tuple(r)[1:] for r in counters.last_n_minutes(points, at(3)).collect()}
    assert got == {"a": (5, 8, 8, 8), "b": (0, 0, 9, 9)}
    silent = {r.counter: tuple(r)[1:] for r in counters.last_n_minutes(points, at(200)).collect()}
    assert silent == {"a": (0, 0, 0, 0), "b": (0, 0, 0, 0)}
    rolling = {(r.counter, r.minute.minute): r.rolling for r in counters.rolling_sum(points, 4).collect()}
    assert rolling[("a", 3)] == 8 and rolling[("a", 0)] == 3 and len(rolling) == 4


def test_key_format(spark):
    df = spark.createDataFrame([("a" * 40,), ("F" * 40,), ("g" * 40,), ("a" * 39,), ("a" * 40 + "\n",), (None,)], "k string")
    assert [r[0] for r in df.select(P.key_well_formed(F.col("k"))).collect()] == [True, True, False, False, False, False]
