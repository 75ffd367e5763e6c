"""Streaming stages against their batch results, with replays and retries."""

import os
import shutil
import tempfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from tests_support import CHAIN_MARKER, chain_documents

from titleloom import schemas
from titleloom.functions.names import with_parsed_name
from titleloom.operators import counters
from titleloom.plans.queries import QUERIES
from titleloom.sources import documents as D
from titleloom.sources import tables
from titleloom.streaming import stages as S
from titleloom.streaming.counters import minute_counters


@pytest.fixture
def paths():
    return S.Paths(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))


def put(df, folder):
    df.coalesce(1).write.mode("append").parquet(folder)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*(columns or df.columns)).collect()), key=str)


def test_discover_skips_known_names_and_survives_replay(spark, paths):
    src = f"{paths.root}/listing"
    frame = lambda names: spark.createDataFrame([(n, "blob") for n in names], schemas.LISTING)
    put(frame(["a.html", "b.html", "index.html"]), src)
    run = lambda: S.discover(spark.readStream.schema(schemas.LISTING).parquet(src), paths, once=True).awaitTermination()
    run()
    put(frame(["b.html", "c.html"]), src)
    run()
    logged = lambda: rows(
        tables.read_changes(spark, paths.log("sources"), schemas.SOURCES), "name", "batch_id"
    )
    want = [("a.html", 0), ("b.html", 0), ("c.html", 1)]
    assert logged() == want
    # Lose the commit of the last batch: it runs again and writes the same rows.
    commits = f"{paths.checkpoint('discover')}/commits"
    os.remove(f"{commits}/1")
    crc = f"{commits}/.1.crc"
    if os.path.exists(crc):
        os.remove(crc)
    run()
    assert logged() == want


def test_documents_to_outputs(spark, paths):
    src = f"{paths.root}/documents"
    put(spark.createDataFrame(chain_documents(), schemas.DOCUMENTS), src)
    documents = spark.readStream.schema(schemas.DOCUMENTS).parquet(src)
    S.extract(documents, CHAIN_MARKER, paths, once=True).awaitTermination()
    decoded = spark.read.schema(schemas.DECODED).parquet(paths.log("decoded"))
    batch = D.read_documents(spark.createDataFrame(chain_documents(), schemas.DOCUMENTS), CHAIN_MARKER)
    assert rows(decoded.drop("ingested_at")) == rows(batch)
    assert rows(D.document_errors(decoded), "source") == [("b.html",), ("c.html",)]

    items = S.item_rows(S.stream_log(spark, paths.log("decoded"), schemas.DECODED))
    S.parse(items, paths, once=True).awaitTermination()
    parsed = spark.read.schema(schemas.PARSED_LOG).parquet(paths.log("parsed"))
    want = with_parsed_name(S.item_rows(decoded), "filename").select("item_hash", "parsed.*")
    assert rows(parsed, *want.columns) == rows(want)

    candidates = spark.createDataFrame([("show|0|series", "a_series", 0, "tt1", "Show", None, None)], schemas.CANDIDATES)
    S.link(S.stream_log(spark, paths.log("parsed"), schemas.PARSED_LOG), candidates, paths, once=True).awaitTermination()
    assert rows(S.link_queue(spark, paths), "item_hash", "completed", "attempts") == [("h1", True, 1), ("h2", False, 2)]
    memo = tables.read_changes(spark, paths.log("memo"), schemas.MEMO)
    assert rows(memo, "lookup_key", "catalog_id") == [("film|2001|any", None), ("show|0|series", "tt1")]

    # Retry: nothing before the cooldown, the miss afterwards; the same pass twice counts once.
    more = candidates.unionByName(
        spark.createDataFrame([("film|2001|any", "a_movie", 0, "tt2", "Film", 2001, None)], schemas.CANDIDATES)
    )
    soon, later = datetime.now() + timedelta(minutes=5), datetime.now() + timedelta(days=2)
    ready = parsed.where("title IS NOT NULL").select("item_hash", "title", "year", "season", "episode")
    S.retry_links(ready, more, paths, soon, -1)
    assert rows(S.link_queue(spark, paths), "item_hash", "attempts") == [("h1", 1), ("h2", 2)]
    for _ in range(2):
        S.retry_links(ready, more, paths, later, -2)
        assert rows(S.link_queue(spark, paths), "item_hash", "completed", "attempts") == [("h1", True, 1), ("h2", True, 3)]

    mappings = S.stream_changes(spark, paths.log("mappings"), schemas.MAPPED_LOG)
    sizes = S.item_rows(decoded).select("item_hash", "size_bytes")
    files = spark.createDataFrame([], schemas.ITEM_FILES)
    for _ in range(2):
        S.route(mappings, sizes, files, paths, once=True).awaitTermination()
        assert rows(S.outputs(spark, paths), "item_hash", "catalog_id", "output_type", "size_bytes", "episode") == [
            ("h1", "tt1", "series", 5, 2),
            ("h2", "tt2", "movie", 6, None),
        ]


def test_route_expands_packs(spark, paths):
    t = datetime(2024, 1, 1)
    put(spark.createDataFrame([("p", "tt1", "series", 2, None, t), ("x", "tt2", "series", None, None, t)], schemas.MAPPED_LOG), f"{paths.log('mappings')}/batch_id=0")
    files = spark.createDataFrame([("p", "E03.mkv", 9, 0), ("p", "i.nfo", 9, 1)], schemas.ITEM_FILES)
    sizes = spark.createDataFrame([("p", 1), ("x", 1)], "item_hash string, size_bytes bigint")
    S.route(S.stream_changes(spark, paths.log("mappings"), schemas.MAPPED_LOG), sizes, files, paths, once=True).awaitTermination()
    assert rows(S.outputs(spark, paths), "item_hash", "file_index", "season", "episode") == [("p", 0, 2, 3)]


def test_route_stores_lists_of_packs_only(spark, paths, monkeypatch):
    t = datetime(2024, 1, 1)
    put(spark.createDataFrame([("p", "tt1", "series", 2, None, t), ("s", "tt2", "movie", None, None, t)], schemas.MAPPED_LOG), f"{paths.log('mappings')}/batch_id=0")
    files = spark.createDataFrame([("p", "E03.mkv", 9, 0), ("s", "film.mkv", 9, 0)], schemas.ITEM_FILES)
    sizes = spark.createDataFrame([("p", 1), ("s", 2)], "item_hash string, size_bytes bigint")
    stored = []
    monkeypatch.setattr(S, "cut_lineage", lambda df, cut=S.cut_lineage: stored.append(cut(df)) or stored[-1])
    S.route(S.stream_changes(spark, paths.log("mappings"), schemas.MAPPED_LOG), sizes, files, paths, once=True).awaitTermination()
    assert [rows(df, "key") for df in stored if "path" in df.columns] == [[("p",)]]
    assert rows(S.outputs(spark, paths), "item_hash", "file_index", "size_bytes") == [("p", 0, 9), ("s", None, 2)]
    assert rows(S.route_queue(spark, paths), "item_hash", "completed", "attempts") == [("p", True, 1), ("s", True, 1)]


def test_route_retry_waits_for_lists_and_items(spark, paths):
    """A pack whose list, and a single whose item, arrive after its batch end in outputs."""
    t = datetime(2024, 1, 1)
    mapped = [("p", "tt1", "series", 2, None, t), ("s", "tt2", "movie", None, None, t)]
    put(spark.createDataFrame(mapped, schemas.MAPPED_LOG), f"{paths.log('mappings')}/batch_id=0")
    sizes = lambda *names: spark.createDataFrame([(n, 1) for n in names], "item_hash string, size_bytes bigint")
    no_files = spark.createDataFrame([], schemas.ITEM_FILES)
    stream = S.stream_changes(spark, paths.log("mappings"), schemas.MAPPED_LOG)
    S.route(stream, sizes("p"), no_files, paths, once=True).awaitTermination()
    state = lambda: rows(S.route_queue(spark, paths), "item_hash", "completed", "attempts")
    assert state() == [("p", False, 1), ("s", False, 0)]
    assert S.outputs(spark, paths).count() == 0
    files = spark.createDataFrame(
        [("p", "E03.mkv", 9, 0, 0), ("p", "E04.mkv", 8, 0, 1)], "key string, path string, size bigint, file_index int, pos int"
    )
    later = datetime.now() + timedelta(days=1)
    for _ in range(2):
        S.retry_routes(sizes("p", "s"), files, paths, later, -1)
        assert state() == [("p", True, 2), ("s", True, 1)]
        assert rows(S.outputs(spark, paths), "item_hash", "file_index", "episode") == [("p", 0, 4), ("s", None, None)]


def test_document_retry(spark, paths):
    src = f"{paths.root}/documents"
    put(spark.createDataFrame(chain_documents(), schemas.DOCUMENTS), src)
    stream = spark.readStream.schema(schemas.DOCUMENTS).parquet(src)
    S.extract(stream, CHAIN_MARKER, paths, once=True).awaitTermination()
    state = lambda: rows(S.document_queue(S.all_decoded(spark, paths)), "source", "completed", "attempts")
    assert state() == [("a.html", True, 1), ("b.html", False, 1), ("c.html", False, 1)]
    good = chain_documents()[0][1]
    now = spark.createDataFrame([("b.html", good), ("c.html", "x"), ("a.html", "x")], schemas.DOCUMENTS)
    later = datetime.now() + timedelta(days=1)
    for _ in range(2):
        S.retry_documents(now, CHAIN_MARKER, paths, later, -1)
        assert state() == [("a.html", True, 1), ("b.html", True, 2), ("c.html", False, 2)]


def test_memo_hit_of_a_retry_beats_the_old_miss(spark, paths):
    parsed = [("h1", "f", "Film", 2001, None, None, "movie", datetime(2024, 1, 1))]
    put(spark.createDataFrame(parsed, schemas.PARSED_LOG), paths.log("parsed"))
    none = spark.createDataFrame([], schemas.CANDIDATES)
    run = lambda c: S.link(S.stream_log(spark, paths.log("parsed"), schemas.PARSED_LOG), c, paths, once=True).awaitTermination()
    run(none)
    found = spark.createDataFrame([("film|2001|any", "a_movie", 0, "tt2", "Film", 2001, None)], schemas.CANDIDATES)
    ready = spark.createDataFrame(parsed, schemas.PARSED_LOG).select("item_hash", "title", "year", "season", "episode")
    S.retry_links(ready, found, paths, datetime.now() + timedelta(days=2), -1)
    put(spark.createDataFrame([("h2", "f", "Film", 2001, None, None, "movie", datetime(2024, 1, 2))], schemas.PARSED_LOG), paths.log("parsed"))
    run(none)  # answered by the memo
    assert rows(S.mappings(spark, paths), "item_hash", "catalog_id") == [("h1", "tt2"), ("h2", "tt2")]


def test_compaction_changes_no_fold(spark, paths):
    t = lambda d: datetime(2024, 1, d)
    log = paths.log("link_marks")
    for batch, data in {0: [("a", 2, False, t(1)), ("b", 1, True, t(1))], 1: [("a", 2, False, t(2))], -1: [("a", 1, True, t(3))], 2: [("c", 1, True, t(4))]}.items():
        tables.append_changes(spark.createDataFrame(data, schemas.MARKS), log, batch)
    want = rows(S.link_queue(spark, paths))
    tables.compact(spark, log, schemas.MARKS, S.fold_marks, -1, 1)
    assert rows(S.link_queue(spark, paths)) == want
    shutil.rmtree(f"{log}/batch_id=0")
    tables.append_changes(spark.createDataFrame([("d", 2, False, t(5))], schemas.MARKS), log, -2)
    assert rows(S.link_queue(spark, paths)) == sorted([*want, ("d", False, 2, t(5))], key=str)
    tables.compact(spark, log, schemas.MARKS, S.fold_marks, -2, 2)
    assert rows(S.link_queue(spark, paths)) == sorted([*want, ("d", False, 2, t(5))], key=str)


def test_minute_counters_equal_batch_once_closed(spark, paths):
    base = datetime(2024, 1, 1)
    events = spark.createDataFrame(
        [(base + timedelta(seconds=37 * i), "ab"[i % 2], i) for i in range(400)], schemas.COUNTER_EVENTS
    )
    src = f"{paths.root}/events"
    put(events, src)
    stream = minute_counters(spark.readStream.schema(schemas.COUNTER_EVENTS).parquet(src), "5 minutes")
    S.append_sink(stream, paths, "minutes", once=True).awaitTermination()
    got = spark.read.parquet(paths.log("minutes"))
    closed = base + timedelta(seconds=37 * 399) - timedelta(minutes=5)
    want = counters.minute_points(events).where(
        F.col("minute") + F.expr("INTERVAL 1 MINUTE") <= F.lit(closed)
    )
    assert rows(got, "counter", "minute", "n") == rows(want, "counter", "minute", "n")
    assert got.count() > 300


def test_snapshots_never_overwrite(spark, paths):
    df = spark.range(3)
    where = tables.write_snapshot(df, f"{paths.root}/snap/v1")
    with pytest.raises(Exception):
        tables.write_snapshot(df, where)
    shutil.rmtree(where)


def test_binary_and_html_readers(spark, paths):
    os.makedirs(f"{paths.root}/files/sub")
    with open(f"{paths.root}/files/k1.bin", "wb") as f:
        f.write(b"d4:infod4:name9:movie.mkv6:lengthi5eee")
    with open(f"{paths.root}/files/sub/a+b c.html", "w") as f:
        f.write("<p>\nx</p>")
    got = tables.read_containers(spark, f"{paths.root}/files", "*.bin").collect()
    assert [(r.key, bytes(r.content)[:3]) for r in got] == [("k1", b"d4:")]
    os.remove(f"{paths.root}/files/k1.bin")
    docs = tables.read_documents(spark, f"{paths.root}/files").collect()
    assert [tuple(r) for r in docs] == [("sub/a+b c.html", "<p>\nx</p>")]


@pytest.mark.parametrize("name", ["stream_discover", "stream_names"])
def test_streams_read_tables_stored_as_folders(spark, tmp_path, name):
    rows = [(i, f"p{i % 9}.html") for i in range(1, 40)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    pages.repartition(3).write.parquet(f"{tmp_path}/folder/pages.parquet")
    (tmp_path / "file").mkdir()
    pages.toPandas().to_parquet(tmp_path / "file" / "pages.parquet")
    want = sorted({u for i, u in rows if i % 5 != 1 and i % 50})
    for kind in ("folder", "file"):
        got = QUERIES[name](spark, f"{tmp_path}/{kind}").collect()
        assert sorted(r.name for r in got) == want
