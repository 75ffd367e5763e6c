"""Registered queries: each runs one operator over the whole given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from titleloom import schemas
from titleloom.functions import display, matching as M, names as N, predicates as P
from titleloom.operators import catalog, counters, depths, linkage, pages, queue, routing, upsert
from titleloom.plans import inputs as I, stages
from titleloom.plans.encode import encode_texts
from titleloom.session import checkpoint_root
from titleloom.sources import buckets, containers, documents, file_lists, polled
from titleloom.sources.listing import document_names
from titleloom.sources.tables import append_changes, read_changes, read_table, write_snapshot
from titleloom.streaming import stages as streaming, state as stateful
from titleloom.streaming.counters import minute_counters as minute_counters_of

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _text(column: str, alias: str | None = None):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(alias or column)


def _state(df: DataFrame) -> DataFrame:
    """A table state with its timestamps as text."""
    return df.select(*[
        _text(c) if t == "timestamp" else F.col(c) for c, t in df.dtypes
    ])


# --- sources -----------------------------------------------------------------


@query
def listing_filter(spark, sf):
    listing = I.table(spark, sf, "pages").selectExpr(
        "CASE WHEN page_id % 50 = 0 THEN 'index.html' ELSE url END AS path",
        "CASE WHEN page_id % 5 = 1 THEN 'tree' ELSE 'blob' END AS type",
    )
    return document_names(listing)


@query
def html_fragment(spark, sf):
    return I.table(spark, sf, "pages").select(
        "page_id",
        documents.fragment(F.col("html"), I.FRAGMENT_MARKER).alias("fragment"),
        documents.fragment(F.col("html"), "no such mark").alias("unmarked"),
    )


@query
def decode_payloads(spark, sf):
    coded = encode_texts(I.json_documents(spark, sf), "json")
    broken = F.when(
        F.substring("source", 2, 20).cast("bigint") % 29 == 0,
        F.concat(F.lit("!"), F.col("payload")),
    ).otherwise(F.col("payload"))
    return documents.decode_payloads(coded.select("source", broken.alias("payload"))).select(
        "source", "json", F.col("error").isNotNull().alias("failed")
    )


@query
def json_shapes(spark, sf):
    wrapped = I.table(spark, sf, "events").selectExpr(
        "event_id",
        """CASE event_id % 5
           WHEN 0 THEN concat('{"title":"t","list":[{"filename":"', event_type, '","hash":"h', cast(event_id AS string), '","size":', get_json_object(props, '$.k'), '}]}')
           WHEN 1 THEN concat('[{"filename":"', event_type, '","hash":"h', cast(event_id AS string), '","bytes":', get_json_object(props, '$.k'), '},{"filename":"b","hash":"c","size":2}]')
           WHEN 2 THEN concat('{"torrents":[{"filename":"', event_type, '","hash":"h', cast(event_id AS string), '","bytes":', get_json_object(props, '$.k'), '}]}')
           WHEN 3 THEN concat('{"list":[{"filename":"a","hash":"b","size":1},', props, ']}')
           ELSE props END AS json""",
    )
    read = documents.with_entries(wrapped)
    return read.select(
        "event_id",
        F.col("entries").isNotNull().alias("valid"),
        "title",
        F.explode_outer("entries").alias("e"),
    ).select("event_id", "valid", "title", "e.filename", "e.item_hash", "e.size_bytes")


_ENCODED: dict[tuple[str, str], str] = {}


def _encoded(spark, sf):
    """Encoded documents, written once per session and folder: queries start from stored payloads."""
    key = spark.sparkContext.applicationId, sf
    coded = encode_texts(I.json_documents(spark, sf), "json")
    if key not in _ENCODED:
        path = f"{checkpoint_root(spark)}/encoded-{uuid.uuid4().hex}"
        coded.write.parquet(path)
        _ENCODED[key] = path
    return spark.read.schema(coded.schema).parquet(_ENCODED[key])


def _documents(spark, sf):
    coded = _encoded(spark, sf)
    html = F.concat(
        F.lit('<html><iframe src="https://'), F.lit(I.DOCUMENT_MARKER), "payload", F.lit('"></iframe>')
    )
    unmarked = F.substring("source", 2, 20).cast("bigint") % 31 == 0
    return coded.select("source", F.when(unmarked, "<html></html>").otherwise(html).alias("html"))


@query
def document_items(spark, sf):
    return documents.document_items(
        documents.read_documents(_documents(spark, sf), I.DOCUMENT_MARKER)
    )


@query
def document_errors(spark, sf):
    read = documents.read_documents(_documents(spark, sf), I.DOCUMENT_MARKER)
    return documents.document_errors(read).select("source")


@query
def container_files(spark, sf):
    return containers.container_files(I.containers(spark, sf)).select(
        "key", "path", "size", "file_index", F.col("error").isNotNull().alias("failed")
    )


@query
def bare_containers(spark, sf):
    """Containers that are the file dictionary itself."""
    return containers.container_files(I.bare_containers(spark, sf), wrapped=False).select(
        "key", "path", "size", "file_index", F.col("error").isNotNull().alias("failed")
    )


@query
def json_file_lists(spark, sf):
    listed = file_lists.with_files(I.provider_lists(spark, sf))
    return file_lists.file_rows(listed)


@query
def first_nonempty_source(spark, sf):
    return routing.first_nonempty_source(I.files(spark, sf))


# --- keyed writes --------------------------------------------------------------


@query
def insert_if_absent(spark, sf):
    have = I.sources(spark, sf).where("completed")
    new = I.table(spark, sf, "lineitem").selectExpr(
        "concat('d', cast(l_orderkey + l_linenumber AS string)) AS name"
    )
    return _state(upsert.insert_if_absent(have, new, "name", upsert.new_queue_columns(I.AS_OF)))


@query
def upsert_items(spark, sf):
    items = I.items(spark, sf).where("attempts < 3")
    rows = I.table(spark, sf, "lineitem").selectExpr(
        "cast(l_suppkey AS int) AS batch",
        "concat('s', cast(l_partkey AS string)) AS source",
        "l_linenumber AS pos",
        f"{I.FILE_KEY} AS item_hash",
        f"{I.FILE_PATH} AS filename",
        f"{I.FILE_SIZE} AS size_bytes",
    )
    return _state(upsert.upsert_items(items, rows, I.AS_OF))


@query
def upsert_parsed(spark, sf):
    old = I.parsed_items(spark, sf).where("attempts < 3").withColumn("episode", F.lit(None).cast("int"))
    new = I.parsed_items(spark, sf).where("attempts > 1")
    return _state(upsert.upsert_parsed(old, new, I.AS_OF))


@query
def upsert_mappings(spark, sf):
    old = I.mappings(spark, sf).where("attempts < 3")
    new = I.mappings(spark, sf).where("attempts > 1").withColumn("content_type", F.lit("movie"))
    return _state(upsert.upsert_mappings(old, new, I.AS_OF))


def _outputs(spark, sf):
    """Stored outputs, half of them without a file index."""
    return I.table(spark, sf, "orders").selectExpr(
        f"{I.HASH} AS item_hash",
        f"{I.CATALOG_ID} AS catalog_id",
        f"{I.CONTENT_TYPE} AS output_type",
        f"{I.ITEM_SIZE} AS size_bytes",
        "CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE cast(o_orderkey % 5 AS int) END AS file_index",
        f"{I.SEASON} AS season",
        f"{I.EPISODE} AS episode",
        "cast(o_orderdate AS timestamp) AS created_at",
    )


def _new_outputs(spark, sf):
    return (
        _outputs(spark, sf)
        .where("cast(item_hash AS bigint) % 3 > 0")
        .withColumn("size_bytes", F.col("size_bytes") + 1)
        .withColumn(
            "file_index",
            F.when(F.col("file_index") == 1, F.lit(9)).otherwise(F.col("file_index")),
        )
    )


@query
def upsert_nullable_key(spark, sf):
    old = _outputs(spark, sf).where("cast(item_hash AS bigint) % 4 > 0")
    return _state(upsert.upsert_outputs(old, _new_outputs(spark, sf), I.AS_OF))


@query
def upsert_nulls_distinct(spark, sf):
    old = _outputs(spark, sf).where("cast(item_hash AS bigint) % 4 > 0")
    return _state(
        upsert.upsert_outputs(old, _new_outputs(spark, sf), I.AS_OF, nulls_distinct=True)
    )


@query
def upsert_repeated_key(spark, sf):
    """Line items merged into the stored outputs, as a pack whose list numbers files twice: the later place wins."""
    rows = I.files(spark, sf).selectExpr(
        "key AS item_hash", "'tt1' AS catalog_id", "'series' AS output_type", "size AS size_bytes",
        "cast(file_index % 2 AS int) AS file_index", "1 AS season", "cast(NULL AS int) AS episode", "file_index AS pos",
    )
    return _state(upsert.upsert_outputs(_outputs(spark, sf), rows, I.AS_OF))


# --- queue -------------------------------------------------------------------


@query
def pending_rows(spark, sf):
    return _state(queue.pending(I.sources(spark, sf), I.AS_OF, max_attempts=3, cooldown_minutes=1440))


@query
def pending_batch(spark, sf):
    return _state(
        queue.pending_batch(I.sources(spark, sf), "name", 5000, I.AS_OF, 3, 1440)
    )


def _claimed(spark, sf):
    """Names mentioned by line items: many mentions per name."""
    return I.table(spark, sf, "lineitem").where("l_returnflag = 'R'").selectExpr(
        "concat('d', cast(l_orderkey AS string)) AS name", "l_quantity"
    )


@query
def touch(spark, sf):
    return _state(queue.touch(I.sources(spark, sf), _claimed(spark, sf), "name", I.AS_OF))


@query
def complete(spark, sf):
    return _state(queue.complete(I.sources(spark, sf), _claimed(spark, sf), "name", I.AS_OF))


@query
def finish_batch(spark, sf):
    """Touch, completion and failure in one pass; a failed try costs two attempts."""
    claimed = _claimed(spark, sf)
    return _state(
        queue.apply_marks(
            I.sources(spark, sf),
            "name",
            I.AS_OF,
            touched=claimed,
            completed=claimed.where("l_quantity > 25"),
            failed=claimed.where("l_quantity <= 5"),
        )
    )


@query
def reset_attempts(spark, sf):
    return _state(queue.reset_attempts(I.sources(spark, sf), "sources", I.AS_OF))


@query
def count_resettable(spark, sf):
    table = I.sources(spark, sf)
    on_list = queue.count_resettable(table, "sources").withColumn("name", F.lit("sources"))
    off_list = queue.count_resettable(table, "outputs").withColumn("name", F.lit("outputs"))
    return on_list.unionByName(off_list)


@query
def queue_depths(spark, sf):
    limits = {"extract": 2, "parse": 3, "link": 1, "singles": 2, "packs": 3}
    return queue.queue_depths(
        I.sources(spark, sf),
        I.items(spark, sf),
        I.parsed_items(spark, sf).where("year IS NOT NULL"),
        I.mappings(spark, sf),
        limits,
    ).withColumn(
        "percent",
        display.completion_percent(F.col("completed"), F.col("unresolved"), F.col("exhausted")),
    )


@query
def snapshot_pending(spark, sf):
    """A stored item table, read back by its explicit schema: the pending rows."""
    path = f"{_new_paths(spark).root}/items"
    write_snapshot(I.items(spark, sf), path, ["completed"])
    table = read_table(spark, "items", path)
    return _state(queue.pending(table, I.AS_OF, max_attempts=3, cooldown_minutes=1440))


# --- names -------------------------------------------------------------------


@query
def parse_name(spark, sf):
    return stages.parse_items(I.items(spark, sf)).select("item_hash", "filename", "parsed.*")


@query
def parse_stage_unparsed(spark, sf):
    return stages.parse(I.items(spark, sf), I.parsed_items(spark, sf), I.AS_OF)["unparsed"]


@query
def file_episode(spark, sf):
    rows = I.files(spark, sf).withColumn("parent", (F.col("size") % 7).cast("int"))
    named = N.with_file_episode(rows, "path", "parent", "fe")
    return named.select(
        "key", "path", "parent", "size", N.basename(F.col("path")).alias("name"), "fe.season", "fe.episode"
    )


@query
def title_file_episode(spark, sf):
    """The three-part form: own title or the parent's, under the strict rule."""
    rows = I.files(spark, sf).withColumn("parent", F.lit(4)).withColumn("ptitle", F.lit("Parent"))
    named = N.with_file_episode(rows, "path", "parent", "fe", strict=True, parent_title="ptitle")
    return named.where("fe IS NOT NULL").select("path", "fe.title", "fe.season", "fe.episode").distinct()


@query
def media_filter(spark, sf):
    return I.files(spark, sf).where(P.media_file(F.col("path"), F.col("size")))


@query
def key_format(spark, sf):
    return I.table(spark, sf, "orders").selectExpr(
        f"CASE WHEN o_orderkey % 3 = 0 THEN replace({I.HASH}, '0', 'G') WHEN o_orderkey % 5 = 0 THEN concat({I.HASH}, '0') ELSE replace({I.HASH}, '1', 'A') END AS key"
    ).withColumn("well_formed", P.key_well_formed(F.col("key")))


@query
def simplify_name(spark, sf):
    return I.catalog_queries(spark, sf).select(
        "query_id", M.simplify_name(F.col("title")).alias("simple")
    )


@query
def name_scores(spark, sf):
    """Similarity, almost-similarity and year similarity of matching rows of two tables."""
    pairs = I.catalog(spark, sf).withColumnRenamed("year", "cyear").join(
        I.catalog_queries(spark, sf), F.col("pos") == F.col("query_id")
    )
    a, b = F.col("name"), F.col("title")
    return pairs.select(
        "query_id",
        F.round(M.name_similarity(a, b), 9).alias("similarity"),
        M.name_almost_similar(a, b).alias("almost"),
        M.year_similar(F.col("year"), F.col("cyear")).alias("year_similar"),
    )


@query
def first_year(spark, sf):
    return I.table(spark, sf, "pages").select(
        "page_id",
        M.candidate_year(F.col("url"), F.concat(F.lit("x"), (F.col("page_id") * 37).cast("string"))).alias("year"),
    )


@query
def type_rules(spark, sf):
    rows = linkage_rows(spark, sf)
    return rows.groupBy("hint", "qid").agg(F.count("*").alias("n")).select(
        "hint",
        "qid",
        "n",
        M.normalise_type(F.col("qid")).alias("content_type"),
        F.coalesce(M.type_allowed(F.col("hint"), F.col("qid")), F.lit(True)).alias("series_ok"),
        M.type_allowed(F.lit("movie"), F.col("qid")).alias("movie_ok"),
    )


@query
def size_text(spark, sf):
    return I.items(spark, sf).selectExpr(
        "item_hash",
        "CASE attempts WHEN 0 THEN size_bytes WHEN 1 THEN size_bytes div 100 WHEN 2 THEN size_bytes div 1000000 ELSE NULL END AS size",
    ).select("item_hash", display.size_text(F.col("size")).alias("size_text"))


@query
def rfc3339(spark, sf):
    ts = F.expr("CASE event_id % 3 WHEN 0 THEN ts WHEN 1 THEN date_trunc('millisecond', ts) ELSE date_trunc('second', ts) END")
    return I.table(spark, sf, "events").select(
        "event_id", display.rfc3339(ts.cast("timestamp")).alias("text")
    )


# --- stages --------------------------------------------------------------------


def _retry():
    return stages.Retry(max_attempts=3, cooldown_minutes=1440)


@query
def stage_extract(spark, sf):
    """Source queue after the extract stage."""
    out = stages.extract(
        I.sources(spark, sf), _documents(spark, sf), I.items(spark, sf), I.DOCUMENT_MARKER, I.AS_OF, retry=_retry()
    )
    return _state(out["sources"])


@query
def stage_parse(spark, sf):
    """Item queue after the parse stage."""
    return _state(stages.parse(I.items(spark, sf), I.parsed_items(spark, sf), I.AS_OF, _retry())["items"]).drop("filename")


@query
def stage_link(spark, sf):
    """Queue of parsed items after the link stage: a miss costs two attempts."""
    out = stages.link(
        I.parsed_items(spark, sf), _candidate_table(spark, sf), I.mappings(spark, sf), I.AS_OF, retry=_retry()
    )
    return _state(out["parsed_items"]).select("item_hash", "completed", "attempts", "last_processed")


@query
def stage_route(spark, sf):
    """Mapping queue after singles and packs."""
    m, i, p = _tables(spark, sf)
    stored = _outputs(spark, sf)
    first = stages.route_singles(m, i, p, stored, I.AS_OF, _retry())["mappings"]
    second = stages.route_packs(first, i, p, stored, _won(spark, sf), I.AS_OF, _retry())["mappings"]
    return _state(second)


@query
def stage_counters(spark, sf):
    """Counters of the parse, link and pack stages, added up."""
    m, i, p = _tables(spark, sf)
    parsed = stages.parse(i, p, I.AS_OF, _retry())["counters"]
    linked = stages.link(p, _candidate_table(spark, sf), m, I.AS_OF, retry=_retry())["counters"]
    packed = stages.route_packs(m, i, p, _outputs(spark, sf), _won(spark, sf), I.AS_OF, _retry())["counters"]
    return counters.counter_totals(parsed.unionByName(linked).unionByName(packed))


# --- linkage -----------------------------------------------------------------


def _keys(spark, sf):
    return linkage.unique_keys(linkage.link_keys(I.parsed_items(spark, sf)))


def linkage_rows(spark, sf):
    return I.candidates(I.spread_keys(spark, sf, _keys(spark, sf)))


@query
def lookup_keys(spark, sf):
    return _keys(spark, sf)


@query
def distinct_keys(spark, sf):
    return counters.distinct_keys(linkage.link_keys(I.parsed_items(spark, sf)), "lookup_key")


@query
def group_by_key(spark, sf):
    return linkage.hashes_by_key(linkage.link_keys(I.parsed_items(spark, sf)))


@query
def candidate_filters(spark, sf):
    c = linkage_rows(spark, sf)
    keep = M.id_ok(F.col("id")) & M.year_similar(F.col("lookup_year"), F.col("year"))
    typed = F.coalesce(M.type_allowed(F.col("hint"), F.col("qid")), F.lit(True))
    return c.where(keep & typed).select("lookup_key", "list", "pos", "id")


def _pick_input(spark, sf, hint):
    return linkage_rows(spark, sf).select(
        "lookup_key",
        F.col("lookup_title").alias("title"),
        F.col("lookup_year").alias("query_year"),
        hint.alias("hint"),
        "pos", "id", "name", "year", "qid",
    )


@query
def link_provider_a(spark, sf):
    rows = _pick_input(spark, sf, F.lit(None).cast("string"))
    return linkage.pick_matches(rows, ["lookup_key"]).select("lookup_key", "catalog_id")


@query
def link_provider_b(spark, sf):
    rows = _pick_input(spark, sf, F.col("hint"))
    return linkage.pick_matches(rows, ["lookup_key"], last_resort=True)


@query
def link_text_years(spark, sf):
    """The provider B pick from candidates whose year is text, or stands in their release note."""
    rows = _pick_input(spark, sf, F.col("hint"))
    text = F.when(F.col("pos") % 2 == 0, F.col("year").cast("string"))
    note = F.concat(F.lit("since "), F.col("year").cast("string"), F.lit("-"))
    dated = rows.withColumn("year", M.candidate_year(text, note))
    return linkage.pick_matches(dated, ["lookup_key"], last_resort=True)


def _candidate_table(spark, sf):
    return linkage_rows(spark, sf).select("lookup_key", "list", "pos", "id", "name", "year", "qid")


@query
def link_cascade(spark, sf):
    return linkage.resolve(_keys(spark, sf), _candidate_table(spark, sf)).select(
        "lookup_key", "stage", "catalog_id", "content_type"
    )


@query
def link_fan_out(spark, sf):
    results, _ = linkage.link_items(I.parsed_items(spark, sf), _candidate_table(spark, sf))
    return results.select("item_hash", "catalog_id", "content_type")


@query
def link_with_memo(spark, sf):
    """Keys of even length are known from the memo, half of them as misses."""
    n = F.length("lookup_key")
    memo = _keys(spark, sf).where(n % 2 == 0).select(
        "lookup_key",
        F.when(n % 4 == 0, F.lit("tt0")).alias("catalog_id"),
        F.when(n % 4 == 0, F.lit("movie")).alias("content_type"),
    )
    results, _ = linkage.link_items(I.parsed_items(spark, sf), _candidate_table(spark, sf), memo)
    return results.select("item_hash", "catalog_id", "content_type")


@query
def link_tally(spark, sf):
    results, _ = linkage.link_items(I.parsed_items(spark, sf), _candidate_table(spark, sf))
    return counters.link_tally(results)


@query
def link_catalog(spark, sf):
    return catalog.link_catalog(I.catalog_queries(spark, sf), I.catalog(spark, sf)).select(
        "query_id", "catalog_id"
    )


@query
def year_similar_join(spark, sf):
    """Catalog rows of the same name in a similar year, counted. The catalog comes reduced to one row
    per name and year, so pairs grow with the names, not with their repeats."""
    right = I.catalog(spark, sf).groupBy("name", "year").agg(
        F.count("*").alias("rows"), F.min("pos").alias("pos")
    ).withColumnRenamed("name", "title")
    pairs = catalog.year_similar_join(I.catalog_queries(spark, sf), right, ["title"])
    return pairs.groupBy("query_id").agg(F.sum("rows").alias("n"), F.min("pos").alias("first_pos"))


# --- routing -----------------------------------------------------------------


def _tables(spark, sf):
    return I.mappings(spark, sf), I.items(spark, sf), I.parsed_items(spark, sf)


@query
def route_singles(spark, sf):
    m, i, p = _tables(spark, sf)
    return routing.emit_singles(routing.singles(m, i, p, I.AS_OF, 3, 1440))


@query
def route_packs(spark, sf):
    m, i, p = _tables(spark, sf)
    return routing.packs(m, i, p, I.AS_OF, 3, 1440).drop("last_processed")


@query
def unrouted(spark, sf):
    m, _, p = _tables(spark, sf)
    return routing.unrouted(m, p)


def _won(spark, sf):
    return routing.first_nonempty_source(I.files(spark, sf))


def _ready_packs(spark, sf):
    return routing.packs(*_tables(spark, sf), I.AS_OF, 3, 1440)


@query
def expand_packs(spark, sf):
    return routing.expand_packs(_ready_packs(spark, sf), _won(spark, sf))


@query
def pack_status(spark, sf):
    return routing.pack_status(_ready_packs(spark, sf), _won(spark, sf))


@query
def pack_tally(spark, sf):
    return counters.pack_tally(routing.pack_status(_ready_packs(spark, sf), _won(spark, sf)))


@query
def union_outputs(spark, sf):
    m, i, p = _tables(spark, sf)
    singles = routing.emit_singles(routing.singles(m, i, p, I.AS_OF, 3, 1440))
    both = singles.unionByName(routing.expand_packs(_ready_packs(spark, sf), _won(spark, sf)))
    return both.groupBy("output_type").agg(
        F.count("*").alias("n"), F.sum("size_bytes").alias("bytes")
    )


@query
def parse_and_route(spark, sf):
    """Flagship: parse every name, join mappings and items, keep the singles."""
    items = I.items(spark, sf)
    parsed = stages.parse_items(items).where(F.col("parsed").isNotNull()).select(
        "item_hash", "parsed.season", "parsed.episode"
    )
    ready = routing.singles(I.mappings(spark, sf), items, parsed, I.AS_OF, 3, 1440)
    return routing.emit_singles(ready)


# --- reads and counters --------------------------------------------------------


@query
def outputs_page(spark, sf):
    named = routing.outputs_with_names(
        _outputs(spark, sf), I.items(spark, sf).where("attempts < 2")
    )
    return _state(pages.page(named, ["item_hash", "file_index"], 3, 500, "created_at"))


@query
def items_page(spark, sf):
    return _state(pages.page(I.items(spark, sf), ["item_hash"], 0, None))


@query
def deep_page(spark, sf):
    return _state(pages.deep_page(I.sources(spark, sf), ["name"], 6, 200))


@query
def page_total(spark, sf):
    return pages.page_total(I.items(spark, sf), 2, 500)


@query
def page_after(spark, sf):
    """Second page through the last row of the first, without an offset."""
    table = I.sources(spark, sf)
    first = pages.page(table, ["name"], 1, 200).orderBy(
        F.col("last_processed").asc(), F.col("name").desc()
    ).first()
    return _state(pages.page_after(table, ["name"], first.asDict(), 200))


@query
def page_after_outputs(spark, sf):
    """The page behind a single, whose index is NULL: both NULL and numbered indexes follow."""
    table = _outputs(spark, sf)
    last = {"created_at": "1995-06-15 00:00:00", "item_hash": "0" * 40, "file_index": None}
    return _state(pages.page_after(table, ["item_hash", "file_index"], last, 200, "created_at"))


@query
def named_history(spark, sf):
    """History of named counters, one of which never occurred."""
    points = counters.minute_points(I.counter_events(spark, sf))
    history = counters.zero_filled_history(points, I.EVENTS_AS_OF, ["click", "never seen"])
    return history.select("counter", F.array_join("points", ",").alias("points"), "total", "last")


@query
def record_counts(spark, sf):
    m, i, p = _tables(spark, sf)
    return counters.record_counts({
        "sources": I.sources(spark, sf),
        "items": i,
        "parsed_items": p,
        "mappings": m,
        "outputs": _outputs(spark, sf),
    })


@query
def counter_totals(spark, sf):
    return counters.counter_totals(I.counter_events(spark, sf))


@query
def minute_counters(spark, sf):
    points = counters.minute_points(I.counter_events(spark, sf))
    return points.select("counter", _text("minute"), "n")


@query
def last_n_minutes(spark, sf):
    points = counters.minute_points(I.counter_events(spark, sf))
    return counters.last_n_minutes(points, I.EVENTS_AS_OF)


@query
def rolling_sum(spark, sf):
    points = counters.minute_points(I.counter_events(spark, sf))
    return counters.rolling_sum(points, 60).select("counter", _text("minute"), "rolling")


@query
def zero_filled_history(spark, sf):
    points = counters.minute_points(I.counter_events(spark, sf))
    history = counters.zero_filled_history(points, I.EVENTS_AS_OF)
    return history.select(
        "counter", F.array_join("points", ",").alias("points"), "total", "last"
    )


# --- streaming -----------------------------------------------------------------


def _stream(spark, sf, name, *columns):
    """One of the given tables, a file or a folder of files, as a file stream."""
    schema = I.table(spark, sf, name).schema
    # As a glob the path may be a single file, too.
    stream = spark.readStream.schema(schema).parquet(f"{sf}/{name}.parque[t]")
    return stream.select(*columns) if columns else stream


def _new_paths(spark):
    """A fresh folder next to the session's checkpoints, which the cluster shares."""
    return streaming.Paths(f"{checkpoint_root(spark)}/stream-{uuid.uuid4().hex}")


@query
def stream_minute_counters(spark, sf):
    """Minutes the watermark has closed, through an append sink."""
    events = _stream(spark, sf, "events").selectExpr(
        "cast(ts AS timestamp) AS ts", "event_type AS counter", "cast(user_id AS bigint) AS n"
    )
    paths = _new_paths(spark)
    streaming.append_sink(minute_counters_of(events), paths, "minutes", once=True).awaitTermination()
    return spark.read.schema("counter string, minute timestamp, n bigint").parquet(
        paths.log("minutes")
    ).select("counter", _text("minute"), "n")


@query
def stream_parse(spark, sf):
    """Names of line item files, parsed by the streaming stage."""
    names = _stream(spark, sf, "lineitem").selectExpr(
        f"{I.FILE_KEY} AS item_hash", f"{I.FILE_PATH} AS filename"
    )
    paths = _new_paths(spark)
    streaming.parse(names, paths, once=True).awaitTermination()
    return spark.read.schema(streaming.PARSED).parquet(paths.log("parsed")).drop("ingested_at")


def _derived(df, paths, name):
    """Rows derived from the given tables, stored and read back as a file stream."""
    folder = f"{paths.root}/derived/{name}"
    df.write.parquet(folder)
    return df.sparkSession.readStream.schema(df.schema).parquet(folder)


_LATER = "2999-01-01 00:00:00"


@query
def stream_discover(spark, sf):
    """Source names of a listing stream."""
    listing = _stream(spark, sf, "pages").selectExpr(
        "CASE WHEN page_id % 50 = 0 THEN 'index.html' ELSE url END AS path",
        "CASE WHEN page_id % 5 = 1 THEN 'tree' ELSE 'blob' END AS type",
    )
    paths = _new_paths(spark)
    streaming.discover(listing, paths, once=True).awaitTermination()
    return read_changes(spark, paths.log("sources"), schemas.SOURCES).select("name", "completed", "attempts")


@query
def stream_extract(spark, sf):
    """Document queue after the stream and one retry: what failed twice has two attempts."""
    paths, docs = _new_paths(spark), _documents(spark, sf)
    streaming.extract(_derived(docs, paths, "documents"), I.DOCUMENT_MARKER, paths, once=True).awaitTermination()
    now = spark.read.schema(docs.schema).parquet(f"{paths.root}/derived/documents")
    streaming.retry_documents(now, I.DOCUMENT_MARKER, paths, _LATER, -1)
    return streaming.document_queue(streaming.all_decoded(spark, paths)).drop("last_processed")


def _parsed_log(spark, sf):
    return I.parsed_items(spark, sf).selectExpr(
        "item_hash", "'f' AS filename", "title", "year", "season", "episode", "'x' AS content_type", "last_processed AS ingested_at"
    )


@query
def stream_link(spark, sf):
    """Link queue of a stream of parsed items."""
    paths = _new_paths(spark)
    stream = _derived(_parsed_log(spark, sf), paths, "parsed")
    streaming.link(stream, _candidate_table(spark, sf), paths, once=True).awaitTermination()
    return streaming.link_queue(spark, paths).drop("last_processed")


@query
def stream_link_retry(spark, sf):
    """Memo after a stream that found no candidates and a retry that did: hits replace the misses."""
    paths = _new_paths(spark)
    parsed = _parsed_log(spark, sf)
    found = _candidate_table(spark, sf)
    streaming.link(_derived(parsed, paths, "parsed"), found.limit(0), paths, once=True).awaitTermination()
    ready = spark.read.schema(parsed.schema).parquet(f"{paths.root}/derived/parsed")
    ready = ready.select("item_hash", "title", "year", "season", "episode")
    streaming.retry_links(ready, found, paths, _LATER, -1)
    return streaming.known_links(read_changes(spark, paths.log("memo"), schemas.MEMO)).select("lookup_key", "catalog_id")


def _routed_stream(spark, sf, first_files):
    m, i, p = _tables(spark, sf)
    mapped = m.select("item_hash", "catalog_id", "content_type").join(
        p.select("item_hash", "season", "episode"), "item_hash"
    ).withColumn("ts", F.lit(I.AS_OF).cast("timestamp")).select(*schemas.MAPPED_LOG.fieldNames())
    paths = _new_paths(spark)
    append_changes(mapped, paths.log("mappings"), 0)
    stream = streaming.stream_changes(spark, paths.log("mappings"), schemas.MAPPED_LOG)
    sizes = i.select("item_hash", "size_bytes")
    streaming.route(stream, sizes, first_files, paths, once=True).awaitTermination()
    return paths, sizes


@query
def stream_route(spark, sf):
    """Outputs of a stream of mappings, singles and packs."""
    paths, _ = _routed_stream(spark, sf, _won(spark, sf))
    return streaming.outputs(spark, paths)


@query
def stream_route_retry(spark, sf):
    """Route queue when file lists come only after the stream: a retry completes the packs."""
    won = _won(spark, sf)
    paths, sizes = _routed_stream(spark, sf, won.limit(0))
    streaming.retry_routes(sizes, won, paths, _LATER, -1)
    return streaming.route_queue(spark, paths).drop("last_processed")


def _marks(spark, sf):
    """Orders as queue marks."""
    return I.sources(spark, sf).selectExpr("name AS item_hash", "attempts AS cost", "completed AS done", "last_processed AS ts")


@query
def stream_claims(spark, sf):
    """What a retry queue in the state store hands out up to the last mark: each claim with its attempts."""
    paths = _new_paths(spark)
    marks = _derived(_marks(spark, sf), paths, "marks")
    stateful.claims(marks, paths, once=True, max_attempts=3, cooldown_minutes=1440, delay="0 seconds").awaitTermination()
    due = spark.read.schema("item_hash string, attempts int, due_at timestamp").parquet(paths.log("claims"))
    return _state(due)


@query
def stream_relink(spark, sf):
    """Memo after a stream without candidates, and the queue of its marks: what is due is linked again by itself."""
    paths = _new_paths(spark)
    parsed = _parsed_log(spark, sf)
    found = _candidate_table(spark, sf)
    streaming.link(_derived(parsed, paths, "parsed"), found.limit(0), paths, once=True).awaitTermination()
    ready = spark.read.schema(parsed.schema).parquet(f"{paths.root}/derived/parsed")
    ready = ready.select("item_hash", "title", "year", "season", "episode")
    stateful.relink(ready, found, paths, once=True, cooldown_minutes=0, delay="0 seconds").awaitTermination()
    return streaming.known_links(read_changes(spark, paths.log("memo"), schemas.MEMO)).select("lookup_key", "catalog_id")


@query
def stream_link_memo(spark, sf):
    """Links through a memo told beforehand: hits and young misses are not looked up, old misses are."""
    paths = _new_paths(spark)
    parsed = _parsed_log(spark, sf).withColumn("ingested_at", F.lit(I.AS_OF).cast("timestamp"))
    keys = linkage.keys_of(parsed)[0].select("lookup_key", (F.length("lookup_key") % 4).alias("kind"))
    told = keys.where("kind < 3").select(
        "lookup_key",
        F.when(F.col("kind") == 0, "tt0").alias("catalog_id"),
        F.when(F.col("kind") == 0, "movie").alias("content_type"),
        F.when(F.col("kind") == 1, F.lit("1999-05-01")).otherwise("1999-05-31").cast("timestamp").alias("ts"),
    )
    append_changes(told, paths.log("memo"), -(2**41))
    stream = _derived(parsed, paths, "parsed")
    stateful.link(stream, _candidate_table(spark, sf), paths, 7 * 1440, once=True).awaitTermination()
    queue_ = streaming.link_queue(spark, paths).select("item_hash", "completed", "attempts")
    return queue_.join(streaming.mappings(spark, paths).select("item_hash", "catalog_id"), "item_hash", "left")


@query
def stream_names(spark, sf):
    """New names of a listing stream, by keys in the state store."""
    listing = _stream(spark, sf, "pages").selectExpr(
        "CASE WHEN page_id % 50 = 0 THEN 'index.html' ELSE url END AS path",
        "CASE WHEN page_id % 5 = 1 THEN 'tree' ELSE 'blob' END AS type",
    )
    paths = _new_paths(spark)
    stateful.discover(listing, paths, once=True).awaitTermination()
    return spark.read.schema(schemas.SOURCES).parquet(paths.log("names")).select("name", "completed", "attempts")


@query
def stream_history(spark, sf):
    """The last history of every counter after an event stream."""
    events = _stream(spark, sf, "events").selectExpr("cast(ts AS timestamp) AS ts", "event_type AS counter", "cast(user_id AS bigint) AS n")
    paths = _new_paths(spark)
    stateful.history(events, paths, once=True).awaitTermination()
    told = spark.read.schema("counter string, as_of timestamp, points array<bigint>, total bigint, last bigint").parquet(paths.log("history"))
    last = upsert.latest_per_key(told, ["counter"], ["as_of"])
    return last.select("counter", _text("as_of"), F.array_join("points", ",").alias("points"), "total", "last")


# --- tables that cost what a batch or page touches ---------------------------------


@query
def link_tiers(spark, sf):
    return linkage.resolve_in_tiers(_keys(spark, sf), _candidate_table(spark, sf)).select("lookup_key", "stage", "catalog_id", "content_type")


@query
def first_nonempty_tiers(spark, sf):
    files = I.files(spark, sf)
    lists = [files.where(F.col("rank") == r).drop("rank") for r in range(3)]
    return routing.first_nonempty_in_tiers(files.select("key"), lists)


@query
def upsert_touched(spark, sf):
    """Outputs upserted in place, one batch twice, as after a crash."""
    path = f"{_new_paths(spark).root}/outputs"
    buckets.create(_outputs(spark, sf).where("cast(item_hash AS bigint) % 4 > 0"), path, "item_hash", 64)
    fold = lambda target, changes: upsert.upsert_outputs(target, changes, I.AS_OF)
    for _ in range(2):
        buckets.apply(_new_outputs(spark, sf), path, schemas.OUTPUTS, "item_hash", 64, 0, fold)
    return _state(buckets.read(spark, path, schemas.OUTPUTS))


@query
def stored_page(spark, sf):
    path = f"{_new_paths(spark).root}/order"
    pages.store_order(I.sources(spark, sf), ["name"], path, partition_rows=1000)
    return _state(pages.stored_page(spark, path, schemas.SOURCES, ["name"], 6, 200))


@query
def maintained_depths(spark, sf):
    """Source counts after inserts, a reset and marks, the marks applied twice; no count reads the table."""
    paths = _new_paths(spark)
    path, log, limit, n = f"{paths.root}/sources", paths.log("depths"), 2, 16
    old = F.length("name") % 2 == 0
    first = I.sources(spark, sf).where(old)
    buckets.create(first, path, "name", n)
    append_changes(depths.depth_changes(None, first, "sources", limit), log, 0)

    def batch(number, changes, fold):
        report = lambda before, after: append_changes(depths.depth_changes(before, after, "sources", limit), log, number)
        buckets.apply(changes, path, schemas.SOURCES, "name", n, number, fold, report)

    batch(1, I.sources(spark, sf).where(~old), lambda target, new: target.unionByName(new))
    batch(2, buckets.read(spark, path, schemas.SOURCES).select("name"), lambda target, _: queue.reset_attempts(target, "sources", I.AS_OF))
    claimed = _claimed(spark, sf)

    def marked(target, marks):
        return queue.apply_marks(target, "name", I.AS_OF, touched=marks, completed=marks.where("l_quantity > 25"), failed=marks.where("l_quantity <= 5"))

    for _ in range(2):
        batch(3, claimed, marked)
    return depths.depths(read_changes(spark, log, depths.DEPTH_LOG))


# --- the polled listing -----------------------------------------------------------


def _manifests(spark, sf):
    """The listing's entries as manifests of several polls."""
    folder = f"{_new_paths(spark).root}/manifests"
    entries = I.table(spark, sf, "pages").selectExpr(
        "CASE WHEN page_id % 50 = 0 THEN 'index.html' ELSE url END AS path",
        "CASE WHEN page_id % 5 = 1 THEN 'tree' ELSE 'blob' END AS type",
    )
    entries.repartition(4).write.parquet(folder)
    polled.register(spark)
    return folder


@query
def polled_listing(spark, sf):
    return document_names(spark.read.format(polled.NAME).load(_manifests(spark, sf)))


@query
def stream_polled_listing(spark, sf):
    """The listing as a stream of polls, one manifest a batch."""
    folder, paths = _manifests(spark, sf), _new_paths(spark)
    entries = spark.readStream.format(polled.NAME).option("per_batch", 1).load(folder)
    writer = document_names(entries).writeStream.format("parquet").option("path", paths.log("names"))
    polls = writer.option("checkpointLocation", paths.checkpoint("polled")).start()
    polls.processAllAvailable()
    polls.stop()
    return spark.read.schema("name string").parquet(paths.log("names"))
