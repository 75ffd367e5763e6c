"""The stages as Structured Streaming queries.

Stateless stages (extract, parse) write through Spark's file sink, which is
exactly-once by itself. Stages that look at other tables (discover, link,
route) use ``foreachBatch`` and append to change logs under the batch id, so a
replayed batch replaces its own rows and nothing else.

A batch is stored once before its results are taken from it. Its time is a column of the stream, set before ``foreachBatch``: the offset
log keeps it, so a replay writes the same times. Queue states are folded from
what the stages logged, by sums and maxima; a retry is a batch pass over the
rows that are due. Passes take negative ids, which keep clear of the stream's own, and a
repeated pass replaces its rows. ``sources.tables.compact`` bounds what a fold reads.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from titleloom import fixed_values as V
from titleloom import schemas
from titleloom.functions.names import with_parsed_name
from titleloom.functions.predicates import at, is_pack, is_single
from titleloom.operators import linkage, queue, routing, upsert
from titleloom.session import cut_lineage
from titleloom.sources import documents as D
from titleloom.sources.listing import document_names
from titleloom.sources.tables import append_changes, read_changes



DECODED, ITEM_ROWS, PARSED = schemas.DECODED, schemas.ITEM_ROWS, schemas.PARSED_LOG
MAPPED, MEMO, MARKS = schemas.MAPPED_LOG, schemas.MEMO, schemas.MARKS
OUTPUT_LOG = schemas.OUTPUT_LOG
TIME = "_batch_time"


@dataclass(frozen=True)
class Paths:
    """Folders of one deployment, on storage every executor can reach."""

    root: str

    def log(self, name: str) -> str:
        return f"{self.root}/logs/{name}"

    def checkpoint(self, name: str) -> str:
        return f"{self.root}/checkpoints/{name}"


def _start(df: DataFrame, paths: Paths, name: str, handler: Callable, once: bool) -> StreamingQuery:
    timed = df.withColumn(TIME, F.current_timestamp())
    writer = timed.writeStream.queryName(name).option("checkpointLocation", paths.checkpoint(name))
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.foreachBatch(handler).start()


def append_sink(df: DataFrame, paths: Paths, name: str, once: bool) -> StreamingQuery:
    writer = (
        df.writeStream.queryName(name)
        .format("parquet")
        .option("path", paths.log(name))
        .option("checkpointLocation", paths.checkpoint(name))
    )
    return (writer.trigger(availableNow=True) if once else writer).start()


def discover(listing: DataFrame, paths: Paths, once: bool = False) -> StreamingQuery:
    """Listing entries to new source names; a name already logged by an earlier batch is skipped."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch = cut_lineage(batch)
        known = read_changes(batch.sparkSession, paths.log("sources"), schemas.SOURCES)
        found = document_names(batch.drop(TIME)).distinct()
        new = found.where(F.col("name").isNotNull()).join(
            known.where(F.col("batch_id") < batch_id).select("name"), "name", "left_anti"
        )
        # One time per batch; a batch without new names has no row to take it from.
        time = batch.agg(F.max(TIME).alias("last_processed"))
        queued = new.join(F.broadcast(time), how="inner")
        columns = [v.alias(n) for n, v in upsert.new_queue_columns("1970-01-01").items() if n != "last_processed"]
        append_changes(queued.select("name", *columns, "last_processed"), paths.log("sources"), batch_id)

    return _start(listing, paths, "discover", handle, once)


def extract(documents: DataFrame, marker: str, paths: Paths, once: bool = False) -> StreamingQuery:
    """Documents to decoded documents, errors included. Items are an explode of this log."""
    decoded = D.read_documents(documents, marker).withColumn("ingested_at", F.current_timestamp())
    return append_sink(decoded, paths, "decoded", once)


def all_decoded(spark: SparkSession, paths: Paths) -> DataFrame:
    """Decoded documents of the stream and of the retry passes: one row per attempt."""
    # The file sink's folder appears with the first batch, as a log's does.
    try:
        first = spark.read.schema(DECODED).parquet(paths.log("decoded"))
    except Exception as problem:
        if "PATH_NOT_FOUND" not in str(problem):
            raise
        first = spark.createDataFrame([], DECODED)
    again = read_changes(spark, paths.log("decoded_retries"), DECODED).drop("batch_id")
    return first.unionByName(again)


def document_queue(decoded: DataFrame) -> DataFrame:
    """Queue triple per source, folded from the attempts in the decoded log."""
    return decoded.groupBy("source").agg(
        F.max(F.col("error").isNull()).alias("completed"),
        F.count(F.lit(1)).cast("int").alias("attempts"),
        F.max("ingested_at").alias("last_processed"),
    )


def retry_documents(
    documents: DataFrame,
    marker: str,
    paths: Paths,
    as_of: datetime | str,
    pass_id: int,
    max_attempts: int = V.MAX_ATTEMPTS,
    cooldown_minutes: int = V.COOLDOWN_MINUTES,
) -> None:
    """Decode failed documents again once they are past their cooldown. ``documents`` holds their present text."""
    spark = documents.sparkSession
    before = read_changes(spark, paths.log("decoded_retries"), DECODED).where(F.col("batch_id") != pass_id)
    first = spark.read.schema(DECODED).parquet(paths.log("decoded"))
    state = document_queue(first.unionByName(before.drop("batch_id")))
    due = queue.pending(state, as_of, max_attempts, cooldown_minutes).select("source")
    read = D.read_documents(documents.join(due, "source", "left_semi"), marker)
    again = read.withColumn("ingested_at", at(as_of)).select(*DECODED.fieldNames())
    append_changes(again, paths.log("decoded_retries"), pass_id)


def item_rows(decoded: DataFrame) -> DataFrame:
    """Item rows of a decoded log (batch or stream) with their order columns."""
    return D.explode_entries(decoded, "source", "ingested_at").select(
        F.col("ingested_at").alias("batch"), "source", "pos", "item_hash", "filename", "size_bytes"
    )


def parse(items: DataFrame, paths: Paths, once: bool = False) -> StreamingQuery:
    """Item rows to parsed rows; names without a title stay in the log with a NULL title."""
    parsed = with_parsed_name(items, "filename").select(
        "item_hash",
        "filename",
        "parsed.*",
        F.current_timestamp().alias("ingested_at"),
    )
    return append_sink(parsed, paths, "parsed", once)


def _log_links(
    parsed: DataFrame,
    candidates: DataFrame,
    memo: DataFrame | None,
    paths: Paths,
    batch_id: int,
    ts: Column,
) -> None:
    """Link parsed items; append memo rows, mappings and queue marks under the batch id.

    Looked-up keys go to the memo's log first and are read back from there, so the
    mappings and marks come from the same lookup, done once.
    """
    spark = parsed.sparkSession
    logged = f"{paths.log('memo')}/batch_id={int(batch_id)}"

    def keep(fresh: DataFrame) -> DataFrame:
        append_changes(fresh.withColumn("ts", ts), paths.log("memo"), batch_id)
        return spark.read.schema(MEMO).parquet(logged).drop("ts")

    results, _ = linkage.link_items(parsed, candidates, memo, prune=True, keep=keep)
    log_results(results, parsed.select("item_hash", "season", "episode"), paths, batch_id, ts)


def log_results(results: DataFrame, own: DataFrame, paths: Paths, batch_id: int, ts: Column) -> None:
    """Append the mappings and queue marks of link results under the batch id. ``own``: item_hash, season, episode."""
    hit = F.col("catalog_id").isNotNull()
    own = own.select("item_hash", "season", "episode")
    found = results.where(hit).join(own, "item_hash").withColumn("ts", ts)
    append_changes(found.select(*MAPPED.fieldNames()), paths.log("mappings"), batch_id)
    # The touch costs one attempt and a failed link another one.
    marks = results.select(
        "item_hash", F.when(hit, 1).otherwise(2).alias("cost"), hit.alias("done"), ts.alias("ts")
    )
    append_changes(marks, paths.log("link_marks"), batch_id)


def known_links(memo: DataFrame) -> DataFrame:
    """The memo folded to one row per key: a hit beats any miss, of hits the latest counts."""
    hit = F.col("catalog_id").isNotNull().alias("hit")
    return upsert.latest_per_key(memo.select("*", hit), ["lookup_key"], ["hit", "ts", "batch_id"]).drop("hit")


def link(parsed: DataFrame, candidates: DataFrame, paths: Paths, once: bool = False) -> StreamingQuery:
    """Parsed rows to mappings. ``candidates`` is a static table; a batch reads the lists of its own keys."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch = cut_lineage(batch)
        ready = upsert.latest_per_key(
            batch.where(F.col("title").isNotNull()).select(
                "item_hash", "ingested_at", TIME, "title", "year", "season", "episode"
            ),
            ["item_hash"],
            ["ingested_at", TIME],
        )
        memo = read_changes(batch.sparkSession, paths.log("memo"), MEMO)
        memo = known_links(memo.where(F.col("batch_id") != batch_id)).drop("batch_id", "ts")
        # The batch's one time, kept by the offset log.
        stamp = batch.agg(F.max(TIME)).first()[0]
        if stamp is not None:
            _log_links(ready.drop("ingested_at", TIME), candidates, memo, paths, batch_id, F.lit(stamp))

    return _start(parsed, paths, "link", handle, once)


def mappings(spark: SparkSession, paths: Paths) -> DataFrame:
    """Mapped items folded from their log: the latest link of an item counts."""
    log = read_changes(spark, paths.log("mappings"), MAPPED)
    return upsert.latest_per_key(log, ["item_hash"], ["ts", "batch_id"]).drop("batch_id", "ts")


def _fold(marks: DataFrame) -> DataFrame:
    return marks.groupBy("item_hash").agg(
        F.max("done").alias("completed"),
        F.sum("cost").cast("int").alias("attempts"),
        F.max("ts").alias("last_processed"),
    )


def fold_marks(marks: DataFrame) -> DataFrame:
    """For ``tables.compact``: marks of an item added up, so that adding later marks gives the same."""
    return marks.groupBy("item_hash").agg(
        F.sum("cost").cast("int").alias("cost"), F.max("done").alias("done"), F.max("ts").alias("ts"), F.max("batch_id").alias("batch_id")
    )


def link_queue(spark: SparkSession, paths: Paths) -> DataFrame:
    """Queue triple per item, folded from the marks: sums and maxima, so order does not matter."""
    return _fold(read_changes(spark, paths.log("link_marks"), MARKS))


def retry_links(
    parsed: DataFrame,
    candidates: DataFrame,
    paths: Paths,
    as_of: datetime | str,
    pass_id: int,
    max_attempts: int = V.MAX_ATTEMPTS,
    cooldown_minutes: int = V.COOLDOWN_MINUTES,
) -> None:
    """One retry pass over missed items that are past their cooldown.

    ``pass_id`` must be new (negative ids keep clear of the stream's own). A
    repeated pass with the same id replaces its rows, so attempts are counted
    once. Known misses are asked again: the memo is not consulted for them.
    """
    marks = read_changes(parsed.sparkSession, paths.log("link_marks"), MARKS)
    state = _fold(marks.where(F.col("batch_id") != pass_id))
    due = queue.pending(state, as_of, max_attempts, cooldown_minutes).select("item_hash")
    again = parsed.join(due, "item_hash", "left_semi")
    _log_links(again, candidates, None, paths, pass_id, at(as_of))


def _log_routes(
    mapped: DataFrame, items: DataFrame, files: DataFrame, paths: Paths, batch_id: int, ts: Column
) -> None:
    """Route mapped items, a stored table; append outputs and queue marks under the batch id.

    A pack without a file list costs an attempt and stays pending. An item that has not
    arrived yet stays pending without one. Mappings neither branch takes get no mark.
    """
    kind, season, episode = F.col("content_type"), F.col("season"), F.col("episode")
    single, pack = is_single(kind, season, episode), is_pack(kind, season, episode)
    # What the batch needs of items and files is read once; the bounds of its keys reach their scans, so
    # that of sorted tables only some row groups are read. Items are joined once, lists are taken for packs only.
    low, high = mapped.agg(F.min("item_hash"), F.max("item_hash")).first()
    sizes = items.where(F.col("item_hash").between(low, high)).select("item_hash", "size_bytes", F.lit(True).alias("_here"))
    joined = cut_lineage(mapped.where(single | pack).join(sizes, "item_hash", "left"))
    linked = joined.where("_here").drop("_here")
    packs = linked.where(pack)
    mine = packs.select(F.col("item_hash").alias("key")).distinct()
    files = cut_lineage(files.where(F.col("key").between(low, high)).join(mine, "key", "left_semi"))
    names = [c for c in OUTPUT_LOG.fieldNames() if c != "ts"]
    one = routing.emit_singles(linked.where(single)).withColumn("pos", F.lit(0))
    many = routing.expand_packs(packs, files)
    if "pos" not in many.columns:
        many = many.withColumn("pos", F.lit(0))
    rows = one.select(*names).unionByName(many.select(*names)).withColumn("ts", ts)
    append_changes(rows, paths.log("outputs"), batch_id)
    routed = linked.where(single).select("item_hash", F.lit(1).alias("cost"), F.lit(True).alias("done"))
    status = routing.pack_status(packs, files).select("item_hash", F.lit(1).alias("cost"), F.col("completed").alias("done"))
    waiting = joined.where("_here IS NULL").select("item_hash", F.lit(0).alias("cost"), F.lit(False).alias("done"))
    marks = routed.unionByName(status).unionByName(waiting).withColumn("ts", ts)
    append_changes(marks, paths.log("route_marks"), batch_id)


def route(
    mapped: DataFrame, items: DataFrame, files: DataFrame, paths: Paths, once: bool = False
) -> StreamingQuery:
    """Mapped rows to output rows, singles and packs in one pass per batch.

    ``items`` (item_hash, size_bytes) and ``files`` are static tables, read anew by every batch.
    What they lack is left to ``retry_routes``.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        # The batch's one time stays beside its rows, so that they are stored once.
        last = cut_lineage(upsert.latest_per_key(batch.drop("batch_id"), ["item_hash"], ["ts", TIME]).drop("ts"))
        stamp = last.agg(F.max(TIME)).first()[0]
        if stamp is not None:
            _log_routes(last.drop(TIME), items, files, paths, batch_id, F.lit(stamp))

    return _start(mapped, paths, "route", handle, once)


def route_queue(spark: SparkSession, paths: Paths) -> DataFrame:
    """Queue triple per mapped item, folded from the marks of routing."""
    return _fold(read_changes(spark, paths.log("route_marks"), MARKS))


def retry_routes(
    items: DataFrame,
    files: DataFrame,
    paths: Paths,
    as_of: datetime | str,
    pass_id: int,
    max_attempts: int = V.MAX_ATTEMPTS,
    cooldown_minutes: int = V.COOLDOWN_MINUTES,
) -> None:
    """Route mapped items again that wait for their file list or their item, past the cooldown."""
    spark = items.sparkSession
    marks = read_changes(spark, paths.log("route_marks"), MARKS)
    state = _fold(marks.where(F.col("batch_id") != pass_id))
    due = queue.pending(state, as_of, max_attempts, cooldown_minutes).select("item_hash")
    again = mappings(spark, paths).join(due, "item_hash", "left_semi")
    _log_routes(cut_lineage(again), items, files, paths, pass_id, at(as_of))


def outputs(spark: SparkSession, paths: Paths) -> DataFrame:
    """Output table folded from its log: the latest row wins per (item, file index), then the later file."""
    log = read_changes(spark, paths.log("outputs"), OUTPUT_LOG)
    last = upsert.latest_per_key(log, ["item_hash", "file_index"], ["ts", "batch_id", "pos"])
    return last.drop("batch_id", "pos", "ts")


def stream_log(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A log folder as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def stream_changes(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A change log folder (one sub-folder per batch) as a stream."""
    full = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])
    return spark.readStream.schema(full).option("basePath", path).parquet(path)
