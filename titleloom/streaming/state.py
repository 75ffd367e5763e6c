"""Stages whose memory lies in the state store: a batch touches the keys it holds, and no log is read back.

* ``due_items``: the retry queue, with a timer per waiting key instead of passes over the marks.
* ``link``: linking with a memo that keeps hits and forgets misses after a while.
* ``discover``: insert-if-absent over a stream of names.
* ``minute_history``: the last points of every counter, zeros for silence.

State is kept by the RocksDB provider, one version per batch in the query's checkpoint, so a restart or a lost executor
goes on from the last batch. The processors of the queue and the memo run once per bucket of keys (by hash) and batch, as each
call costs milliseconds: a batch reads and writes the buckets it hits. ``minute_history`` has a state per counter. What a hot key brings is
reduced in Catalyst first (marks and minutes are sums, names are dropped where they repeat).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from titleloom import fixed_values as V
from titleloom import schemas
from titleloom.operators import linkage
from titleloom.session import cut_lineage
from titleloom.sources.listing import document_names
from titleloom.sources.tables import append_changes
from titleloom.streaming.counters import minute_counters
from titleloom.streaming.stages import MAPPED, MEMO, Paths, append_sink, log_results, stream_changes

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MINUTE = 60_000
BUCKETS = 1 << 12  # keys of a state; fixed for the life of a checkpoint


def _started(writer: DataStreamWriter, once: bool, clock: bool) -> StreamingQuery:
    """With the clock's time a query always has a next batch, so that taking what is there once means one batch."""
    if once:
        writer = writer.trigger(once=True) if clock else writer.trigger(availableNow=True)
    return writer.start()


def _with_store(spark: SparkSession, start: Callable[[], StreamingQuery]) -> StreamingQuery:
    """Start a query with the RocksDB provider; the session's own choice stays as it was."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, PROVIDER)
    try:
        return start()
    finally:
        spark.conf.set(name, before)


def _held(batch: DataFrame, paths: Paths, name: str, batch_id: int) -> DataFrame:
    """The batch as a stored table; a replay writes it again."""
    path = f"{paths.log(name)}/batch_id={int(batch_id)}"
    batch.write.mode("overwrite").parquet(path)
    return batch.sparkSession.read.schema(batch.schema).parquet(path)


def _bucket(name: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(name), F.lit(buckets)).cast("int").alias("bucket")


# --- the retry queue ------------------------------------------------------------

_DUE = "item_hash string, attempts int, due_at bigint"


class RetryQueue(StatefulProcessor):
    """(completed, attempts, last_processed) per item of a bucket, and a timer for the first cooldown to end.

    Marks (cost, done, ts) raise the attempts, complete the item and restart its cooldown. An item
    without attempts is due at once; any other open one when its cooldown is over. What is due is claimed:
    the claim costs ``claim_cost`` attempts (0 where the work's own marks count the touch) and
    starts the cooldown anew, so work that never reports is handed out again.
    A completed or exhausted item is never due. A bucket costs a few calls of the store, whatever it holds.
    """

    def __init__(self, max_attempts: int, cooldown_minutes: int, claim_cost: int, event_time: bool) -> None:
        self.limit, self.cooldown, self.cost, self.event_time = max_attempts, cooldown_minutes * MINUTE, claim_cost, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.queue = handle.getValueState("queue", "items array<string>, completed array<boolean>, attempts array<int>, last array<bigint>, timer bigint")

    def _read(self) -> tuple[dict[str, list], int | None]:
        held = self.queue.get()
        return ({i: list(v) for i, *v in zip(*held[:4])}, held[4]) if held else ({}, None)

    def _keep(self, items: dict[str, list], timer: int | None) -> None:
        """Store the bucket; ``timer``: the one that is set."""
        ends = [last + self.cooldown for done, attempts, last in items.values() if not done and attempts < self.limit]
        first = min(ends, default=None)
        if first != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if first is not None:
                self.handle.registerTimer(first)
        done, attempts, last = map(list, zip(*items.values()))
        self.queue.update((list(items), done, attempts, last, first))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        items, timer = self._read()
        touched = {}
        for r in rows:
            own = touched[r.item_hash] = items.setdefault(r.item_hash, [False, 0, 0])
            own[:] = own[0] or r.done, own[1] + r.cost, max(own[2], r.at)
        claimed = []
        for item, own in touched.items():
            if not own[0] and own[1] == 0 < self.limit:
                own[1:] = self.cost, own[2] if self.event_time else timerValues.getCurrentProcessingTimeInMs()
                claimed.append(Row(item_hash=item, attempts=own[1], due_at=own[2]))
        self._keep(items, timer)
        yield from claimed

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        items, timer = self._read()
        now = timerValues.getCurrentWatermarkInMs() if self.event_time else timerValues.getCurrentProcessingTimeInMs()
        now = max(now, expiredTimerInfo.getExpiryTimeInMs())
        claimed = []
        for item, own in items.items():
            done, attempts, last = own
            if not done and attempts < self.limit and last + self.cooldown <= now:
                own[1:] = attempts + self.cost, now
                claimed.append(Row(item_hash=item, attempts=own[1], due_at=last + self.cooldown))
        # The store drops the timer that ran out by itself.
        self._keep(items, None if timer == expiredTimerInfo.getExpiryTimeInMs() else timer)
        yield from claimed

    def close(self) -> None:
        pass


def due_items(
    marks: DataFrame,
    max_attempts: int = V.MAX_ATTEMPTS,
    cooldown_minutes: int = V.COOLDOWN_MINUTES,
    claim_cost: int = 1,
    delay: str | None = None,
    buckets: int = BUCKETS,
) -> DataFrame:
    """A stream of marks (item_hash, cost, done, ts) to a stream of claims (item_hash, attempts, due_at).

    A new key enters with a mark of cost 0. With ``delay`` time is the marks' own (late by at most the delay),
    else the clock's; timers then also run out while no marks arrive.
    """
    slim = marks.select(_bucket("item_hash", buckets), "item_hash", "cost", "done", "ts", F.unix_millis("ts").alias("at"))
    if delay is not None:
        slim = slim.withWatermark("ts", delay)
    processor = RetryQueue(max_attempts, cooldown_minutes, claim_cost, delay is not None)
    mode = "ProcessingTime" if delay is None else "EventTime"
    due = slim.groupBy("bucket").transformWithState(processor, _DUE, "append", mode)
    return due.withColumn("due_at", F.timestamp_millis("due_at"))


def claims(marks: DataFrame, paths: Paths, once: bool = False, name: str = "claims", **queue: Any) -> StreamingQuery:
    """``due_items`` into a log, each claim once."""
    writer = due_items(marks, **queue).writeStream.queryName(name).format("parquet").option("path", paths.log(name))
    writer = writer.option("checkpointLocation", paths.checkpoint(name))
    return _with_store(marks.sparkSession, lambda: _started(writer, once, queue.get("delay") is None))


def relink(parsed: DataFrame, candidates: DataFrame, paths: Paths, once: bool = False, **queue: Any) -> StreamingQuery:
    """Missed items are linked again as they come due; the stage's own marks feed the queue.

    ``parsed`` is a static table, of which a batch reads the items that are due. Batches log under negative
    ids, which keep clear of the linking stream's.
    """
    spark = parsed.sparkSession
    marks = stream_changes(spark, paths.log("link_marks"), schemas.MARKS)
    timed = due_items(marks, claim_cost=0, **queue).withColumn("_now", F.current_timestamp())

    def handle(batch: DataFrame, batch_id: int) -> None:
        # The state's answers are stored once: a second reading would run the queue again.
        due = _held(batch, paths, "due", batch_id)
        stamp = due.agg(F.max("_now")).first()[0]
        if stamp is not None:
            again = cut_lineage(parsed.join(due.select("item_hash").distinct(), "item_hash", "left_semi"))
            keys, keyed = linkage.keys_of(again)
            found = _looked_up(keys, candidates, paths, -1 - batch_id, F.lit(stamp))
            log_results(linkage.fan_out(keyed, found), again, paths, -1 - batch_id, F.lit(stamp))

    writer = timed.writeStream.queryName("relink").option("checkpointLocation", paths.checkpoint("relink")).foreachBatch(handle)
    return _with_store(spark, lambda: _started(writer, once, queue.get("delay") is None))


# --- linking with a memo ------------------------------------------------------------

_ASKED = "lookup_key string, item_hash string, season int, episode int, known boolean, catalog_id string, content_type string"


class LinkMemo(StatefulProcessor):
    """What is known of the lookup keys of a bucket. A hit stays; a miss is forgotten ``keep`` milliseconds after it was told.

    A miss also leaves the store ``keep`` milliseconds after it came in, by the batch's time, when the bucket is next asked.
    """

    def __init__(self, keep: int) -> None:
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        names = "keys array<string>, ids array<string>, types array<string>, hits array<bigint>, misses array<bigint>, until array<bigint>"
        self.memo = handle.getValueState("memo", names)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        # Per lookup key: id, type and time of the hit, time of the miss and how long the store keeps it.
        now = timerValues.getCurrentProcessingTimeInMs()
        memo = {k: list(v) for k, *v in zip(*(self.memo.get() or [[]]))}
        asks, changed = [], False
        for own in memo.values():
            if own[4] is not None and own[4] <= now:
                own[3:], changed = (None, None), True
        for r in rows:
            if r.item_hash is not None:
                asks.append(r)
                continue
            own = memo.setdefault(r.lookup_key, [None] * 5)
            if r.catalog_id is not None:
                if own[2] is None or own[2] <= r.at:
                    own[:3], changed = (r.catalog_id, r.content_type, r.at), True
            elif own[3] is None or own[3] < r.at:
                own[3:], changed = (r.at, now + self.keep), True
        if changed:
            kept = {k: v for k, v in memo.items() if v[2] is not None or v[3] is not None}
            self.memo.update((list(kept), *map(list, zip(*kept.values())))) if kept else self.memo.clear()
        for r in asks:
            id_, type_, hit, miss, _ = memo.get(r.lookup_key, [None] * 5)
            known = hit is not None or miss is not None and r.at - miss <= self.keep
            yield Row(
                lookup_key=r.lookup_key, item_hash=r.item_hash, season=r.season, episode=r.episode,
                known=known, catalog_id=id_, content_type=type_,
            )

    def close(self) -> None:
        pass


def _looked_up(keys: DataFrame, candidates: DataFrame, paths: Paths, batch_id: int, ts: Column) -> DataFrame:
    """Look keys up, log the answers, and go on from the log."""
    fresh = linkage.resolve(keys, candidates, prune=True).select("lookup_key", "catalog_id", "content_type")
    append_changes(fresh.withColumn("ts", ts), paths.log("memo"), batch_id)
    logged = f"{paths.log('memo')}/batch_id={int(batch_id)}"
    return keys.sparkSession.read.schema(MEMO).parquet(logged).drop("ts")


def link(parsed: DataFrame, candidates: DataFrame, paths: Paths, miss_minutes: int, once: bool = False) -> StreamingQuery:
    """Parsed rows to mappings, through a memo in the state store.

    A batch looks up only keys that are unknown, or whose miss is older than ``miss_minutes``; it reads neither the
    memo's log nor candidates of other keys. Answers go to the memo's log, from where the stream takes them into the
    state with the next batch.
    """
    spark = parsed.sparkSession
    append_changes(spark.createDataFrame([], MEMO), paths.log("memo"), -(2**40))  # the folder has to exist
    none = F.lit(None).cast("string")
    asks = linkage.link_keys(parsed.where(F.col("title").isNotNull()))
    asks = asks.select("lookup_key", "item_hash", "season", "episode", none.alias("catalog_id"), none.alias("content_type"), F.unix_millis("ingested_at").alias("at"))
    told = stream_changes(spark, paths.log("memo"), MEMO)
    number = F.lit(None).cast("int")
    told = told.select("lookup_key", none.alias("item_hash"), number.alias("season"), number.alias("episode"), "catalog_id", "content_type", F.unix_millis("ts").alias("at"))
    known = asks.unionByName(told).withColumn("bucket", _bucket("lookup_key", BUCKETS)).groupBy("bucket").transformWithState(LinkMemo(miss_minutes * MINUTE), _ASKED, "append", "ProcessingTime")
    timed = known.withColumn("_now", F.current_timestamp())

    def handle(batch: DataFrame, batch_id: int) -> None:
        # The state's answers are stored once: three results are taken from them.
        asked = _held(batch, paths, "asked", batch_id)
        stamp = asked.agg(F.max("_now")).first()[0]
        if stamp is None:
            return
        open_ = asked.where(~F.col("known"))
        found = _looked_up(open_.select("lookup_key").distinct(), candidates, paths, batch_id, F.lit(stamp))
        answers = open_.drop("catalog_id", "content_type").join(found, "lookup_key").select(asked.columns).unionByName(asked.where("known"))
        hint = linkage.M.type_hint(F.col("season"), F.col("episode"))
        typed = F.when(F.col("catalog_id").isNotNull(), F.coalesce(hint, "content_type"))
        results = answers.select("item_hash", "catalog_id", typed.alias("content_type")).dropDuplicates(["item_hash"])
        log_results(results, asked.select("item_hash", "season", "episode").dropDuplicates(["item_hash"]), paths, batch_id, F.lit(stamp))

    writer = timed.writeStream.queryName("link-memo").option("checkpointLocation", paths.checkpoint("link-memo")).foreachBatch(handle)
    return _with_store(spark, lambda: _started(writer, once, clock=True))


# --- insert-if-absent --------------------------------------------------------------


def discover(listing: DataFrame, paths: Paths, once: bool = False) -> StreamingQuery:
    """New source names of a listing stream: the state holds one row per name, nothing else is looked at."""
    names = document_names(listing).where(F.col("name").isNotNull()).dropDuplicates(["name"])
    queued = names.select("name", F.lit(False).alias("completed"), F.lit(0).alias("attempts"), F.current_timestamp().alias("last_processed"))
    return _with_store(listing.sparkSession, lambda: append_sink(queued, paths, "names", once))


# --- live history -------------------------------------------------------------------

_HISTORY = "counter string, as_of bigint, points array<bigint>, total bigint, last bigint"


class MinuteRing(StatefulProcessor):
    """The last ``size`` closed minutes of a counter and its running total.

    A history is told when minutes close with events, and by a timer when they close without.
    """

    def __init__(self, size: int) -> None:
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ring = handle.getValueState("ring", "points array<bigint>, last bigint, total bigint")

    def _told(self, key: Any, added: dict[int, int], watermark: int) -> Row:
        """Move the ring's end to the last closed minute; minutes are counted from the epoch."""
        end = watermark // MINUTE - 1
        points, last, total = self.ring.get() if self.ring.exists() else ([0] * self.size, end, 0)
        end = max(end, last)
        moved = min(end - last, self.size)
        points = [*points, *[0] * moved][-self.size :]
        for minute, n in added.items():
            total += n
            if 0 <= end - minute < self.size:
                points[self.size - 1 - (end - minute)] += n
        self.ring.update((points, end, total))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((end + 2) * MINUTE)
        return Row(counter=key[0], as_of=end * MINUTE, points=points, total=total, last=points[-1])

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        added: dict[int, int] = {}
        for r in rows:
            added[r.at // MINUTE] = added.get(r.at // MINUTE, 0) + r.n
        yield self._told(key, added, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        yield self._told(key, {}, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def minute_history(events: DataFrame, delay: str = "10 minutes", size: int = V.HISTORY_MINUTES) -> DataFrame:
    """``ts, counter, n`` to the history of every counter at each batch that closes a minute.

    Minutes are summed and closed by ``minute_counters``; the processor sees one row per counter and minute.
    """
    closed = minute_counters(events, delay).select("counter", F.unix_millis("minute").alias("at"), "n")
    told = closed.groupBy("counter").transformWithState(MinuteRing(size), _HISTORY, "append", "EventTime")
    return told.withColumn("as_of", F.timestamp_millis("as_of"))


def history(events: DataFrame, paths: Paths, once: bool = False, delay: str = "10 minutes") -> StreamingQuery:
    """``minute_history`` into a log; a reader takes the latest row of a counter."""
    return _with_store(events.sparkSession, lambda: append_sink(minute_history(events, delay), paths, "history", once))
