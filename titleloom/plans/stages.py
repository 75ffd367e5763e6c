"""The six table-to-table stages as batch plans.

A stage takes table states and returns new states (and reports). It does not
write: the caller stores the states it wants, see ``sources.tables``. Every
eligible row is processed; there is no batch limit, Spark's partitions are the
unit of work.

What a stage computes (decoded documents, parsed names, link results) is stored in the
shared folder once, and every state is folded from it. Stages also return
``counters``, the (ts, counter, n) rows of their run; ``counters.counter_totals`` adds them up.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titleloom import fixed_values as V
from titleloom.functions.names import with_parsed_name
from titleloom.operators import counters, linkage, queue, routing, upsert
from titleloom.session import cut_lineage
from titleloom.sources import documents as D
from titleloom.sources.listing import document_names


@dataclass(frozen=True)
class Retry:
    max_attempts: int = V.MAX_ATTEMPTS
    cooldown_minutes: int = V.COOLDOWN_MINUTES


def discover(listing: DataFrame, sources: DataFrame, as_of: datetime | str) -> DataFrame:
    """New source rows to append."""
    return upsert.insert_if_absent(
        sources, document_names(listing), "name", upsert.new_queue_columns(as_of)
    )


def extract(
    sources: DataFrame,
    documents: DataFrame,
    items: DataFrame,
    marker: str,
    as_of: datetime | str,
    batch: int = 0,
    retry: Retry = Retry(),
) -> dict[str, DataFrame]:
    """Pending sources to items. A failed document keeps its raised attempts and waits."""
    claimed = queue.pending(sources, as_of, retry.max_attempts, retry.cooldown_minutes)
    mine = documents.join(claimed.select(F.col("name").alias("source")), "source", "left_semi")
    read = cut_lineage(D.read_documents(mine, marker))
    rows = D.document_items(read).withColumn("batch", F.lit(batch))
    rows = rows.select("batch", "source", "pos", "item_hash", "filename", "size_bytes")
    good = read.where(F.col("error").isNull()).select(F.col("source").alias("name"))
    return {
        "items": upsert.upsert_items(items, rows, as_of),
        "sources": queue.apply_marks(sources, "name", as_of, touched=claimed, completed=good),
        "errors": D.document_errors(read),
        "counters": counters.stage_counters(
            read,
            as_of,
            documents_read=F.count_if(F.col("error").isNull()),
            documents_failed=F.count_if(F.col("error").isNotNull()),
            items_read=F.sum(F.when(F.col("entries").isNotNull(), F.size("entries"))),
        ),
    }


def parse_items(items: DataFrame) -> DataFrame:
    """Parsed columns beside the item hash; ``parsed`` is NULL for names without a title."""
    return with_parsed_name(items.select("item_hash", "filename"), "filename")


def parse(
    items: DataFrame, parsed_items: DataFrame, as_of: datetime | str, retry: Retry = Retry()
) -> dict[str, DataFrame]:
    """Pending items to parsed items. Unparseable ones are completed too, and reported."""
    claimed = queue.pending(items, as_of, retry.max_attempts, retry.cooldown_minutes)
    parsed = cut_lineage(parse_items(claimed))
    rows = parsed.where(F.col("parsed").isNotNull()).select(
        "item_hash", "parsed.title", "parsed.year", "parsed.season", "parsed.episode"
    )
    return {
        "parsed_items": upsert.upsert_parsed(parsed_items, rows, as_of),
        "items": queue.apply_marks(items, "item_hash", as_of, touched=claimed, completed=claimed),
        "unparsed": parsed.where(F.col("parsed").isNull()).select("item_hash", "filename"),
        "counters": counters.stage_counters(
            parsed,
            as_of,
            names_parsed=F.count_if(F.col("parsed").isNotNull()),
            names_unparsed=F.count_if(F.col("parsed").isNull()),
        ),
    }


def link(
    parsed_items: DataFrame,
    candidates: DataFrame,
    mappings: DataFrame,
    as_of: datetime | str,
    memo: DataFrame | None = None,
    retry: Retry = Retry(),
) -> dict[str, DataFrame]:
    """Pending parsed items to mappings. A failed link costs two attempts: the touch and the failure."""
    claimed = queue.pending(parsed_items, as_of, retry.max_attempts, retry.cooldown_minutes)
    results, fresh = linkage.link_items(claimed, candidates, memo, prune=True, keep=cut_lineage)
    results = cut_lineage(results)
    hit = results.where(F.col("catalog_id").isNotNull())
    miss = results.where(F.col("catalog_id").isNull())
    return {
        "mappings": upsert.upsert_mappings(
            mappings, hit.select("item_hash", "catalog_id", "content_type"), as_of
        ),
        "parsed_items": queue.apply_marks(
            parsed_items, "item_hash", as_of, touched=claimed, completed=hit, failed=miss
        ),
        "memo": fresh,
        "results": results,
        "counters": counters.stage_counters(
            results,
            as_of,
            links_found=F.count_if(F.col("catalog_id").isNotNull()),
            links_missed=F.count_if(F.col("catalog_id").isNull()),
        ),
    }


def route_singles(
    mappings: DataFrame,
    items: DataFrame,
    parsed_items: DataFrame,
    outputs: DataFrame,
    as_of: datetime | str,
    retry: Retry = Retry(),
) -> dict[str, DataFrame]:
    ready = routing.singles(
        mappings, items, parsed_items, as_of, retry.max_attempts, retry.cooldown_minutes
    )
    ready = cut_lineage(ready)
    return {
        "counters": counters.stage_counters(ready, as_of, singles_routed=F.count(F.lit(1))),
        "outputs": upsert.upsert_outputs(outputs, routing.emit_singles(ready), as_of),
        "mappings": queue.apply_marks(
            mappings, "item_hash", as_of, touched=ready, completed=ready
        ),
    }


def route_packs(
    mappings: DataFrame,
    items: DataFrame,
    parsed_items: DataFrame,
    outputs: DataFrame,
    files: DataFrame,
    as_of: datetime | str,
    retry: Retry = Retry(),
) -> dict[str, DataFrame]:
    """``files``: the winning file list per item, see ``routing.first_nonempty_source``."""
    ready = routing.packs(
        mappings, items, parsed_items, as_of, retry.max_attempts, retry.cooldown_minutes
    )
    ready = cut_lineage(ready)
    status = cut_lineage(routing.pack_status(ready, files))
    return {
        "counters": counters.stage_counters(
            status,
            as_of,
            pack_outputs=F.sum("outputs"),
            packs_done=F.count_if(F.col("completed")),
            packs_waiting=F.count_if(~F.col("completed")),
        ),
        "outputs": upsert.upsert_outputs(outputs, routing.expand_packs(ready, files), as_of),
        "mappings": queue.apply_marks(
            mappings,
            "item_hash",
            as_of,
            touched=ready,
            completed=status.where("completed"),
        ),
        "status": status,
    }
