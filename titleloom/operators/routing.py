"""Route linked items to singles and packs, and expand packs into files."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titleloom import fixed_values as V
from titleloom.functions import predicates as P
from titleloom.functions.names import with_file_episode
from titleloom.operators.queue import pending
from titleloom.session import cut_lineage

_OUTPUT = ["item_hash", "catalog_id", "output_type", "size_bytes", "file_index", "season", "episode"]


def _linked(mappings: DataFrame, items: DataFrame, parsed_items: DataFrame) -> DataFrame:
    # One row per hash on every side: no fan-out, no skew. Bucketed on the hash, no shuffle.
    return (
        mappings.select("item_hash", "catalog_id", "content_type", "last_processed")
        .join(items.select("item_hash", "size_bytes"), "item_hash")
        .join(parsed_items.select("item_hash", "season", "episode"), "item_hash")
    )


def singles(
    mappings: DataFrame,
    items: DataFrame,
    parsed_items: DataFrame,
    as_of: datetime | str,
    max_attempts: int = V.MAX_ATTEMPTS,
    cooldown_minutes: int = V.COOLDOWN_MINUTES,
) -> DataFrame:
    """Pending mappings that stand for one film or one episode."""
    ready = pending(mappings, as_of, max_attempts, cooldown_minutes)
    return _linked(ready, items, parsed_items).where(
        P.is_single(F.col("content_type"), F.col("season"), F.col("episode"))
    )


def packs(
    mappings: DataFrame,
    items: DataFrame,
    parsed_items: DataFrame,
    as_of: datetime | str,
    max_attempts: int = V.MAX_ATTEMPTS,
    cooldown_minutes: int = V.COOLDOWN_MINUTES,
) -> DataFrame:
    """Pending mappings that stand for a whole season."""
    ready = pending(mappings, as_of, max_attempts, cooldown_minutes)
    return (
        _linked(ready.where(F.col("content_type") == "series"), items, parsed_items)
        .where(P.is_pack(F.col("content_type"), F.col("season"), F.col("episode")))
        .select("item_hash", "catalog_id", "season", "size_bytes", "last_processed")
    )


def unrouted(mappings: DataFrame, parsed_items: DataFrame) -> DataFrame:
    """Mappings neither branch takes."""
    return (
        mappings.join(parsed_items.select("item_hash", "season", "episode"), "item_hash")
        .where(P.is_unrouted(F.col("content_type"), F.col("season"), F.col("episode")))
        .select("item_hash", "catalog_id", "content_type", "season", "episode")
    )


def emit_singles(routed: DataFrame) -> DataFrame:
    return routed.select(
        "item_hash",
        "catalog_id",
        F.col("content_type").alias("output_type"),
        "size_bytes",
        F.lit(None).cast("int").alias("file_index"),
        "season",
        "episode",
    )


def first_nonempty_source(
    lists: Sequence[DataFrame] | DataFrame, key: str = "key", rank: str = "rank"
) -> DataFrame:
    """Per key, the whole list of the first source that has any file. Lists never merge.

    The lowest rank per key is a plain aggregate with map-side combine, joined
    back on (key, rank): a key holding very many files is never sorted in one
    window, and the join streams the files, which AQE may split.
    """
    if isinstance(lists, DataFrame):
        files = lists
    else:
        ranked = [df.withColumn(rank, F.lit(i)) for i, df in enumerate(lists)]
        files = ranked[0]
        for df in ranked[1:]:
            files = files.unionByName(df)
    first = files.groupBy(key).agg(F.min(rank).alias(rank))
    return files.join(first, [key, rank])


def expand_packs(routed: DataFrame, files: DataFrame, strict: bool = False) -> DataFrame:
    """One output per media file of a pack, under the file's own episode or the pack's season.

    ``files`` comes from ``first_nonempty_source``. Files are filtered before
    the join, so only media rows are shuffled. A ``pos`` of the files (place in their
    list) stays with the rows; ``upsert_outputs`` goes by it where an index repeats.
    """
    media = files.where(P.media_file(F.col("path"), F.col("size"))).select(
        F.col("key").alias("item_hash"), "path", "size", "file_index", *[c for c in ("pos",) if c in files.columns]
    )
    joined = media.join(routed.select("item_hash", "catalog_id", "season"), "item_hash")
    named = with_file_episode(joined, "path", "season", "_fe", strict)
    own = F.col("_fe").isNotNull()
    return named.select(
        "item_hash",
        "catalog_id",
        F.lit("series").alias("output_type"),
        F.col("size").alias("size_bytes"),
        "file_index",
        F.when(own, F.col("_fe.season")).otherwise(F.col("season")).alias("season"),
        F.col("_fe.episode").alias("episode"),
        *[c for c in ("pos",) if c in files.columns],
    ).select(*_OUTPUT, *[c for c in ("pos",) if c in files.columns])


def pack_status(routed: DataFrame, files: DataFrame) -> DataFrame:
    """Per pack: outputs created, and whether it is done.

    No file list at all keeps the pack pending; a list without media completes
    it with zero outputs. File rows are counted per key before the join.
    """
    media = P.media_file(F.col("path"), F.col("size"))
    counts = files.groupBy(F.col("key").alias("item_hash")).agg(
        F.count_if(media).alias("_outputs")
    )
    return routed.select("item_hash").join(counts, "item_hash", "left").select(
        "item_hash",
        F.coalesce(F.col("_outputs"), F.lit(0)).alias("outputs"),
        F.col("_outputs").isNotNull().alias("completed"),
    )


def outputs_with_names(outputs: DataFrame, items: DataFrame) -> DataFrame:
    """Outputs with the item's name, or '' when the item is gone."""
    return outputs.join(items.select("item_hash", "filename"), "item_hash", "left").withColumn(
        "filename", F.coalesce(F.col("filename"), F.lit(""))
    )


def first_nonempty_in_tiers(keys: DataFrame, lists: Sequence[DataFrame], key: str = "key", seen: list[int] | None = None) -> DataFrame:
    """Per key of ``keys``, the whole list of the first source that has any file, with the source's ``rank``.

    A source is asked only for keys that all before it lacked. The open keys are a stored table, so that a
    large source is filtered while it is read. ``seen`` receives the files read per source.
    """
    open_, found = cut_lineage(keys.select(key).distinct()), []
    for rank, files in enumerate(lists):
        found.append(cut_lineage(files.join(open_, key, "left_semi").withColumn("rank", F.lit(rank))))
        if seen is not None:
            seen.append(found[-1].count())
        open_ = cut_lineage(open_.join(found[-1].select(key).distinct(), key, "left_anti"))
        if open_.isEmpty():
            break
    return reduce(DataFrame.unionByName, found)
