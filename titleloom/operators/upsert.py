"""Keyed writes as DataFrame expressions: each returns the new state of a table.

Changes are reduced to one row per key with a map-side combine first, so a hot
key never travels whole. The join that follows has one row per key on both
sides. With both tables bucketed on the key, the join needs no shuffle of the
target (see ``sources.tables.write_bucketed``).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titleloom.functions.predicates import at


def new_queue_columns(as_of: datetime | str) -> dict[str, Column]:
    return {
        "completed": F.lit(False),
        "attempts": F.lit(0),
        "last_processed": at(as_of),
    }


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last row per key by ``order``; equal orders fall back to the payload, so the pick is fixed."""
    payload = [c for c in df.columns if c not in keys and c not in order]
    top = F.max(F.struct(*order, *payload)).alias("_top")
    return (
        df.groupBy(*keys)
        .agg(top)
        .select(*keys, *[F.col(f"_top.{c}").alias(c) for c in [*order, *payload]])
        .select(*df.columns)
    )


def insert_if_absent(
    target: DataFrame, new: DataFrame, key: str, defaults: Mapping[str, Column]
) -> DataFrame:
    """Rows of ``new`` whose key the target lacks, ready to append."""
    return (
        new.select(key)
        .where(F.col(key).isNotNull())
        .distinct()
        .join(target.select(key), key, "left_anti")
        .select(key, *[v.alias(n) for n, v in defaults.items()])
    )


def upsert(
    target: DataFrame,
    changes: DataFrame,
    keys: Sequence[str],
    payload: Sequence[str],
    defaults: Mapping[str, Column],
    nullable_keys: Sequence[str] = (),
    nulls_distinct: bool = False,
    order: Sequence[str] = (),
) -> DataFrame:
    """Replace ``payload`` where the key exists, insert with ``defaults`` where it does not.

    Changes may repeat a key: the last by ``order`` counts, of equals the greatest
    payload. Columns outside the payload keep the target's values: an updated row is not queued again.
    A NULL in a nullable key equals NULL, unless ``nulls_distinct``, which
    appends such rows instead.
    """
    if nulls_distinct and nullable_keys:
        null_key = reduce(lambda x, y: x | y, [F.col(k).isNull() for k in nullable_keys])
        kept = upsert(target, changes.where(~null_key), keys, payload, defaults, order=order)
        extra = changes.where(null_key).select(
            *keys, *payload, *[v.alias(n) for n, v in defaults.items()]
        )
        return kept.unionByName(extra)
    changes = latest_per_key(changes.select(*keys, *payload, *order), keys, order)
    # New columns get names of their own, so a target derived from the same rows is no riddle.
    old = target.withColumn("_old", F.lit(True))
    # The first key is written anew, so that Spark does not shuffle a bucketed target to the
    # partitions the reduced changes happen to have: the small side moves, the target stays.
    first = F.col(keys[0])
    moved = F.concat(first, F.lit("")) if dict(changes.dtypes)[keys[0]] == "string" else first
    new = changes.select(
        moved.alias(f"_new_{keys[0]}"),
        *[F.col(c).alias(f"_new_{c}") for c in [*keys[1:], *payload]],
        F.lit(True).alias("_new"),
    )
    same = [
        F.col(k).eqNullSafe(F.col(f"_new_{k}")) if k in nullable_keys else F.col(k) == F.col(f"_new_{k}")
        for k in keys
    ]
    joined = old.join(new, reduce(lambda x, y: x & y, same), "full_outer")
    hit_old, hit_new = F.col("_old").isNotNull(), F.col("_new").isNotNull()
    cells = {k: F.when(hit_old, F.col(k)).otherwise(F.col(f"_new_{k}")) for k in keys}
    cells |= {c: F.when(hit_new, F.col(f"_new_{c}")).otherwise(F.col(c)) for c in payload}
    cells |= {n: F.when(hit_old, F.col(n)).otherwise(v) for n, v in defaults.items()}
    return joined.select(*[cells[c].alias(c) for c in target.columns])


def upsert_items(items: DataFrame, rows: DataFrame, as_of: datetime | str) -> DataFrame:
    """``rows``: batch, source, pos, item_hash, filename, size_bytes. Later position wins."""
    return upsert(
        items,
        rows,
        ["item_hash"],
        ["filename", "size_bytes"],
        new_queue_columns(as_of),
        order=["batch", "source", "pos"],
    )


def upsert_parsed(parsed_items: DataFrame, rows: DataFrame, as_of: datetime | str) -> DataFrame:
    return upsert(
        parsed_items,
        rows,
        ["item_hash"],
        ["title", "year", "season", "episode"],
        new_queue_columns(as_of),
    )


def upsert_mappings(mappings: DataFrame, rows: DataFrame, as_of: datetime | str) -> DataFrame:
    return upsert(
        mappings, rows, ["item_hash"], ["catalog_id", "content_type"], new_queue_columns(as_of)
    )


def upsert_outputs(
    outputs: DataFrame, rows: DataFrame, as_of: datetime | str, nulls_distinct: bool = False
) -> DataFrame:
    """Key (item_hash, file_index) with a NULL index for singles; created_at survives updates.

    Of rows with one key the last by ``pos`` counts, where the rows carry that column.
    """
    return upsert(
        outputs,
        rows,
        ["item_hash", "file_index"],
        ["catalog_id", "output_type", "size_bytes", "season", "episode"],
        {"created_at": at(as_of)},
        nullable_keys=["file_index"],
        nulls_distinct=nulls_distinct,
        order=[c for c in ("pos",) if c in rows.columns],
    )
