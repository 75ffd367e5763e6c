"""Retry queue carried by every stage table: (completed, attempts, last_processed)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titleloom import fixed_values as V
from titleloom.functions.predicates import at, eligible, is_pack


def pending(
    table: DataFrame,
    as_of: datetime | str,
    max_attempts: int = V.MAX_ATTEMPTS,
    cooldown_minutes: int = V.COOLDOWN_MINUTES,
) -> DataFrame:
    """Every eligible row. A Spark batch takes them all; ``pending_batch`` cuts at n."""
    return table.where(eligible(as_of, max_attempts, cooldown_minutes))


def pending_batch(
    table: DataFrame,
    key: str,
    limit: int,
    as_of: datetime | str,
    max_attempts: int = V.MAX_ATTEMPTS,
    cooldown_minutes: int = V.COOLDOWN_MINUTES,
) -> DataFrame:
    """Oldest ``limit`` eligible rows; the key breaks ties. Plans as a top-k, not a sort."""
    return (
        pending(table, as_of, max_attempts, cooldown_minutes)
        .orderBy(F.col("last_processed").asc(), F.col(key).asc())
        .limit(limit)
    )


def apply_marks(
    table: DataFrame,
    key: str,
    as_of: datetime | str,
    touched: DataFrame | None = None,
    completed: DataFrame | None = None,
    failed: DataFrame | None = None,
    touch_cost: int = 1,
    failure_cost: int = 1,
) -> DataFrame:
    """Touch, complete and fail keys in one pass over the table.

    Each argument holds keys, any number of times. One aggregate with map-side
    combine reduces all of them to one row per key, and one join applies them.
    """
    given = {"_touched": touched, "_failed": failed, "_done": completed}
    marks = None
    for name, keys in given.items():
        if keys is None:
            continue
        part = keys.select(key, *[F.lit(name == n).alias(n) for n in given])
        marks = part if marks is None else marks.unionByName(part)
    cost = F.when(F.max("_touched"), touch_cost).otherwise(0) + F.when(
        F.max("_failed"), failure_cost
    ).otherwise(0)
    marks = marks.groupBy(key).agg(cost.cast("int").alias("_cost"), F.max("_done").alias("_done"))
    hit = F.col("_cost").isNotNull()
    out = table.join(marks, key, "left")
    new: dict[str, Column] = {
        "completed": F.col("completed") | F.coalesce(F.col("_done"), F.lit(False)),
        "attempts": F.col("attempts") + F.coalesce(F.col("_cost"), F.lit(0)),
        "last_processed": F.when(hit, at(as_of)).otherwise(F.col("last_processed")),
    }
    return out.select(*[new[c].alias(c) if c in new else F.col(c) for c in table.columns])


def touch(table: DataFrame, claimed: DataFrame, key: str, as_of: datetime | str) -> DataFrame:
    """Before work: attempts + 1 and a new timestamp."""
    return apply_marks(table, key, as_of, touched=claimed)


def complete(table: DataFrame, done: DataFrame, key: str, as_of: datetime | str) -> DataFrame:
    return apply_marks(table, key, as_of, completed=done)


def mark_failure(
    table: DataFrame, failed: DataFrame, key: str, as_of: datetime | str, failure_cost: int = 1
) -> DataFrame:
    """After a failed link: attempts again, on top of the touch (two per failed try by default)."""
    return apply_marks(table, key, as_of, failed=failed, failure_cost=failure_cost)


def _resettable() -> Column:
    return ~F.col("completed") & (F.col("attempts") > 0)


def reset_attempts(table: DataFrame, name: str, as_of: datetime | str) -> DataFrame:
    """Attempts back to 0 where not completed; tables off the list stay as they are."""
    if name not in V.RESETTABLE:
        return table
    hit = _resettable()
    new = {
        "attempts": F.when(hit, F.lit(0)).otherwise(F.col("attempts")),
        "last_processed": F.when(hit, at(as_of)).otherwise(F.col("last_processed")),
    }
    return table.select(*[new[c].alias(c) if c in new else F.col(c) for c in table.columns])


def count_resettable(table: DataFrame, name: str) -> DataFrame:
    """How many rows ``reset_attempts`` changes (0 for tables off the list)."""
    hit = _resettable() if name in V.RESETTABLE else F.lit(False)
    return table.agg(F.count_if(hit).alias("changed"))


def _depths(done: Column, attempts: Column, limit: int, member: Column) -> list[Column]:
    return [
        F.count_if(member & done),
        F.count_if(member & ~done & (attempts < limit)),
        F.count_if(member & ~done & (attempts >= limit)),
    ]


def queue_depths(
    sources: DataFrame,
    items: DataFrame,
    parsed_items: DataFrame,
    mappings: DataFrame,
    max_attempts: dict[str, int] | None = None,
    singles_exhausted: bool = False,
) -> DataFrame:
    """completed / unresolved / exhausted per stage, one scan per table.

    The mapping stages share one left join with the parsed items. As in the
    original counts, singles ignore the season, the link row uses the singles
    limit, and exhausted singles read 0 unless ``singles_exhausted``.
    """
    limits = {s: V.MAX_ATTEMPTS for s in ("extract", "parse", "link", "singles", "packs")}
    limits.update(max_attempts or {})
    yes = F.lit(True)

    def row(table: DataFrame, stages: dict[str, list[Column]]) -> DataFrame:
        flat = [
            c.alias(f"{stage}{i}") for stage, cells in stages.items() for i, c in enumerate(cells)
        ]
        wide = ", ".join(f"'{s}', {s}0, {s}1, {s}2" for s in stages)
        return table.agg(*flat).selectExpr(
            f"stack({len(stages)}, {wide}) AS (stage, completed, unresolved, exhausted)"
        )

    def simple(table: DataFrame, stage: str, limit: int) -> DataFrame:
        cells = _depths(F.col("completed"), F.col("attempts"), limit, yes)
        return row(table, {stage: cells})

    joined = mappings.select("item_hash", "content_type", "completed", "attempts").join(
        parsed_items.select("item_hash", "season", "episode", F.lit(True).alias("_p")),
        "item_hash",
        "left",
    )
    known = F.col("_p").isNotNull()
    done, tries = F.col("completed"), F.col("attempts")
    single = known & (
        (F.col("content_type") == "movie")
        | ((F.col("content_type") == "series") & F.col("episode").isNotNull())
    )
    pack = known & is_pack(F.col("content_type"), F.col("season"), F.col("episode"))
    singles = _depths(done, tries, limits["singles"], single)
    if not singles_exhausted:
        singles[2] = F.count_if(F.lit(False))
    mapped = row(
        joined,
        {
            "links": _depths(done, tries, limits["singles"], yes),
            "singles": singles,
            "packs": _depths(done, tries, limits["packs"], pack),
        },
    )
    return (
        simple(sources, "sources", limits["extract"])
        .unionByName(simple(items, "items", limits["parse"]))
        .unionByName(simple(parsed_items, "parsed_items", limits["link"]))
        .unionByName(mapped)
    )
