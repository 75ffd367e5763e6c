"""Link parsed names to catalog ids through candidate lists.

Candidates of a hot key may be very many, so nothing collects them: each pick is
three order statistics (best similarity, first almost-similar, first valid)
taken as min / max of structs, which Spark combines before the shuffle. The
candidate position is part of every struct, so ties always fall the same way.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from titleloom import fixed_values as V
from titleloom.functions import matching as M
from titleloom.session import cut_lineage

# Which search a candidate came from, and what stage of the cascade reads it.
PROVIDER_A = ["a_movie", "a_series"]
PROVIDER_B = ["b_year", "b_plain"]


def link_keys(parsed_items: DataFrame) -> DataFrame:
    """Items with their lookup title, hint and text key."""
    return (
        parsed_items.withColumn("lookup_title", F.lower("title"))
        .withColumn("hint", M.type_hint(F.col("season"), F.col("episode")))
        .withColumn("lookup_key", M.lookup_key(F.col("title"), F.col("year"), F.col("hint")))
    )


def unique_keys(keyed: DataFrame) -> DataFrame:
    """One row per lookup key. The title is a minimum only because titles may differ in outer blanks."""
    return keyed.groupBy("lookup_key").agg(
        F.min("lookup_title").alias("lookup_title"),
        F.first("year").alias("lookup_year"),
        F.first("hint").alias("hint"),
    )


def keys_of(parsed_items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row per lookup key, the items with their keys)."""
    keyed = link_keys(parsed_items)
    return unique_keys(keyed), keyed


def hashes_by_key(keyed: DataFrame) -> DataFrame:
    """Item hashes per lookup key, as one row per member with the group's size.

    The list itself is left unrolled: a hot key would not fit one row. Sizes
    come from a combined count, joined back.
    """
    sizes = keyed.groupBy("lookup_key").agg(F.count(F.lit(1)).alias("members"))
    return keyed.select("lookup_key", "item_hash").join(sizes, "lookup_key")


def _with_scores(df: DataFrame, title: Column, name: Column) -> DataFrame:
    out = df.withColumn("_q", M.simplify_name(title)).withColumn("_c", M.simplify_name(name))
    q, c = F.col("_q"), F.col("_c")
    return out.withColumn("_sim", M.similarity_of_simple(q, c)).withColumn(
        "_almost", M.almost_similar_simple(q, c)
    )


def _picks(ok: Column, prefix: str, last_resort: Column) -> list[Column]:
    """Aggregates for one candidate list under one admission rule."""
    cand = F.struct(F.col("id").alias("id"), F.col("qid").alias("qid"))
    best = F.struct(
        F.col("_sim"), (-F.col("pos")).alias("_order"), cand.alias("cand"), F.col("_almost")
    )
    first = F.struct(F.col("pos"), cand.alias("cand"))
    return [
        F.max(F.when(ok & (F.col("_sim") > V.SIMILARITY_GOAL), best)).alias(f"{prefix}best"),
        F.min(F.when(ok & F.col("_almost"), first)).alias(f"{prefix}second"),
        F.min(F.when(ok & last_resort, first)).alias(f"{prefix}first"),
    ]


def _choice(prefix: str) -> Column:
    """Second choice beats a best one that is not almost similar; then best, second, first."""
    best, second, first = (F.col(f"{prefix}{c}") for c in ("best", "second", "first"))
    override = best.isNotNull() & second.isNotNull() & ~best["_almost"]
    return F.when(override, second["cand"]).otherwise(
        F.coalesce(best["cand"], second["cand"], first["cand"])
    )


def pick_matches(candidates: DataFrame, by: list[str], last_resort: bool = False) -> DataFrame:
    """One chosen candidate per group ``by``, or NULL cells when none passes.

    Input: ``by`` columns, title, query_year, hint, and pos, id, name, year, qid.
    Provider A style has no hint (NULL) and no last resort.
    """
    ok = M.id_ok(F.col("id")) & M.year_similar(F.col("query_year"), F.col("year"))
    ok = ok & F.when(F.col("hint").isNull(), F.lit(True)).otherwise(
        M.type_allowed(F.col("hint"), F.col("qid"))
    )
    scored = _with_scores(candidates, F.col("title"), F.col("name"))
    picked = scored.groupBy(*by).agg(*_picks(ok, "_", F.lit(last_resort)))
    return picked.select(
        *by,
        _choice("_")["id"].alias("catalog_id"),
        F.when(_choice("_").isNotNull(), M.normalise_type(_choice("_")["qid"])).alias(
            "content_type"
        ),
    )


def resolve(keys: DataFrame, candidates: DataFrame, prune: bool = False) -> DataFrame:
    """Cascade over the candidate lists of each key; keys without a match stay, with NULLs.

    ``keys``: lookup_key, one row per key. ``candidates``: ``schemas.CANDIDATES``.
    Stages in order:
    0-1 provider A lists (series first under a series hint, type = the list's);
    2-3 provider B under the hint ("title year" only when there is a year);
    4-5 provider B without the hint, type forced to the hint.

    The key carries title, year and hint, so candidates are scored and combined
    where they lie; only one row per key and list is shuffled, and a key with
    very many candidates is no hot spot. ``prune`` drops candidates of other
    keys first, for small batches against a large candidate table.
    """
    if prune:
        candidates = candidates.join(keys.select("lookup_key"), "lookup_key", "left_semi")
    return _with_winners(keys, _staged(candidates))


def _staged(candidates: DataFrame) -> DataFrame:
    """lookup_key, stage, catalog_id, content_type: what each candidate list offers at its stages, NULL ids where nothing fits."""
    title, key_year, key_hint = M.key_parts(F.col("lookup_key"))
    year, hint = F.col("_year"), F.col("hint")
    parts = (
        candidates.withColumn("_title", title)
        .withColumn("_year", key_year)
        .withColumn("hint", key_hint)
    )
    scored = _with_scores(parts, F.col("_title"), F.col("name"))
    base = M.id_ok(F.col("id")) & M.year_similar(year, F.col("year"))
    is_b = F.col("list").isin(PROVIDER_B)
    usable = F.col("list").isin(PROVIDER_A) | (F.col("list") == "b_plain") | (
        (F.col("list") == "b_year") & year.isNotNull()
    )
    typed = base & (
        ~is_b | hint.isNull() | F.coalesce(M.type_allowed(hint, F.col("qid")), F.lit(True))
    )
    picked = scored.where(usable).groupBy("lookup_key", "list", "hint").agg(
        *_picks(typed, "t_", is_b),
        *_picks(base & is_b & hint.isNotNull(), "u_", is_b),
    )
    lst = F.col("list")
    series_first = F.coalesce(hint == "series", F.lit(False))
    a_stage = F.when((lst == "a_series") == series_first, 0).otherwise(1)
    is_a = lst.isin(PROVIDER_A)
    b_stage = F.when(lst == "b_year", 2).otherwise(3)
    typed_pick = F.struct(
        F.when(is_a, a_stage).otherwise(b_stage).alias("stage"),
        _choice("t_")["id"].alias("catalog_id"),
        F.when(lst == "a_series", "series")
        .when(lst == "a_movie", "movie")
        .otherwise(M.normalise_type(_choice("t_")["qid"]))
        .alias("content_type"),
    )
    untyped_pick = F.struct(
        (b_stage + 2).alias("stage"),
        _choice("u_")["id"].alias("catalog_id"),
        hint.alias("content_type"),
    )
    return picked.select("lookup_key", F.inline(F.array(typed_pick, untyped_pick)))


def _with_winners(keys: DataFrame, staged: DataFrame) -> DataFrame:
    """The keys with the offer of the lowest stage."""
    won = (
        staged.where(F.col("catalog_id").isNotNull())
        .groupBy("lookup_key")
        .agg(F.min(F.struct("stage", "catalog_id", "content_type")).alias("w"))
        .select("lookup_key", "w.*")
    )
    return keys.join(won, "lookup_key", "left").select(
        *keys.columns, "stage", "catalog_id", "content_type"
    )


def resolve_in_tiers(keys: DataFrame, candidates: DataFrame, seen: list[int] | None = None) -> DataFrame:
    """The results of ``resolve``, asking one list after the other and only for keys still without a match.

    Each of the four lists is read for the open keys alone: the open keys are a small stored table, so its join
    turns into a broadcast or a run-time filter on the candidates' scan, and candidates stored by list are
    pruned to their folder. Offers under a dropped hint come from the same scans and wait until all
    lists were asked. Pays off where most keys end early and candidates are many; ``resolve`` reads them in one pass.
    ``seen`` receives the number of candidates scored per list.
    """
    series = F.coalesce(M.key_parts(F.col("lookup_key"))[2] == "series", F.lit(False))
    is_a = F.col("list").isin(PROVIDER_A)
    preferred = (F.col("list") == "a_series") == series
    tiers = [is_a & preferred, is_a & ~preferred, F.col("list") == "b_year", F.col("list") == "b_plain"]
    open_ = cut_lineage(keys.select("lookup_key"))
    offers = []
    for stage, mine in enumerate(tiers):
        here = candidates.where(mine).join(open_, "lookup_key", "left_semi")
        counted = Observation()
        offers.append(cut_lineage(_staged(here.observe(counted, F.count(F.lit(1)).alias("n")))))
        if seen is not None:
            seen.append(counted.get["n"])
        closed = offers[-1].where((F.col("stage") == stage) & F.col("catalog_id").isNotNull())
        open_ = cut_lineage(open_.join(closed.select("lookup_key"), "lookup_key", "left_anti"))
        if open_.isEmpty():
            break
    return _with_winners(keys, reduce(DataFrame.unionByName, offers))


def fan_out(keyed: DataFrame, resolved: DataFrame) -> DataFrame:
    """Every item gets its key's result; the hint, if any, decides the type. Misses stay as NULLs.

    A title shared by a third of all items is one hot join key on the item
    side; the other side is one row per key, so AQE splits the hot partition.
    """
    won = resolved.select("lookup_key", "catalog_id", F.col("content_type").alias("_found"))
    return keyed.join(won, "lookup_key", "left").select(
        "item_hash",
        "lookup_key",
        "catalog_id",
        F.when(F.col("catalog_id").isNotNull(), F.coalesce(F.col("hint"), F.col("_found"))).alias(
            "content_type"
        ),
    )


def link_items(
    parsed_items: DataFrame,
    candidates: DataFrame,
    memo: DataFrame | None = None,
    prune: bool = False,
    keep: Callable[[DataFrame], DataFrame] = lambda fresh: fresh,
) -> tuple[DataFrame, DataFrame]:
    """(item results incl. misses, new memo rows). Memo hits and memo misses are not looked up again.

    ``keep`` stores the looked-up keys (one row each), so that both results come from one lookup.
    """
    keyed = link_keys(parsed_items)
    keys = unique_keys(keyed)
    if memo is None:
        fresh = keep(resolve(keys, candidates, prune).select("lookup_key", "catalog_id", "content_type"))
        return fan_out(keyed, fresh), fresh
    known = memo.select("lookup_key", "catalog_id", "content_type")
    todo = keys.join(known.select("lookup_key"), "lookup_key", "left_anti")
    fresh = keep(resolve(todo, candidates, prune).select("lookup_key", "catalog_id", "content_type"))
    return fan_out(keyed, fresh.unionByName(known)), fresh
