"""Link names against a whole catalog table, exactly, without comparing all pairs.

The rule is the candidate rule: best similarity above the goal (ties to the
lower position), overridden by the first almost-similar name when the best one
is not almost similar, years within one of each other or unknown.

Three observations keep it scalable:

* Equal simplified names act alike, so the catalog is first reduced to its
  lowest position per (simplified name, year) and the queries to distinct
  (simplified name, year).
* "Almost similar" is prefix/suffix equality, and only the first such name is
  wanted. Prefixes and suffixes are equi-join keys and the wanted row is a
  minimum, so this half never enumerates pairs.
* Only the best similarity is wanted. Queries are matched in tiers of growing
  edit distance; a query that has a match in one tier is done, because later
  tiers hold only worse ones. Within a tier, a name split into d+1 pieces keeps
  at least one piece untouched by d edits, so pieces at their possible offsets
  are equi-join keys and no match is lost (partition-based edit-distance join:
  Li, Deng, Wang, Feng, VLDB 2011). The distance is checked inside the join
  and the pairs go straight into a combined maximum: pairs are never stored,
  shuffled or de-duplicated.

Years are part of the join key (a catalog row is filed under every year it may be
asked for), so blocks stay small. A hot piece is a hot join key; AQE splits it on either side.
Affixes and pieces are many times the tables they come from, which Spark does not see when it
plans; their joins ask for a merge, so that none of them is broadcast. Names are dealt over
tasks before they are cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titleloom import fixed_values as V
from titleloom.functions import matching as M
from titleloom.session import cut_lineage, spread

# Edit-distance share of the longer name per tier; the last one is the goal itself.
TIERS = (0.0, 0.08, 0.2, 1 - V.SIMILARITY_GOAL)
# Year cells: four times the year, so that the two special cells are no year's.
_ANY_YEAR, _NO_YEAR = 1, 2
# Names of one task, each of which becomes hundreds of affixes or pieces.
NAMES_OF_TASK = 2_000


def _cell(year: Column) -> Column:
    return year.cast("bigint") * 4


def reduce_catalog(catalog: DataFrame) -> DataFrame:
    """Lowest (pos, id) per simplified name and year cell.

    ``catalog``: pos, id, name, year. A row is filed under the years it agrees
    with, or under "unknown", and always under "any", which queries without a
    year look up. The catalog carries this fan-out because a query has far more
    pieces than a catalog name.
    """
    y = _cell(F.col("year"))
    special = [F.lit(c).cast("bigint") for c in (_NO_YEAR, _ANY_YEAR)]
    cells = F.when(y.isNull(), F.array(*special)).otherwise(F.array(y - 4, y, y + 4, special[1]))
    return (
        catalog.where(M.id_ok(F.col("id")))
        .select(
            M.simplify_name(F.col("name")).alias("c"),
            F.explode(cells).alias("cell"),
            "pos",
            "id",
        )
        .groupBy("c", "cell")
        .agg(F.min(F.struct("pos", "id")).alias("low"))
    )


def reduce_queries(queries: DataFrame) -> DataFrame:
    return queries.select(
        M.simplify_name(F.col("title")).alias("q"), F.col("year").alias("qy")
    ).distinct()


def _with_cells(queries: DataFrame) -> DataFrame:
    y = _cell(F.col("qy"))
    cells = F.when(y.isNull(), F.array(F.lit(_ANY_YEAR).cast("bigint"))).otherwise(
        F.array(y, F.lit(_NO_YEAR).cast("bigint"))
    )
    return queries.withColumn("cell", F.explode(cells))


def _affixes(text: Column) -> Column:
    """All prefixes and suffixes of a text with how they were cut; both contain '' and the text."""
    n = F.length(text)
    cuts = F.sequence(F.lit(0), n)
    heads = F.transform(cuts, lambda k: F.struct(F.lit("p").alias("side"), F.substring(text, F.lit(1), k).alias("part")))
    tails = F.transform(cuts, lambda k: F.struct(F.lit("s").alias("side"), F.substring(text, n - k + 1, k).alias("part")))
    return F.concat(heads, tails)


def first_almost_similar(queries: DataFrame, reduced: DataFrame) -> DataFrame:
    """Per query with an almost similar name: the lowest position of one, and the similarity of the
    closest one, as (q, qy, second, closest). Of two such names one begins or ends the other,
    so their distance is the difference of their lengths."""
    wanted = _with_cells(queries)
    # Catalog names that start or end with the query: affixes of catalog names,
    # reduced to one row each before they meet the queries.
    longer = (
        reduced.where(F.col("c") != "")
        .select("c", "cell", "low", F.inline(_affixes(F.col("c"))))
        .groupBy("part", "cell")
        .agg(F.min("low").alias("low"), F.min(F.length("c")).alias("n"))
        .withColumnRenamed("part", "q")
    )
    near = lambda short, long: (F.lit(1.0) - (long - short) / F.greatest(long, F.lit(1))).alias("near")
    by_catalog = wanted.join(longer.hint("merge"), ["q", "cell"]).select("q", "qy", "low", near(F.length("q"), F.col("n")))
    # Catalog names the query starts or ends with: affixes of queries, one row per
    # distinct affix on the catalog side. The empty affix finds names that simplify to
    # nothing, which are almost similar to everything.
    shorter = (
        wanted.select("q", "qy", "cell", F.explode(F.array_distinct(_affixes(F.col("q"))["part"])).alias("c"))
        .join(reduced.hint("merge"), ["c", "cell"])
        .select("q", "qy", "low", near(F.length("c"), F.length("q")))
    )
    return (
        by_catalog.unionByName(shorter)
        .groupBy("q", "qy")
        .agg(F.min("low").alias("second"), F.max("near").alias("closest"))
    )


def _allowed(longer: Column, share: float) -> Column:
    """Largest distance of a tier: below the goal strictly at the last one, inclusive before."""
    if share >= 1 - V.SIMILARITY_GOAL:
        # 1 - d/n > goal, in whole numbers: 5d < 2n for a goal of 0.6
        return F.greatest(F.ceil(longer * 2 / 5).cast("int") - 1, F.lit(0))
    return F.floor(longer * share + 1e-9).cast("int")


def _piece(n: Column, d: Column, i: Column) -> tuple[Column, Column]:
    """Start (1-based) and length of piece i (1..d+1) of a name of length n; the last pieces are longer."""
    base = F.floor(n / (d + 1)).cast("int")
    short = (d + 1) - n % (d + 1)
    extra = F.greatest(i - 1 - short, F.lit(0))
    return (i - 1) * base + extra + 1, base + F.when(i > short, 1).otherwise(0)


def _catalog_pieces(reduced: DataFrame, share: float) -> DataFrame:
    """Pieces of catalog names, for every distance a partner of some length would allow."""
    n = F.length("c")
    most = F.floor(n / (1 - share) + 1e-9).cast("int")
    distances = F.array_distinct(F.transform(F.sequence(n, most), lambda k: _allowed(k, share)))
    out = (
        reduced.where(F.col("c") != "")
        .withColumn("n", n)
        .withColumn("d", F.explode(distances))
        .where(F.col("n") > F.col("d"))
        .withColumn("i", F.explode(F.sequence(F.lit(1), F.col("d") + 1)))
    )
    start, size = _piece(F.col("n"), F.col("d"), F.col("i"))
    return out.withColumn("piece", F.substring(F.col("c"), start, size)).select(
        "c", F.col("cell").alias("_cell"), "low", F.col("d").alias("_d"), _piece_key()
    )


def _piece_key() -> Column:
    """One number for all a piece has to agree in, which sorts faster than its parts."""
    return F.xxhash64("cell", "n", "d", "i", "piece").alias("key")


def _query_pieces(queries: DataFrame, share: float) -> DataFrame:
    """Substrings of queries that could be piece i of a catalog name of length n."""
    m = F.length("q")
    fewest = F.ceil(m * (1 - share) - 1e-9).cast("int")
    most = F.floor(m / (1 - share) + 1e-9).cast("int")
    out = (
        _with_cells(queries.where(F.col("q") != ""))
        .withColumn("m", m)
        .withColumn("n", F.explode(F.sequence(F.greatest(fewest, F.lit(1)), most)))
        .withColumn("d", _allowed(F.greatest(F.col("m"), F.col("n")), share))
        .where((F.abs(F.col("m") - F.col("n")) <= F.col("d")) & (F.col("n") > F.col("d")))
        .withColumn("i", F.explode(F.sequence(F.lit(1), F.col("d") + 1)))
    )
    start, size = _piece(F.col("n"), F.col("d"), F.col("i"))
    gap = F.col("m") - F.col("n")
    left, right = F.col("i") - 1, F.col("d") + 1 - F.col("i")
    low = F.greatest(F.lit(1), start - left, start + gap - right)
    high = F.least(F.col("m") - size + 1, start + left, start + gap + right)
    return (
        out.withColumn("_lo", low)
        .withColumn("_hi", high)
        .withColumn("_size", size)
        .where(F.col("_lo") <= F.col("_hi"))
        .withColumn(
            "piece",
            F.explode(F.array_distinct(F.transform(
                F.sequence("_lo", "_hi"), lambda at: F.substring(F.col("q"), at, F.col("_size"))
            ))),
        )
        .select("q", "qy", "cell", "n", "d", _piece_key())
    )


def _best(pairs: DataFrame) -> DataFrame:
    """Best pair per query, combined before the shuffle. Expects q, qy, c, low, dist."""
    longer = F.greatest(F.length("q"), F.length("c"))
    sim = F.lit(1.0) - F.col("dist") / longer
    best = F.struct(
        sim.alias("sim"),
        (-F.col("low.pos")).alias("_order"),
        F.col("low.id").alias("id"),
        M.almost_similar_simple(F.col("q"), F.col("c")).alias("almost"),
    )
    return (
        pairs.where(sim > V.SIMILARITY_GOAL).groupBy("q", "qy").agg(F.max(best).alias("best"))
    )


def _tier(queries: DataFrame, reduced: DataFrame, share: float) -> DataFrame:
    if share == 0.0:
        same = _with_cells(queries.where(F.col("q") != "")).join(
            reduced.withColumnRenamed("cell", "_cell"),
            (F.col("q") == F.col("c")) & (F.col("cell") == F.col("_cell")),
        )
        return _best(same.withColumn("dist", F.lit(0)))
    pairs = _query_pieces(queries, share).join(_catalog_pieces(reduced, share).hint("merge"), "key")
    # Other pieces may have the same key; written as no equality, so that they do not become further join keys.
    same = (F.abs(F.col("cell") - F.col("_cell")) + F.abs(F.col("n") - F.length("c")) + F.abs(F.col("d") - F.col("_d"))) < 1
    # The threshold form of the distance gives up early and returns -1.
    checked = pairs.withColumn("dist", F.when(same, F.expr("levenshtein(q, c, d)")).otherwise(-1))
    return _best(checked.where(F.col("dist") >= 0))


def best_similar(queries: DataFrame, reduced: DataFrame, tiers=TIERS) -> DataFrame:
    """Best similarity above the goal per query, as (q, qy, best). Tier results are one row per query."""
    open_queries, found = queries, None
    for share in tiers:
        if share:
            open_queries = spread(cut_lineage(open_queries), NAMES_OF_TASK, "q")
        hit = _tier(open_queries, reduced, share)
        if share != tiers[-1]:
            hit = cut_lineage(hit)
            open_queries = open_queries.alias("o").join(
                hit.alias("h"),
                (F.col("o.q") == F.col("h.q")) & F.col("o.qy").eqNullSafe(F.col("h.qy")),
                "left_anti",
            )
        found = hit if found is None else found.unionByName(hit)
    return found


def link_catalog(queries: DataFrame, catalog: DataFrame, tiers=TIERS) -> DataFrame:
    """``queries`` (title, year, any other columns) with ``catalog_id``, NULL on a miss."""
    reduced = spread(cut_lineage(reduce_catalog(catalog)), NAMES_OF_TASK, "c")
    distinct = spread(cut_lineage(reduce_queries(queries)), NAMES_OF_TASK, "q")
    second = cut_lineage(first_almost_similar(distinct, reduced))
    # With an almost similar name none of which is above the goal, that name wins whatever else
    # is found: such queries need no search.
    decided = second.where(F.col("closest") <= V.SIMILARITY_GOAL).select(F.col("q").alias("_q"), F.col("qy").alias("_qy"))
    searched = distinct.join(decided, (F.col("q") == F.col("_q")) & F.col("qy").eqNullSafe(F.col("_qy")), "left_anti")
    best = best_similar(searched, reduced, tiers)
    second = second.drop("closest")
    merged = (
        best.withColumn("second", F.lit(None).cast(second.schema["second"].dataType))
        .unionByName(second.withColumn("best", F.lit(None).cast(best.schema["best"].dataType)))
        .groupBy("q", "qy")
        .agg(F.max("best").alias("best"), F.min("second").alias("second"))
    )
    override = F.col("best").isNotNull() & F.col("second").isNotNull() & ~F.col("best.almost")
    picked = merged.select(
        F.col("q").alias("_q"),
        F.col("qy").alias("_qy"),
        F.when(override, F.col("second.id"))
        .otherwise(F.coalesce("best.id", "second.id"))
        .alias("catalog_id"),
    )
    keyed = queries.withColumn("_key", M.simplify_name(F.col("title")))
    return keyed.join(
        picked, (F.col("_key") == F.col("_q")) & F.col("year").eqNullSafe(F.col("_qy")), "left"
    ).drop("_key", "_q", "_qy")


def year_similar_join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Join on keys with years within one of each other or unknown.

    The left side lists the years it accepts, so this stays a hash join; NULL
    years on either side take their own cell instead of a nested loop.
    Right columns keep their names; the right year is ``right_year``.
    """
    y = _cell(F.col("year"))
    none, any_year = (F.lit(c).cast("bigint") for c in (_NO_YEAR, _ANY_YEAR))
    accepted = F.when(y.isNull(), F.array(any_year)).otherwise(F.array(y - 4, y, y + 4, none))
    own = F.coalesce(_cell(F.col("right_year")), none)
    spread = right.withColumnRenamed("year", "right_year").withColumn(
        "_cell", F.explode(F.array(own, any_year))
    )
    return left.withColumn("_cell", F.explode(accepted)).join(spread, [*on, "_cell"]).drop("_cell")
