"""Mixing sources to target weights.

One aggregate gives the words per source. Sources in code-point order (NULL
last) weigh 5, 2, 1, repeating, and share all words; no target exceeds a stated
multiple of its source, and what is cut off goes to the others by weight until none is
above. The repetition rate of a source is target / size: each document is taken
floor(rate) times, and once more if a uniform number hashed from its id and size
lies below the fraction.

The table of sources has one row per source and is the only thing a window
without partitions sees. It is broadcast after its size was checked, and joined by
shuffle beyond that; a hot source is then split by AQE. Built-in functions only.

Defined cases: NULL text has size 0; the NULL source is a source of its own; a source
without words has target 0 and rate 0; equal rows are drawn alike; an empty table
gives an empty result. Input columns named like an added one are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from titleloom.llm.common import SPACED_WORD, kept_names, packed, store, text_of, unpacked

WEIGHTS = (5, 2, 1)
MOST = 3
SEED = 17
SMALL_BYTES = 8 << 20  # a table of sources up to this size is broadcast
ADDED = ("size", "source_size", "target", "copies", "taken")


def words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(SPACED_WORD)).cast("long")


def uniform(doc_id: Column, size: Column, seed: int) -> Column:
    """52 hash bits as a number in [0, 1)."""
    text = F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), size.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def targets(per_source: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target, from one row per source.

    Filling by weight up to caps: with sources by cap / weight, the level at a source
    is what is left of the total after all caps before it, over the weights from it on. The
    first source whose cap exceeds its level has the highest level of that kind.
    """
    everywhere = Window.partitionBy()
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((turn - 1) % len(weights) + 1).cast("int"))
    sources = per_source.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("source_size").over(everywhere) - before
    ahead = F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    sources = sources.withColumn("level", left.cast("double") / ahead.cast("double"))
    open_level = F.when(F.col("cap") > F.col("level") * F.col("weight"), F.col("level"))
    sources = sources.withColumn("level", F.max(open_level).over(everywhere))
    full = F.col("cap").cast("double")
    target = F.least(full, F.coalesce(F.col("level") * F.col("weight"), full))
    return sources.select("source", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST,
    seed: int = SEED,
    small_bytes: int = SMALL_BYTES,
) -> DataFrame:
    """The documents with size, source_size, target, copies and taken (size times copies)."""
    names = kept_names(docs, *ADDED)
    rows = docs.select(packed(docs, *ADDED).alias("row"), F.col("source"), F.col("doc_id").alias("id"), words(text_of()).alias("size"))
    per_source = docs.select("source", words(text_of()).alias("size")).groupBy("source").agg(F.sum("size").alias("source_size"))
    table = store(targets(per_source, weights, most), "mix-targets")
    held = table.agg(F.sum(F.coalesce(F.octet_length("source"), F.lit(0)) + 64)).first()[0] or 0
    table = table.withColumnRenamed("source", "of_source")
    if held <= small_bytes:
        table = F.broadcast(table)
    joined = rows.join(table, F.col("source").eqNullSafe(F.col("of_source")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(rate)
    extra = uniform(F.col("id"), F.col("size"), seed) < rate - whole
    joined = joined.withColumn("copies", (whole + extra.cast("long")).cast("long"))
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return unpacked(joined, names, F.col("size"), F.col("source_size"), F.col("target"), F.col("copies"), taken)


def emit(mixed: DataFrame) -> DataFrame:
    """Each document as often as it was drawn, without the added columns."""
    names = kept_names(mixed, *ADDED)
    copies = F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("_copy")
    row = packed(mixed, *ADDED).alias("row")
    return unpacked(mixed.select(row, copies), names)
