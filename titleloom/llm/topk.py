"""Exact top-k by inner product over norm-sorted, rotated vectors.

Components become integers, floor(scale * x). A rotation (the eigenvectors of the
vectors' second-moment matrix, which are the right singular vectors of the table)
puts most of a vector's length into its first coordinates. Vectors are dealt by
descending length into blocks. A query meets the block of the longest
vectors first, which gives it a threshold; it then meets only blocks whose longest
vector could still reach the threshold (Cauchy-Schwarz), and inside a block a partial sum over the first
rotated coordinates plus the product of the residual lengths bounds each score. What a
bound does not rule out is scored exactly with the integers, so the result does not depend
on rounding: bounds carry a margin and ties are kept.

Queries travel in blocks to the candidate blocks they need; nothing is broadcast
but the rotation (dimension squared). The second-moment matrix is summed per
partition. The best of a query are reduced in each pair of blocks before they are ranked.

Defined cases: a vector that is NULL or holds a NULL or non-finite component takes no part, nor does a
row without id. Vectors of unequal dimension are compared as if the shorter ended in
zeros; an empty vector scores 0 everywhere. Rows that repeat a query's id are that
query's own and no candidates of it; a repeated query counts once, by its largest vector in
array order; repeated candidates each count. Components and scores beyond the
range of a long stand at its limits. An empty table, or one without queries, gives an empty result.
Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from titleloom.llm.common import store

SCALE = 1024
K = 10
QUERY_EVERY = 100
BLOCK = 4096  # candidate vectors of one block
QUERIES = 1024  # queries of one block
SAMPLE = 100_000  # vectors the rotation is fitted on, about
MOST_BLOCKS = 1_000_000  # block lengths carried by tasks, 8 bytes each


def integers(embedding: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component as longs; NULL if the vector takes no part."""
    doubles = F.transform(embedding, lambda x: x.cast("double"))
    bad = F.exists(doubles, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    scaled = F.transform(doubles, lambda x: F.floor(x * scale))
    return F.when(~bad, scaled)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, padded with zeros to the common width."""
    flat = np.asarray(column.flatten()).astype(np.int64)
    length = np.diff(np.asarray(column.offsets))
    if (length == width).all():
        return flat.reshape(len(length), width)
    out = np.zeros((len(length), width), np.int64)
    out[np.arange(width)[None, :] < length[:, None]] = flat
    return out


def rotation(vectors: DataFrame, width: int, parts: int = 8) -> np.ndarray:
    """Eigenvectors of the second-moment matrix, largest first; width squared numbers reach the driver, ``parts`` times as many are summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            m = matrix(batch.column("v"), width).astype(np.float64)
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width)), pa.array(total.reshape(-1))], ["at", "x"])

    sums = vectors.select("v").coalesce(parts).mapInArrow(run, "at bigint, x double").groupBy("at").agg(F.sum("x").alias("x"))
    held = sums.toArrow()
    total = np.zeros(width * width)
    total[np.asarray(held.column("at"))] = np.asarray(held.column("x"))
    _, axes = np.linalg.eigh(total.reshape(width, width))
    return np.ascontiguousarray(axes[:, ::-1])


def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of the rows of a with the rows of b."""
    reach = _largest(a) * _largest(b) * max(1, a.shape[1])
    if reach < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if reach < 2**62:
        return a @ b.T
    exact = a.astype(object) @ b.T.astype(object)
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def _largest(m: np.ndarray) -> float:
    return float(np.abs(m.astype(np.float64)).max(initial=0))


class Block:
    """Candidates of one block with their rotated coordinates, longest first."""

    def __init__(self, ids: np.ndarray, ints: np.ndarray, axes: np.ndarray) -> None:
        self.ids, self.ints = ids, ints
        self.turned = ints.astype(np.float64) @ axes
        self.norm = np.sqrt((self.turned**2).sum(axis=1))

    def residual(self, first: int) -> np.ndarray:
        return np.sqrt((self.turned[:, first:] ** 2).sum(axis=1))


def best(block: Block, ids: np.ndarray, ints: np.ndarray, axes: np.ndarray, floor: np.ndarray, k: int, steps: tuple[int, ...]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, ids, scores) of the k best of a block that reach the query's floor, ties to the smaller id."""
    turned = ints.astype(np.float64) @ axes
    norm = np.sqrt((turned**2).sum(axis=1))
    slack = 1e-9 * (norm[:, None] * block.norm[None, :] + 1)
    alive = (norm[:, None] * block.norm[None, :] + slack) >= floor[:, None]
    for first in steps:
        if not alive.any():
            return
        rows, columns = np.flatnonzero(alive.any(axis=1)), np.flatnonzero(alive.any(axis=0))
        partial = turned[rows, :first] @ block.turned[columns, :first].T
        rest = np.sqrt((turned[rows, first:] ** 2).sum(axis=1))[:, None] * block.residual(first)[columns][None, :]
        box = np.ix_(rows, columns)
        alive[box] &= partial + rest + slack[box] >= floor[rows, None]
    rows, columns = np.flatnonzero(alive.any(axis=1)), np.flatnonzero(alive.any(axis=0))
    if not len(rows):
        return
    scores = dot(ints[rows], block.ints[columns])
    found = block.ids[columns]
    for at, row in enumerate(rows.tolist()):
        keep = alive[row, columns] & (found != ids[row])
        s, c = scores[at][keep], found[keep]
        if len(s) > k:
            lowest = np.partition(s, len(s) - k)[len(s) - k]
            near = s >= lowest  # ties included
            s, c = s[near], c[near]
        order = np.lexsort((c, -s))[:k]
        yield int(ids[row]), c[order], s[order]


def top_k(
    vectors: DataFrame,
    k: int = K,
    every: int = QUERY_EVERY,
    scale: int = SCALE,
    block: int = BLOCK,
    queries: int = QUERIES,
) -> DataFrame:
    """query_id, rank, vec_id, score: for rows whose id ``every`` divides, the k best of all other rows."""
    taken = vectors.select(F.col("vec_id").cast("long").alias("id"), integers(F.col("embedding"), scale).alias("v"))
    taken = taken.filter("id IS NOT NULL AND v IS NOT NULL")
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    taken = store(taken.withColumn("length", length), "topk-integers")
    rows, width = taken.agg(F.count("*"), F.max(F.size("v"))).first()
    width = max(1, width or 0)
    # Any rotation is exact, so a sample by hash decides it.
    axes = rotation(taken.filter(F.pmod(F.xxhash64("id"), F.lit(-(-rows // SAMPLE) or 1)) == 0), width)
    steps = tuple(sorted({width // 8, width // 4, width // 2} - {0}))

    # Candidates by descending length: range partitions are cut into blocks where they lie.
    count = max(1, -(-rows // block))
    dealt = taken.repartitionByRange(count, F.col("length").desc(), F.col("id")).sortWithinPartitions(F.col("length").desc(), "id")
    dealt = store(dealt.select(F.spark_partition_id().alias("block"), "id", "v", "length"), "topk-blocks")
    reach = store(dealt.groupBy("block").agg(F.max("length").alias("longest")), "topk-reach")
    count = (reach.agg(F.max("block")).first()[0] or 0) + 1  # as many as Spark made of it

    asked = taken.filter(F.col("id") % every == 0).groupBy("id").agg(F.max(F.struct("v", "length")).alias("q"))
    groups = max(1, -(-rows // every // queries))
    asked = store(asked.select(F.pmod(F.xxhash64("id"), F.lit(groups)).alias("group"), "id", "q.v", "q.length", F.lit(0).alias("block")), "topk-queries")

    nothing = F.lit(float("-inf"))
    opening = _scored(dealt, asked.withColumn("floor", nothing), axes, width, k, steps)
    opening = store(opening, "topk-opening")
    lows = opening.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score").cast("double")).alias("low"))
    floors = asked.join(lows.withColumnRenamed("query_id", "id"), "id", "left")
    floors = store(floors.withColumn("floor", F.coalesce("low", nothing)).drop("low"), "topk-floors")

    # A query goes on to a block only if the block's longest vector can reach the query's floor. Blocks
    # descend in length, so the blocks it needs are the first ones.
    if count <= MOST_BLOCKS:
        going = _needed(floors, reach, count).withColumn("block", F.explode(F.sequence(F.lit(1), F.col("end") - 1))).drop("end")
    else:
        every = floors.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).filter("block > 0").join(reach, "block")
        going = every.filter(F.col("length") * F.col("longest") * (1 + 1e-9) + 1e-9 >= F.col("floor")).drop("longest")
    going = store(going.select("group", "id", "v", "length", "block", "floor"), "topk-going")
    closing = _scored(dealt, going, axes, width, k, steps)

    every_best = opening.unionAll(closing)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = every_best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _needed(floors: DataFrame, reach: DataFrame, count: int) -> DataFrame:
    """The queries that need more than the opening block, with ``end``: the number of blocks they need, from the first on."""
    held = reach.toArrow()
    longest = np.full(count, np.inf)
    longest[np.asarray(held.column("block"))] = np.asarray(held.column("longest"))
    falling = np.minimum.accumulate(longest)  # an empty block counts like the one before it
    shared = floors.sparkSession.sparkContext.broadcast(-falling)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, floor = (np.asarray(batch.column(c)) for c in ("length", "floor"))
            with np.errstate(divide="ignore", invalid="ignore"):
                least = np.where(length > 0, (floor - 1e-9) / (length * (1 + 1e-9)), np.where(floor <= 1e-9, -np.inf, np.inf))
            # A little more than exact: the division rounds too.
            end = np.searchsorted(shared.value, -(least - 1e-9 * np.abs(np.where(np.isfinite(least), least, 0))), side="right")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(end.astype(np.int32))], [*batch.schema.names, "end"])

    slim = floors.select("id", "length", "floor")
    ends = store(slim.mapInArrow(run, "id bigint, length double, floor double, end int").filter("end > 1").select("id", "end"), "topk-ends")
    return floors.join(ends, "id")


def _scored(dealt: DataFrame, asked: DataFrame, axes: np.ndarray, width: int, k: int, steps: tuple[int, ...], chunk: int = 128) -> DataFrame:
    """The k best of each block for each query sent to it; a task holds one block and one group of queries."""
    needed = asked.select(F.col("block").alias("to_block"), F.col("group").alias("to_group")).distinct()
    met = dealt.join(needed, F.col("block") == F.col("to_block")).select("to_block", "to_group", "id", "v")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, np.ndarray, np.ndarray]] = []
        if left.num_rows and right.num_rows:
            held = Block(np.asarray(left.column("id")), matrix(left.column("v").combine_chunks(), width), axes)
            ids, ints = np.asarray(right.column("id")), matrix(right.column("v").combine_chunks(), width)
            floor = np.asarray(right.column("floor"))
            for at in range(0, len(ids), chunk):
                part = slice(at, at + chunk)
                out.extend(best(held, ids[part], ints[part], axes, floor[part], k, steps))
        query = np.repeat([q for q, _, _ in out], [len(i) for _, i, _ in out]).astype(np.int64)
        columns = [np.concatenate([x[c] for x in out]) if out else np.zeros(0, np.int64) for c in (1, 2)]
        return pa.table({"query_id": query, "vec_id": columns[0], "score": columns[1]})

    both = met.groupBy("to_block", "to_group").cogroup(asked.select("block", "group", "id", "v", "floor").groupBy("block", "group"))
    return both.applyInArrow(run, "query_id bigint, vec_id bigint, score bigint")
