"""Embedding near-duplicates by sorted projection passes.

A pass gives each vector a key, the signs of its products with random directions one after another, and
sorts all vectors by it. Vectors at a small angle share long beginnings of their keys, so they
come to stand close together. Two vectors meet in a pass if they are at most WINDOW places apart, or if
their keys begin alike in the first ``bits`` signs. The window alone is a bound that a group of more
alike vectors would break; the common beginning lets every such group meet whole, however
large. ``bits`` follows from the number of vectors, so that beginnings of spread vectors
are shared by fewer than a window holds, and the number of passes from ``bits``: a pair at
exactly the least cosine meets in some pass with a probability of at least RECALL, closer
pairs with more. Up to WINDOW vectors one pass compares all.

What meets is verified by its cosine in double precision. A pair that meets in several passes is
counted in the first: each vector carries its places in all passes. Equal vectors are one
node with a count. A pass is cut into blocks of places; a unit of work is a pair of blocks that share
a window or a beginning, so a long run of alike keys is spread over many tasks. A unit
reports links per vector and a spanning forest, never pairs. Components come from
``simhash.components``. Comparing a group of n different vectors that are all alike costs n * n / 2
products, but only n rows per block leave a unit.

Defined cases: a vector that is NULL, empty, zero, or holds a NULL or non-finite component links with nothing.
Vectors of unequal dimension are compared as if the shorter ended in zeros. Repeated rows, or rows of
one id with several vectors, are vectors of their own. A NULL vec_id never becomes a component id unless
the component has no other. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titleloom.llm.common import store
from titleloom.llm.ordering import positions
from titleloom.llm.simhash import components, forest

LEAST = 0.95
WINDOW = 512
BLOCK = 8 * WINDOW
RECALL = 0.99
SIGNS = 62  # of a key
SEED = 42


def plan_passes(n: int, least: float = LEAST, window: int = WINDOW, recall: float = RECALL) -> tuple[int, int]:
    """(signs of a common beginning, passes) for n vectors."""
    bits = min(SIGNS, max(0, math.ceil(math.log2(max(1, n) / window))))
    met = (1 - math.acos(least) / math.pi) ** bits
    return bits, 1 if met == 1 else math.ceil(math.log(1 - recall) / math.log1p(-met))


def unit_rows(column: pa.Array, width: int) -> np.ndarray:
    """Vectors of length one in double precision; shorter ones end in zeros."""
    flat = np.asarray(column.flatten()).astype(np.float64)
    length = np.diff(np.asarray(column.offsets))
    out = np.zeros((len(length), width))
    out[np.arange(width)[None, :] < length[:, None]] = flat
    out /= np.abs(out).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return out / np.sqrt((out * out).sum(axis=1, keepdims=True))


def with_keys(nodes: DataFrame, width: int, passes: int, seed: int = SEED) -> DataFrame:
    """node and its key in each pass. The directions follow from the seed, pass by pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        axes = [np.random.default_rng([seed, p]).standard_normal((width, SIGNS)) for p in range(passes)]
        weights = np.int64(1) << np.arange(SIGNS - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                rows = unit_rows(batch.column("v"), width)
                keys = np.stack([((rows @ a > 0) * weights).sum(axis=1) for a in axes], axis=1)
                offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * passes)
                lists = pa.ListArray.from_arrays(offsets, pa.array(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column("node"), lists], ["node", "keys"])

    return nodes.select("node", "v").mapInArrow(run, "node bigint, keys array<bigint>")


class Side:
    """Rows of one block in a unit, by place."""

    def __init__(self, rows: pa.Table, at: int, width: int) -> None:
        place, begin = (np.asarray(rows.column(c).combine_chunks().flatten()).reshape(rows.num_rows, -1) if rows.num_rows else np.zeros((0, at + 1), np.int64) for c in ("places", "begins"))
        order = np.argsort(place[:, at], kind="stable")
        self.place, self.begin = place[order], begin[order]
        self.node, self.count = (np.asarray(rows.column(c))[order] for c in ("node", "rows"))
        v = rows.column("v").combine_chunks()
        self.rows = unit_rows(v, width)[order] if rows.num_rows else np.zeros((0, width))


def linked(a: Side, b: Side, same: bool, at: int, least: float, window: int, chunk: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs (row of a, row of b) that meet in pass ``at`` for the first time."""

    def meet(i: np.ndarray, j: np.ndarray, p: int) -> np.ndarray:
        return (np.abs(a.place[i, p] - b.place[j, p]) <= window) | (a.begin[i, p] == b.begin[j, p])

    for start in range(0, len(a.node), chunk):
        stop = min(start + chunk, len(a.node))
        reach = max(
            int(np.searchsorted(b.place[:, at], a.place[stop - 1, at] + window, side="right")),
            int(np.searchsorted(b.begin[:, at], a.begin[stop - 1, at], side="right")),
        )
        first = start if same else 0
        i, j = np.nonzero(a.rows[start:stop] @ b.rows[first:reach].T >= least)
        i, j = i + start, j + first
        good = meet(i, j, at) & ((i < j) if same else True)
        for p in range(at):
            good[good] &= ~meet(i[good], j[good], p)
        if good.any():
            yield i[good], j[good]


def links(vectors: DataFrame, width: int, n: int, least: float, window: int, block: int, recall: float) -> DataFrame:
    """u, v, links for stored distinct vectors (node, v, rows): a forest of links, and each vector's share of its link count."""
    bits, passes = plan_passes(n, least, window, recall)
    keyed = store(with_keys(vectors, width, passes), "neighbour-keys")
    each = keyed.select("node", F.posexplode("keys").alias("lap", "key"))
    placed = positions(each, "lap", ["key", "node"], "neighbour-order").drop("n")
    placed = placed.withColumns({"begin": F.shiftright("key", SIGNS - bits), "own": F.expr(f"pos div {block}")})
    placed = store(placed.select("node", "lap", "pos", "begin", "own"), "neighbour-places")

    # Runs of one beginning that reach over a block's end; all others stay in theirs.
    runs = placed.groupBy("lap", "begin").agg(F.min("own").alias("low"), F.max("own").alias("high")).filter("low < high")
    runs = store(runs, "neighbour-runs")
    spread = placed.join(runs, ["lap", "begin"], "left")
    last = F.when(F.col("pos") % block >= block - window, F.col("own") + 1)
    before = F.when((F.col("pos") % block < window) & (F.col("own") > 0), F.col("own") - 1)
    spread = spread.withColumns({"from": F.least("own", "low", before), "to": F.greatest("own", "high", last)})
    seen = spread.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("lap", "pos", "begin", "own", "from", "to"))).alias("seen"))

    met = vectors.join(seen, "node").select("node", "v", "rows", F.col("seen.pos").alias("places"), F.col("seen.begin").alias("begins"), F.inline("seen"))
    met = met.select("node", "v", "rows", "places", "begins", "lap", "own", F.explode(F.sequence("from", "to")).alias("other"))
    met = met.select("*", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two")).drop("other")

    def run(rows: pa.Table) -> pa.Table:
        at, one, two = (rows.column(c)[0].as_py() for c in ("lap", "one", "two"))
        own = np.asarray(rows.column("own"))
        a = Side(rows.filter(pa.array(own == one)), at, width)
        b = a if one == two else Side(rows.filter(pa.array(own == two)), at, width)
        behind = 0 if one == two else len(a.node)
        node = a.node if one == two else np.concatenate([a.node, b.node])
        found = np.zeros(len(node), np.int64)

        def counted() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for i, j in linked(a, b, one == two, at, least, window):
                np.add.at(found, i, b.count[j])
                np.add.at(found, j + behind, a.count[i])
                yield i, j + behind

        label = forest(len(node), counted())
        some = np.flatnonzero(found)
        return pa.table({"u": node[some], "v": node[label[some]], "links": found[some]})

    return met.groupBy("lap", "one", "two").applyInArrow(run, "u bigint, v bigint, links bigint")


def near_duplicates(
    vectors: DataFrame,
    least: float = LEAST,
    window: int = WINDOW,
    block: int = BLOCK,
    recall: float = RECALL,
) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row."""
    doubles = F.transform("embedding", lambda x: x.cast("double"))
    good = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(doubles, lambda x: x != 0)
    plain = F.transform("embedding", lambda x: x + F.lit(0).cast(vectors.schema["embedding"].dataType.elementType))  # no negative zero
    rows = vectors.select("vec_id", F.when(good, plain).alias("v"))
    # Two hashes of 64 bits name a vector.
    rows = rows.select("vec_id", "v", F.when(F.col("v").isNotNull(), F.xxhash64("v")).alias("one"), F.xxhash64(F.lit(SEED), "v").alias("two"))
    rows = store(rows, "neighbour-rows")
    alike = rows.filter("v is not null").groupBy("one", "two").agg(F.count("*").alias("rows"), F.min("vec_id").alias("lead"), F.first("v").alias("v"))
    nodes = store(alike.withColumn("node", F.monotonically_increasing_id()), "neighbour-nodes")
    n, width = nodes.agg(F.count("*"), F.max(F.size("v"))).first()
    found = store(links(nodes.select("node", "v", "rows"), max(1, width or 0), n, least, window, block, recall), "neighbour-links")

    roots = components(found.select("u", "v"))
    counts = found.groupBy("u").agg(F.sum("links").alias("links")).withColumnRenamed("u", "node")
    slim = nodes.select("one", "two", "node", "rows", "lead").join(counts, "node", "left")
    slim = slim.join(roots.withColumnsRenamed({"u": "node", "v": "root"}), "node", "left").withColumn("root", F.coalesce("root", "node"))
    slim = store(slim, "neighbour-roots")
    leads = slim.groupBy("root").agg(F.min("lead").alias("component_id"))
    named = store(slim.join(leads, "root").select("one", "two", "rows", F.coalesce("links", F.lit(0)).alias("links"), "component_id"), "neighbour-components")
    whole = rows.select("vec_id", "one", "two").join(named, ["one", "two"], "left")
    return whole.select(
        "vec_id",
        F.coalesce(F.col("rows") - 1 + F.col("links"), F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.col("vec_id").eqNullSafe(F.coalesce("component_id", "vec_id")).alias("kept"),
    )
