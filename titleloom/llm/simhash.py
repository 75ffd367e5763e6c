"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints are compared 64 at a time: a block stores its fingerprints as 64 bit
planes, one machine word holds the same bit of 64 of them. XOR with the query's
bit gives 64 one-bit differences, and carry-save counters of three bit planes
add them up for all lanes at once. A query row is abandoned as soon as every lane
of its block is over the radius.

Which fingerprints meet in a block: with radius r the 64 bits are cut into m > r
parts, so two fingerprints within the radius agree on m - r parts at least. Each
choice of m - r parts is a key; fingerprints that share a key meet. m grows with the
number of distinct fingerprints so that key groups stay small; every choice is
exact. A group beyond the block size is cut into blocks, and each pair of
blocks is a unit of work of its own, so a hot key is spread over many tasks.

Only distinct fingerprints are compared, so exact copies cost nothing here. A
block reports a spanning forest of its links, never all pairs. Components come
from alternating large-star and small-star rounds; no link, component or
fingerprint list reaches the driver.

Defined cases: a NULL text is the empty text; texts without words have the
fingerprint zero and link like any other; fewer words than the shingle size
make one shingle of the whole sequence. Repeated rows each get a row. A NULL
doc_id never becomes a component id unless the component has no other. An empty
table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titleloom.llm.common import packed, slices, store, text_of

SEED = 42
RADIUS = 4
SHINGLE = 4
BLOCK = 1024  # fingerprints of one block
GROUP = 512  # wanted size of a key group


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """A bit is set if it is set in over half of the shingles' hashes, repeats counted."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII only
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - shingle + 1].tolist()
    parts = (joined[s:e] for s, e in zip(starts, ends[shingle - 1 :].tolist()))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, parts, itertools.repeat(seed)), np.uint64, len(starts))
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    set_bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(set_bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, mark (a hash of the text), fp (the 64 bits as a signed long); one row per row, whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                values = [fingerprint(t, shingle, seed) for t in part.column("text").to_pylist()]
                fp = np.array(values, np.uint64).view(np.int64)
                columns = [part.column("doc_id"), part.column("mark"), pa.array(fp)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "mark", "fp"])

    slim = docs.select("doc_id", text_mark().alias("mark"), text_of().alias("text"))
    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, mark bigint, fp bigint")


def text_mark() -> Column:
    return F.xxhash64(text_of())


def key_masks(n: int, radius: int = RADIUS, group: int = GROUP) -> list[int]:
    """Masks of the keys for n distinct fingerprints; any two within the radius agree under one."""
    parts = radius + 1
    while parts < 2 * radius and n >> (64 * (parts - radius) // parts) > group:
        parts += 1
    edges = [64 * i // parts for i in range(parts + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [sum(chosen) for chosen in itertools.combinations(masks, parts - radius)]


def close_pairs(fps: np.ndarray, radius: int, rows: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j), j < i, of fingerprints at most ``radius`` (up to 7) bits apart."""
    n = len(fps)
    bits = np.unpackbits(fps.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").T
    width = -(-n // 64)
    lanes = np.zeros((64, width * 64), np.uint8)
    lanes[:, :n] = bits
    planes = np.packbits(lanes, axis=1, bitorder="little").view(np.uint64)
    asked = np.where(bits, np.uint64(2**64 - 1), np.uint64(0))
    upto = np.packbits(np.arange(width * 64)[None, :] >= np.arange(n)[:, None], axis=1, bitorder="little").view(np.uint64)
    for start in range(0, n, rows):
        query = np.arange(start, min(n, start + rows))
        reach = -(-int(query[-1] + 1) // 64)  # lanes behind the last query are out anyway
        over = upto[query, :reach].copy()
        c0, c1, c2 = (np.zeros_like(over) for _ in range(3))
        for b in range(0, 64, 2):
            x = planes[b, None, :reach] ^ asked[b, query, None]
            y = planes[b + 1, None, :reach] ^ asked[b + 1, query, None]
            s = x ^ y
            carry = (x & y) | (c0 & s)
            c0 ^= s
            up = c1 & carry
            c1 ^= carry
            over |= c2 & up
            c2 ^= up
            if b % 8 == 6:
                beyond = over | _above(c0, c1, c2, radius)
                alive = (beyond != np.uint64(2**64 - 1)).any(axis=1)
                if not alive.all():
                    query, over, c0, c1, c2 = query[alive], over[alive], c0[alive], c1[alive], c2[alive]
                    if not len(query):
                        break
        if len(query):
            near = ~(over | _above(c0, c1, c2, radius))
            i, lane = np.nonzero(np.unpackbits(near.view(np.uint8), axis=1, bitorder="little"))
            if len(i):
                yield query[i], lane


def _above(c0: np.ndarray, c1: np.ndarray, c2: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose three-bit counter is over the radius."""
    out = np.zeros_like(c0)
    for value in range(radius + 1, 8):
        hit = c0 if value & 1 else ~c0
        hit = hit & (c1 if value & 2 else ~c1)
        out |= hit & (c2 if value & 4 else ~c2)
    return out


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of n nodes the smallest node it is linked with, directly or not."""
    label = np.arange(n)
    for a, b in pairs:
        while True:
            low = np.minimum(label[a], label[b])
            if (label[a] == low).all() and (label[b] == low).all():
                break
            np.minimum.at(label, label[a], low)
            np.minimum.at(label, label[b], low)
            while (label[label] != label).any():
                label = label[label]
    return label


def links(fps: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """u, v: a spanning forest per block of the links between distinct fingerprints (column fp)."""
    masks = key_masks(fps.count(), radius)
    as_long = [int(np.array([m], np.uint64).view(np.int64)[0]) for m in masks]
    keyed = fps.select(
        "fp",
        F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in as_long])).alias("part", "value"),
    )
    groups = keyed.groupBy("part", "value").count().filter("count > 1")
    blocks = F.ceil(F.col("count") / block).cast("int")
    met = keyed.join(store(groups, "simhash-groups"), ["part", "value"])
    met = met.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    unit = [F.col("part"), F.col("value"), F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")]
    units = met.select(*unit, "fp").repartition("part", "value", "low", "high")
    units = units.sortWithinPartitions("part", "value", "low", "high", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fp in _whole_units(batches, block):
            label = forest(len(fp), close_pairs(fp, radius))
            moved = np.flatnonzero(label != np.arange(len(fp)))
            if len(moved):
                u, v = fp[moved].view(np.int64), fp[label[moved]].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return units.mapInArrow(run, "u bigint, v bigint")


def _whole_units(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[np.ndarray]:
    """Runs of whole units as distinct fingerprints, packed together while they fit ``most`` rows.

    Comparing across packed units finds true links only, so packing is harmless.
    """
    names = ["part", "value", "low", "high"]
    held: list[np.ndarray] = []  # whole units waiting
    size = 0
    open_parts: list[np.ndarray] = []  # rows of the unit not yet closed
    last: tuple | None = None

    def closed() -> None:
        nonlocal size, open_parts
        unit = np.concatenate(open_parts) if open_parts else np.zeros(0, np.uint64)
        open_parts = []
        held.append(unit)
        size += len(unit)

    for batch in batches:
        if batch.num_rows == 0:
            continue
        keys = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in names], axis=1)
        fp = np.asarray(batch.column("fp")).view(np.uint64)
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(fp)]):
            key = tuple(keys[a])
            if key != last and last is not None:
                closed()
                if size >= most // 2:
                    yield np.unique(np.concatenate(held))
                    held, size = [], 0
            last = key
            open_parts.append(fp[a:b])
    if last is not None:
        closed()
    if size:
        yield np.unique(np.concatenate(held))


def components(edges: DataFrame) -> DataFrame:
    """u, v: every linked node with the smallest node of its component, that node left out.

    Rounds end with one that changes no edge: no node with larger neighbours has a smaller one, and none has two smaller ones.
    """
    current = store(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct(), "edges")
    while True:
        both = current.unionAll(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = store(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("low")), "least")
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"), (F.col("low") < F.col("u")).alias("moved"))
        large = store(large.groupBy("u", "v").agg(F.max("moved").alias("moved")), "large-star")
        least = store(large.groupBy("u").agg(F.min("v").alias("low")), "least")
        if large.count() == least.count() and large.filter("moved").isEmpty():
            return large.select("u", "v")
        small = large.join(least, "u").filter("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        current = store(small.unionAll(least.select("u", F.col("low").alias("v"))).distinct(), "small-star")


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def classes(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(doc_id, mark, fp per row; fp, root per distinct fingerprint). Both are stored tables."""
    fps = store(fingerprints(docs, shingle), "simhash")
    distinct = store(fps.select("fp").distinct(), "simhash-distinct")
    roots = components(links(distinct, radius, block))
    rooted = distinct.join(roots, F.col("fp") == F.col("u"), "left").select("fp", F.coalesce("v", "fp").alias("root"))
    return fps, store(rooted, "simhash-roots")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links)."""
    fps, roots = classes(docs, radius, shingle, block)
    first = fps.groupBy("fp").agg(F.min("doc_id").alias("lead")).join(roots, "fp")
    leads = store(first.groupBy("root").agg(F.min("lead").alias("component_id")), "simhash-leads")
    of_fp = store(roots.join(leads, "root").select("fp", "component_id"), "simhash-components")
    return fps.join(of_fp, "fp").select("doc_id", hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """One document per component."""
    return keep_first(docs, *classes(docs, radius, shingle, block))


def keep_first(docs: DataFrame, fps: DataFrame, roots: DataFrame) -> DataFrame:
    """Of each component the smallest doc_id (NULL last), of equal ids the smallest text mark.

    ``fps`` and ``roots`` are as ``classes`` gives them. Rows alike in id and text count as
    one document, of which one row stays.
    """
    order = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id"), F.col("mark"))
    per_row = fps.groupBy("fp", "doc_id", "mark").agg(F.count("*").alias("rows"))
    best = per_row.groupBy("fp").agg(F.min_by(F.struct(order.alias("order"), "rows"), order).alias("best"))
    best = best.join(roots, "fp").groupBy("root").agg(F.min("best").alias("best"))
    best = store(best.select("best.order.doc_id", "best.order.mark", "best.rows"), "simhash-kept")
    best = best.withColumnsRenamed({"doc_id": "kept_id", "mark": "kept_mark"})
    rows = docs.select(packed(docs).alias("row"), F.col("doc_id").alias("id"), text_mark().alias("mark"))
    kept = rows.join(best, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("mark") == F.col("kept_mark")))
    once = kept.filter("rows = 1").select("row.*")
    repeated = kept.filter("rows > 1").dropDuplicates(["id", "mark"]).select("row.*")
    return once.unionAll(repeated)
