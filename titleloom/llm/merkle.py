"""Merkle manifest of a table: digests, proofs and verification by superblocks.

A row's digest is the SHA-256 of its fields, each with its byte count, so that no two rows
write the same bytes. The rows of a group ascend by key; every ``arity`` consecutive nodes
become the digest of their digests until one is left, the group's subroot. The
subroots, by group, become the root in the same way.

A superblock is a run of arity**depth leaves, the leaves of one whole subtree. Places come from a range sort
(``ordering.positions``), so a group with a third of all rows is spread over many
superblocks. A first pass reduces each superblock to its top. The tops are the nodes of a tree
arity**depth times smaller that is treated the same way, level of superblocks by level, until each
group has one. This gives each superblock its outer nodes: the siblings on the way from
its top to the root, some dozens of digests. Then leaves and outer nodes are cogrouped by
superblock, and one function finishes the reduction inside, joins inner and outer
proof and folds the claimed digest up to the root. A task holds one superblock at a time; the
driver holds no digest.

Defined cases: a NULL field is written as ``-``, unlike the empty text. A NULL group is a group
of its own and comes first. A NULL key sorts first. Rows with equal keys are sorted by
digest, so the order of the input does not matter; rows alike in all fields each keep a leaf.
A group of one row has its leaf as subroot; an empty table gives an empty result. Other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titleloom.llm.common import store
from titleloom.llm.ordering import positions

ARITY = 2
DEPTH = 10  # levels of a superblock
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPER_EVERY = 7

_PATH = "left array<string>, right array<string>"


def digest_of(*fields: Column) -> Column:
    """SHA-256 over fields: ``-`` for NULL, else byte count, colon, value."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def node(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels_of(digests: list[str], arity: int, most: int, whole: bool) -> list[list[str]]:
    """The levels of a subtree from its leaves to its top.

    A part of a larger tree has exactly ``most`` levels above the leaves; a whole
    tree ends where one node is left.
    """
    out = [digests]
    while len(out[-1]) > 1 if whole else len(out) <= most:
        row = out[-1]
        out.append([node(row[i : i + arity]) for i in range(0, len(row), arity)])
    return out


def path_of(levels: list[list[str]], at: int, arity: int) -> tuple[list[str], list[str]]:
    """Per level the siblings before and after the node on the way from leaf ``at`` to the top."""
    left, right = [], []
    for row in levels[:-1]:
        first = at - at % arity
        left.append("".join(row[first:at]))
        right.append("".join(row[at + 1 : first + arity]))
        at //= arity
    return left, right


def fold(digest: str, left: list[str], right: list[str]) -> str:
    """The root that a leaf and its proof lead to."""
    return reduce(lambda d, sides: node([sides[0], d, sides[1]]), zip(left, right), digest)


class Tree:
    """Arity and depth of superblocks, and the jobs over them."""

    def __init__(self, arity: int = ARITY, depth: int = DEPTH) -> None:
        self.arity, self.depth, self.block = arity, depth, arity**depth

    def _subtree(self, rows: pd.DataFrame) -> tuple[pd.DataFrame, list[list[str]]]:
        rows = rows.sort_values("pos", ignore_index=True)
        return rows, levels_of(rows["digest"].tolist(), self.arity, self.depth, int(rows["n"].iloc[0]) <= self.block)

    def tops(self, nodes: DataFrame) -> DataFrame:
        """tree, pos, n, digest: each superblock reduced to its top."""

        def run(rows: pd.DataFrame) -> pd.DataFrame:
            rows, levels = self._subtree(rows)
            first = rows.iloc[0]
            n = -(-int(first["n"]) // self.block)
            return pd.DataFrame({"tree": [first["tree"]], "pos": [int(first["pos"]) // self.block], "n": [n], "digest": levels[-1]})

        slim = nodes.select("tree", "pos", "n", "digest", self._own().alias("block"))
        return slim.groupBy("tree", "block").applyInPandas(run, "tree string, pos bigint, n bigint, digest string")

    def _own(self) -> Column:
        return F.expr(f"pos div {self.block}")

    def outer(self, nodes: DataFrame) -> DataFrame:
        """tree, block, left, right, top: the siblings outside each superblock and the tree's top."""
        tops = store(self.tops(nodes), "merkle-tops")
        if tops.filter("n > 1").isEmpty():
            none = F.expr("cast(array() as array<string>)")
            return tops.select("tree", F.col("pos").alias("block"), none.alias("left"), none.alias("right"), F.col("digest").alias("top"))
        return self.paths(tops).withColumnRenamed("pos", "block")

    def paths(self, nodes: DataFrame) -> DataFrame:
        """tree, pos, left, right, top: the proof of each node."""

        def run(rows: pd.DataFrame, around: pd.DataFrame) -> pd.DataFrame:
            rows, levels = self._subtree(rows)
            above = around.iloc[0]
            sides = [path_of(levels, i, self.arity) for i in range(len(rows))]
            rows["left"] = [a + list(above["left"]) for a, _ in sides]
            rows["right"] = [b + list(above["right"]) for _, b in sides]
            rows["top"] = above["top"]
            return rows[["tree", "pos", "left", "right", "top"]]

        inner = nodes.select("tree", "pos", "n", "digest", self._own().alias("block")).groupBy("tree", "block")
        met = inner.cogroup(self.outer(nodes).groupBy("tree", "block"))
        return store(met.applyInPandas(run, f"tree string, pos bigint, {_PATH}, top string"), "merkle-paths")

    def proofs(self, leaves: DataFrame, outer: DataFrame) -> DataFrame:
        """name, leaf, claim, left, right, subroot, root, folded_root of each leaf."""

        def run(rows: pd.DataFrame, around: pd.DataFrame) -> pd.DataFrame:
            rows, levels = self._subtree(rows)
            above = around.iloc[0]
            ends = list(above["left"]), list(above["right"])
            sides = [path_of(levels, i, self.arity) for i in range(len(rows))]
            rows["left"] = [a + ends[0] for a, _ in sides]
            rows["right"] = [b + ends[1] for _, b in sides]
            rows["folded_root"] = [fold(d, a, b) for d, a, b in zip(rows["claim"], rows["left"], rows["right"])]
            rows["subroot"], rows["root"] = above["subroot"], above["root"]
            return rows.rename(columns={"digest": "leaf"})[["name", "leaf", "claim", "left", "right", "subroot", "root", "folded_root"]]

        inner = leaves.select("tree", "pos", "n", "digest", "claim", "name", self._own().alias("block")).groupBy("tree", "block")
        met = inner.cogroup(outer.groupBy("tree", "block"))
        return met.applyInPandas(run, f"name string, leaf string, claim string, {_PATH}, subroot string, root string, folded_root string")


def manifest(
    docs: DataFrame,
    fields: tuple[str, ...] = FIELDS,
    key: str = "doc_id",
    group: str = "lang",
    claim: Column | None = None,
    arity: int = ARITY,
    depth: int = DEPTH,
) -> DataFrame:
    """Key, leaf, claim, proof (left, right per level), subroot, root and folded_root of every row.

    ``claim`` is the digest to be proved against the manifest (default: the leaf itself); it stands if
    folded_root equals root.
    """
    tree = Tree(arity, depth)
    leaf = digest_of(*[F.col(f"`{f}`") for f in fields])
    # NULL first, then the names by bytes: a prefix keeps NULL and the empty name apart.
    name = F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit(""))
    kind = docs.select(F.col(f"`{key}`")).schema[0].dataType
    rows = docs.select(
        name.alias("tree"),
        F.col(f"`{key}`").alias("key"),
        leaf.alias("digest"),
        (leaf if claim is None else claim).alias("claim"),
        F.monotonically_increasing_id().alias("spread"),
    )
    rows = store(rows, "merkle-leaves")
    placed = positions(rows, "tree", ["key", "digest", "spread"], "merkle-sorted")
    leaves = store(placed.select("tree", "pos", "n", "digest", "claim", F.col("key").cast("string").alias("name")), "merkle-placed")

    outer = store(tree.outer(leaves), "merkle-outer")
    subroots = outer.filter("block = 0").select(F.lit("").alias("all"), F.col("tree").alias("group"), F.col("top").alias("digest"))
    subroots = store(positions(subroots, "all", ["group"], "merkle-groups"), "merkle-subroots")
    above = tree.paths(subroots.select(F.col("all").alias("tree"), "pos", "n", "digest"))
    above = above.select("pos", F.col("left").alias("more_left"), F.col("right").alias("more_right"), F.col("top").alias("root"))
    above = subroots.select("pos", "group").join(above, "pos")
    joined = outer.join(above, F.col("tree") == F.col("group")).select(
        "tree",
        "block",
        F.concat("left", "more_left").alias("left"),
        F.concat("right", "more_right").alias("right"),
        F.col("top").alias("subroot"),
        "root",
    )
    proved = tree.proofs(leaves, joined)
    return proved.select(F.col("name").cast(kind).alias(key), *[c for c in proved.columns if c != "name"])


def siblings(left: str = "left", right: str = "right") -> Column:
    """The siblings of a proof as one text, level by level, left to right."""
    return F.array_join(F.zip_with(left, right, lambda a, b: F.concat(a, b)), "")


def tampered(every: int = TAMPER_EVERY) -> Column:
    """The leaf of a document with 1 added to n_chars, where ``every`` divides the CRC-32 of its id (a NULL id: never)."""
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % every == 0, F.col("n_chars").cast("decimal(20,0)") + 1).otherwise(F.col("n_chars").cast("decimal(20,0)"))
    return digest_of(*[changed if f == "n_chars" else F.col(f) for f in FIELDS])
