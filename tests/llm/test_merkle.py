"""The manifest against a plain tree over all rows, and what tampering does to it."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from titleloom.llm import merkle

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, digest string, pos int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def slow_leaf(r):
    doc_id, text, lang, source, n_chars = r[:5]
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def slow_tree(digests, arity):
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + arity]) for i in range(0, len(levels[-1]), arity)])
    return levels


def slow_proof(levels, at, arity):
    out = []
    for row in levels[:-1]:
        first = at // arity * arity
        out.append(("".join(row[first:at]), "".join(row[at + 1 : first + arity])))
        at //= arity
    return out


def slow_manifest(rows, arity):
    """Sorted (leaf, subroot, root, siblings)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: slow_tree([d for _, _, d in sorted((r[0] is not None, r[0] or 0, slow_leaf(r)) for r in groups[g])], arity) for g in names}
    top = slow_tree([trees[g][-1][0] for g in names], arity)
    out = []
    for at, g in enumerate(names):
        for i, leaf in enumerate(trees[g][0]):
            path = slow_proof(trees[g], i, arity) + slow_proof(top, at, arity)
            out.append((leaf, trees[g][-1][0], top[-1][0], "".join(a + b for a, b in path)))
    return sorted(out)


def made(rng, n):
    langs = ["en"] * 6 + ["de", "", None, "zz", "é"]
    rows = [(i, f"text {i} ünï", rng.choice(langs), rng.choice(["a", None]), rng.choice([i, None])) for i in range(n)]
    rows += [rows[0]] * 30 + [(None, None, None, None, None)] * 3 + [(5, "other", "en", None, 1), (7, "", "alone", "", 2**63 - 1)]
    rng.shuffle(rows)
    return [(*r, "clash", 1) for r in rows]


@pytest.mark.parametrize(("arity", "depth"), [(2, 10), (2, 2), (3, 1)])
def test_equals_a_plain_tree(spark, arity, depth):
    rows = made(random.Random(arity * depth), 150)
    df = merkle.manifest(spark.createDataFrame(rows, SCHEMA), arity=arity, depth=depth)
    got = df.select("leaf", "subroot", "root", merkle.siblings(), "folded_root", "claim").collect()
    assert sorted(tuple(r)[:4] for r in got) == slow_manifest(rows, arity)
    assert all(r.folded_root == r.root and r.claim == r.leaf for r in got)


def test_tampering_shows(spark):
    rows = made(random.Random(9), 60)
    docs = spark.createDataFrame(rows, SCHEMA)
    df = merkle.manifest(docs, claim=merkle.tampered(), depth=3)
    touched = docs.filter(F.expr("crc32(cast(doc_id as string)) % 7 = 0 and n_chars is not null")).count()
    assert df.filter("folded_root <> root").count() == touched > 0
    assert df.filter("folded_root <> root and claim = leaf").isEmpty()
    ids = lambda d: sorted(map(str, (r[0] for r in d.select("doc_id").collect())))
    assert ids(df) == ids(docs) and df.schema["doc_id"].dataType == docs.schema["doc_id"].dataType


def test_order_and_partitions_do_not_matter(spark):
    rows = made(random.Random(4), 80)
    roots = {merkle.manifest(spark.createDataFrame(r, SCHEMA).repartition(p), depth=2).first().root for r, p in ((rows, 1), (rows[::-1], 7))}
    assert len(roots) == 1


def test_empty_and_single(spark):
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).collect() == []
    one = merkle.manifest(spark.createDataFrame([(1, "x", "en", "s", 1, "", 0)], SCHEMA)).first()
    assert one.leaf == one.subroot == one.root == one.folded_root and one.left == one.right == []


def test_hot_group_is_spread(spark, monkeypatch):
    """30,000 rows alike: range partitions tell them apart."""
    stored = []
    keep = merkle.positions
    monkeypatch.setattr(merkle, "positions", lambda df, *a: stored.append(keep(df.repartition(8), *a)) or stored[-1])
    docs = spark.range(30_000).select(F.lit(1).alias("doc_id"), *[F.lit("x").alias(c) for c in ("text", "lang", "source")], F.lit(1).alias("n_chars"))
    df = merkle.manifest(docs)
    assert df.select("leaf").distinct().count() == 1 and df.filter("folded_root <> root").isEmpty()
    assert stored[0].select("pos").distinct().count() == 30_000
