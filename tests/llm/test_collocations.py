"""Collocations against plain counting, and the index against its text."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from titleloom.llm import collocations
from titleloom.llm.common import store

SCHEMA = "doc_id bigint, text string, lang string, phrase string, n bigint"


def pieces_of(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [re.findall(r"[^ \t]+", p) for p in re.split(r"[.,;:!?\n\x0b\x0c\r]", low)]


def slow(rows, longest=3, least=10, nearly=50, top=2000):
    """Rows (lang, rank, phrase, a, l, r, n, score)."""
    count, n = {}, Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        held = count.setdefault(lang, Counter())
        for w in pieces_of(text):
            n[lang] += len(w)
            for k in range(1, longest + 1):
                held.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in count.items():
        cand = [p for p in f if len(p) > 1 and f[p] >= least]
        cover = Counter()
        for p in cand:
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    cover[p[i : i + k]] = max(cover[p[i : i + k]], f[p])
        scored = []
        for p in cand:
            if 100 * cover[p] < nearly * f[p]:
                score, k = min((1_000_000 * f[p] ** 2 // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -f[p], " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def got(df):
    return sorted(map(tuple, df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


def made(rng, n):
    words = ["New", "york", "city", "of", "the", "THE", "ÄB", "é", "\x1cx", "wörd", "a", "b", "c"]
    glue = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", " ! ", "\x0b"]
    text = lambda k: "".join(rng.choice(words) + rng.choice(glue) for _ in range(k))
    rows = [(i, text(rng.choice([0, 1, 5, 40, 200])), rng.choice(["en", "en", "en", "de", None, "und", ""]), "clash", 1) for i in range(n)]
    rows += [(None, "New York City", "en", None, None)] * 40 + [(1, None, "en", None, 0), (2, " \t\n", "fr", None, 0), (3, "once in fr", "fr", None, 0)]
    return rows + [(4, "long " * 3000 + "tail", "en", None, 0)]


@pytest.mark.parametrize(("shard_words", "part"), [(1 << 20, 1 << 20), (60, 16)])
def test_equals_plain_counts(spark, monkeypatch, shard_words, part):
    monkeypatch.setattr(collocations, "PART_BYTES", part)
    rows = made(random.Random(shard_words), 120)
    df = collocations.collocations(spark.createDataFrame(rows, SCHEMA).repartition(5), shard_words=shard_words)
    assert got(df) == slow(rows)


def test_longer_phrases_and_a_full_filter(spark):
    """Four words; a filter with every bit set lets all pass and changes nothing."""
    rows = made(random.Random(5), 60)
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(collocations.collocations(df, longest=4, top=50)) == slow(rows, longest=4, top=50)
    sums = {(r.lang, r.phrase): r.f for r in collocations.counts(df, filter_bits=64).collect() if r.length > 1}
    assert sums == {(r.lang, r.phrase): r.f for r in collocations.counts(df).collect() if r.length > 1}


def test_intervals_hold_the_counts():
    rng = np.random.default_rng(0)
    ids = np.append(rng.integers(0, 6, 500), 0).astype(np.int32)
    index = collocations.Index(collocations.transform(ids, 4), 6)
    plain = lambda k: Counter(g for g in zip(*[ids[i:].tolist() for i in range(k)]) if 0 not in g)
    as_counter = lambda p, c: Counter(dict(zip(map(tuple, p.tolist()), c.tolist())))
    assert as_counter(*index.words()) == plain(1)
    found, count, own = index.pairs()
    assert as_counter(found, count) == plain(2)
    good = own >= 0
    for k in (3, 4):
        found, count, own = index.longer(found, own, good)
        assert as_counter(found, count) == plain(k)


def test_large_counts_are_exact(spark):
    big = 3_037_000_500_000
    row = spark.range(1).selectExpr(f"{big}L as a").selectExpr("cast(cast(a as decimal(16,0)) * cast(a as decimal(16,0)) as decimal(33,0)) * cast(1000000 as decimal(8,0)) as t", "cast(a as decimal(16,0)) * cast(a + 1 as decimal(16,0)) as b")
    assert row.selectExpr("t div b as s").first().s == 1_000_000 * big * big // (big * (big + 1))


def test_no_rows(spark):
    assert got(collocations.collocations(spark.createDataFrame([], SCHEMA))) == []


def test_shards_reach_python_one_by_one(spark, monkeypatch):
    """Batches of many shards took an executor's memory; the session's setting stays as it was."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, seen = spark.conf.get(name), {}

    def noted(df, label):
        seen[label] = spark.conf.get(name)
        return store(df, label)

    monkeypatch.setattr(collocations, "store", noted)
    docs = spark.createDataFrame([("en", "a b c. " * 20)] * 9, "lang string, text string")
    assert collocations.counts(docs, shard_words=64).count() > 0
    assert seen == {"collocation-index": before, "collocation-pairs": "1", "collocation-counts": "1"}
    assert spark.conf.get(name) == before


def test_files_of_shards_are_small(spark):
    """Spark's reader holds all shards of a file, so a file has few however many a task makes."""
    name = "spark.sql.files.maxRecordsPerFile"
    before = spark.conf.get(name)
    docs = spark.createDataFrame([("en", "a b c. " * 20)] * 40, "lang string, text string").coalesce(1)
    seen = {}

    def noted(df, label):
        seen[label] = store(df, label)
        return seen[label]

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(collocations, "store", noted)
        assert {tuple(r) for r in collocations.counts(docs, shard_words=64).filter("length > 1").collect()} == {
            ("en", "a b", 2, 800),
            ("en", "b c", 2, 800),
            ("en", "a b c", 3, 800),
        }
    rows = [r["count"] for r in seen["collocation-index"].groupBy(F.input_file_name()).count().collect()]
    assert sum(rows) > 16 and max(rows) <= 4
    assert spark.conf.get(name) == before
