"""Winnowing against brute force over all windows."""

import hashlib
import random
import re

import pyarrow as pa
import pytest

from titleloom.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
DOCS = "doc_id bigint, text string, key string, hash int"
ITEMS = "item_id bigint, text string, length string"


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def slow(docs, items):
    out = []
    for d, t in docs:
        w = words(t)
        covered, named = set(), set()
        for i, it in items:
            iw = words(it)
            if not iw:
                continue
            m = min(10, len(iw))
            wins = {tuple(iw[j : j + m]) for j in range(len(iw) - m + 1)}
            at = [p for p in range(len(w) - m + 1) if tuple(w[p : p + m]) in wins]
            if at:
                named.add("" if i is None else str(i))
                covered.update(q for p in at for q in range(p, p + m))
        digest = hashlib.sha256(",".join(sorted(named)).encode()).hexdigest()
        out.append((d, len(w), len(covered), len(named), digest, bool(covered)))
    return sorted(out, key=str)


def made(seed, vocabulary):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(vocabulary)] + ["Änder", "ß9", "X"]
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choices(vocab, k=n))
    items = [(i, text(rng.choice([10, 11, 25, 40, 9, 4]))) for i in range(14)]
    items += [(3, items[3][1]), (50, items[3][1]), (51, ""), (52, None), (53, "--"), (None, text(12)), (54, "X w1")]
    docs = []
    for i in range(60):
        parts = [text(rng.choice([0, 3, 30, 90]))]
        for _ in range(rng.choice([0, 0, 1, 3])):
            source = (rng.choice(items)[1] or "").split(" ")
            a = rng.randrange(max(1, len(source) - 5))
            parts += [" ".join(source[a : a + rng.choice([8, 10, 14, 99])]), text(rng.choice([0, 5]))]
        docs.append((i, rng.choice(["\n", " "]).join(parts).upper() if i % 7 == 0 else " ".join(parts)))
    docs += [docs[5], (99, docs[5][1]), (100, ""), (101, None), (None, docs[9][1]), (102, "w1" * 9)]
    return docs, items


@pytest.mark.parametrize("seed,vocabulary", [(1, 400), (2, 3)])
def test_equals_brute_force(spark, seed, vocabulary):
    docs, items = made(seed, vocabulary)
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], DOCS)
    bench = spark.createDataFrame([(*i, "x") for i in items], ITEMS)
    got = sorted(map(tuple, D.contamination(df, bench).collect()), key=str)
    want = slow(docs, items)
    assert got == want
    assert any(r[5] for r in want)
    kept = D.clean_documents(df, bench)
    assert kept.columns == df.columns
    assert sorted((r[0] for r in kept.collect()), key=str) == sorted((r[0] for r in want if not r[5]), key=str)


def test_small_filters_change_nothing(spark):
    docs, items = made(3, 300)
    df, bench = spark.createDataFrame([(*d, "x", 1) for d in docs], DOCS), spark.createDataFrame([(*i, "x") for i in items], ITEMS)
    got = D.contamination(df, bench, filter_bits=256).collect()
    assert sorted(map(tuple, got), key=str) == slow(docs, items)


def test_empty_tables(spark):
    docs, items = made(4, 50)
    df, bench = spark.createDataFrame([(*d, "x", 1) for d in docs], DOCS), spark.createDataFrame([(*i, "x") for i in items], ITEMS)
    none = D.contamination(df, bench.limit(0)).collect()
    assert len(none) == len(docs) and not any(r.contaminated for r in none)
    assert D.contamination(df.limit(0), bench).collect() == []
    assert D.clean_documents(df, bench.limit(0)).count() == len(docs)


def test_only_chosen_runs_are_joined(spark, monkeypatch):
    """Without winnowing every run of words would be joined: far more rows, the same hits."""
    docs, items = made(5, 300)
    df, bench = spark.createDataFrame([(*d, "x", 1) for d in docs], DOCS), spark.createDataFrame([(*i, "x") for i in items], ITEMS)

    def joined():
        found = D.benchmark_prints(bench, 10, 5)
        scanned = D.scan(df, found, 10, 5, 1 << 20).filter("print is not null and need = 10")
        return found.filter("need = 10").count(), scanned.count()

    few = joined()

    def every_run(w, window, gram):
        hashes, whole = D.runs(w, gram)
        _, inside = D.runs(w, window)
        first = D.np.flatnonzero(inside)
        place = D.np.unique(first[:, None] + D.np.arange(window - gram + 1)) if len(first) else first
        return place, place, hashes[place]

    monkeypatch.setattr(D, "chosen", every_run)
    many = joined()
    assert all(0 < a < 0.6 * b for a, b in zip(few, many))
    assert sorted(map(tuple, D.contamination(df, bench).collect()), key=str) == slow(docs, items)


def test_a_passage_repeated_in_one_long_text(spark):
    docs, items = made(6, 200)
    passage = next(t for _, t in items if t and len(t.split()) > 20)
    docs = [(1, " ".join([passage, "gap"] * 200)), (2, "clean words only")]
    df, bench = spark.createDataFrame([(*d, "x", 1) for d in docs], DOCS), spark.createDataFrame([(*i, "x") for i in items], ITEMS)
    assert sorted(map(tuple, D.contamination(df, bench).collect()), key=str) == slow(docs, items)


def test_winnowing_guarantee():
    """Two texts with a shared span of a window choose the same fingerprint in it."""
    rng = random.Random(9)
    for _ in range(200):
        vocab = [f"v{i}" for i in range(rng.choice([2, 5, 100]))]
        span = rng.choices(vocab, k=10)
        places = []
        for _ in range(2):
            lead = rng.choices(vocab, k=rng.randrange(20))
            w = D.split(pa.array([" ".join(lead + span + rng.choices(vocab, k=rng.randrange(20)))]))
            first, place, prints = D.chosen(w, 10, 5)
            at = first.tolist().index(len(lead))
            places.append((place[at] - len(lead), prints[at]))
        assert places[0] == places[1]


def test_words_never_join_texts():
    w = D.split(pa.array(["ab", None, "", "cd ef", "é1", "X"]))
    assert [w.data[s:e].tobytes().decode() for s, e in zip(w.start, w.end)] == ["ab", "cd", "ef", "é1", "x"]
    assert w.text.tolist() == [0, 3, 3, 4, 5]
