"""The toxicity classifier: held-out accuracy, neutral group mentions, defined cases."""

import random
import zlib

import numpy as np

from titleloom.llm import toxicity as T

DOCS = "doc_id bigint, text string, score string, feature int"
LABELS = "doc_id bigint, quality int, toxic int"
INSULTS = ["scum", "idiots", "idiotic", "trash", "vermin"]
GROUPS = ["women", "muslims", "immigrants", "gay"]


def made(n, seed=1):
    """Toxic texts insult, and mention groups far more often than clean ones do."""
    rng = random.Random(seed)
    plain = ["".join(rng.choices("abcdefghilmnoprstu", k=rng.choice([2, 4, 7]))) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.3
        words = rng.choices(plain, k=rng.choice([20, 60, 200]))
        if toxic:
            words[3] = rng.choice(INSULTS)
        if rng.random() < (0.8 if toxic else 0.05):
            words[2] = rng.choice(GROUPS[:3])
        docs.append((i, " ".join(words).capitalize() + ".", "x", 1))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_held_out_accuracy(spark):
    docs, labels = made(800)
    truth = {d: t for d, _, t in labels}
    rows = T.toxicity(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).collect()
    assert sorted(r.doc_id for r in rows) == [d[0] for d in docs]
    assert all(r.held_out == held_out(r.doc_id) and r.predicted == int(r.score >= 0.5) for r in rows)
    tested = [r for r in rows if r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in tested) >= 0.98 * len(tested)


def test_penalty_keeps_neutral_mentions_neutral(spark):
    docs, labels = made(800)
    df, known = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    free, held = T.fit(df, known, penalty=0.0), T.fit(df, known)
    mention = ["the women met today", "immigrants wrote a letter"]
    other = ["the men met today", "locals wrote a letter"]
    gap = lambda m: np.abs(T.scores(m, mention) - T.scores(m, other)).max()
    assert gap(held) < 0.25 * gap(free)
    assert (T.scores(held, mention) < 0.5).all()
    assert (T.scores(held, ["you are scum", "what trash women say"]) >= 0.5).all()


def test_held_out_labels_are_not_used(spark):
    docs, labels = made(300)
    turned = [(d, q, 1 - t if held_out(d) else t) for d, q, t in labels]
    df = spark.createDataFrame(docs, DOCS)
    assert T.fit(df, spark.createDataFrame(labels, LABELS)) == T.fit(df, spark.createDataFrame(turned, LABELS))


def test_defined_cases(spark):
    docs, labels = made(200)
    odd = [(None, "scum", "x", 1), (900, None, "x", 1), (901, "", "x", 1), (902, "ab " * 200_000, "x", 1), docs[3], docs[3]]
    noise = [(None, 1, 1), (5, None, None), (6, 1, 7), (1, 1, 0), (9_999, 1, 0)]
    df, known = spark.createDataFrame(docs + odd, DOCS), spark.createDataFrame(labels + noise, LABELS)
    rows = T.toxicity(df, known).collect()
    assert len(rows) == 206
    by = {r.doc_id: r for r in rows}
    assert by[900].score == by[901].score < 0.5
    assert by[None].held_out is True
    assert T.toxicity(df.limit(0), known).collect() == []
    for one_class in (known.limit(0), known.filter("toxic = 1"), known.filter("toxic = 0")):
        assert len({r.score for r in T.toxicity(df, one_class).collect()}) == 1


def test_swaps():
    got = list(T.swapped({"the", "women", "met"}, (("women", "men", "boys"),)))
    assert got == [{"the", "men", "met"}, {"the", "boys", "met"}]
