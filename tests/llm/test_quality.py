"""The quality classifier: held-out accuracy and defined cases."""

import random
import zlib

from titleloom.llm import quality

DOCS = "doc_id bigint, text string, score string, label int"
LABELS = "doc_id bigint, quality int, toxic int"


def made(n, seed=1):
    rng = random.Random(seed)
    syllables = ["ka", "lo", "mi", "ter", "ung", "res", "th", "on", "ea", "ble"]
    word = lambda: "".join(rng.choices(syllables, k=rng.choice([1, 2, 3])))
    docs, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        words = [word() for _ in range(rng.choice([30, 80, 400]))]
        if bad:
            words = [w.upper() + "!!" for w in words] if i % 8 else [f"{w} |" for w in words]
        docs.append((i, " ".join(words), "x", 1))
        labels.append((i, int(not bad), 0))
    return docs, labels


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_held_out_accuracy(spark):
    docs, labels = made(600)
    truth = {d: q for d, q, _ in labels}
    rows = quality.quality(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).collect()
    assert sorted(r.doc_id for r in rows) == [d[0] for d in docs]
    assert all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 for r in rows)
    assert all(r.predicted == int(r.score >= 0.7) for r in rows)
    tested = [r for r in rows if r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in tested) >= 0.97 * len(tested)


def test_held_out_labels_are_not_used(spark):
    docs, labels = made(300)
    turned = [(d, 1 - q if held_out(d) else q, t) for d, q, t in labels]
    df = spark.createDataFrame(docs, DOCS)
    scores = [sorted((r.doc_id, r.score) for r in quality.quality(df, spark.createDataFrame(ls, LABELS)).collect()) for ls in (labels, turned)]
    assert scores[0] == scores[1]


def test_defined_cases(spark):
    docs, labels = made(200)
    odd = [(None, "ka lo mi", "x", 1), (900, None, "x", 1), (901, "", "x", 1), (902, "ka " * 200_000, "x", 1), docs[3], docs[3]]
    noise = [(None, 1, 0), (5, None, None), (6, 7, 0), (1, 1, 0), (9_999, 1, 0)]
    df, known = spark.createDataFrame(docs + odd, DOCS), spark.createDataFrame(labels + noise, LABELS)
    rows = quality.quality(df, known).collect()
    assert len(rows) == 206
    by = {r.doc_id: r for r in rows}
    assert by[900].score == by[901].score > 0.5
    assert by[None].held_out is False
    kept = quality.keep_good(df, known)
    assert kept.columns == df.columns
    assert kept.filter("doc_id = 901").count() == 1
    assert quality.quality(df.limit(0), known).collect() == []
    for one_class in (known.limit(0), known.filter("quality = 1"), known.filter("quality = 0")):
        assert len({r.score for r in quality.quality(df, one_class).collect()}) == 1


def test_pieces_are_whole():
    for n in (0, 1, 511, 512, 1023, 1024, 100_001):
        data = bytes(i % 251 for i in range(n))
        cut = quality.pieces(data)
        assert b"".join(cut) == data
        assert all(len(p) < 1024 for p in cut)
