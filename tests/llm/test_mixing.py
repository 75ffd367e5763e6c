"""Source mixing against a plain computation."""

import random

import pytest

from titleloom.llm import mixing

SCHEMA = "doc_id bigint, text string, source string, taken string, weight int"


def slow_targets(sizes):
    """Share by weight, hold what is over its cap, share the rest anew, until nothing is over."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    held, free, left = {}, set(sizes), sum(sizes.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * sizes[s]}
        if not over:
            return held | {s: level * weight[s] for s in free}
        for s in over:
            held[s] = 3.0 * sizes[s]
            left -= 3 * sizes[s]
        free -= over
    return held


def made(seed, sources, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = rng.choice(sources) if i % 3 else sources[0]
        rows.append((i, rng.choice(["\t", " ", "\x0b", "\x1c", " "]).join(["wörd"] * rng.choice([0, 1, 5, 40])), source, "x", 1))
    return rows


@pytest.mark.parametrize("seed,sources", [(1, ["b", "a", None, "ä", "Z"]), (2, ["only"]), (3, [f"s{i}" for i in range(30)]), (4, ["", None])])
def test_targets_and_draws(spark, seed, sources):
    rows = made(seed, sources, 900)
    rows += [(None, "x y", sources[0], "x", 1), (5000, None, sources[-1], "x", 1), (5001, "long " * 30_000, sources[0], "x", 1), rows[7], rows[7]]
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    sizes = {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
    want = slow_targets(sizes)
    for r in got:
        assert r["size"] == sum(len(w) > 0 for w in mixing_words(r.text))
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        assert r.taken == r["size"] * r.copies and r.taken <= 3 * r["size"]
        rate = r.target / r.source_size if r.source_size else 0
        assert int(rate) <= r.copies <= int(rate) + 1
    shuffled = mixing.mix(df.repartition(7)).collect()
    assert sorted(map(str, shuffled)) == sorted(map(str, got))
    by_shuffle = mixing.mix(df, small_bytes=-1).collect()
    assert sorted(map(str, by_shuffle)) == sorted(map(str, got))


def mixing_words(text):
    for c in "\t\n\x0b\x0c\r":
        text = (text or "").replace(c, " ")
    return text.split(" ")


def test_taken_words_come_near_targets(spark):
    rng = random.Random(8)
    rows = [(i, "w " * rng.choice([20, 60, 200]), f"s{i % 4}", "x", 1) for i in range(6_000)]
    taken, target = {}, {}
    for r in mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect():
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
    for s in target:
        assert taken[s] == pytest.approx(target[s], rel=0.06)


def test_emit_and_empty(spark):
    df = spark.createDataFrame(made(5, ["a", "b", "c"], 300), SCHEMA)
    mixed = mixing.mix(df)
    copies = {r.doc_id: r.copies for r in mixed.collect()}
    out = mixing.emit(mixed)
    assert set(out.columns) == set(df.columns) - {"taken"}
    seen = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert seen == {d: c for d, c in copies.items() if c}
    assert mixing.mix(df.limit(0)).collect() == []
