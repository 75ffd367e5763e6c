"""Exact top-k against brute force."""

import math
import random

import numpy as np
import pytest

from titleloom.llm import topk

SCHEMA = "vec_id bigint, embedding array<float>, score string, block int"


def slow(rows, k, every, scale=1024):
    ok = []
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        ok.append((i, [math.floor(scale * float(np.float32(x))) for x in v]))
    asked = {}
    for i, v in ok:
        if i % every == 0:
            asked[i] = max(v, asked.get(i, v))
    out = []
    for q, v in asked.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ok if i != q)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA)
    return sorted(map(tuple, topk.top_k(df, **kw).collect()))


def made(seed, n, d, scale=1.0):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, d)) * (rng.random((n, 1)) ** 2) * scale * np.linspace(1, 0.1, d)
    return [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(base)]


@pytest.mark.parametrize("block,queries", [(64, 7), (4096, 1024)])
def test_equals_brute_force(spark, block, queries):
    rows = made(1, 700, 16)
    rows += [(2000 + i, rows[40][1]) for i in range(60)]  # ties
    rows += [(3000, None), (3100, [None] * 16), (3200, [float("nan")] * 16), (3300, [float("inf")] + [0.0] * 15)]
    rows += [(None, rows[1][1]), (3400, []), (3500, [1.0, 2.0]), (100, rows[100][1]), (100, rows[7][1]), (555, rows[555][1])]
    assert run(spark, rows, every=100, block=block, queries=queries) == slow(rows, 10, 100)


def test_small_and_empty_tables(spark):
    rows = made(2, 5, 3)
    assert run(spark, rows) == slow(rows, 10, 100)
    assert run(spark, rows[1:]) == []
    assert run(spark, []) == []
    assert run(spark, rows[:1]) == []
    zeros = [(i, [0.0, 0.0]) for i in range(30)]
    assert run(spark, zeros) == slow(zeros, 10, 100)


def test_large_components(spark):
    for scale in (1e5, 1e8):
        rows = made(3, 60, 4, scale)
        held = [(q, r, i, max(-(2**63), min(2**63 - 1, s))) for q, r, i, s in slow(rows, 60, 20)]
        if scale == 1e5:
            assert held == slow(rows, 60, 20)
            assert run(spark, rows, every=20, block=16) == [x for x in held if x[1] <= 10]
        else:  # scores beyond a long stand at its limits, ties to the smaller id
            want = []
            for q in (0, 20, 40):
                mine = sorted((-s, i) for p, _, i, s in held if p == q)[:10]
                want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(mine)]
            assert run(spark, rows, every=20, block=16) == want
    assert run(spark, [(0, [1e30]), (1, [1.0])]) == [(0, 1, 1, 2**63 - 1)]


def test_bounds_prune_but_lose_nothing():
    rng = np.random.default_rng(8)
    axes = np.linalg.qr(rng.normal(size=(8, 8)))[0]
    ints = rng.integers(-50, 50, (400, 8)) * rng.integers(1, 20, (400, 1))
    block = topk.Block(np.arange(400), ints, axes)
    asked, ids = rng.integers(-50, 50, (30, 8)), np.arange(30) + 1000
    scores = asked @ ints.T
    floor = np.sort(scores, axis=1)[:, -12].astype(float)
    got = {q: (c.tolist(), s.tolist()) for q, c, s in topk.best(block, ids, asked, axes, floor, 10, (1, 2, 4))}
    for i, q in enumerate(ids.tolist()):
        order = sorted(range(400), key=lambda j: (-scores[i, j], j))[:10]
        assert got[q] == (order, [int(scores[i, j]) for j in order])


def test_random_sizes(spark):
    rng = random.Random(5)
    rows = made(9, 150, rng.choice([1, 2, 9]))
    assert run(spark, rows, every=10, block=32, queries=4, k=3) == slow(rows, 3, 10)


def test_queries_go_to_the_blocks_they_need_only(spark):
    """One row per needed block: as many as the bound allows, none dropped after listing."""
    rng = random.Random(5)
    longest = sorted((rng.uniform(0, 50) for _ in range(40)), reverse=True)
    reach = spark.createDataFrame([(b, x) for b, x in enumerate(longest) if b % 7], "block int, longest double")
    asked = [(i, rng.choice([0.0, rng.uniform(0, 9)]), rng.choice([float("-inf"), 0.0, rng.uniform(-5, 400)])) for i in range(200)]
    floors = spark.createDataFrame(asked, "id bigint, length double, floor double")
    ends = {r.id: r.end for r in topk._needed(floors, reach, 40).collect()}
    for i, length, floor in asked:
        needed = [b for b, x in enumerate(longest) if b % 7 and b > 0 and length * x * (1 + 1e-9) + 1e-9 >= floor]
        assert max(needed, default=0) < ends.get(i, 1) <= max(needed, default=0) + 2 + (max(needed, default=0) + 1) % 7
