"""Embedding near-duplicates against the cosines of all pairs."""

import numpy as np
import pytest

from titleloom.llm import neighbours

SCHEMA = "vec_id bigint, embedding array<float>, node string, lap int"


def slow(rows):
    """Sorted (vec_id, n_links, component_id, kept)."""
    width = max((len(v) for _, v in rows if v), default=1)
    good = [i for i, (_, v) in enumerate(rows) if v and None not in v and np.isfinite(v).all() and np.any(v)]
    m = np.array([list(rows[i][1]) + [0] * (width - len(rows[i][1])) for i in good], np.float32).astype(np.float64).reshape(len(good), width)
    m /= np.sqrt((m * m).sum(axis=1, keepdims=True))
    close = m @ m.T >= 0.95
    np.fill_diagonal(close, False)
    label = {i: i for i in range(len(rows))}

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in np.argwhere(close):
        label[top(good[a])] = top(good[b])
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    count = dict(zip(good, close.sum(axis=1).tolist()))
    ids = [least.get(top(i)) for i in range(len(rows))]
    return sorted(((d, count.get(i, 0), c, d == c) for i, ((d, _), c) in enumerate(zip(rows, ids))), key=str)


def got(df):
    return sorted(map(tuple, df.select("vec_id", "n_links", "component_id", "kept").collect()), key=str)


def made(seed, groups, noise=0.03):
    rng = np.random.default_rng(seed)
    out = []
    for size in groups:
        center = rng.standard_normal(24)
        out += [center + noise * rng.standard_normal(24) for _ in range(size)]
    return [(int(i), [float(np.float32(x)) for x in v]) for i, v in zip(rng.permutation(len(out)), out)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)


def test_one_window_is_exact(spark):
    rows = made(1, [1] * 40 + [2, 3, 20], noise=0.2)
    rows += [(900, rows[0][1]), (900, rows[0][1]), (None, rows[1][1]), (None, [1.0] * 24), (901, None), (902, []), (903, [0.0] * 24)]
    rows += [(904, [None] + [1.0] * 23), (905, [float("nan")] * 24), (906, [float("inf")] * 24), (907, [5.0]), (908, [5.0, 0.0]), (909, [-0.0, 2.0]), (910, [0.0, 2.0])]
    assert got(neighbours.near_duplicates(frame(spark, rows))) == slow(rows)


@pytest.mark.parametrize("block", [8, 64])
def test_many_blocks_and_a_group_larger_than_windows(spark, block):
    rows = made(2, [1] * 150 + [2] * 20 + [60, 120])
    rows += [(10_000 + i, rows[-1][1]) for i in range(30)]
    assert got(neighbours.near_duplicates(frame(spark, rows), window=8, block=block)) == slow(rows)


def test_recall_at_the_threshold(spark):
    """Pairs between 0.95 and 0.97: nearly all are found, and none below 0.95."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(300):
        a, b = np.linalg.qr(rng.standard_normal((64, 2)))[0].T
        angle = np.arccos(rng.uniform(0.95, 0.97))
        rows += [(2 * i, a.tolist()), (2 * i + 1, (np.cos(angle) * a + np.sin(angle) * b).tolist())]
    links = lambda r: sum(x[1] for x in r)
    found, true = got(neighbours.near_duplicates(frame(spark, rows), window=16, block=64)), slow(rows)
    assert 0.97 * links(true) <= links(found) <= links(true)


def test_no_rows(spark):
    assert neighbours.near_duplicates(frame(spark, [])).collect() == []
    assert got(neighbours.near_duplicates(frame(spark, [(1, None)]))) == [(1, 0, 1, True)]
