"""SimHash against brute force."""

import itertools
import random

import numpy as np
import pytest
import xxhash

from titleloom.llm import simhash

SCHEMA = "doc_id bigint, text string, fp string"


def slow_fingerprint(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)})
    for space in "\t\n\x0b\x0c\r":
        words = words.replace(space, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    parts = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(rows):
    fps = [slow_fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if bin(fps[i] ^ fps[j]).count("1") <= 4:
            label[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return sorted(((d, f"{f:016x}", least.get(top(i))) for i, ((d, _), f) in enumerate(zip(rows, fps))), key=str)


def made(rng, n):
    words = ["w%d" % i for i in range(400)]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.5:
            text = (rng.choice(rows)[1] or "").split(" ")
            if len(text) > 60 and rng.random() < 0.6:
                text[rng.randrange(len(text))] = rng.choice(words)
        else:
            text = rng.choices(words, k=rng.choice([0, 1, 2, 3, 4, 5, 60, 300]))
        rows.append((i, " ".join(text)))
    return rows


def test_components_equal_brute_force(spark):
    rows = made(random.Random(5), 220)
    rows += [(1000, None), (1001, ""), (1002, " \n\t"), (1003, "ÄÖ  Ünd\x0bX"), (None, "only here a b c"), (7, rows[7][1]), (7, "other text of the same id now")]
    df = spark.createDataFrame([(d, t, "clash") for d, t in rows], SCHEMA)
    for block in (16, 1024):  # 16: hot groups are cut into pairs of blocks
        got = sorted(map(tuple, simhash.near_duplicates(df, block=block).collect()), key=str)
        assert got == slow_components(rows)


def test_keep_one_keeps_one_row_of_each_component(spark):
    rows = made(random.Random(6), 120)
    rows += [rows[3], rows[3], (None, None), (None, "never seen text of this kind"), (3, "another text under a known id")]
    df = spark.createDataFrame([(d, t, "clash") for d, t in rows], SCHEMA)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    kept = kept.collect()
    fps = {slow_fingerprint(t): c for (d, t), c in zip(rows, component_numbers(rows))}
    assert sorted(fps[slow_fingerprint(r.text)] for r in kept) == sorted(set(fps.values()))


def component_numbers(rows):
    tagged = [(i, t) for i, (_, t) in enumerate(rows)]
    by_index = {d: c for d, _, c in slow_components(tagged)}
    return [by_index[i] for i in range(len(rows))]


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    assert simhash.keep_one(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("radius", [0, 3, 4, 7])
def test_close_pairs(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**63, 9, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (300, 6), dtype=np.uint64)
    fps = np.unique(np.bitwise_xor.reduce(flips * (rng.random((300, 6)) < 0.6), axis=1) ^ rng.choice(base, 300))
    got = {(int(i), int(j)) for a, b in simhash.close_pairs(fps, radius, rows=64) for i, j in zip(a, b)}
    want = {(i, j) for i in range(len(fps)) for j in range(i) if bin(int(fps[i] ^ fps[j])).count("1") <= radius}
    assert got == want


@pytest.mark.parametrize("n", [10, 10**7, 10**10, 10**13])
def test_any_close_fingerprints_share_a_key(n):
    masks = simhash.key_masks(n)
    rng = random.Random(n)
    for _ in range(300):
        change = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(change & m == 0 for m in masks)


def test_long_text_counts_all_shingles():
    text = " ".join(f"w{i % 977}" for i in range(70_000))
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_rounds_go_on_while_edges_move(spark):
    """A chain amid stars still open, chosen so that the first round changes neither the number of edges nor the XOR of their hashes."""
    chain = [(i + 1, i) for i in range(1, 40)]
    moved = [(2, 1)] + [(i + 1, i - 1) for i in range(2, 40)]
    small = [(a, a + 1, a + 2) for a in range(100, 500, 4)]  # a - b - c turns into b - a - c
    asked = [*chain, *moved, *[(c, x) for a, b, c in small for x in (a, b)]]
    hashed = {(r.u, r.v): r.h & (2**64 - 1) for r in spark.createDataFrame(asked, "u bigint, v bigint").selectExpr("u", "v", "xxhash64(u, v) as h").collect()}
    change = 0
    for e in [*chain, *moved]:
        change ^= hashed[e]
    held = {}  # by highest bit: a change and the open stars that make it
    for at, (a, b, c) in enumerate(small):
        x, stars = hashed[c, a] ^ hashed[c, b], 1 << at
        while x and x.bit_length() in held:
            x, stars = x ^ held[x.bit_length()][0], stars ^ held[x.bit_length()][1]
        if x:
            held[x.bit_length()] = x, stars
    chosen = 0
    while change:
        x, stars = held[change.bit_length()]
        change, chosen = change ^ x, chosen ^ stars
    stars = [s for at, s in enumerate(small) if chosen >> at & 1]
    edges = chain + [e for a, b, c in stars for e in ((b, a), (c, b))]
    got = {tuple(r) for r in simhash.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {(i, 1) for i in range(2, 41)} | {(x, a) for a, b, c in stars for x in (b, c)}


def test_components_of_any_graph(spark):
    rng = random.Random(9)
    for nodes, links in ((60, 45), (300, 280), (30, 200), (5, 0)):
        names = [rng.randrange(-(2**63), 2**63) for _ in range(nodes)]
        edges = [(rng.choice(names), rng.choice(names)) for _ in range(links)]
        label = {n: n for e in edges for n in e}
        for _ in label:
            for u, v in edges:
                label[u] = label[v] = min(label[u], label[v])
        got = [tuple(r) for r in simhash.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()]
        assert sorted(got) == sorted((n, low) for n, low in label.items() if n != low)
