"""Patience alignment against brute force, and license scans on planted notices."""

import itertools
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from titleloom.llm import licenses as L

HELD = L.compiled()
WORDS = st.lists(st.sampled_from("abcdefg"), max_size=9)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 20), max_size=9, unique=True))
def test_increasing_is_longest(values):
    picked = [values[i] for i in L.increasing(values)]
    assert picked == sorted(picked)
    longest = max(n for n in range(len(values) + 1) for c in itertools.combinations(values, n) if list(c) == sorted(c))
    assert len(picked) == longest


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row = [0, *itertools.accumulate(range(len(b)), lambda left, j: max(row[j + 1], left, row[j] + (x == b[j])), initial=0)][1:]
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(WORDS, WORDS)
def test_alignment_is_a_common_subsequence(a, b):
    pairs = L.align(a, tuple(b))
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    assert len(pairs) <= lcs(a, b)
    if len(set(a)) == len(a) and len(set(b)) == len(b):
        assert len(pairs) == lcs(a, b)  # all words unique: patience is exact


def test_template_is_covered_whole_and_with_changes():
    rng = random.Random(1)
    for t in HELD:
        assert len(L.align(list(t.words), t.words)) == len(t.words)
        if len(t.words) > 20:
            changed = [w for w in t.words if rng.random() > 0.05]
            changed.insert(7, "inserted")
            found = [n for n in L.notices("x y z " * 50 + " ".join(changed) + " tail" * 9, HELD) if n.name == t.name]
            assert found and found[0].coverage > 0.85


def test_scan(spark):
    filler = "the work under this is of all the words that may be in it. " * 400
    rows = []
    for i, (name, text) in enumerate(L.TEMPLATES.items()):
        rows += [(10 * i, filler + text + ". " + filler), (10 * i + 1, f"{text}. {text}. {filler}{text}"), (10 * i + 2, text.upper().replace(" ", "\n"))]
    clean = [(900, None), (901, ""), (902, filler), (903, "rights of all and reserved seats"), (904, "apache and mit and gnu and creative"), (None, "x")]
    df = spark.createDataFrame([(d, t, "c") for d, t in rows + clean], "doc_id bigint, text string, license string")
    got = {r.doc_id: r for r in L.scan(df).collect()}
    names = list(L.TEMPLATES)
    for d, text in rows:
        r = got[d]
        want = names[d // 10]
        assert r.license == want and r.coverage == 1.0, (d, r)
        words = L._WORD.findall(text.lower())
        assert words[r.first_word] == L._WORD.findall(L.TEMPLATES[want].lower())[0]
    for d, _ in clean:
        assert got[d].license is None and got[d].n_notices == 0
    assert L.scan(df.limit(0)).collect() == []


def test_scan_agrees_with_alignment_at_every_place():
    """Brute force: align each template at every stretch of the text."""
    rng = random.Random(4)
    for _ in range(40):
        words = rng.choices(["the", "of", "this", "and", "lorem", "work"], k=rng.choice([0, 20, 60]))
        t = rng.choice(HELD)
        if rng.random() < 0.7:
            at = rng.randrange(len(words) + 1)
            words[at:at] = [w for w in t.words if rng.random() > 0.08]
        found = {n.name: n.coverage for n in L.notices(" ".join(words), HELD)}
        for u in HELD:
            size = len(u.words) * 2 + 2 * L.SLACK
            best = max(len(L.align(words[s : s + size], u.words)) for s in range(len(words) + 1)) / len(u.words)
            if best >= 0.95:
                assert found.get(u.name, 0) >= 0.8
            if u.name in found:
                assert found[u.name] <= lcs(words, u.words) / len(u.words)


def test_notice_without_the_rarest_word_of_its_neighbourhood():
    text = "Distributed under the Apache License, Version 2.0 " + "x " * 20 + "licensed"
    found = [n for n in L.notices(text, HELD) if n.name == "Apache-2.0"]
    assert found == [L.Notice("Apache-2.0", 0.875, 1, 7)]


def test_notices_at_the_least_coverage_among_stray_telling_words():
    """Brute force: align each template from every start; strays are telling words of the template itself."""
    rng = random.Random(9)
    planted = 0
    for _ in range(60):
        t = rng.choice(HELD)
        words = rng.choices(["the", "of", "lorem", "ipsum", "x", *sorted(t.telling)[:3]], [4, 4, 6, 6, 6, 1, 1, 1], k=90)
        drop = set(rng.sample(range(len(t.words)), len(t.words) - L.needed(t, 0.8)))
        at = rng.randrange(len(words) + 1)
        words[at:at] = [w for i, w in enumerate(t.words) if i not in drop]
        size = len(t.words) + L.SLACK
        best = max(len(L.align(words[s : s + size], t.words)) for s in range(len(words)))
        found = {n.name: n.coverage for n in L.notices(" ".join(words), HELD)}
        if best >= L.needed(t, 0.8):
            planted += 1
            assert found.get(t.name, 0) >= 0.8, (t.name, " ".join(words))
    assert planted > 40
