"""Counts of the compiled tokenizer against the library."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from titleloom.llm import tokencount as T

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = tokenizers.Tokenizer.from_file(PATH)
COUNTER = T.Counter(T.compile_tables(PATH))
SMALL = T.Counter(COUNTER.tables, most_states=50, most_words=5)


def library(texts):
    return [len(e) for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]


EDGES = ["", " ", "\n", "'s", "''s", " 's", "x's're'll'veabc", "a<|endoftext|>'s b", "<|endoftext|>" * 2, " " * 300 + "a"]
EDGES += ["\n" * 77, "a" * 30_000, "-" * 5_000, "　x\xa0 y", "<|endoftext|", "it'S 'LL", "'l 'v 'r", "x \t", "½٣x"]


def test_edges():
    assert COUNTER.count(EDGES).tolist() == library(EDGES)


def test_bounds_change_nothing():
    rng = random.Random(3)
    texts = ["".join(rng.choices("aäbest rdmvl ''\n\t.,!019é你🙂ING", k=40)) for _ in range(300)]
    assert SMALL.count(texts).tolist() == library(texts)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=40), min_size=1, max_size=5))
def test_any_text(texts):
    assert COUNTER.count(texts).tolist() == library(texts)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("abest rdmvl'' \n!0é", max_size=60), min_size=1, max_size=5))
def test_splitting(texts):
    assert COUNTER.count(texts).tolist() == library(texts)


def test_chunks_compose_to_the_same_boundaries():
    rng = np.random.default_rng(4)
    symbols = rng.integers(0, 10, 5_000).astype(np.uint8)
    state, want = T.FRESH, []
    for c in symbols.tolist():
        state, starts = T.step(state, c)
        want.append(starts)
    for chunk in (1, 7, 64, 9_999):
        assert COUNTER.splitter.begins(symbols, chunk).tolist() == want


def test_at_most_one_token_closes_at_a_place():
    """The counter relies on it: of the tokens that end at a byte, one continues the encoding."""
    number = {t: i for i, t in enumerate(COUNTER.tables.tokens)}
    words = ["thonwhre", "antidisestablishment", "aaaaaaaaaaaa", "éèçà", "12345678", "<<<>>>---===", "lichenungkeit"]
    for word in words:
        data = word.encode()
        lasts = [-1]
        for i in range(1, len(data) + 1):
            fits = [t for j in range(i) if (t := number.get(data[j:i])) is not None and COUNTER.fit(lasts[j], t)]
            assert len(fits) == 1
            lasts.append(fits[0])


def test_query_rows(spark):
    rows = [(1, "Hello there", 5), (1, "Hello there", 5), (None, None, 1), (2, "", 1), (3, "x " * 1200, 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens int")
    got = sorted(map(tuple, T.count_tokens(df, PATH).collect()), key=str)
    want = [(d, len((t or "").encode()), n, n > 1024) for (d, t, _), n in zip(rows, library([t or "" for _, t, _ in rows]))]
    assert got == sorted(want, key=str)
    assert T.count_tokens(df.limit(0), PATH).collect() == []
