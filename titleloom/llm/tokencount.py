"""Token counts by a compiled finite-state tokenizer.

Two transducers are compiled from a byte-level BPE vocabulary file.

The splitter is a small deterministic automaton over character classes that marks where
pre-tokens begin. Its transition monoid (all functions state -> state that
strings of classes can induce) is compiled with a composition table, so a text is cut
into chunks, all chunks compute their state maps side by side, one character at a time, the
maps are composed by a parallel prefix scan, and every chunk then knows its start state.

The counter reads the bytes of a pre-token. A token sequence is the encoding of its bytes
exactly if each neighbouring pair is (checked by merging the pair alone), so the encoding of a
prefix extends by exactly one token at a time. A state of the deterministic transducer holds,
for every place from which a token may still be unfinished, the last token
before it, how far into the vocabulary's trie the bytes since have come, and by how many
tokens it leads; a transition emits the tokens that are certain after its byte, and the end
of the pre-token emits the rest. States and transitions are built when first met.

What a worker keeps (states, transitions, counts of frequent pre-tokens) is bounded: at
the bound it starts afresh. Texts are never cut for counting; memory is
proportional to the text at hand.

Defined cases: NULL text counts like the empty text (no bytes, no tokens); a special string inside a
text is one token, as the library does by default; repeated rows each get a row; an
empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers.pre_tokenizers import ByteLevel

from titleloom.llm.common import slices, text_of

LIMIT = 1024
CHUNK = 512
MOST_STATES = 300_000
MOST_WORDS = 500_000

# Symbols the splitter reads: a character's class with what must be known of the characters after it.
(
    LETTER,
    NUMBER,
    OTHER,
    SHORT,  # an apostrophe before a contraction's single letter
    LONG,  # an apostrophe before a contraction's two letters
    SPACE,  # a space before white space or the end
    SPACE_INK,  # a space before anything else
    WHITE,  # other white space, likewise
    WHITE_INK,
    END,  # the end of a text
) = range(10)

# The contractions of the public byte-level splitting rule.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")

# States of the splitter: what came before.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_SPACE, AFTER_WHITE, ONE_LEFT, TWO_LEFT, CLOSED = range(9)


def step(state: int, symbol: int) -> tuple[int, bool]:
    """(next state, whether a pre-token begins at this character)."""
    if symbol == END:
        return FRESH, False
    if symbol in (SPACE, SPACE_INK, WHITE, WHITE_INK):
        starts = state not in (AFTER_SPACE, AFTER_WHITE) or symbol in (SPACE_INK, WHITE_INK)
        return (AFTER_SPACE if symbol in (SPACE, SPACE_INK) else AFTER_WHITE), starts
    if symbol == LETTER and state in (TWO_LEFT, ONE_LEFT):
        return (ONE_LEFT if state == TWO_LEFT else CLOSED), False
    run = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS}.get(symbol, IN_OTHERS)
    if state in (run, AFTER_SPACE):
        return run, False
    return {SHORT: ONE_LEFT, LONG: TWO_LEFT}.get(symbol, run), True


class Splitter:
    """The splitter's automaton, its transition monoid and the scan that runs it."""

    def __init__(self, classes: np.ndarray) -> None:
        states, symbols = range(9), range(10)
        maps = [tuple(step(q, c)[0] for q in states) for c in symbols]
        elements = [tuple(states)]  # the identity first
        known = {elements[0]: 0}
        for element in elements:  # grows while it is read
            for m in maps:
                after = tuple(m[q] for q in element)
                if after not in known:
                    known[after] = len(elements)
                    elements.append(after)
        n = len(elements)
        kind = np.uint8 if n <= 256 else np.uint16
        self.compose = np.array([[known[tuple(g[q] for q in f)] for g in elements] for f in elements], kind)
        self.of_symbol = np.array([known[m] for m in maps], kind)
        self.apply = np.array(elements, np.uint8)
        self.starts = np.array([[step(q, c)[1] for c in symbols] for q in states])
        self.classes = classes

    def symbols(self, codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Symbols of code points; ``ends`` marks the characters that stand for the end of a text."""
        out = self.classes[codes]
        blank = (out == SPACE) | (out == WHITE) | ends
        ink_next = np.zeros(len(out), bool)
        ink_next[:-1] = ~blank[1:]
        quotes = np.flatnonzero(codes == ord("'"))
        out[((out == SPACE) | (out == WHITE)) & ink_next] += 1
        padded = np.concatenate([codes, np.zeros(2, codes.dtype)])
        cut = np.concatenate([ends, np.ones(2, bool)])
        one, two = padded[quotes + 1], padded[quotes + 2]
        for tail in CONTRACTIONS:
            fits = (one == ord(tail[0])) & ~cut[quotes + 1]
            if len(tail) == 2:
                fits &= (two == ord(tail[1])) & ~cut[quotes + 2]
            out[quotes[fits]] = SHORT if len(tail) == 1 else LONG
        out[ends] = END
        return out

    def begins(self, symbols: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
        """Where pre-tokens begin: state maps per chunk, scanned over the chunks, then applied."""
        n = len(symbols)
        if not n:
            return np.zeros(0, bool)
        rows = -(-n // chunk)
        grid = np.full(rows * chunk, END, np.uint8)
        grid[:n] = symbols
        grid = np.ascontiguousarray(grid.reshape(rows, chunk).T)  # one row per place in the chunks
        maps = np.empty((chunk + 1, rows), self.compose.dtype)
        maps[0] = 0
        for t in range(chunk):
            maps[t + 1] = self.compose[maps[t], self.of_symbol[grid[t]]]
        whole = maps[-1].copy()
        reach = 1
        while reach < rows:  # inclusive scan of the chunks' maps
            whole[reach:] = self.compose[whole[:-reach].copy(), whole[reach:]]
            reach *= 2
        entry = np.full(rows, FRESH, np.uint8)
        entry[1:] = self.apply[whole[:-1], FRESH]
        before = self.apply[maps[:-1], entry[None, :]]
        return self.starts[before, grid].T.reshape(-1)[:n]


def class_table(block: int = 1 << 14) -> np.ndarray:
    """LETTER, NUMBER, OTHER, SPACE or WHITE for every code point, as the library's own splitter
    sees them (its Unicode version may be another than Python's): a sign of a known class in front
    of a character stays with it only if the character is of that class."""
    table = np.full(0x110000, WHITE, np.uint8)
    split = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
    for start in range(0, len(table), block):
        codes = np.array([c for c in range(start, start + block) if not 0xD800 <= c < 0xE000], np.int64)
        signs = "".join(map(chr, codes))
        for lead, code in (("a", LETTER), ("1", NUMBER), ("!", OTHER)):
            begun = np.zeros(3 * len(codes) + 1, bool)
            begun[[at for _, (at, _) in split("".join(f"{lead}{c}\n" for c in signs))]] = True
            table[codes[~begun[1::3][: len(codes)]]] = code
    table[ord(" ")] = SPACE
    return table


def byte_signs() -> dict[str, int]:
    """The printable sign that stands for each byte in byte-level vocabularies, by the public rule:
    printable Latin-1 bytes stand for themselves, the others for 256 and up in turn."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tables(NamedTuple):
    tokens: list[bytes]
    ranks: dict[tuple[int, int], tuple[int, int]]  # pair -> rank, merged token
    trie: dict[int, int]  # node * 256 + byte -> node
    token_at: dict[int, int]  # node -> token
    inner: set[int]  # nodes that go on
    special: tuple[str, ...]
    classes: np.ndarray  # of code points


def compile_tables(path: str) -> Tables:
    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    special = tuple(t["content"] for t in held["added_tokens"])
    signs = byte_signs()
    vocab = {t: i for t, i in held["model"]["vocab"].items() if t not in special}
    tokens = [b""] * (max(vocab.values()) + 1)
    for text, i in vocab.items():
        tokens[i] = bytes(signs[c] for c in text)
    pairs = (m if isinstance(m, list) else m.split(" ") for m in held["model"]["merges"])
    ranks = {(vocab[a], vocab[b]): (r, vocab[a + b]) for r, (a, b) in enumerate(pairs)}
    trie: dict[int, int] = {}
    token_at: dict[int, int] = {}
    inner: set[int] = set()
    for i, token in enumerate(tokens):
        if not token:
            continue
        node = 0
        for byte in token:
            inner.add(node)
            node = trie.setdefault(node << 8 | byte, len(trie) + 1)
        token_at[node] = i
    return Tables(tokens, ranks, trie, token_at, inner, special, class_table())


class Counter(dict):
    """The counting transducer; as a dictionary, the counts of pre-tokens met so far."""

    def __init__(self, tables: Tables, most_states: int = MOST_STATES, most_words: int = MOST_WORDS) -> None:
        super().__init__()
        self.tables, self.most_states, self.most_words = tables, most_states, most_words
        self.single = {t[0]: i for i, t in enumerate(tables.tokens) if len(t) == 1}
        self.splitter = Splitter(tables.classes)
        self.fits: dict[tuple[int, int], bool] = {}
        self._reset()

    def __reduce__(self):
        return Counter, (self.tables, self.most_states, self.most_words)

    def _reset(self) -> None:
        start = ((-1, 0, 0),)
        self.states: list[tuple] = [start]
        self.ids: dict[tuple, int] = {start: 0}
        self.moves: dict[int, tuple[int, int]] = {}  # state * 256 + byte -> state, emitted tokens
        self.rest: list[int] = [0]  # tokens emitted if the pre-token ends here

    def encode(self, data: bytes) -> list[int]:
        """Plain merging, lowest rank first, leftmost on ties; used to compile transitions."""
        parts = [self.single[b] for b in data]
        ranks = self.tables.ranks
        while len(parts) > 1:
            found = [(ranks[p][0], i) for i, p in enumerate(zip(parts, parts[1:])) if p in ranks]
            if not found:
                break
            _, i = min(found)
            parts[i : i + 2] = [ranks[parts[i], parts[i + 1]][1]]
        return parts

    def fit(self, last: int, token: int) -> bool:
        """Whether ``token`` can follow ``last`` in an encoding (-1: nothing before)."""
        known = self.fits.get((last, token))
        if known is None:
            if len(self.fits) >= self.most_states:
                self.fits.clear()
            tokens = self.tables.tokens
            pair = [token] if last < 0 else [last, token]
            known = self.fits[last, token] = self.encode(b"".join(tokens[t] for t in pair)) == pair
        return known

    def move(self, state: int, byte: int) -> tuple[int, int]:
        """Build the transition: follow every unfinished token, close the one that fits."""
        trie, token_at, inner = self.tables.trie, self.tables.token_at, self.tables.inner
        places, closing = [], None
        for last, node, lead in self.states[state]:
            after = trie.get(node << 8 | byte)
            if after is None:
                continue
            token = token_at.get(after)
            if token is not None and closing is None and self.fit(last, token):
                closing = (token, 0, lead + 1)
            if after in inner:
                places.append((last, after, lead))
        places.append(closing)
        sure = min(lead for _, _, lead in places)
        key = tuple((last, node, lead - sure) for last, node, lead in places)
        at = self.ids.get(key)
        if at is None:
            at = self.ids[key] = len(self.states)
            self.states.append(key)
            self.rest.append(key[-1][2])
        made = self.moves[state << 8 | byte] = (at, sure)
        return made

    def __missing__(self, word: str) -> int:
        if len(self.states) > self.most_states:
            self._reset()
        state, total = 0, 0
        moves = self.moves
        for byte in word.encode("utf-8", "surrogatepass"):
            found = moves.get(state << 8 | byte)
            if found is None:
                found = self.move(state, byte)
            state, sure = found
            total += sure
        total += self.rest[state]
        if len(self) >= self.most_words:
            self.clear()
        if len(word) <= 64:
            self[word] = total
        return total

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        joined = "\n".join(texts) + "\n"
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        closing = np.cumsum(sizes) - 1
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.zeros(len(codes), bool)
        ends[closing] = True
        out = np.zeros(len(texts), np.int64)
        for name in self.tables.special:
            at = joined.find(name)
            while at >= 0:
                ends[at : at + len(name)] = True
                out[np.searchsorted(closing, at)] += 1
                at = joined.find(name, at + len(name))
        begins = self.splitter.begins(self.splitter.symbols(codes, ends))
        bounds = np.flatnonzero(begins | ends)
        real = ~ends[bounds]
        edges = bounds.tolist()
        words = [joined[a:b] for a, b, r in zip(edges, [*edges[1:], len(joined)], real.tolist()) if r]
        counts = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        owner = np.searchsorted(closing, bounds[real])
        return out + np.bincount(owner, weights=counts, minlength=len(texts)).astype(np.int64)


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit. ``path`` names a byte-level BPE file (.json).

    The compiled tables of the vocabulary are broadcast; their size is the vocabulary's.
    A worker keeps its transducer from task to task.
    """
    compiled = docs.sparkSession.sparkContext.broadcast(Counter(compile_tables(path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = compiled.value
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                tokens = counter.count(part.column("text").to_pylist())
                columns = [part.column("doc_id"), part.column("n_bytes"), pa.array(tokens), pa.array(tokens > limit)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    slim = docs.select("doc_id", F.octet_length(text_of()).cast("long").alias("n_bytes"), text_of().alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
