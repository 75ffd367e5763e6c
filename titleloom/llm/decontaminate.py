"""Benchmark decontamination by winnowing.

Words are hashed, runs of ``gram`` words get a hash of their own, and of every
``window - gram + 1`` consecutive runs (together one window of ``window`` words) the smallest
hash, rightmost on ties, is the window's fingerprint. Only these runs, about one in
three, are kept of a text; each is kept with the words that a window around it can hold. Equal windows
choose equal runs at equal places, so every shared span of ``window`` words or more has a
fingerprint on both sides. Fingerprints of documents and benchmark are joined by hash; where the
runs' words are equal too, the hit is extended to the left and to the right as far as the words agree.
What is as long as a window then is a hit, word for word. Items shorter than a window
count as one window of their own length, which is its own fingerprint.

Tasks carry a Bloom filter of the benchmark's fingerprints, with 16 bits or more for each up to FILTER_BITS.
It decides only what takes part in the join: with more than 60 million fingerprints it
lets more of a text's fingerprints pass, and the join still drops them.
Everything after the scan of the texts moves hits only, one row each. Exact copies of a
text are reduced to one before the join. Benchmark fingerprints with the same words around them form one
row with the set of their items, and equal sets one class, so a passage shared by many items is not multiplied out.

Defined cases: NULL text has no words; a NULL item id counts as the empty id; repeated
benchmark rows count once; repeated documents each get a row; with an empty benchmark
nothing is hit; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from titleloom.llm.common import packed, slices, store, text_of

WINDOW = 10
GRAM = 5
FILTER_BITS = 1 << 30  # at most

_CODES = np.arange(256)
_UPPER = (_CODES >= 65) & (_CODES <= 90)
_LOWERED = np.where(_UPPER, _CODES + 32, _CODES).astype(np.uint8)
_IS_WORD = ((_CODES >= 48) & (_CODES <= 57)) | _UPPER | ((_CODES >= 97) & (_CODES <= 122)) | (_CODES >= 128)
_BASE = np.uint64(0x9E3779B97F4A7C15)


class Words(NamedTuple):
    """The words of several texts in a row: lower-cased bytes, bounds, hashes, owning text."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    text: np.ndarray

    def held(self, first: int, end: int) -> list[str]:
        """The words from ``first`` up to ``end``."""
        return [self.data[s:e].tobytes().decode("utf-8", "replace") for s, e in zip(self.start[first:end], self.end[first:end])]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def split(texts: pa.Array) -> Words:
    """Words of all texts; no word runs over the end of a text."""
    texts = pa.array(texts.fill_null(""), pa.large_string()) if texts.type != pa.large_string() else texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    raw = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held is not None else np.zeros(0, np.uint8)
    begins = (offsets - offsets[0])[:-1]
    inside = _IS_WORD[raw]
    before = np.zeros(len(raw), bool)
    before[1:] = inside[:-1]
    before[begins[begins < len(raw)]] = False
    start = np.flatnonzero(inside & ~before)
    after = np.zeros(len(raw), bool)
    after[:-1] = inside[1:]
    closing = begins[(begins > 0) & (begins <= len(raw))] - 1
    after[closing] = False
    end = np.flatnonzero(inside & ~after) + 1
    data = _LOWERED[raw]
    text = np.searchsorted(begins, start, side="right") - 1
    if not len(start):
        return Words(data, start, end, np.zeros(0, np.uint64), text)
    length = end - start
    packed_at = np.cumsum(length) - length
    place = np.arange(int(length.sum())) - np.repeat(packed_at, length)
    power = np.cumprod(np.full(int(length.max()), _BASE, np.uint64))
    values = (data[inside].astype(np.uint64) + np.uint64(1)) * power[place]
    return Words(data, start, end, _mixed(np.add.reduceat(values, packed_at)), text)


def runs(words: Words, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the run of words from every word on, and whether it lies in one text."""
    n = len(words.hash) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    out = np.zeros(n, np.uint64)
    for i in range(length):
        out = out * _BASE + words.hash[i : i + n]
    return _mixed(out + np.uint64(length)), words.text[:n] == words.text[length - 1 :]


def chosen(words: Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per window inside one text: its first word, and the place and hash of its fingerprint."""
    hashes, _ = runs(words, gram)
    _, whole = runs(words, window)
    first = np.flatnonzero(whole)
    if not len(first):
        return first, first, np.zeros(0, np.uint64)
    n = len(whole)
    least, place = hashes[:n].copy(), np.arange(n)
    for shift in range(1, window - gram + 1):
        other = hashes[shift : shift + n]
        better = other <= least
        least[better] = other[better]
        place[better] = np.flatnonzero(better) + shift
    return first, place[first], least[first]


def _bits(hashes: np.ndarray, size: int) -> np.ndarray:
    """Three bit numbers per hash."""
    mask = np.uint64(size - 1)
    return np.stack([(hashes >> np.uint64(s)) & mask for s in (0, 20, 40)]).astype(np.int64)


def maybe(hashes: np.ndarray, bitmap: np.ndarray, size: int) -> np.ndarray:
    out = np.ones(len(hashes), bool)
    for bit in _bits(hashes, size):
        out &= (bitmap[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
    return out


#: A fingerprint: its hash, words and place, the words around it, and the length a hit needs.
PRINT_SCHEMA = "print bigint, place int, need int, run array<string>, left array<string>, right array<string>"
_PRINT = ["print", "place", "need", "run", "left", "right"]
_LIST = pa.list_(pa.string())


def prints_of(words: Words, window: int, gram: int, short: list[int], wanted: Callable[[np.ndarray], np.ndarray]) -> Iterator[tuple[int, tuple]]:
    """(text, fingerprint) for all fingerprints whose hash is ``wanted``. The left side is given backwards."""
    count = np.bincount(words.text, minlength=int(words.text.max(initial=-1)) + 1)
    end = np.cumsum(count)
    around = window - gram
    _, place, hashes = chosen(words, window, gram)
    place, first = np.unique(place, return_index=True)
    for length, at, found, near in [(gram, place, hashes[first], around), *((n, *_short(words, n), 0) for n in short)]:
        good = np.flatnonzero(wanted(found))
        for w, h in zip(at[good].tolist(), found[good].view(np.int64).tolist()):
            text = int(words.text[w])
            begin, stop = int(end[text] - count[text]), int(end[text])
            left = words.held(max(begin, w - near), w)[::-1]
            right = words.held(w + length, min(stop, w + length + near))
            yield text, (h, w - begin, window if near else length, words.held(w, w + length), left, right)


def _short(words: Words, length: int) -> tuple[np.ndarray, np.ndarray]:
    hashes, whole = runs(words, length)
    first = np.flatnonzero(whole)
    return first, hashes[first]


def _columns(found: list[tuple]) -> list[pa.Array]:
    kinds = [pa.int64(), pa.int32(), pa.int32(), _LIST, _LIST, _LIST]
    return [pa.array([f[i] for f in found], k) for i, k in enumerate(kinds)]


def benchmark_prints(benchmark: DataFrame, window: int, gram: int) -> DataFrame:
    """item and fingerprint, repeated ones too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 19):
                words = split(part.column("text"))
                count = np.bincount(words.text, minlength=part.num_rows)
                short = sorted(set(count[(count > 0) & (count < window)].tolist()))
                every = lambda hashes: np.ones(len(hashes), bool)
                found = [(t, f) for t, f in prints_of(words, window, gram, short, every) if f[2] == window or f[2] == count[t]]
                items = part.column("item").take(pa.array([t for t, _ in found], pa.int64()))
                yield pa.RecordBatch.from_arrays([items, *_columns([f for _, f in found])], ["item", *_PRINT])

    slim = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), text_of().alias("text"))
    return slim.mapInArrow(run, f"item string, {PRINT_SCHEMA}")


def bitmap_of(hashes: DataFrame, column: str, size: int) -> np.ndarray:
    """A Bloom filter of the column; at most size / 8 bytes reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.asarray(batch.column(column)).view(np.uint64)
            bit = np.unique(_bits(values, size))
            yield pa.RecordBatch.from_arrays([pa.array(bit >> 6), pa.array(np.int64(1) << (bit & 63))], ["word", "bits"])

    words = hashes.select(column).mapInArrow(run, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    held = words.toArrow()
    bitmap = np.zeros(size // 64, np.int64)
    bitmap[np.asarray(held.column("word"))] = np.asarray(held.column("bits"))
    return bitmap.view(np.uint8)


def text_key() -> Column:
    """128 bits that stand for the text."""
    return F.md5(text_of())


def filter_size(n: int, most: int) -> int:
    return min(most, max(1 << 16, 1 << (16 * n).bit_length()))


def scan(docs: DataFrame, found: DataFrame, window: int, gram: int, filter_bits: int) -> DataFrame:
    """Two kinds of rows: doc_id, key, n_words per document (print NULL), and key with a fingerprint the benchmark may hold."""
    spark = docs.sparkSession
    short = sorted(r[0] for r in found.filter(F.col("need") < window).select("need").distinct().collect())  # under 10 rows
    size = filter_size(found.select("print").distinct().count(), filter_bits)
    prints = spark.sparkContext.broadcast(bitmap_of(found, "print", size))
    slim = docs.select("doc_id", text_key().alias("key"), text_of().alias("text"))
    kind = slim.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "key", "n_words", *_PRINT]
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                words = split(part.column("text"))
                count = pa.array(np.bincount(words.text, minlength=part.num_rows).astype(np.int64))
                empty = _columns([(None,) * len(_PRINT)] * part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), count, *empty], names)
                hit = prints_of(words, window, gram, short, lambda hashes: maybe(hashes, prints.value, size))
                while held := list(itertools.islice(hit, 1 << 14)):
                    keys = part.column("key").take(pa.array([t for t, _ in held], pa.int64()))
                    none = [pa.nulls(len(held), part.column("doc_id").type), keys, pa.nulls(len(held), pa.int64())]
                    yield pa.RecordBatch.from_arrays([*none, *_columns([f for _, f in held])], names)

    return slim.mapInArrow(run, f"doc_id {kind.simpleString()}, key string, n_words bigint, {PRINT_SCHEMA}")


def extended(scanned: DataFrame, held: DataFrame) -> DataFrame:
    """key, place, length and the columns of ``held`` for every hit: fingerprints joined and grown word by word.

    ``held`` has one row per fingerprint and words around it. Exact copies of a text bring each fingerprint once.
    """
    mine = scanned.filter("print IS NOT NULL").dropDuplicates(["key", "place", "need"]).select("key", *_PRINT)
    theirs = held.withColumnsRenamed({c: f"its_{c}" for c in _PRINT if c != "place"})
    same = (F.col("print") == F.col("its_print")) & (F.col("need") == F.col("its_need")) & (F.col("run") == F.col("its_run"))

    def agreeing(side: str) -> Column:
        differ = F.array_position(F.zip_with(side, f"its_{side}", lambda x, y: x.eqNullSafe(y)), False)
        return F.when(differ == 0, F.size(side)).otherwise(differ - 1).cast("int")

    met = mine.join(theirs, same).withColumns({"before": agreeing("left"), "behind": agreeing("right")})
    met = met.withColumn("length", F.col("before") + F.size("run") + F.col("behind")).filter("length >= need")
    return met.select("key", (F.col("place") - F.col("before")).alias("place"), "length", *[c for c in held.columns if c not in _PRINT])


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, filter_bits: int = FILTER_BITS
) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated; a row per document."""
    found = store(benchmark_prints(benchmark, window, gram), "bench-prints")
    scanned = store(scan(docs, found, window, gram, filter_bits), "decontaminate-scan")

    # A class of fingerprints: those with the same set of items, known by order-free hashes of it.
    words = ["print", "need", "run", "left", "right"]
    owned = found.select(*words, "item").distinct()
    marks = [F.bit_xor(F.xxhash64("item")), F.bit_xor(F.xxhash64(F.lit(7), "item")), F.count("*")]
    kinds = store(owned.groupBy(*words).agg(F.struct(*[m.alias(f"m{i}") for i, m in enumerate(marks)]).alias("kind")), "bench-kinds")
    items = store(owned.join(kinds, words).select("kind", "item").distinct(), "bench-items")
    matched = store(extended(scanned, kinds).distinct(), "decontaminate-matched")

    ordered = Window.partitionBy("key").orderBy("place", "length")
    end = F.col("place") + F.col("length")
    reached = F.max(end).over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), end - F.greatest(F.col("place"), F.coalesce(reached, F.lit(0))))
    covered = matched.select("key", fresh.alias("fresh")).groupBy("key").agg(F.sum("fresh").alias("n_hit"))
    named = matched.select("key", "kind").distinct().join(items, "kind").select("key", "item").distinct()
    named = named.groupBy("key").agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_list("item")), ",").alias("items"))
    per_text = store(covered.join(named, "key"), "decontaminate-texts")

    rows = scanned.filter("print IS NULL").select("doc_id", "key", "n_words")
    both = rows.join(per_text, "key", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("items", F.lit("")).alias("items")
    )
    return both.select(
        "doc_id", "n_words", F.col("n_hit").cast("long").alias("n_hit"), F.col("n_items").cast("long").alias("n_items"),
        F.sha2("items", 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, filter_bits: int = FILTER_BITS) -> DataFrame:
    """The documents in which no benchmark window occurs, all columns kept."""
    found = store(benchmark_prints(benchmark, window, gram), "bench-prints")
    scanned = store(scan(docs, found, window, gram, filter_bits).filter("print IS NOT NULL"), "decontaminate-scan")
    held = store(found.drop("item", "place").distinct(), "bench-distinct")
    dirty = store(extended(scanned, held).select("key").distinct(), "decontaminate-dirty")
    rows = docs.select(packed(docs).alias("row"), text_key().alias("of_text"))
    return rows.join(dirty, F.col("of_text") == F.col("key"), "left_anti").select("row.*")
