"""Phrase collocations from an FM-index per shard.

Texts become word ids, and each shard of about half a million words of one language an index: its
vocabulary and the Burrows-Wheeler transform of its ids, with rotations sorted by as many first
symbols as phrases may have words. A row of the sorted rotations stands for a place in the text. The
word before it is the transform's symbol, the word it starts with follows from the symbol
counts, and the stable order of the symbols maps a row to that of the place after it. Intervals of rows that start alike are
phrases, their lengths the counts. All intervals of a depth are extended at once: to the right
one interval falls into runs by the next word; to the left the rows mapped before an interval's form, word by
word, the intervals of the longer phrases. Pieces are parted by a symbol no phrase may hold.

Shards are summed in Spark. Most phrases are rare, so counts are summed in two steps. First each
shard reports the pairs of words it holds as 64-bit hashes with counts. The hashes whose sums reach the
least count make a Bloom filter; a phrase can only reach it if all its pairs do. Then
shards report as text what the filter lets through, and these sums are exact. Hashes that collide and bits set by
chance let more through, never less, so the filter decides costs alone. It has 16 bits per
frequent pair, up to FILTER_BITS; beyond that it lets more and more pass.

Scores compare each cut of a phrase in decimals of 38 digits. A candidate inside a longer one
that is nearly as frequent is dropped.

Defined cases: a NULL text is the empty text; a NULL language is ``und``, together with a language of
that name; texts without words give nothing; an empty table gives an empty result. Repeated
rows count each. A text without any end of a piece is held whole by one task, else parts of about a megabyte. A
language with fewer words than a shard shares no index with others. Other columns are ignored.
"""

from __future__ import annotations

import contextlib
import itertools
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from titleloom.llm.common import store, text_of

LONGEST = 3  # words of a phrase
LEAST = 10  # occurrences of a candidate
NEARLY = 50  # percent of a phrase's occurrences that a longer one needs to take its place
SCALE = 1_000_000
TOP = 2000
SHARD_WORDS = 1 << 19
SHARDS_OF_FILE = 4
PART_BYTES = 1 << 20
FILTER_BITS = 1 << 30  # at most

# Lower case, one mark for the end of a piece, one blank.
_PLAIN = bytes.maketrans(bytes(range(65, 91)) + b".,;:!?\n\x0b\x0c\r\t", bytes(range(97, 123)) + b"\n" * 10 + b" ")
_END = b"\n"
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)]


def parts_of(text: str, most: int = PART_BYTES) -> Iterator[bytes]:
    """The plain text in parts of whole pieces."""
    raw = text.encode("utf-8", "surrogatepass").translate(_PLAIN)
    at = 0
    while at < len(raw):
        end = raw.find(_END, at + most)
        end = len(raw) if end < 0 else end
        yield raw[at:end]
        at = end + 1


class Growing:
    """A shard while words are added: ids from 1, 0 between pieces."""

    def __init__(self) -> None:
        self.ids: defaultdict[bytes, int] = defaultdict(itertools.count().__next__)
        self.ids[_END]  # takes 0
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, raw: bytes) -> None:
        words = filter(None, raw.replace(_END, b" \n ").split(b" "))
        self.parts.append(np.append(np.fromiter(map(self.ids.__getitem__, words), np.int32), np.int32(0)))
        self.size += len(self.parts[-1])

    def closed(self, depth: int) -> tuple[list[bytes], np.ndarray]:
        return list(self.ids), transform(np.concatenate(self.parts), depth)


def transform(ids: np.ndarray, depth: int) -> np.ndarray:
    """The symbol before each rotation, rotations sorted by their first ``depth`` symbols or more."""
    rank, known = ids.astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while known < depth:
        code = rank * (int(rank.max()) + 1) + np.roll(rank, -known)
        order = np.argsort(code, kind="stable")
        new = np.zeros(len(ids), np.int64)
        new[1:] = np.cumsum(np.diff(code[order]) != 0)
        rank[order] = new
        known *= 2
    return ids[order - 1]


class Index:
    """Intervals of an FM-index, extended level by level."""

    def __init__(self, bwt: np.ndarray, symbols: int) -> None:
        self.count = np.bincount(bwt, minlength=symbols)
        self.first = np.repeat(np.arange(symbols, dtype=np.int32), self.count)
        self.after = np.argsort(bwt, kind="stable")  # the row of the place after a row's

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """(phrases as rows of symbols, counts) of depth one."""
        held = np.flatnonzero(self.count[1:]) + 1
        return held[:, None], self.count[held]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words extended to the right: (phrases, counts, the interval of each row or -1)."""
        second = self.first[self.after]
        return self._runs((self.first > 0) & (second > 0), self.first, second, lambda at: np.stack([self.first[at], second[at]], axis=1))

    def longer(self, phrases: np.ndarray, own: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Intervals ``own`` extended to the left where the new first pair's rows are ``good``."""
        inner = own[self.after]
        return self._runs(good & (inner >= 0), self.first, inner, lambda at: np.column_stack([self.first[at], phrases[inner[at]]]))

    def _runs(self, valid: np.ndarray, one: np.ndarray, two: np.ndarray, phrases_at) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows = np.flatnonzero(valid)
        own = np.full(len(valid), -1, np.int64)
        new = np.ones(len(rows), bool)
        new[1:] = (one[rows[1:]] != one[rows[:-1]]) | (two[rows[1:]] != two[rows[:-1]])
        number = np.cumsum(new) - 1
        own[rows] = number
        return phrases_at(rows[new]), np.bincount(number, minlength=int(new.sum())), own


def pair_hashes(lang: str, words: list[bytes], pairs: np.ndarray) -> np.ndarray:
    base = np.uint64(xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass")))
    of_word = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    h = (of_word[pairs[:, 0]] * _MIX[0]) ^ (of_word[pairs[:, 1]] * _MIX[1] + base)
    h = (h ^ (h >> np.uint64(32))) * _MIX[2]
    return h ^ (h >> np.uint64(29))


def build(docs: DataFrame, longest: int = LONGEST, shard_words: int = SHARD_WORDS) -> DataFrame:
    """lang, words (the vocabulary; the end of a piece first), bwt: a row per shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[str, Growing] = {}

        def closed(lang: str) -> pa.RecordBatch:
            words, bwt = open_.pop(lang).closed(longest)
            return pa.RecordBatch.from_arrays(
                [pa.array([lang], pa.string()), pa.array([words], pa.list_(pa.binary())), pa.array([bwt], pa.list_(pa.int32()))], ["lang", "words", "bwt"]
            )

        for batch in batches:
            for lang, text in zip(batch.column("lang"), batch.column("text")):
                lang = lang.as_py()
                for raw in parts_of(text.as_py()):
                    shard = open_.setdefault(lang, Growing())
                    shard.add(raw)
                    if shard.size >= shard_words:
                        yield closed(lang)
                while sum(s.size for s in open_.values()) > 2 * shard_words:
                    yield closed(max(open_, key=lambda k: open_[k].size))
        for lang in list(open_):
            yield closed(lang)

    slim = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_of().alias("text"))
    return slim.mapInArrow(run, "lang string, words array<binary>, bwt array<int>")


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes], Index]]:
    for batch in batches:
        for i in range(batch.num_rows):
            words = batch.column("words")[i].as_py()
            yield batch.column("lang")[i].as_py(), words, Index(np.asarray(batch.column("bwt")[i].values), len(words))


@contextlib.contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    before = {name: spark.conf.get(name) for name in values}
    try:
        for name, value in values.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def small_files(spark: SparkSession) -> contextlib.AbstractContextManager[None]:
    """A file gets SHARDS_OF_FILE shards; Spark's reader holds up to 4,096 rows of a file, which are all shards of a larger one."""
    return _settings(spark, {"spark.sql.files.maxRecordsPerFile": str(SHARDS_OF_FILE)})


def one_row_batches(spark: SparkSession) -> contextlib.AbstractContextManager[None]:
    """Python gets one shard at a time; batches of all shards of a task are held by Spark and by Python.

    A small file counts little, so that a task reads several and sums them before the shuffle.
    """
    return _settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": "1", "spark.sql.files.openCostInBytes": str(1 << 20)})


def hashed_pairs(index: DataFrame) -> DataFrame:
    """hash, f: pairs of words of each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words, shard in _each(batches):
            pairs, count, _ = shard.pairs()
            hashes = pair_hashes(lang, words, pairs).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(count)], ["hash", "f"])

    return index.mapInArrow(run, "hash bigint, f bigint")


_SHIFTS = (0, 17, 34)


def filter_of(hashes: DataFrame, size: int) -> np.ndarray:
    """A Bloom filter of ``size`` bits (a power of two) over the column hash; size / 8 bytes, in words of 64 bits."""
    bits = F.explode(F.array(*[F.shiftrightunsigned("hash", s).bitwiseAND(F.lit(size - 1)) for s in _SHIFTS])).alias("bit")
    one = F.expr("shiftleft(1L, cast(bit & 63 as int))")
    held = hashes.select(bits).groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(one).alias("bits")).toArrow()
    out = np.zeros(size // 64, np.int64)
    out[np.asarray(held.column("at"))] = np.asarray(held.column("bits"))
    return out.view(np.uint64)


def maybe(hashes: np.ndarray, held: np.ndarray) -> np.ndarray:
    out = np.ones(len(hashes), bool)
    for s in _SHIFTS:
        bit = (hashes >> np.uint64(s)) & np.uint64(64 * len(held) - 1)
        out &= (held[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
    return out


def phrases(index: DataFrame, frequent: np.ndarray, longest: int = LONGEST) -> DataFrame:
    """lang, phrase, length, f: all words of each shard, and the phrases whose pairs may be frequent."""
    shared = index.sparkSession.sparkContext.broadcast(frequent)
    names = ["lang", "phrase", "length", "f"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words, shard in _each(batches):
            texts = pa.array([w.decode("utf-8", "replace") for w in words], pa.string())

            def told(found: np.ndarray, count: np.ndarray) -> Iterator[pa.RecordBatch]:
                for start in range(0, len(found), 1 << 16):
                    rows = found[start : start + (1 << 16)]
                    columns = [texts.take(pa.array(c)) for c in rows.T]
                    text = pc.binary_join_element_wise(*columns, " ") if len(columns) > 1 else columns[0]
                    length = pa.array(np.full(len(rows), rows.shape[1], np.int32))
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(rows), pa.string()), text, length, pa.array(count[start : start + (1 << 16)])], names)

            yield from told(*shard.words())
            found, count, own = shard.pairs()
            kept = maybe(pair_hashes(lang, words, found), shared.value)
            good = np.append(kept, False)[own]  # -1: no pair
            own = np.where(good, own, -1)
            for length in range(2, longest + 1):
                yield from told(found[kept], count[kept])
                if length < longest:
                    found, count, own = shard.longer(found, own, good)
                    kept = np.ones(len(found), bool)

    return index.mapInArrow(run, "lang string, phrase string, length int, f bigint")


def counts(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, shard_words: int = SHARD_WORDS, filter_bits: int = FILTER_BITS) -> DataFrame:
    """lang, phrase, length, f: all words, and phrases that occur ``least`` times. A stored table."""
    with small_files(docs.sparkSession):
        index = store(build(docs, longest, shard_words), "collocation-index")
    sums = hashed_pairs(index).groupBy("hash").agg(F.sum("f").alias("f"))
    with one_row_batches(index.sparkSession):
        frequent = store(sums.filter(F.col("f") >= least).select("hash"), "collocation-pairs")
    size = 1 << max(16, (16 * frequent.count()).bit_length())
    held = filter_of(frequent, min(size, filter_bits))
    total = phrases(index, held, longest).groupBy("lang", "phrase", "length").agg(F.sum("f").alias("f"))
    with one_row_batches(index.sparkSession):
        return store(total.filter((F.col("length") == 1) | (F.col("f") >= least)), "collocation-counts")


def collocations(
    docs: DataFrame,
    longest: int = LONGEST,
    least: int = LEAST,
    nearly: int = NEARLY,
    scale: int = SCALE,
    top: int = TOP,
    shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each language."""
    found = counts(docs, longest, least, shard_words)
    n = store(found.filter("length = 1").groupBy("lang").agg(F.sum("f").alias("n")), "collocation-sizes")
    cand = found.filter((F.col("length") > 1) & (F.col("f") >= least)).withColumn("words", F.split("phrase", " "))

    # Every longer candidate names the shorter phrases inside it.
    def within(k: int) -> DataFrame:
        starts = F.sequence(F.lit(1), F.col("length") - k + 1)
        names = F.transform(starts, lambda i: F.array_join(F.slice("words", i, F.lit(k)), " "))
        return cand.filter(F.col("length") > k).select("lang", "f", F.explode(names).alias("phrase"))

    inside = reduce(DataFrame.unionAll, map(within, range(2, longest))) if longest > 2 else None
    if inside is not None:
        cover = inside.groupBy("lang", "phrase").agg(F.max("f").alias("cover"))
        cand = cand.join(cover, ["lang", "phrase"], "left").filter((F.col("cover").isNull()) | (F.col("cover").cast("decimal(38,0)") * 100 < F.col("f").cast("decimal(38,0)") * nearly))
    cand = store(cand.select("lang", "phrase", "words", "length", F.col("f").alias("a")), "collocation-candidates")

    cuts = cand.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("length") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("head"), F.array_join(F.slice("words", F.col("k") + 1, F.col("length") - F.col("k")), " ").alias("tail"))
    side = found.select(F.col("lang").alias("of"), F.col("phrase").alias("part"), "f")
    for name, count in (("head", "l"), ("tail", "r")):
        cuts = cuts.join(side, (F.col("lang") == F.col("of")) & (F.col(name) == F.col("part"))).withColumnRenamed("f", count).drop("of", "part")
    exact = lambda c: F.col(c).cast("decimal(16,0)")
    ratio = F.expr("cast(cast(a as decimal(16,0)) * cast(a as decimal(16,0)) as decimal(33,0))") * F.lit(scale).cast("decimal(4,0)" if scale < 10**4 else "decimal(8,0)")
    cuts = cuts.withColumn("top", ratio).withColumn("bottom", exact("l") * exact("r"))
    cuts = cuts.withColumn("score", F.expr("top div bottom"))
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("best")).select("lang", "phrase", "best.*")
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
