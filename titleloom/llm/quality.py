"""Quality score from compression with two dictionaries.

A zstandard dictionary is trained on good and one on bad labelled text. A text is cut
into pieces of about ``PIECE`` bytes, each piece is compressed with either
dictionary, and the normalised differences of the compressed sizes

    (bad - good) / (bad + good)    and    (bad - good) / bytes

say which dictionary knows the text better. The differences of a document (over the
whole text, mean and least piece) become a probability through a logistic curve fitted on
labelled documents that no dictionary saw; it also knows how long a text is, as short
ones say little.

Bounded samples are used for fitting only: ``DICTIONARY_DOCS`` documents per class and
``PIECES`` pieces of them for the dictionaries, ``CALIBRATION_DOCS`` for the curve, all
chosen by hash. Scoring reads every text as a whole, in one pass without a shuffle.

Defined cases: NULL text scores like the empty text, which gets the share of good
documents; conflicting labels of one id count as bad; rows without id are not used for
fitting; if the sample lacks a class, every document gets the smoothed share of
good labels. Repeated rows each get a row; an empty table gives an empty result. Extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from titleloom.llm.common import id_crc, logistic, packed, slices, store, text_of

PIECE = 512
DICTIONARY_BYTES = 112 << 10
DICTIONARY_DOCS = 2_000  # per class
PIECES = 8_000  # per class
CALIBRATION_DOCS = 8_000
LEVEL = 3
EVIDENCE = 400  # bytes at which a text has half the weight of a long one
THRESHOLD = 0.7
FOLDS, HELD_OUT = 4, 2


class Model(NamedTuple):
    good: bytes  # dictionaries; empty if a class was missing
    bad: bytes
    weights: tuple[float, ...]  # of features() and a constant
    prior: float


def pieces(data: bytes, size: int = PIECE) -> list[bytes]:
    """The whole of the data in near-equal parts of ``size`` to twice ``size`` bytes."""
    n = max(1, len(data) // size)
    edges = [len(data) * i // n for i in range(n + 1)]
    return [data[a:b] for a, b in zip(edges, edges[1:])]


def dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary; too few samples to train on serve as they are."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


class Sizer:
    """Compressed sizes of pieces with one dictionary."""

    def __init__(self, content: bytes, level: int = LEVEL) -> None:
        held = zstandard.ZstdCompressionDict(content)
        held.precompute_compress(level=level)
        self.compress = zstandard.ZstdCompressor(
            level=level, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False
        ).compress

    def sizes(self, parts: list[bytes]) -> np.ndarray:
        return np.array([len(self.compress(p)) for p in parts], np.float64)


def features(text: str, good: Sizer, bad: Sizer) -> list[float]:
    """Differences of compressed sizes (positive: the good dictionary fits better), and the length's weight."""
    parts = pieces(text.encode("utf-8", "surrogatepass"))
    g, b = good.sizes(parts), bad.sizes(parts)
    n = np.array([max(1, len(p)) for p in parts], np.float64)
    relative, per_byte = (b - g) / (b + g), (b - g) / n
    clipped = np.clip(relative, -0.3, 0.3)
    share = n / n.sum()
    return [
        float(np.clip((b.sum() - g.sum()) / (b.sum() + g.sum()), -0.3, 0.3)),
        float((clipped * share).sum()),
        float(clipped.min()),
        float(np.clip((b.sum() - g.sum()) / n.sum(), -0.15, 0.15)),
        float((np.clip(per_byte, -0.15, 0.15) * share).sum()),
        float(np.clip(per_byte, -0.15, 0.15).min()),
        float((share * (per_byte < 0.02)).sum()),
        float(n.sum() / (n.sum() + EVIDENCE)),
    ]


def design(rows: np.ndarray) -> np.ndarray:
    """Differences and their squares, the same weighted by how much text there was, and a constant.

    A few words are weak evidence; the weighted columns let the fit say so.
    """
    scale = np.array([0.1, 0.1, 0.1, 0.05, 0.05, 0.05, 0.5])
    rows = rows.reshape(-1, len(scale) + 1)
    x, trust = rows[:, :-1] / scale, rows[:, -1:]
    x = np.concatenate([x, x * x], axis=1)
    return np.concatenate([x, x * trust, trust, np.ones((len(x), 1))], axis=1)


def predict(model: Model, rows: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(design(rows) @ np.array(model.weights), -30, 30)))


def learnable(labels: DataFrame, column: str, folds: int, held_out: int) -> DataFrame:
    """_id, label: one row per labelled id outside the held-out fold."""
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1) & (id_crc() % folds != held_out))
    return usable.groupBy(F.col("doc_id").alias("_id")).agg(F.min(column).cast("int").alias("label"))


def first_by_hash(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """A fixed sample of at most n rows."""
    return df.orderBy(F.xxhash64(F.lit("sample"), *keys), *keys).limit(n)


def fit(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT) -> Model:
    known = store(learnable(labels, "quality", folds, held_out), "quality-labels")
    half = F.pmod(F.xxhash64(F.lit("half"), "_id"), F.lit(2))
    parts = [first_by_hash(known.filter((half == 0) & (F.col("label") == c)), DICTIONARY_DOCS, "_id") for c in (0, 1)]
    parts.append(first_by_hash(known.filter(half == 1), CALIBRATION_DOCS, "_id"))
    chosen = parts[0].unionAll(parts[1]).withColumn("use", F.lit("dictionary")).unionAll(parts[2].withColumn("use", F.lit("curve")))
    # At most 2 * DICTIONARY_DOCS + CALIBRATION_DOCS rows of three small columns.
    texts = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    texts = store(texts.select("_id", "label", "use", "text"), "quality-sample")

    samples = []
    for label in (1, 0):
        found = first_by_hash(_cut(texts.filter((F.col("use") == "dictionary") & (F.col("label") == label))), PIECES, "_id", "at", "piece")
        samples.append([bytes(r[0]) for r in found.select("piece").collect()])  # PIECES * 2 * PIECE bytes at most
    counts = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    prior = (counts.get(1, 0) + 1) / (counts.get(0, 0) + counts.get(1, 0) + 2)
    if not all(sum(map(len, s)) >= 8 for s in samples):
        return Model(b"", b"", (), prior)
    good, bad = dictionary(samples[0]), dictionary(samples[1])
    rows = first_by_hash(_features(texts.filter("use = 'curve' AND text <> ''"), good, bad), CALIBRATION_DOCS, "_id", "x").collect()
    if len({r["label"] for r in rows}) < 2:
        rows = first_by_hash(_features(texts.filter("text <> ''"), good, bad), CALIBRATION_DOCS, "_id", "x").collect()
    x, y = np.array([r["x"] for r in rows]), np.array([float(r["label"]) for r in rows])
    if len(set(y.tolist())) < 2:
        return Model(b"", b"", (), prior)
    return Model(good, bad, tuple(logistic(design(x), y, 1.0).tolist()), prior)


def _cut(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                cut = [pieces(t.encode("utf-8", "surrogatepass")) for t in part.column("text").to_pylist()]
                owner = np.repeat(np.arange(len(cut)), [len(c) for c in cut])
                at = np.concatenate([np.arange(len(c)) for c in cut])
                columns = [part.column("_id").take(pa.array(owner)), pa.array(at), pa.array([p for c in cut for p in c], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["_id", "at", "piece"])

    slim = texts.select("_id", "text")
    return slim.mapInArrow(run, f"_id {slim.schema['_id'].dataType.simpleString()}, at bigint, piece binary")


def _features(texts: DataFrame, good: bytes, bad: bytes) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with_good, with_bad = Sizer(good), Sizer(bad)
        for batch in batches:
            rows = [features(t, with_good, with_bad) for t in batch.column("text").to_pylist()]
            columns = [batch.column("_id"), batch.column("label"), pa.array(rows, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, ["_id", "label", "x"])

    slim = texts.select("_id", "label", "text")
    return slim.mapInArrow(run, f"_id {slim.schema['_id'].dataType.simpleString()}, label int, x array<double>")


def scored(df: DataFrame, model: Model, text: str) -> DataFrame:
    """The columns of df without ``text``, and the score of that column's whole texts."""
    keep = [f for f in df.schema.fields if f.name != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizers = (Sizer(model.good), Sizer(model.bad)) if model.weights else None
        for batch in batches:
            for part in slices(batch, text):
                texts = part.column(text).to_pylist()
                score = np.full(len(texts), model.prior)
                full = [i for i, t in enumerate(texts) if t]
                if sizers and full:
                    score[full] = predict(model, np.array([features(texts[i], *sizers) for i in full]))
                columns = [part.column(f.name) for f in keep] + [pa.array(score)]
                yield pa.RecordBatch.from_arrays(columns, [*(f.name for f in keep), "score"])

    return df.mapInArrow(run, StructType([*keep, StructField("score", DoubleType())]))


def quality(
    docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, folds: int = FOLDS, held_out: int = HELD_OUT
) -> DataFrame:
    """doc_id, held_out, score (of label 1), predicted."""
    model = fit(docs, labels, folds, held_out)
    slim = docs.select("doc_id", (id_crc() % folds == held_out).alias("held_out"), text_of().alias("text"))
    return scored(slim, model, "text").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents not rejected, all columns kept."""
    model = fit(docs, labels)
    names = docs.columns
    rows = docs.select(packed(docs).alias("row"), text_of().alias("text"))
    kept = scored(rows, model, "text").filter(F.col("score") >= threshold)
    return kept.select(*[F.col("row").getField(c).alias(c) for c in names])
