"""Toxicity by a counterfactual-regularised classifier.

A logistic regression over words and word beginnings (toxic words are often inflected).
In every labelled sentence that names a group, the identity term is swapped for
others of its kind; the fit adds a penalty on the squared change of the score between
the sentence and its swapped form. So no weight settles on a group's name merely because
it is mentioned more in toxic text, and neutral mentions stay neutral.

Bounded samples are used for fitting only, chosen by hash: ``DOCS`` documents per class
and ``PAIRS`` swapped sentences; ``FEATURES`` features are chosen by their
chi-square with the label, counted over the sampled documents' whole texts. Scoring reads
every text as a whole, in one pass without a shuffle.

Defined cases: NULL text scores like the empty text; conflicting labels of one id count as
toxic; rows without id are not used for fitting; if the sample lacks a class, every document
gets the smoothed share of toxic labels. Repeated rows each get a row; an empty table
gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titleloom.llm.common import id_crc, slices, store, text_of

DOCS = 5_000  # per class
FEATURES = 512
PAIRS = 10_000
STRENGTH = 10.8  # least chi-square of a feature with the label (one in a thousand by chance)
SEEN = 2  # least number of documents of a feature
RIDGE = 2.0  # on a feature of least strength; stronger ones are held less, in proportion
PENALTY = 20.0
BEGINNINGS = (4, 5, 6, 7, 8)
THRESHOLD = 0.5
FOLDS, HELD_OUT = 5, 0

# Identity terms, by kind. A term is swapped for the others of its kind.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys", "trans", "nonbinary"),
    ("woman", "man", "girl", "boy"),
    ("female", "male", "transgender"),
    ("gay", "lesbian", "bisexual", "straight", "queer", "heterosexual", "homosexual"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "sikh", "atheist", "catholic", "protestant"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "sikhs", "atheists", "catholics", "protestants"),
    ("black", "white", "asian", "latino", "hispanic", "indigenous", "arab"),
    ("african", "american", "european", "mexican", "chinese", "indian", "german", "french", "turkish", "polish"),
    ("immigrants", "refugees", "migrants", "foreigners", "locals", "citizens"),
    ("old", "young", "elderly", "teenage"),
    ("disabled", "deaf", "blind", "autistic"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten"),
    ("ausländer", "flüchtlinge", "einwanderer", "deutsche", "türken", "polen"),
    ("femmes", "hommes", "filles", "garçons"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"),
    ("immigrés", "réfugiés", "étrangers", "français", "arabes", "africains"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"),
    ("inmigrantes", "refugiados", "extranjeros", "españoles", "árabes", "africanos"),
)

_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[^.!?\n]+")


class Model(NamedTuple):
    weights: dict[str, float]
    constant: float


def words(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def features(found: set[str]) -> set[str]:
    """Words, and beginnings written with a star."""
    out = set(found)
    for n in BEGINNINGS:
        out.update([w[:n] + "*" for w in found if len(w) >= n])
    return out


def swapped(sentence: set[str], terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS) -> Iterator[set[str]]:
    """The sentence's words with each identity term replaced by each other term of its kind."""
    for kind in terms:
        for term in sentence.intersection(kind):
            for other in kind:
                if other not in sentence:
                    yield (sentence - {term}) | {other}


def learnable(labels: DataFrame, folds: int, held_out: int) -> DataFrame:
    """_id, label: one row per labelled id outside the held-out fold."""
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (id_crc() % folds != held_out))
    return usable.groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").cast("int").alias("label"))


def _counts(texts: DataFrame) -> DataFrame:
    """feature, toxic, clean: sampled documents with the feature, added up per batch before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 8 << 20):
                seen: tuple[Counter, Counter] = (Counter(), Counter())
                for text, label in zip(part.column("text").to_pylist(), part.column("label").to_pylist()):
                    seen[label].update(features(words(text)))
                names = list(seen[0].keys() | seen[1].keys())
                columns = [pa.array(names, pa.string()), *(pa.array([s[n] for n in names], pa.int64()) for s in (seen[1], seen[0]))]
                yield pa.RecordBatch.from_arrays(columns, ["feature", "toxic", "clean"])

    found = texts.select("label", "text").mapInArrow(run, "feature string, toxic bigint, clean bigint")
    return found.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _indexed(texts: DataFrame, names: list[str]) -> DataFrame:
    """label, on: the chosen features of each sampled document."""
    place = {n: i for i, n in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [sorted(place[f] for f in features(words(t)) & place.keys()) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("label"), pa.array(rows, pa.list_(pa.int32()))], ["_id", "label", "on"])

    slim = texts.select("_id", "label", "text")
    return slim.mapInArrow(run, f"_id {slim.schema['_id'].dataType.simpleString()}, label int, on array<int>")


def _pairs(texts: DataFrame, names: list[str], terms: tuple[tuple[str, ...], ...]) -> DataFrame:
    """gone, come: chosen features that a swap in a labelled sentence takes away and brings."""
    place = {n: i for i, n in enumerate(names)}
    every = {t for kind in terms for t in kind}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = set()
            for text in batch.column("text").to_pylist():
                lowered = text.lower()
                if not words(lowered) & every:
                    continue
                for sentence in _SENTENCE.findall(lowered):
                    held = words(sentence)
                    before = features(held) & place.keys()
                    for other in swapped(held, terms):
                        after = features(other) & place.keys()
                        if before != after:
                            found.add((tuple(sorted(place[f] for f in before - after)), tuple(sorted(place[f] for f in after - before))))
            kind = pa.list_(pa.int32())
            rows = sorted(found)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], kind), pa.array([r[1] for r in rows], kind)], ["gone", "come"])

    return texts.select("text").mapInArrow(run, "gone array<int>, come array<int>")


def solve(x: np.ndarray, y: np.ndarray, swaps: np.ndarray, ridge: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Newton steps on the logistic loss, a ridge per feature, and the squared score changes of swaps; the last column of x is the constant."""
    pull = np.diag(np.append(ridge, 1e-6))
    pull[:-1, :-1] += penalty * (swaps.T @ swaps)
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = np.maximum(p * (1 - p), 1e-5)
        move = np.linalg.solve((x * curve[:, None]).T @ x + pull, x.T @ (p - y) + pull @ w)
        w -= move * min(1.0, 4.0 / max(1e-9, float(np.abs(move).max())))
        if np.abs(move).max() < 1e-7:
            break
    return w


def fit(
    docs: DataFrame,
    labels: DataFrame,
    folds: int = FOLDS,
    held_out: int = HELD_OUT,
    terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS,
    penalty: float = PENALTY,
) -> Model:
    known = store(learnable(labels, folds, held_out), "toxic-labels")
    counts = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    share = (counts.get(1, 0) + 1) / (counts.get(0, 0) + counts.get(1, 0) + 2)
    order = [F.xxhash64(F.lit("sample"), "_id"), F.col("_id")]
    # At most 2 * DOCS rows of two small columns.
    chosen = known.filter("label = 1").orderBy(*order).limit(DOCS).unionAll(known.filter("label = 0").orderBy(*order).limit(DOCS))
    texts = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    texts = store(texts.select("_id", "label", "text"), "toxic-sample")

    sizes = {r[0]: r[1] for r in texts.groupBy("label").count().collect()}
    n1, n0 = (F.lit(float(sizes.get(c, 0))) for c in (1, 0))
    a, b = F.col("toxic"), F.col("clean")
    chi = (n1 + n0) * (a * (n0 - b) - b * (n1 - a)) ** 2 / (n1 * n0 * (a + b) * (n1 + n0 - a - b))
    strong = _counts(texts).filter((a + b >= SEEN) & (a + b < n1 + n0)).withColumn("strength", F.when((n1 > 0) & (n0 > 0), chi))
    strong = strong.filter(F.col("strength") >= STRENGTH)
    best = strong.orderBy(F.col("strength").desc(), "feature").limit(FEATURES).select("feature", "strength").collect()
    names = [r[0] for r in best]
    # Repeated documents of one id may exceed the number of ids; the same bound holds again.
    rows = _indexed(texts, names).orderBy(F.xxhash64("_id"), "_id", "on").limit(2 * DOCS).collect()
    y = np.array([float(r["label"]) for r in rows])
    if not 0 < y.sum() < len(y):
        return Model({}, float(np.log(share / (1 - share))))
    x = np.zeros((len(rows), len(names) + 1))
    x[:, -1] = 1
    for i, r in enumerate(rows):
        x[i, r["on"]] = 1
    pairs = _pairs(texts, names, terms).distinct().orderBy(F.xxhash64("gone", "come"), "gone", "come").limit(PAIRS).collect()
    swaps = np.zeros((len(pairs), len(names)))
    for i, r in enumerate(pairs):
        swaps[i, r["gone"]] = 1
        swaps[i, r["come"]] = -1
    ridge = np.array([RIDGE * STRENGTH / r[1] for r in best])
    w = solve(x, y, swaps, ridge, penalty)
    # The sample is dealt by class; the constant goes back to the classes' shares among all labels.
    shift = np.log(share / (1 - share)) - np.log(y.mean() / (1 - y.mean()))
    return Model(dict(zip(names, w[:-1].tolist())), float(w[-1] + shift))


def scores(model: Model, texts: list[str]) -> np.ndarray:
    """Probability of label 1 for whole texts."""
    get = model.weights.get
    out = np.empty(len(texts))
    for i, text in enumerate(texts):
        found = words(text)
        hit = {w for w in found if w in model.weights}
        for n in BEGINNINGS:
            hit.update(b for w in found if (b := w[:n] + "*") in model.weights and len(w) >= n)
        out[i] = model.constant + sum(get(f) for f in sorted(hit))
    return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, folds: int = FOLDS, held_out: int = HELD_OUT) -> DataFrame:
    """doc_id, held_out, score (of label 1), predicted."""
    model = fit(docs, labels, folds, held_out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                score = scores(model, part.column("text").to_pylist())
                columns = [part.column("doc_id"), part.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted"])

    slim = docs.select("doc_id", (id_crc() % folds == held_out).alias("held_out"), text_of().alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
