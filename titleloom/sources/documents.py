"""HTML documents with an encoded fragment to item rows.

Fragments are cut and JSON is read in Catalyst. Only the payload codec runs over
Arrow batches, inside the tasks that hold the documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titleloom import fixed_values as V
from titleloom.functions.barrier import pinned
from titleloom.sources import strict_json as J
from titleloom.sources.payload import decode_text


def fragment(html: Column, marker: str) -> Column:
    """Text between the first marker and the next double quote. '' if empty, NULL if unmarked or unclosed."""
    start = F.locate(marker, html)
    rest = F.substring(html, start + len(marker), F.length(html))
    return F.when((start > 0) & (F.locate('"', rest) > 0), F.substring_index(rest, '"', 1))


def decode_payloads(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Replace the payload column by ``json`` and ``error`` (one of them is NULL).

    Whole payloads, one row in, one row out, batches bounded by Spark's Arrow
    byte and record limits.
    """
    keep = [c for c in df.columns if c != payload]
    fields = [df.schema[c] for c in keep]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields])
    schema += (", " if schema else "") + "json string, error string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            results = [decode_text(p) for p in batch.column(payload).to_pylist()]
            texts = pa.array([r[0] for r in results], pa.string())
            errors = pa.array([r[1] for r in results], pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep] + [texts, errors], [*keep, "json", "error"]
            )

    return df.mapInArrow(run, schema)


def _entries(listed: Column) -> Column:
    """The list's entries; NULL for one when any field is missing, given under both names, or mistyped.

    An expression inside ``transform`` is evaluated as often as it is written, so each step names what
    the next one uses more than once.
    """
    sizes = [f"_size{i}" for i in range(len(V.SIZE_KEYS))]
    found = F.transform(listed, lambda v: F.struct(
        J.field(v, "filename").alias("name"),
        J.field(v, "hash").alias("item"),
        *[J.field(v, k).alias(c) for k, c in zip(V.SIZE_KEYS, sizes)],
    ))
    typed = F.transform(found, lambda e: F.struct(
        J.text_of(e["name"]).alias("filename"),
        J.text_of(e["item"]).alias("item_hash"),
        J.single([e[c] for c in sizes]).alias("_size"),
    ))
    whole = F.transform(typed, lambda e: F.struct(
        e["filename"].alias("filename"), e["item_hash"].alias("item_hash"), J.whole_of(e["_size"]).alias("size_bytes")
    ))
    return F.transform(whole, lambda e: F.when(
        e["filename"].isNotNull() & e["item_hash"].isNotNull() & e["size_bytes"].isNotNull(), e
    ))


def with_entries(df: DataFrame, json: str = "json") -> DataFrame:
    """Add ``title`` and ``entries``; entries are NULL when the document is invalid as a whole.

    Shapes: an object with one of the list keys and an optional title, or a bare
    array. Unknown fields are ignored, an empty list is valid, a key that repeats
    in an object is not. Everything is an expression over a variant; see ``strict_json``.
    """
    names = [F.col(f"`{c}`") for c in df.columns]
    parsed = df.select("*", pinned(J.parse(F.col(f"`{json}`"))).alias("_doc"))
    doc = F.col("_doc")
    title = J.field(doc, "title")
    listed = F.coalesce(J.items(doc), F.when(J.is_null(title) | J.text_of(title).isNotNull(), J.items(J.only(doc, V.LIST_KEYS))))
    read = parsed.select(*names, J.text_of(title).alias("title"), pinned(_entries(listed)).alias("_read"))
    whole = F.when(F.forall("_read", lambda e: e.isNotNull()), F.col("_read"))
    read = read.select(*names, pinned(F.struct(F.when(whole.isNotNull(), F.col("title")).alias("title"), whole.alias("entries"))).alias("_whole"))
    return read.select(*names, "_whole.title", "_whole.entries")


def explode_entries(df: DataFrame, *keep: str) -> DataFrame:
    """One row per entry with its position; documents without a valid list give none."""
    return df.select(*keep, "title", F.posexplode("entries").alias("pos", "e")).select(
        *keep, "title", "pos", "e.filename", "e.item_hash", "e.size_bytes"
    )


def read_documents(documents: DataFrame, marker: str) -> DataFrame:
    """``source, html`` to ``source, title, entries, error``: decoded once, used by both outputs.

    ``error`` is NULL for valid documents, also for an empty list.
    """
    found = documents.select("source", fragment(F.col("html"), marker).alias("payload"))
    read = with_entries(decode_payloads(found))
    return read.select(
        "source",
        "title",
        "entries",
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(F.col("entries").isNull(), "invalid document")
        .alias("error"),
    )


def document_items(read: DataFrame) -> DataFrame:
    return explode_entries(read, "source")


def document_errors(read: DataFrame) -> DataFrame:
    """Dead letters: these sources stay pending."""
    return read.where(F.col("error").isNotNull()).select("source", "error")
