"""Helpers the operators of this folder share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Words between ASCII white space, as Java, Python and RE2 read the pattern.
SPACED_WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``, which driver and executors share.

    Only a session that runs inside one process may lack the setting; it gets a
    folder of its own. Any session with separate executors is refused.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", named)
    return named


def store(df: DataFrame, label: str) -> DataFrame:
    """Write the rows to a table in the shared folder and go on from there.

    Cuts the lineage: a lost executor costs a read, not a recomputation. The rows
    are computed once however often the result is used, and a join against the
    table shuffles both sides itself, so that AQE can split a hot key.
    """
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_of(name: str = "text") -> Column:
    """A text column with NULL read as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, ASCII_UPPER, ASCII_UPPER.lower())


def id_crc(name: str = "doc_id") -> Column:
    """CRC-32 of the id written as text; a NULL id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")))


def packed(df: DataFrame, *added: str) -> Column:
    """The input row as one struct, so that no column of it can clash with working columns.

    Columns named like one of ``added`` (in any case) are left out: the
    operator's own column replaces them.
    """
    taken = {a.lower() for a in added}
    fields = [F.col(f"`{c}`") for c in df.columns if c.lower() not in taken]
    return F.struct(*fields) if fields else F.struct(F.lit(None).alias("none"))


def unpacked(df: DataFrame, names: list[str], *more: Column, row: str = "row") -> DataFrame:
    fields = [F.col(row).getField(c).alias(c) for c in names]
    return df.select(*fields, *more)


def kept_names(df: DataFrame, *added: str) -> list[str]:
    taken = {a.lower() for a in added}
    return [c for c in df.columns if c.lower() not in taken]


def slices(batch: pa.RecordBatch, column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Split a batch so that each part holds about ``most`` bytes of text, one row at least.

    Texts are never cut; a longer one is a part of its own.
    """
    if batch.num_rows == 0:
        return
    array = batch.column(column)
    lengths = np.asarray(pc.binary_length(array).fill_null(0)).astype(np.int64)
    end = np.cumsum(lengths)
    start = 0
    while start < batch.num_rows:
        base = end[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(end, base + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def logistic(x: np.ndarray, y: np.ndarray, ridge: float, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic regression by Newton steps; the last column of x is the constant."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + penalty * w
        weight = np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((x * weight[:, None]).T @ x + np.diag(penalty), gradient)
        w -= step * min(1.0, 5.0 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-8:
            break
    return w
