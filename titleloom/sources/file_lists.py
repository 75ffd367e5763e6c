"""JSON file lists of a provider to file rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titleloom.functions.barrier import pinned
from titleloom.sources import strict_json as J


def _file(entry: Column, place: Column) -> Column:
    """(path, size, id, place in the list) of a well-formed entry, else NULL."""
    path, size, number = J.text_of(J.field(entry, "path")), J.whole_of(J.field(entry, "bytes")), J.whole_of(J.field(entry, "id"))
    plain = F.regexp_replace(path, "^/", "")
    row = F.struct(plain.alias("path"), size.alias("size"), number.alias("id"), place.alias("pos"))
    return F.when(path.isNotNull() & size.isNotNull() & number.isNotNull(), row)


def with_files(df: DataFrame, json: str = "json") -> DataFrame:
    """Add ``files``: well-formed entries of ``$.files``; NULL without such an array."""
    names = [F.col(f"`{c}`") for c in df.columns]
    listed = J.items(J.field(J.parse(F.col(f"`{json}`")), "files"))
    files = F.filter(F.transform(listed, _file), lambda f: f.isNotNull())
    return df.select(*names, pinned(files).alias("files"))


def file_rows(listed: DataFrame, key: str = "key") -> DataFrame:
    """Row per file with its place in the list; the provider counts from 1, rows from 0.

    Numbers 0 and 1 both give index 0; the later place wins where rows are stored.
    """
    index = F.greatest(F.col("id") - 1, F.lit(0)).cast("int").alias("file_index")
    return listed.select(key, F.inline("files")).select(key, "path", "size", index, "pos")


def list_errors(listed: DataFrame, key: str = "key") -> DataFrame:
    return listed.where(F.col("files").isNull()).select(key, F.lit("no file list").alias("error"))
