"""File listings to document names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def document_names(listing: DataFrame, suffix: str = ".html", index: str = "index.html") -> DataFrame:
    """Files with the suffix, but for the root index itself."""
    return listing.where(
        (F.col("type") == "blob") & F.col("path").endswith(suffix) & (F.col("path") != index)
    ).select(F.col("path").alias("name"))
