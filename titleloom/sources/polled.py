"""A polled listing as a data source for batch and streaming reads.

A poll leaves a manifest: a Parquet file with the entries it saw (``path``, ``type``), under a name that sorts after
the earlier ones. The source reads a folder of manifests. Row groups are its partitions, so a large manifest is read by
many tasks; the offset of a stream is the name of the last manifest taken, so a restart goes on behind it and
no manifest is read twice. ``per_batch`` manifests at most enter one micro-batch.

    register(spark)
    spark.read.format("polled_listing").load(folder)
    spark.readStream.format("polled_listing").option("per_batch", 100).load(folder)
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

NAME = "polled_listing"


@dataclass
class RowGroup(InputPartition):
    """One row group of one manifest."""

    path: str
    number: int


class Manifests:
    """The manifests of a folder on any store Arrow reaches."""

    def __init__(self, folder: str) -> None:
        self.folder = folder

    def _place(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.folder) if "://" in self.folder or self.folder.startswith("file:") else (pafs.LocalFileSystem(), self.folder)

    def names(self) -> list[str]:
        store, root = self._place()
        found = store.get_file_info(pafs.FileSelector(root, allow_not_found=True))
        return sorted(f.base_name for f in found if f.is_file and f.base_name.endswith(".parquet") and f.base_name[0] not in "._")

    def row_groups(self, names: list[str]) -> list[RowGroup]:
        store, root = self._place()
        counts = [pq.ParquetFile(store.open_input_file(f"{root}/{n}")).num_row_groups for n in names]
        return [RowGroup(n, g) for n, count in zip(names, counts) for g in range(count)]

    def rows(self, part: RowGroup, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        store, root = self._place()
        with store.open_input_file(f"{root}/{part.path}") as source:
            for batch in pq.ParquetFile(source).read_row_group(part.number, columns=schema.names).cast(schema).to_batches(1 << 14):
                yield batch


_SCHEMA = pa.schema([("path", pa.string()), ("type", pa.string())])


class _Batch(DataSourceReader):
    def __init__(self, manifests: Manifests) -> None:
        self.manifests = manifests

    def partitions(self) -> list[RowGroup]:
        # An empty list would be read as one partition without a name.
        return self.manifests.row_groups(self.manifests.names()) or [RowGroup("", -1)]

    def read(self, partition: RowGroup) -> Iterator[pa.RecordBatch]:
        if partition.number >= 0:
            yield from self.manifests.rows(partition, _SCHEMA)


class _Stream(DataSourceStreamReader):
    def __init__(self, manifests: Manifests, per_batch: int) -> None:
        self.manifests, self.per_batch, self.last = manifests, per_batch, ""

    def initialOffset(self) -> dict:
        return {"last": ""}

    def latestOffset(self) -> dict:
        ahead = [n for n in self.manifests.names() if n > self.last][: self.per_batch]
        self.last = ahead[-1] if ahead else self.last
        return {"last": self.last}

    def partitions(self, start: dict, end: dict) -> list[RowGroup]:
        self.last = max(self.last, end["last"])
        return self.manifests.row_groups([n for n in self.manifests.names() if start["last"] < n <= end["last"]])

    def read(self, partition: RowGroup) -> Iterator[pa.RecordBatch]:
        return self.manifests.rows(partition, _SCHEMA)


class PolledListing(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "path string, type string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Batch(Manifests(self.options["path"]))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(Manifests(self.options["path"]), int(self.options.get("per_batch", 1000)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PolledListing)
