"""``spark.read.format("vecframe")``: the snapshot in force of a collection, by its path on a mounted file system."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, root: Path, manifest: dict, schema: StructType) -> None:
        self.root, self.manifest, self.names = root, manifest, schema.names

    def partitions(self) -> list[InputPartition]:
        files = [f for p in self.manifest["parts"] for f in sorted((self.root / p["path"]).glob("*.parquet"))]
        return [_File(str(f)) for f in files]

    def read(self, partition: InputPartition) -> Iterator:
        import pyarrow.parquet as pq

        if partition is not None:
            yield from pq.ParquetFile(partition.path).iter_batches(columns=self.names)


class CollectionSource(DataSource):
    """Option ``path``: the collection's folder."""

    @classmethod
    def name(cls) -> str:
        return "vecframe"

    def _manifest(self) -> tuple[Path, dict]:
        root = Path(self.options["path"].removeprefix("file://").removeprefix("file:"))
        current = (root / "CURRENT").read_text()
        return root, json.loads((root / f"manifest-{int(current)}.json").read_text())

    def schema(self) -> StructType:
        return StructType.fromJson(json.loads(self._manifest()[1]["schema"]))

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(*self._manifest(), schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CollectionSource)
