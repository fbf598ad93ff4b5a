"""A Spark data source for binary logs: ``spark.read.format("logstrata").load(folder)``.

One partition for each file, so files are parsed in parallel and a lost one is read again.
Rows are the flat records of ``tracev3.RECORD`` with the file's path. For files that only Spark
can reach use ``ingest.read_archive``, which reads through ``binaryFile``.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import tracev3


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.root = options.get("path", "")

    def partitions(self):
        found = [p for p in Path(self.root).rglob("*.tracev3") if not p.name.startswith("._")]
        return [_File(str(p)) for p in sorted(found, key=lambda p: (-p.stat().st_size, str(p)))]  # the largest first

    def read(self, partition):
        for what, row in tracev3.records(Path(partition.path).read_bytes()):
            if what == "entry":
                yield (partition.path, *row)


class LogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "logstrata"

    def schema(self) -> str:
        return "path string, " + tracev3.RECORD

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LogSource)
