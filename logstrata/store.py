"""A case on disk: a folder of Parquet tables and a status that is written last."""

from __future__ import annotations

import json
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.keywords import keyword_index
from .operators.query import LogStore, read_surface
from .schemas import STATUSES
from .scratch import drop, written

TABLES = ("logs", "source_files", "anchors", "boots", "shutdown_events", "shutdown_clients", "kb_signatures", "annotations", "extracted_values", "identified", "keywords")


class InvalidCaseError(ValueError):
    pass


class IncompleteCaseError(InvalidCaseError):
    pass


class CaseStore:
    """Tables live at <path>/<table>; <path>/_meta holds one JSON line. Files are reached through
    Spark's file system layer, so a case may lie in any store that Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _exists(self, name: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def meta(self) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/_meta").first()[0]) if self._exists("_meta") else {}

    def set_status(self, status: str, **more) -> None:
        if status not in STATUSES:
            raise ValueError(status)
        line = json.dumps(self.meta() | more | {"status": status, "at": datetime.now(timezone.utc).isoformat()})
        self.spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/_meta")

    def seal(self, log_path: str) -> str:
        """Notes the digest of an operational log file in the case, so that a later change shows. The file is on the driver."""
        import hashlib

        digest = hashlib.sha256()
        with open(log_path, "rb") as f:
            while part := f.read(1 << 20):
                digest.update(part)
        self.set_status(self.meta().get("status", "complete"), log_file=log_path, log_file_sha256=digest.hexdigest())
        return digest.hexdigest()

    @classmethod
    def create(cls, spark: SparkSession, path: str, **meta) -> CaseStore:
        out = cls(spark, path)
        if out._exists(""):
            raise FileExistsError(path)
        out.set_status("running", **meta)
        return out

    @classmethod
    def open(cls, spark: SparkSession, path: str, allow_incomplete: bool = False) -> CaseStore:
        out = cls(spark, path)
        if not out._exists(""):
            raise FileNotFoundError(path)
        if not out._exists("logs"):
            raise InvalidCaseError(f"{path}: no logs table")
        if not allow_incomplete and out.meta().get("status", "complete") != "complete":
            raise IncompleteCaseError(f"{path}: {out.meta()['status']}")
        return out

    def write(self, name: str, df: DataFrame, mode: str = "overwrite", **options) -> None:
        df.write.mode(mode).options(**options).parquet(f"{self.path}/{name}")

    def write_valid(self, name: str, df: DataFrame, required: tuple[str, ...] = ("id", "timestamp_unix_ns", "timestamp_mach", "message"), **options) -> int:
        """Writes the rows that have all ``required`` columns; the others go to <name>_rejects, and their number is returned. One bad row spoils no table."""
        rows = written(df, name)
        valid = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in required if c in df.columns], F.lit(True))
        self.write(name, rows.filter(valid), **options)
        bad = rows.filter(~valid)
        n = bad.count()
        if n:
            self.write(f"{name}_rejects", bad)
        drop(rows)
        return n

    def append(self, name: str, df: DataFrame) -> None:
        self.write(name, df, "append")

    def table(self, name: str) -> DataFrame | None:
        return self.spark.read.parquet(f"{self.path}/{name}") if self._exists(name) else None

    def logs(self) -> LogStore:
        return LogStore(self.table("logs"), self.table("kb_signatures"), self.table("annotations"), self.table("extracted_values"), self.table("keywords"))

    def index_messages(self) -> None:
        """Writes the keyword index of the logs; from then on keyword queries use it."""
        found = keyword_index(self.table("logs"))
        found.repartition("bucket", "token").sortWithinPartitions("bucket", "token", "id").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/keywords")

    def view(self, name: str = "v_logs") -> DataFrame:
        """Registers and returns the stable read surface."""
        df = read_surface(self.table("logs"))
        df.createOrReplaceTempView(name)
        return df

    def clear(self, *names: str) -> int:
        """Empties tables; returns how many rows went."""
        gone = 0
        for n in names:
            df = self.table(n)
            if df is not None:
                gone += df.count()
                self.write(n, self.spark.createDataFrame([], df.schema))
        return gone
