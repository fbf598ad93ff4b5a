"""Tables between the steps of an operator, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a narrow key table (at most about 100 bytes a row) may be broadcast.
BROADCAST_ROWS = 500_000

_LOCAL: dict[str, str] = {}
_TABLES: list[str] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Without its native library, Hadoop starts a `chmod` for each file and folder that it makes on a local file system, and such a child shares
#: the JVM's memory until it is replaced. So tables have no checksum files and no marks of success; their pages carry checksums instead.
_WRITING = {
    "compression": "zstd",
    "parquet.page.write-checksum.enabled": "true",
    "mapreduce.fileoutputcommitter.marksuccessfuljobs": "false",
    "fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem",
    "fs.file.impl.disable.cache": "true",
}
_READING = {"parquet.page.verify-checksum.enabled": "true"}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Only an application in one local JVM may do without it; it then gets a folder
    of its own, once.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    application = spark.sparkContext.applicationId
    if application not in _LOCAL:
        _LOCAL[application] = tempfile.mkdtemp(prefix="logstrata-")
    return _LOCAL[application]


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage, survives lost executors,
    and fixes what a rerun of a task could otherwise deal out differently. The shuffle
    files of the query go as soon as the table stands. See :func:`drop` and :func:`drop_all`."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    schema, before = df.schema, spark.conf.get(_CLEANUP)
    _TABLES.append(path)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.options(**_WRITING).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(schema).options(**_READING).parquet(path)
    out._table_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Removes tables that :func:`written` gave and that nothing reads any more."""
    for df in tables:
        _remove(df.sparkSession, df._table_path)


def drop_all(spark: SparkSession) -> None:
    """Removes all tables that operators have written from this driver and that still stand. Results that were not read yet are lost."""
    for path in list(_TABLES):
        _remove(spark, path)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Removes at its end the tables that were written within; for operations whose results are stored by then."""
    before = set(_TABLES)
    try:
        yield
    finally:
        for path in [p for p in _TABLES if p not in before]:
            _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    if path in _TABLES:
        _TABLES.remove(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows, else as it is, for a
    shuffled join whose skewed partitions adaptive execution splits. ``df`` is a written table."""
    return F.broadcast(df) if df.count() <= rows else df
