"""Reading a case: filtered rows, counts, pages, context, annotations."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import VIEW
from .filters import LogFilters, apply_filters, warn_unknown
from .ordering import event_window

PAGE = 500


def rolled_up(logs: DataFrame, signatures: DataFrame, annotations: DataFrame, values: DataFrame) -> DataFrame:
    """``logs`` with signature_ids and values_by_label: one row for each log, whatever its annotations.

    Annotations are gathered for each log before the join, so the fact rows never multiply.
    """
    a = annotations.join(signatures.select("kb_id", "signature_id"), "kb_id").groupBy("log_id").agg(F.array_sort(F.collect_set("signature_id")).alias("signature_ids"))
    v = values.filter("value is not null").groupBy("log_id", "label").agg(F.array_join(F.array_sort(F.collect_set("value")), "; ").alias("joined"))
    v = v.groupBy(F.col("log_id").alias("vid")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "joined")))).alias("values_by_label"))
    out = logs.join(a, F.col("id") == F.col("log_id"), "left").join(v, F.col("id") == F.col("vid"), "left").drop("log_id", "vid")
    return out.withColumn("signature_ids", F.coalesce("signature_ids", F.array().cast("array<string>")))


def read_surface(logs: DataFrame) -> DataFrame:
    """The stable columns, as far as the rows have them."""
    return logs.select(*[c for c in (*VIEW, "source_order", "event_order") if c in logs.columns])


def with_lookups(fact: DataFrame, *lookups: tuple[DataFrame, str, str, list[str]]) -> DataFrame:
    """``fact`` with columns of its lookup tables, each (table, key in the fact, key in the table, columns); rows without a match keep nulls.

    Only key and columns of a lookup are read; one that is small by its statistics, or found so at run time, is broadcast.
    """
    out = fact
    for k, (table, own, key, columns) in enumerate(lookups):
        side = table.select(F.col(key).alias(f"_key{k}"), *columns)
        out = out.join(side, F.col(own) == F.col(f"_key{k}"), "left").drop(f"_key{k}")
    return out


class LogStore:
    """A case that is held open: its tables and what can be asked of them."""

    def __init__(self, logs: DataFrame, signatures: DataFrame | None = None, annotations: DataFrame | None = None, values: DataFrame | None = None, index: DataFrame | None = None):
        self.logs, self.signatures, self.annotations, self.values, self.index = logs, signatures, annotations, values, index

    @property
    def annotated(self) -> bool:
        return self.annotations is not None

    @property
    def indexed(self) -> bool:
        return self.index is not None

    def matching(self, filters: LogFilters | None = None) -> DataFrame:
        return apply_filters(self.logs, filters or LogFilters(), self.signatures, self.annotations, index=self.index)

    def count(self, filters: LogFilters | None = None) -> int:
        return self.matching(filters).count()

    def query(self, filters: LogFilters | None = None, limit: int | None = None) -> DataFrame:
        """Rows in read order (time, id). The limit counts logs, not joined rows; 0 gives none."""
        rows = self.matching(filters).orderBy("timestamp_unix_ns", "id")
        rows = rows if limit is None else rows.limit(limit)
        return self._dressed(rows).orderBy("timestamp_unix_ns", "id")

    def fetch(self, offset: int = 0, limit: int = PAGE, filters: LogFilters | None = None) -> DataFrame:
        """One page. Its ids are chosen on narrow rows; only then are whole rows joined."""
        ids = self.matching(filters).select("timestamp_unix_ns", "id").orderBy("timestamp_unix_ns", "id").offset(offset).limit(limit).select("id")
        return self._dressed(self.logs.join(F.broadcast(ids), "id", "left_semi")).orderBy("timestamp_unix_ns", "id")

    def context(self, log_id: int, before: int = 20, after: int = 20) -> DataFrame:
        return event_window(self.logs, log_id, before, after)

    def annotations_for(self, log_id: int) -> DataFrame:
        if not self.annotated:
            raise ValueError("this case is not annotated")
        return self.annotations.filter(F.col("log_id") == log_id).join(self.signatures, "kb_id").orderBy("signature_id")

    def label_table(self) -> DataFrame:
        """(signature_id, label, n): the labels that each signature has values for, and how many."""
        return self.values.join(self.signatures.select("kb_id", "signature_id"), "kb_id").groupBy("signature_id", "label").agg(F.count("*").alias("n"))

    def labels(self) -> list[str]:
        return [r[0] for r in self.label_table().select("label").distinct().orderBy("label").collect()] if self.values is not None and self.signatures is not None else []

    def rows(self, filters: LogFilters | None = None, limit: int | None = None) -> Iterator:
        """Rows one after the other, a partition at a time on the driver."""
        return self.query(filters, limit).toLocalIterator(prefetchPartitions=True)

    def _dressed(self, rows: DataFrame) -> DataFrame:
        return rolled_up(rows, self.signatures, self.annotations, self.values) if self.annotated else rows


def query_logs(logs: DataFrame, limit: int | None = None, check_names: bool = False, **criteria) -> DataFrame:
    """Matching rows in read order. With ``check_names`` names that no row has are warned of first, which reads the columns asked for."""
    if check_names:
        warn_unknown(logs, LogFilters(**criteria))
    return LogStore(logs).query(LogFilters(**criteria), limit)


def count_logs(logs: DataFrame, **criteria) -> int:
    return LogStore(logs).count(LogFilters(**criteria))


def fetch_logs(logs: DataFrame, offset: int = 0, limit: int = PAGE, **criteria) -> DataFrame:
    return LogStore(logs).fetch(offset, limit, LogFilters(**criteria))


def fetch_context(logs: DataFrame, log_id: int, before: int = 20, after: int = 20) -> DataFrame:
    return LogStore(logs).context(log_id, before, after)
