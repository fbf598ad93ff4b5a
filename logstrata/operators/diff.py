"""What a recording of an action adds to a baseline."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the note on rows whose time could not be resolved.
UNRESOLVED = "unresolved timestamp (timestamp_unix_ns=0)"
_PROCESS = "process_key"
#: The columns of an exported comparison. Those that a case does not have are left out.
EXPORT_COLUMNS = ("timestamp", "timestamp_unix_ns", "event_order", "source_order", "source_file", "process", "pid", "tid", "log_level", "event_type", "subsystem", "category", "message", "matched_signatures", "note")


def _keyed(df: DataFrame) -> DataFrame:
    return df.withColumn(_PROCESS, F.coalesce("process", F.lit("")))


def cutoffs(logs: DataFrame, *by: str) -> DataFrame:
    """The latest resolved time (cutoff) of each group; without groups, one row, null if no time is resolved."""
    return logs.filter("timestamp_unix_ns > 0").groupBy(*by).agg(F.max("timestamp_unix_ns").alias("cutoff"))


def baseline_cutoff(baseline: DataFrame) -> int:
    """The latest resolved time of the baseline."""
    cutoff = cutoffs(baseline).first().cutoff
    if cutoff is None:
        raise ValueError("the baseline has no log with a resolved time")
    return cutoff


def compare_to_baseline(action: DataFrame, baseline: DataFrame, cutoff_ns: int | None = None) -> DataFrame:
    """Rows of ``action`` after the cutoff, with excluded and note.

    Excluded is a row whose message and process also stand in the baseline. Rows
    without a message never are, and rows without a resolved time stay, with a note.
    The baseline's distinct keys are joined, so rows never multiply.
    """
    cutoff = baseline_cutoff(baseline) if cutoff_ns is None else cutoff_ns
    keys = _keyed(baseline).filter("message is not null").select("message", _PROCESS).distinct().withColumn("_known", F.lit(True))
    after = _keyed(action).filter((F.col("timestamp_unix_ns") > cutoff) | (F.col("timestamp_unix_ns") == 0))
    out = after.join(keys, ["message", _PROCESS], "left")
    resolved = F.col("timestamp_unix_ns") != 0
    out = out.withColumn("excluded", (resolved & F.col("_known").isNotNull()).cast("int")).withColumn("note", F.when(~resolved, F.lit(UNRESOLVED)))
    return out.select(*action.columns, "excluded", "note")


def with_signatures(rows: DataFrame, signatures: DataFrame, annotations: DataFrame) -> DataFrame:
    """``rows`` with the signature ids of each log, sorted and joined; repeats stay."""
    ids = annotations.join(signatures.select("kb_id", "signature_id"), "kb_id").groupBy("log_id").agg(F.array_join(F.array_sort(F.collect_list("signature_id")), ",").alias("signatures"))
    return rows.join(ids, rows["id"] == ids["log_id"], "left").drop("log_id")


@dataclass(frozen=True)
class Counts:
    retained: int
    noise: int
    kb_known: int
    hidden: int


class IdentifyResults:
    """The rows of a comparison, some of which an analyst hides by message and process."""

    def __init__(self, rows: DataFrame, hidden: DataFrame | None = None):
        if "signatures" not in rows.columns:
            rows = rows.withColumn("signatures", F.lit(None).cast("string"))
        self._rows = rows
        self._hidden = hidden if hidden is not None else rows.sparkSession.createDataFrame([], f"message string, {_PROCESS} string")

    def hide(self, message: str, process: str | None) -> None:
        row = self._rows.sparkSession.createDataFrame([(message, process or "")], f"message string, {_PROCESS} string")
        self._hidden = self._hidden.unionByName(row).distinct()

    def unhide(self, message: str, process: str | None) -> None:
        self._hidden = self._hidden.filter(~((F.col("message") == message) & (F.col(_PROCESS) == (process or ""))))

    def hidden_keys(self) -> DataFrame:
        return self._hidden.orderBy("message", _PROCESS)

    def flagged(self) -> DataFrame:
        """All rows with is_hidden and is_known. A row without a message is never hidden."""
        marks = self._hidden.withColumn("_h", F.lit(True))
        out = _keyed(self._rows).join(marks, ["message", _PROCESS], "left")
        return out.select(*self._rows.columns, F.col("_h").isNotNull().alias("is_hidden"), F.coalesce(F.col("signatures") != "", F.lit(False)).alias("is_known"))

    def count_table(self) -> DataFrame:
        """One row: retained, noise, kb_known, hidden."""
        noise, known, hidden = F.col("excluded") == 1, F.col("is_known"), F.col("is_hidden")
        return self.flagged().agg(F.count_if(~noise & ~known & ~hidden).alias("retained"), F.count_if(noise).alias("noise"), F.count_if(known).alias("kb_known"), F.count_if(hidden).alias("hidden"))

    def counts(self) -> Counts:
        return Counts(*self.count_table().first())

    def rows(self, noise: bool = False, known: bool = False, hidden: bool = False, search: str | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
        """The rows in read order. ``search`` is a part of the message as it stands, whatever the case of its ASCII letters; ``%`` and ``_`` are themselves."""
        from .filters import contains

        out = self.flagged()
        for show, flag in ((noise, F.col("excluded") == 1), (known, F.col("is_known")), (hidden, F.col("is_hidden"))):
            if not show:
                out = out.filter(~flag)
        if search:
            out = out.filter(contains(F.col("message"), search))
        out = out.select(*self._rows.columns).orderBy("timestamp_unix_ns", "id").offset(offset)
        return out if limit is None else out.limit(limit)

    def count(self, **which) -> int:
        return self.rows(**which).count()

    def export_csv(self, path: str, noise: bool = False, known: bool = True) -> int:
        """The rows that are not hidden as one CSV file, in read order; returns how many."""
        from ..functions.scalars import iso_or_empty
        from .export import write_csv

        rows = self.rows(noise=noise, known=known).withColumns({"timestamp": iso_or_empty(F.col("timestamp_unix_ns")), "matched_signatures": F.coalesce("signatures", F.lit(""))})
        return write_csv(rows, path, [c for c in EXPORT_COLUMNS if c in rows.columns]).rows
