"""Writing filtered logs as CSV, JSON, JSON lines or a reference-style export."""

from __future__ import annotations

import csv
import json
import os
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import iso_or_empty


def export_rows(rolled: DataFrame, fields: bool = True, labels: list[str] | None = None) -> DataFrame:
    """Rolled-up logs as they are exported: with ISO time, signature ids as a list, and one column for each label."""
    out = rolled.withColumn("timestamp", iso_or_empty(F.col("timestamp_unix_ns")))
    if fields and "values_by_label" in rolled.columns and labels is not None:
        out = out.withColumns({k: F.try_element_at("values_by_label", F.lit(k)) for k in sorted(labels)})
    return out


@dataclass(frozen=True)
class ExportResult:
    path: str
    rows: int


def _atomic(path: str, write: Callable[[object], int], **how) -> ExportResult:
    temporary = f"{path}.partial"
    try:
        with open(temporary, "w", **how) as f:
            n = write(f)
        os.replace(temporary, path)
    finally:
        if os.path.exists(temporary):
            os.remove(temporary)
    return ExportResult(path, n)


def write_csv(rows: DataFrame, path: str, columns: list[str] | None = None) -> ExportResult:
    """One file with a byte-order mark and CRLF line ends; lists are joined by commas. Rows stream through the driver in order."""
    names = columns or [c for c, k in rows.dtypes if not k.startswith("map")]

    def write(f) -> int:
        out, n = csv.writer(f, lineterminator="\r\n"), 0
        out.writerow(names)
        for r in rows.select(*names).toLocalIterator():
            out.writerow(["" if v is None else ",".join(map(str, v)) if isinstance(v, list) else v for v in r])
            n += 1
        return n

    return _atomic(path, write, encoding="utf-8-sig", newline="")


def _objects(rows: DataFrame, fields: bool):
    for r in rows.toLocalIterator():
        d = r.asDict(recursive=True)
        values = d.pop("values_by_label", None)
        if fields:
            d["extracted_values"] = values or {}
        yield d


def write_json(rows: DataFrame, path: str, fields: bool = True) -> ExportResult:
    def write(f) -> int:
        n = 0
        f.write("[")
        for d in _objects(rows, fields):
            f.write((",\n" if n else "\n") + json.dumps(d, ensure_ascii=False))
            n += 1
        f.write("\n]\n")
        return n

    return _atomic(path, write, encoding="utf-8")


def write_jsonl(rows: DataFrame, path: str, fields: bool = True) -> ExportResult:
    def write(f) -> int:
        n = 0
        for n, d in enumerate(_objects(rows, fields), 1):
            f.write(json.dumps(d, ensure_ascii=False) + "\n")
        return n

    return _atomic(path, write, encoding="utf-8")


FORMATS: dict[str, Callable[..., ExportResult]] = {"csv": lambda rows, path, fields=True: write_csv(rows, path), "json": write_json, "jsonl": write_jsonl, "ndjson": write_jsonl}


def run_export(rows: DataFrame, path: str, fmt: str | None = None, fields: bool = True) -> ExportResult:
    """Format as named, else by the file's suffix."""
    fmt = (fmt or os.path.splitext(path)[1].lstrip(".")).lower()
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}; known: {', '.join(sorted(FORMATS))}")
    return FORMATS[fmt](rows, path, fields=fields)


def bulk(rows: DataFrame, path: str, fmt: str = "json") -> None:
    """A folder of part files, written by all executors."""
    getattr(rows.write.mode("error"), fmt)(path)


def reference_rows(logs: DataFrame) -> DataFrame:
    """Logs under the names of a reference export, in order of the monotonic clock."""
    return logs.orderBy("timestamp_mach", "id").select(
        F.col("boot_uuid").alias("bootUUID"), F.col("timestamp_mach").alias("machTimestamp"), F.col("tid").alias("threadID"), F.col("pid").alias("processID"), F.col("euid").alias("userID"), "subsystem", "category",
        F.col("message").alias("eventMessage"), F.col("message_format_string").alias("formatString"), F.col("log_level").alias("messageType"), F.col("process").alias("processImagePath"), iso_or_empty(F.col("timestamp_unix_ns")).alias("timestamp"),
    )


def pivot_values(annotated: DataFrame, values: DataFrame, labels: list[str]) -> DataFrame:
    """One row for each log with a column for each label: distinct values, sorted, joined."""
    found = values.filter(F.col("label").isin(labels)).groupBy("log_id").pivot("label", labels).agg(F.when(F.count("value") > 0, F.array_join(F.array_sort(F.collect_set("value")), "; ")))
    return annotated.join(found, annotated["id"] == found["log_id"], "left").drop("log_id")
