"""What a case holds: totals, bounds, facets, histogram."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NS = 1_000_000_000
#: Histogram bucket widths in seconds.
BUCKETS = (1, 2, 5, 10, 15, 30, 60, 120, 300, 600, 900, 1800, 3600, 7200, 21600, 43200, 86400, 172800, 604800)
FACETS = ("process", "subsystem", "category", "log_level")


@dataclass
class Summary:
    total: int = 0
    unresolved: int = 0
    first_ns: int | None = None
    last_ns: int | None = None
    annotated: int = 0
    top: dict[str, list[tuple[str, int]]] = field(default_factory=dict)
    actions: list[tuple[str, str, int]] = field(default_factory=list)
    bucket_ns: int | None = None
    histogram: list[tuple[int, int, int]] = field(default_factory=list)


def bounds(logs: DataFrame) -> DataFrame:
    """One row: total, unresolved, first_ns, last_ns. Rows without a wall-clock time (0) count only in the first two."""
    ts = F.col("timestamp_unix_ns")
    return logs.agg(F.count("*").alias("total"), F.count_if(ts == 0).alias("unresolved"), F.min(F.when(ts > 0, ts)).alias("first_ns"), F.max(F.when(ts > 0, ts)).alias("last_ns"))


def facets(logs: DataFrame, columns: tuple[str, ...] = FACETS) -> DataFrame:
    """(facet, value, n) for all columns, in one scan: each row gives one pair for each column that it has, and pairs are counted."""
    pairs = F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).alias("value")) for c in columns])
    return logs.select(F.inline(pairs)).filter("value is not null").groupBy("facet", "value").agg(F.count("*").alias("n"))


def bucket_ns(span_ns: int, target: int = 40) -> int:
    """The least nice width that makes at most about ``target`` buckets."""
    want = max(span_ns, 1) / max(target, 1)
    return next((b for b in BUCKETS if b * NS >= want), BUCKETS[-1]) * NS


def histogram(logs: DataFrame, annotated: DataFrame | None = None, target: int = 40, width_ns: int | None = None) -> DataFrame:
    """(bucket, start_ns, total, annotated), with empty buckets, from the first resolved log on.

    ``annotated`` has log_id; each log counts once there, whatever its annotations.
    """
    b = bounds(logs).first()
    if b.first_ns is None:
        return logs.sparkSession.createDataFrame([], "bucket long, start_ns long, total long, annotated long")
    span = max(b.last_ns - b.first_ns, 1)
    width = width_ns or bucket_ns(span, target)
    at = F.expr(f"(timestamp_unix_ns - {b.first_ns}L) div {width}L").alias("bucket")
    seen = logs.filter("timestamp_unix_ns > 0")
    if annotated is not None:
        ids = annotated.select(F.col("log_id").alias("_hit")).distinct()
        seen = seen.join(ids, seen["id"] == ids["_hit"], "left")
    else:
        seen = seen.withColumn("_hit", F.lit(None).cast("long"))
    counts = seen.select(at, "_hit").groupBy("bucket").agg(F.count("*").alias("total"), F.count("_hit").alias("annotated"))
    spine = logs.sparkSession.range(span // width + 1).withColumnRenamed("id", "bucket")
    zero = F.lit(0).cast("long")
    return spine.join(counts, "bucket", "left").select("bucket", (F.col("bucket") * width + b.first_ns).alias("start_ns"), F.coalesce("total", zero).alias("total"), F.coalesce("annotated", zero).alias("annotated"))


def top_actions(signatures: DataFrame, annotations: DataFrame, top: int = 10) -> DataFrame:
    """(signature_id, action, n): annotations, not distinct logs."""
    counted = annotations.join(signatures.select("kb_id", "signature_id", "action"), "kb_id").groupBy("signature_id", "action").agg(F.count("*").alias("n"))
    return counted.orderBy(F.desc("n"), "signature_id", "action").limit(top)


def top_facets(logs: DataFrame, top: int = 10) -> DataFrame:
    """(facet, value, n, r): the most frequent values of each facet, ties by value; of levels, which are few, five."""
    ranked = facets(logs).withColumn("r", F.row_number().over(Window.partitionBy("facet").orderBy(F.desc("n"), "value")))
    return ranked.filter(F.col("r") <= F.when(F.col("facet") == "log_level", 5).otherwise(top))


def case_stats(logs: DataFrame) -> DataFrame:
    """(event_type, log_level, n, processes, subsystems): rows of each kind, and how many names they have."""
    return logs.groupBy("event_type", "log_level").agg(F.count("*").alias("n"), F.count_distinct("process").alias("processes"), F.count_distinct("subsystem").alias("subsystems"))


def annotated_logs(annotations: DataFrame) -> DataFrame:
    """One row: how many logs have an annotation."""
    return annotations.agg(F.count_distinct("log_id").alias("n"))


def summarise(logs: DataFrame, signatures: DataFrame | None = None, annotations: DataFrame | None = None, top: int = 10, buckets: int = 40) -> Summary:
    out = Summary(**bounds(logs).first().asDict())
    if not out.total or out.first_ns is None:
        return out
    for r in top_facets(logs, top).orderBy("facet", "r").collect():
        out.top.setdefault(r.facet, []).append((r.value, r.n))
    if annotations is not None:
        out.annotated = annotated_logs(annotations).first().n
        out.actions = [tuple(r) for r in top_actions(signatures, annotations, top).collect()]
    out.bucket_ns = bucket_ns(max(out.last_ns - out.first_ns, 1), buckets)
    out.histogram = [(r.start_ns, r.total, r.annotated) for r in histogram(logs, annotations, buckets).orderBy("bucket").collect()]
    return out


def store(summary: Summary, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(asdict(summary), f)


def load(path: str) -> Summary | None:
    """The stored summary; None where there is none or it can't be read."""
    try:
        with open(path, encoding="utf-8") as f:
            raw = json.load(f)
        raw["top"] = {k: [tuple(x) for x in v] for k, v in raw["top"].items()}
        raw["actions"], raw["histogram"] = [tuple(x) for x in raw["actions"]], [tuple(x) for x in raw["histogram"]]
        return Summary(**raw)
    except (OSError, ValueError, KeyError, TypeError):
        return None


def text(s: Summary) -> str:
    from datetime import datetime, timezone

    when = lambda ns: datetime.fromtimestamp(ns / NS, timezone.utc).isoformat() if ns else "-"
    lines = [f"Logs: {s.total:,} ({s.unresolved:,} without wall-clock time)", f"From {when(s.first_ns)} to {when(s.last_ns)}"]
    for facet, entries in s.top.items():
        lines += [f"Top {facet}:"] + [f"  {n:>12,}  {v}" for v, n in entries]
    if s.actions:
        lines += ["Annotated actions:"] + [f"  {n:>12,}  {i}: {a}" for i, a, n in s.actions]
    most = max((n for _, n, _ in s.histogram), default=0)
    lines += [f"  {when(at)}  {'#' * (40 * n // most if most else 0)} {n}" for at, n, _ in s.histogram]
    return "\n".join(lines)
