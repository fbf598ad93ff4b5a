"""Whole operations: ingest an archive to a case, annotate it, compare it with a baseline, verify it."""

from __future__ import annotations

import os
import time
import warnings
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import content_digest
from ..kb import KnowledgeBase
from ..operators import compare, diff, summary
from ..operators.annotate import annotate
from ..sources import containers, package
from ..sources.ingest import archive_files, read_archive
from ..sources.shutdown import parse_shutdown_log
from ..scratch import temporary
from ..store import CaseStore


@dataclass(frozen=True)
class ExtractResult:
    case: str
    rows: int
    first_ns: int | None
    last_ns: int | None
    seconds: dict[str, float] = field(default_factory=dict)


def run_extract(spark: SparkSession, source: str, case_path: str, work: str | None = None, keep_parsed: bool = False, keep_raw: bool = False) -> ExtractResult:
    """A case from an archive in any wrapping. Its status is running until all tables are there, and cancelled if that fails.

    Parsed records are written once; joins and windows read them. Source files are hashed before and
    after, and a file that changed in between is told by its two digests.
    """
    seconds, began, case = {}, time.time(), None

    def done(phase: str) -> None:
        """Notes a phase that ended in the case's ledger, so that a broken run tells how far it came."""
        nonlocal began
        seconds[phase], began = round(time.time() - began, 3), time.time()
        if case is not None:
            case.set_status("running", phase=phase, seconds=seconds)

    root, facts = source, {}
    if "://" not in source:
        if package.is_package(source):
            root = package.unpack(source, _work(spark, source, work, case_path))
        else:
            made = containers.prepare(source, _work(spark, source, work, case_path))
            root, facts = made.root, {"product_version": made.product_version}
        facts |= {"archive": containers.archive_facts(root)}
    case = CaseStore.create(spark, case_path, source=source, started=datetime.now(timezone.utc).isoformat(), **facts)
    done("prepare")

    def keep(df: DataFrame, name: str) -> DataFrame:
        case.write(f"_{name}", df)
        return case.table(f"_{name}")

    try:
        with temporary(spark):
            _store(spark, case, root, keep, keep_raw, done)
        b = summary.bounds(case.table("logs")).first()
        damaged = case.table("source_files").filter(F.size("damage") > 0).count()
        case.set_status("complete", rows=b.total, first_ns=b.first_ns, last_ns=b.last_ns, damaged_files=damaged, seconds=seconds)
    except BaseException:
        case.set_status("cancelled")
        raise
    if not keep_parsed:
        for name in ("_parsed", "_strings", "_anchors", "_boots"):
            _remove(spark, f"{case_path}/{name}")
    return ExtractResult(case_path, b.total, b.first_ns, b.last_ns, seconds)


def _store(spark: SparkSession, case: CaseStore, root: str, keep, keep_raw: bool, done) -> None:
    """All tables of an archive into a case, phase by phase."""
    tables = read_archive(spark, root, keep, keep_raw)
    case.write("source_files", tables["source_files"])
    done("parse")
    for name in ("anchors", "boots", "logs"):
        case.write(name, tables[name])
    done("resolve and order")
    files = archive_files(spark, root, ids=False)
    lines = files.filter("kind = 'shutdown'").select(F.posexplode(F.split(F.decode("content", "UTF-8"), "\n")).alias("n", "value"))
    if not lines.isEmpty():
        for name, df in zip(("shutdown_events", "shutdown_clients"), parse_shutdown_log(lines)):
            case.write(name, df)
    after = files.select("rel_path", content_digest(F.col("content")).alias("sha256"))
    changed = compare.custody(case.table("source_files"), after).filter("status <> 'matched'").count()
    done("hash again")
    case.set_status("running", changed_files=changed)


def _work(spark: SparkSession, source: str, work: str | None, case_path: str) -> str:
    """Where a wrapped archive is unpacked to. Executors read from there, so on a cluster it has to be named and shared."""
    master = spark.sparkContext.master
    if work is None and not (master == "local" or master.startswith("local[")) and not os.path.isdir(source):
        raise ValueError("work: name a folder that all executors share, or unpack the archive first")
    return work or f"{case_path}.work"


def _remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def open_or_extract(spark: SparkSession, source: str, case_path: str, **how) -> CaseStore:
    try:
        return CaseStore.open(spark, case_path)
    except FileNotFoundError:
        run_extract(spark, source, case_path, **how)
        return CaseStore.open(spark, case_path)


def annotate_case(case: CaseStore, kb: KnowledgeBase, **which) -> int:
    """Appends annotations (a second run adds them again); returns how many."""
    have = case.table("kb_signatures")
    first = 1 + ((have.agg(F.max("kb_id")).first()[0] or 0) if have is not None else 0)
    with temporary(case.spark):
        signatures, annotations, values = annotate(case.table("logs"), kb, datetime.now(timezone.utc).isoformat(), first, **which)
        case.append("annotations", annotations)
        case.append("extracted_values", values)
        case.append("kb_signatures", signatures)
    return case.table("annotations").filter(F.col("kb_id") >= first).count()


def clear_annotations(case: CaseStore) -> int:
    n = case.table("annotations").count() if case.table("annotations") is not None else 0
    case.clear("annotations", "extracted_values", "kb_signatures")
    return n


def run_identify(baseline: CaseStore, action: CaseStore, kb: KnowledgeBase | None = None) -> diff.IdentifyResults:
    """What the action's case has beyond the baseline's, annotated first if a knowledge base is given. Written to the table identified."""
    if kb is not None:
        annotate_case(action, kb)
    rows = diff.compare_to_baseline(action.table("logs"), baseline.table("logs"))
    if action.table("annotations") is not None:
        rows = diff.with_signatures(rows, action.table("kb_signatures"), action.table("annotations"))
    action.write("identified", rows)
    return diff.IdentifyResults(action.table("identified"))


@dataclass(frozen=True)
class Check:
    name: str
    passed: bool | None
    detail: str = ""


def verify_case(case: CaseStore, root: str | None = None) -> list[Check]:
    """Completeness, ranks without gaps, and the source files' digests, if they are still there. None: can't be told."""
    meta, logs = case.meta(), case.table("logs")
    out = [Check("status", meta.get("status") == "complete", str(meta.get("status")))]
    s = logs.agg(F.count("*").alias("n"), F.count_distinct("event_order").alias("d"), F.max("event_order").alias("m"), F.count_if(F.col("source_order").isNull() | F.col("event_order").isNull()).alias("nulls")).first()
    out += [Check("rows", meta.get("rows") in (None, s.n), f"{s.n}"), Check("event order", s.nulls == 0 and s.d == s.n == (s.m or 0), f"{s.d} of {s.n}")]
    stored = case.table("source_files")
    if root is None:
        return [*out, Check("source files", None, "no source given")]
    fresh = archive_files(case.spark, root, ids=False).select("rel_path", content_digest(F.col("content")).alias("sha256"))
    counts = {r.status: r.n for r in compare.custody(stored, fresh).groupBy("status").agg(F.count("*").alias("n")).collect()}
    bad = {k: v for k, v in counts.items() if k in ("mismatch", "missing_file")}
    return [*out, Check("source files", None if not counts.get("matched") and not bad else not bad, ", ".join(f"{v} {k}" for k, v in sorted(counts.items())))]


def validate(reference_lines: DataFrame, case: CaseStore, allow_missing: int = 0) -> tuple[bool, DataFrame]:
    """(passed, full outer comparison) of a case with a reference export."""
    ref = compare.match_key(compare.read_reference(reference_lines))
    own = compare.match_key(case.table("logs"))
    outer = compare.full_outer(ref.withColumn("id", F.monotonically_increasing_id()), own, compare.KEY, ["id"])
    missing = outer.filter("verdict = 'missing'").count()
    if missing > allow_missing:
        warnings.warn(f"{missing} logs of the reference are missing", stacklevel=2)
    return missing <= allow_missing, outer


def validate_acquisition(spark: SparkSession, one: str, two: str) -> tuple[bool, DataFrame]:
    """(passed, verdicts) of two archives of one device, file by file and without parsing.

    A live store grows, rotates and purges, so files that only one side has, or that begin like the other's, are
    normal. Only a log file whose bytes changed in place (diverged) fails the check.
    """
    sides = [compare.file_table(spark, root).filter(compare.is_log_data(F.col("rel_path"))) for root in (one, two)]
    found = compare.compare_files(*sides)
    return found.filter("verdict = 'diverged'").isEmpty(), found
