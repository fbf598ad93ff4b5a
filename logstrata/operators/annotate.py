"""Annotating logs with a knowledge base of signatures.

All signatures are applied in one scan: each log gets the list of those whose stored-column
criteria it meets, and only such rows go on to the regular expressions, which
are Python's and run on Arrow batches.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence
from dataclasses import asdict
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..kb import KnowledgeBase, Match, Signature, in_version_range
from ..schemas import ANNOTATIONS, KB_SIGNATURES, VALUES
from ..scratch import written


def select_signatures(kb: KnowledgeBase, only_ids: Sequence[str] = (), only_tags: Sequence[str] = (), platform: str | None = None, version: str | None = None) -> list[Signature]:
    """Those named by id or by tag (all, if neither is given) that fit the case's platform and version."""
    chosen = [s for s in kb.signatures if (not only_ids and not only_tags) or s.id in only_ids or set(s.tags) & set(only_tags)]
    return [s for s in chosen if (not platform or s.platform == platform) and in_version_range(version, s.ios_min, s.ios_max)]


def candidate(match: Match) -> Column:
    """The criteria on stored columns, all together."""
    parts = []
    templates = [match.format_str] if match.format_str is not None else list(match.format_str_any)
    if templates:
        parts.append(F.col("message_format_string").isin(templates))
    for column, value in (("process", match.process), ("subsystem", match.subsystem), ("category", match.category), ("log_level", match.log_level), ("event_type", match.event_type), ("library", match.library)):
        if value is not None:
            parts.append(F.col(column) == value)
    if not parts:
        raise ValueError("a signature without any criterion on a stored column would scan every message")
    return reduce(lambda a, b: a & b, parts)


def extract_values(signature: Signature, message: str | None) -> list[tuple[str, str]]:
    """(label, value): named groups of the one expression, then each field's own expression."""
    out, text = [], message or ""
    if signature.extract_regex and (m := re.search(signature.extract_regex, text)):
        out += [(k, v) for k, v in m.groupdict().items() if v is not None]
    for label, pattern in signature.extract_fields:
        if m := re.search(pattern, text):
            named = m.groupdict().get(label)
            value = named if named is not None else m[1] if m.re.groups and m[1] is not None else m[0]
            out.append((label, value))
    return out


def definition(signature: Signature) -> tuple[str, str, str]:
    """What a signature matched on, what it extracts, and its references, as JSON: a case says by itself why a log was annotated."""
    match = {k: v for k, v in asdict(signature.match).items() if v}
    extract = {"regex": signature.extract_regex, "fields": dict(signature.extract_fields)}
    return json.dumps(match, sort_keys=True), json.dumps({k: v for k, v in extract.items() if v}, sort_keys=True), json.dumps(signature.references)


def annotate(logs: DataFrame, kb: KnowledgeBase, applied_at: str = "", first_kb_id: int = 1, **which) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(signatures, annotations, values) to append to a case; only signatures with a hit get a row."""
    spark, chosen = logs.sparkSession, select_signatures(kb, **which)
    if not chosen:
        return tuple(spark.createDataFrame([], s) for s in (KB_SIGNATURES, ANNOTATIONS, VALUES))
    numbers = F.array_compact(F.array(*[F.when(candidate(s.match), F.lit(i)) for i, s in enumerate(chosen)]))
    some = reduce(lambda a, b: a | b, [candidate(s.match) for s in chosen])
    rows = logs.filter(some).select(F.col("id").alias("log_id"), "message", numbers.alias("hits"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = [re.compile(s.match.message_regex) if s.match.message_regex else None for s in chosen]
        kind = pa.list_(pa.struct([("label", pa.string()), ("value", pa.string())]))
        for batch in batches:
            out = []
            for log_id, message, hits in zip(*(batch.column(k).to_pylist() for k in range(3))):
                for k in hits:
                    if tests[k] is None or message is not None and tests[k].search(message):
                        out.append((log_id, first_kb_id + k, [{"label": a, "value": b} for a, b in extract_values(chosen[k], message)]))
            cols = list(zip(*out)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], kind)], names=["log_id", "kb_id", "values"])

    found = written(rows.mapInArrow(read, "log_id long, kb_id long, values array<struct<label:string,value:string>>"), "annotated")  # one scan for three tables
    annotations = found.select("log_id", "kb_id")
    values = found.select("log_id", "kb_id", F.inline("values"))
    meta = spark.createDataFrame(
        [(first_kb_id + i, s.id, s.action, s.description, s.confidence, list(s.tags), kb.version, applied_at, *definition(s)) for i, s in enumerate(chosen)],
        "kb_id long, signature_id string, action string, description string, confidence string, tags array<string>, kb_version string, applied_at string, match string, extract string, references string",
    )
    counts = annotations.groupBy("kb_id").agg(F.count("*").alias("match_count"))
    signatures = counts.join(F.broadcast(meta), "kb_id").select("kb_id", "signature_id", "action", "description", "confidence", "tags", "kb_version", "match_count", "applied_at", "match", "extract", "references")
    return signatures, annotations, values


def annotation_state(signatures: DataFrame, annotations: DataFrame) -> DataFrame:
    """One row: annotated logs, signatures, versions and times of application."""
    s = signatures.agg(F.count("*").alias("signatures"), F.array_sort(F.collect_set("kb_version")).alias("kb_versions"), F.max("applied_at").alias("applied_at"))
    return annotations.agg(F.count_distinct("log_id").alias("annotated_logs")).crossJoin(s)  # one row each


def empty_annotations(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(spark.createDataFrame([], s) for s in (KB_SIGNATURES, ANNOTATIONS, VALUES))
