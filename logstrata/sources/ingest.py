"""From an archive of binary logs to the tables of a case.

Files are read by Spark and parsed in parallel, one task at a time for each file, and the flat records
written once. Their order is settled on those, before anything is joined to them. Everything after
that is relational and runs once, when the logs are read: format strings by joins on (table, offset),
oversize items by key, times by the clock's intervals.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.printf import message
from ..functions.scalars import content_digest, event_name, level_name, process_name
from ..operators.clock import asof_join, resolve_times
from ..operators.ordering import boot_ranks, event_order, numbered, running_total
from ..schemas import EMPTY_IS_NULL, FACT
from ..scratch import small, written
from . import clockfiles, stringfiles, tracev3

DYNAMIC = 0x80000000


def archive_files(spark: SparkSession, root: str, ids: bool = True) -> DataFrame:
    """(file_id, kind, name, rel_path, size, content) of an archive, numbered in reading order if ``ids``; resource forks of other systems are left out."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    parts = F.split("path", "/")
    name, folder = F.element_at(parts, -1), F.element_at(parts, -2)
    kind = (
        F.when(name.endswith(".tracev3"), F.lit("log")).when(name.endswith(".timesync"), F.lit("clock")).when((folder == "dsc") & name.rlike("^[0-9A-Fa-f]{32}$") | name.rlike("^[0-9A-Fa-f]{32}\\.dsc$"), F.lit("shared"))
        .when(folder.rlike("^[0-9A-Fa-f]{2}$") & name.rlike("^[0-9A-Fa-f]{30}$"), F.lit("strings")).when(name == "shutdown.log", F.lit("shutdown"))
    )
    uuid = F.upper(F.when(kind == "strings", F.concat(folder, name)).otherwise(F.regexp_replace(name, "\\.dsc$", "")))
    place = F.when(folder == "Persist", 0).when(folder == "Special", 1).when(folder == "Signpost", 2).otherwise(3)
    out = df.select(kind.alias("kind"), uuid.alias("name"), place.alias("place"), name.alias("file"), F.col("path").alias("rel_path"), F.col("length").alias("size"), "content").filter(F.col("kind").isNotNull() & ~F.col("file").startswith("._"))
    if not ids:
        return out
    numbers = numbered(out.select("rel_path", "kind", "place", "file"), ["kind", "place", "file", "rel_path"], "file_id", "files", first=1).select("rel_path", "file_id")
    return out.join(small(written(numbers, "file-ids")), "rel_path")


_PARSED = "file_id long, what string, " + tracev3.RECORD


def parse_logs(files: DataFrame, keep_raw: bool = False) -> DataFrame:
    """Flat records of all log files; what is "entry" or "oversize", and "file" at the end of each: seq has its entries, items what was damaged."""
    width = len(tracev3.RECORD.split(", "))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ["file_id", "what", *[x.split()[0] for x in tracev3.RECORD.split(", ")]]
        at = {c: i for i, c in enumerate(columns)}
        schema = pa.schema([(c, {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<string>": pa.list_(pa.string())}[x.split()[1]]) for c, x in zip(columns, _PARSED.split(", "))])
        for batch in batches:
            for file_id, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows: list = []
                damage, entries = Counter(), 0
                for what, r in tracev3.records(data, damage, keep_raw):
                    if what == "oversize":
                        full: list = [None] * (width + 2)
                        for c, v in zip(("first", "second", "data_ref", "items", "chunkset", "seq", "raw"), r):
                            full[at[c]] = v
                        full[0], full[1] = file_id, what
                        rows.append(tuple(full))
                    else:
                        rows.append((file_id, what, *r))
                        entries += 1
                    if len(rows) >= 5_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                        rows = []
                end: list = [None] * (width + 2)
                end[0], end[1], end[at["seq"]], end[at["items"]] = file_id, "file", entries, [f"{n} {k}" for k, n in sorted(damage.items())]
                rows.append(tuple(end))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return files.filter("kind = 'log'").select("file_id", "content").mapInArrow(run, _PARSED)


def clock_table(files: DataFrame) -> DataFrame:
    """Anchors of all clock files, numbered in reading order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(f, *a) for f, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for a in clockfiles.anchors(data)]
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            names = ["file_id", "boot_uuid", "file_offset", "kernel_time", "wall_ns", "numerator", "denominator", "is_boot"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 8, kinds)], names=names)

    raw = files.filter("kind = 'clock'").select("file_id", "content").mapInArrow(run, "file_id long, boot_uuid string, file_offset long, kernel_time long, wall_ns long, numerator long, denominator long, is_boot boolean")
    return numbered(raw, ["file_id", "file_offset"], "anchor_id", "anchors", first=1).withColumn("record", F.col("anchor_id"))


def string_table(files: DataFrame) -> DataFrame:
    """(src, uuid, low, high, ordinal, string, path, library): a row for each string of file ``src``, and one at -1 for each uuidtext file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for src, kind, name, data in zip(*(batch.column(k).to_pylist() for k in range(4))):
                rows = [(src, *r, name) for r in stringfiles.uuidtext(name, data)] if kind == "strings" else [(src, *r) for r in stringfiles.shared_cache(name, data)]
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.string())
                names = ["src", "uuid", "low", "high", "ordinal", "string", "path", "library"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 8, kinds)], names=names)

    return files.filter("kind in ('strings', 'shared')").select("file_id", "kind", "name", "content").mapInArrow(run, "src long, uuid string, low long, high long, ordinal long, string binary, path string, library string")


def _references(e: DataFrame) -> DataFrame:
    """With the table and offset that each entry's format string is looked up in, and the uuids that the entry gets."""
    source = F.col("source")
    dynamic = F.col("location") == DYNAMIC
    shared = source.isin("shared", "large")
    half = F.expr("large div 2")
    low = F.col("location").bitwiseAND(F.lit(0xFFFFFFFF))
    at = (
        F.when(F.col("high") == 0, F.col("location")).when((F.col("high") != half) & (source != "shared"), F.shiftleft(half, 32).bitwiseOR(low))
        .when(source == "shared", F.col("location") + 0x80000000).otherwise(F.shiftleft(F.col("high"), 32).bitwiseOR(low))
    )
    table = F.when(dynamic, F.lit("")).when(source == "uuid", F.col("relative")).when(shared, F.col("dsc_uuid")).when(source == "absolute", F.col("image_uuid")).when(source == "main", F.col("main_uuid")).otherwise(F.lit(""))
    process = F.when(dynamic | (source == "uuid"), F.lit("")).when(shared | source.isin("absolute", "main"), F.col("main_uuid")).otherwise(F.lit(""))
    return e.withColumns({"ref_uuid": table, "ref_at": F.when(shared, at).otherwise(F.col("location")), "process_uuid": process, "dynamic": dynamic})


def resolve_strings(e: DataFrame, strings: DataFrame) -> DataFrame:
    """With template, library, process_image and format_src_file_id of each entry. Distinct references are looked up once, then joined back."""
    refs = e.filter("ref_uuid <> ''").select(F.col("ref_uuid").alias("uuid"), F.col("ref_at").alias("at")).distinct()
    table = strings.filter("low >= 0").groupBy("uuid", "low").agg(F.min_by(F.struct("high", "string", "path"), "ordinal").alias("s")).select("uuid", "low", "s.*")
    met = asof_join(refs, table, "uuid", "at", "low", ["high", "string", "path"])
    hit = F.col("at") < F.col("high")
    rest = F.decode(F.expr("substring(string, cast(at - low + 1 as int))"), "UTF-8")
    met = met.select("uuid", "at", F.when(hit, F.regexp_replace(rest, "\\x00.*$", "")).alias("template"), F.when(hit, F.col("path")).alias("range_path"))
    images = F.max(F.when(F.col("low") == -1, F.col("path"))).alias("image")
    files = written(strings.groupBy(F.col("uuid").alias("fu")).agg(F.min("src").alias("format_src_file_id"), images), "string-files")
    met = met.join(small(files), F.col("uuid") == F.col("fu"), "left").select("uuid", "at", "template", "format_src_file_id", F.coalesce("image", "range_path").alias("library"))
    met = small(written(met, "references"), 200_000)
    out = e.join(met, (F.col("ref_uuid") == F.col("uuid")) & (F.col("ref_at") == F.col("at")), "left").drop("uuid", "at")
    main = small(files).select(F.col("fu").alias("mu"), F.col("image").alias("process_image"))
    out = out.join(main, F.col("process_uuid") == F.col("mu"), "left").drop("mu")
    template = F.when(F.col("dynamic"), F.coalesce(F.get("items", F.lit(0)), F.lit(""))).otherwise(F.coalesce("template", F.lit("")))
    return out.withColumns({"template": template, "library": F.coalesce("library", F.lit(""))})


def replace_oversize(e: DataFrame, parsed: DataFrame) -> DataFrame:
    """Items that did not fit their entry come from the last oversize chunk with its key, in reading order."""
    last = parsed.filter("what = 'oversize'").groupBy("first", "second", "data_ref").agg(F.max_by(F.struct("items", "raw"), F.struct("file_id", "chunkset", "seq")).alias("big"))
    big = last.select(F.col("first").alias("f"), F.col("second").alias("s"), F.col("data_ref").alias("r"), "big")
    wanted = F.col("kind").isin(tracev3.NON_ACTIVITY, tracev3.SIGNPOST) & (F.col("data_ref") != 0)
    out = e.join(small(written(big, "oversize")), wanted & (F.col("first") == F.col("f")) & (F.col("second") == F.col("s")) & (F.col("data_ref") == F.col("r")), "left")
    found = F.size("big.items") > 0
    return out.withColumns({c: F.when(found, F.col(f"big.{c}")).otherwise(F.col(c)) for c in ("items", "raw")}).drop("f", "s", "r", "big")


def read_archive(spark: SparkSession, root: str, keep: Callable[[DataFrame, str], DataFrame] | None = None, keep_raw: bool = False) -> dict[str, DataFrame]:
    """The tables logs, anchors, boots and source_files of an archive.

    ``keep(df, name)`` writes parsed records and gives them back, by default to the shared folder, so that
    archives are parsed once. With ``keep_raw`` the column raw_data has the items of each entry as JSON.
    """
    keep = keep or written
    files = archive_files(spark, root)
    parsed = keep(parse_logs(files, keep_raw), "parsed")
    anchors = keep(clock_table(files), "anchors")
    strings = keep(string_table(files), "strings")
    boots = keep(boot_ranks(anchors), "boots")
    ends = parsed.filter("what = 'file'").select("file_id", F.col("seq").alias("entries"), F.col("items").alias("damage"))
    before = small(written(running_total(ends.select(F.col("file_id").alias("fid"), "entries"), ["fid"], {"entries": "before"}).drop("entries"), "file-starts"))
    entries = parsed.filter("what = 'entry'").join(before, F.col("file_id") == F.col("fid")).withColumn("id", F.col("before") + F.col("seq")).drop("fid", "before")
    e = event_order(entries, boots, by=("mach", "id"))
    e = replace_oversize(_references(e), parsed)
    e = resolve_strings(e, strings)
    e = resolve_times(e.withColumnsRenamed({"mach": "timestamp_mach", "base": "preamble_base"}), anchors)
    dump = F.col("kind") < 0
    text = F.when(F.col("message").isNotNull(), F.col("message")).when(F.col("kind") == tracev3.TRACE, F.array_join("items", " ")).otherwise(message(F.col("template"), F.col("items")))
    library_uuid = F.when(dump, F.col("library_uuid")).when(F.col("dynamic"), F.lit("")).otherwise(F.col("ref_uuid"))
    event = F.when(F.col("kind") == -1, F.lit("Statedump")).when(F.col("kind") == -2, F.lit("Simpledump")).otherwise(event_name(F.col("kind")))
    rows = e.select(
        "id", F.col("file_id").alias("tracev3_file_id"), F.when(~dump & ~F.col("dynamic"), F.col("format_src_file_id")).alias("format_src_file_id"), "timesync_file_id", F.col("chunkset").alias("tracev3_chunkset_file_offset"),
        F.col("firehose").alias("tracev3_firehose_inner_offset"), F.col("entry").alias("tracev3_entry_inner_offset"), F.col("seq").alias("source_order"), "event_order",
        "timestamp_unix_ns", "timestamp_mach", "timesync_anchor_id", process_name(F.col("process_image"), F.col("library"), F.col("process_uuid")).alias("process"), "pid", "tid", "euid", level_name(F.col("log_type")).alias("log_level"),
        event.alias("event_type"), "subsystem", "category", text.alias("message"), F.col("template").alias("message_format_string"), "library", library_uuid.alias("library_uuid"), "process_uuid", "activity_id",
        F.col("parent_id").alias("parent_activity_id"), "boot_uuid", F.col("raw").alias("raw_data"),
    )
    rows = rows.withColumns({c: F.nullif(F.coalesce(F.col(c), F.lit("")), F.lit("")) for c in EMPTY_IS_NULL})
    rows = rows.withColumn("message", F.coalesce("message", F.lit("")))
    have = set(rows.columns)
    logs = rows.select(*[F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in FACT], "source_order", "event_order")
    sources = files.select("file_id", "rel_path", "kind", "size", content_digest(F.col("content")).alias("sha256")).join(small(written(ends, "file-ends")), "file_id", "left")
    return {"logs": logs, "anchors": anchors, "boots": boots, "source_files": sources}
