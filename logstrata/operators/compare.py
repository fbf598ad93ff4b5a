"""Holding a case against a reference: log by log, and file by file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import content_digest, floor_div, int_or_zero, plain_message, plain_uuid, process_label
from ..scratch import small, written
from .ordering import first_of_each, numbered

KEY = ["boot", "mach", "tid"]
FIELDS = ("pid", "euid", "log_level", "event_type", "subsystem", "category", "activity_id", "process")


def match_key(logs: DataFrame) -> DataFrame:
    """With boot, mach and tid, by which both sides meet: the uuid in upper case without dashes, a missing thread as 0."""
    return logs.withColumns({"boot": plain_uuid(F.coalesce("boot_uuid", F.lit(""))), "mach": F.col("timestamp_mach"), "tid": F.coalesce(F.col("tid"), F.lit(0).cast("long"))})


def full_outer(reference: DataFrame, own: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """One row for each key of either side, with structs ref and db (null where a side has none) and verdict.

    Of rows with equal keys on one side the first by ``by`` counts. The join is a
    full outer sort-merge join, which spills by itself.
    """
    sides = []
    for df, name in ((reference, "ref"), (own, "db")):
        one = first_of_each(df, keys, by)
        sides.append(one.select(*keys, F.struct(*[c for c in one.columns if c not in keys], F.lit(1).alias("here")).alias(name)))
    out = sides[0].join(sides[1], keys, "full_outer")
    return out.withColumn("verdict", F.when(F.col("db").isNull(), F.lit("missing")).when(F.col("ref").isNull(), F.lit("extra")).otherwise(F.lit("matched")))


def field_stats(matched: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(field, compared, equal, pct) over matched pairs; two missing values are equal. One pass."""
    sums = [F.sum(F.col(f"ref.{f}").eqNullSafe(F.col(f"db.{f}")).cast("long")).alias(f) for f in fields]
    wide = matched.agg(F.count("*").alias("compared"), *sums)
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f), F.lit(0).cast("long")).alias("equal")) for f in fields])
    out = wide.select("compared", F.inline(rows))
    return out.select("field", "compared", "equal", F.when(F.col("compared") > 0, F.col("equal") * 100.0 / F.col("compared")).otherwise(F.lit(0.0)).alias("pct"))


def message_stats(matched: DataFrame) -> DataFrame:
    """One row: messages equal as they are, equal but for case and white space, templates equal; times compared, within one µs, and the largest difference."""
    r, d = F.col("ref.message"), F.col("db.message")
    both = (F.coalesce("ref.timestamp_unix_ns", F.lit(0)) != 0) & (F.coalesce("db.timestamp_unix_ns", F.lit(0)) != 0)
    delta = F.abs(floor_div(F.col("ref.timestamp_unix_ns"), 1000) - floor_div(F.col("db.timestamp_unix_ns"), 1000))
    return matched.agg(
        F.count("*").alias("matched"),
        F.count_if(F.coalesce(r, F.lit("")) == F.coalesce(d, F.lit(""))).alias("message_exact"),
        F.count_if(plain_message(r) == plain_message(d)).alias("message_normalised"),
        F.count_if(F.col("ref.message_format_string").eqNullSafe(F.col("db.message_format_string"))).alias("template_equal"),
        F.count_if(both).alias("times_compared"),
        F.count_if(both & (delta <= 1)).alias("times_equal"),
        F.max(F.when(both, delta)).alias("largest_delta_us"),
    )


def most_missing(outer: DataFrame, n: int = 10, by: str = "process") -> DataFrame:
    """(process or format, n): those with most logs that only the reference has, ``by`` process or format; ties by name."""
    if by not in ("process", "format"):
        raise ValueError(by)
    name = process_label(F.col("ref.process"), F.col("ref.process_uuid")) if by == "process" else F.coalesce("ref.message_format_string", F.lit(""))
    missing = outer.filter("verdict = 'missing'").select(name.alias(by))
    return missing.groupBy(by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), by).limit(n)


def samples(outer: DataFrame, verdict: str, n: int = 20) -> DataFrame:
    """The n earliest by the monotonic clock."""
    return outer.filter(F.col("verdict") == verdict).orderBy("mach", "boot", "tid").limit(n)


#: How a reference export names things.
REFERENCE_JSON = "eventType string, bootUUID string, machTimestamp string, threadID string, processID string, userID string, subsystem string, category string, activityIdentifier string, parentActivityIdentifier string, timestamp string, eventMessage string, formatString string, messageType string, processImagePath string, processImageUUID string"
EVENTS = {"logEvent": "Log", "activityCreateEvent": "Activity", "traceEvent": "Trace", "signpostEvent": "Signpost", "lossEvent": "Loss"}
SKIPPED = ("timesyncEvent", "stateEvent")


def read_reference(lines: DataFrame) -> DataFrame:
    """Rows (value: a line of a JSON-lines export) to log rows. Lines that are no JSON object, and clock and state events, are left out."""
    from ..functions.scalars import apple_timestamp_us, basename

    objects = lines.filter(F.ltrim("value").startswith("{")).select(F.from_json("value", REFERENCE_JSON + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("o"))
    o = objects.filter("o._bad is null").select("o.*").filter(~F.coalesce("eventType", F.lit("")).isin(*SKIPPED))
    events = F.create_map(*[F.lit(x) for kv in EVENTS.items() for x in kv])
    return o.select(
        F.col("bootUUID").alias("boot_uuid"), int_or_zero(F.col("machTimestamp")).alias("timestamp_mach"), int_or_zero(F.col("threadID")).alias("tid"), int_or_zero(F.col("processID")).alias("pid"),
        int_or_zero(F.col("userID")).alias("euid"), F.nullif("subsystem", F.lit("")).alias("subsystem"), F.nullif("category", F.lit("")).alias("category"), int_or_zero(F.col("activityIdentifier")).alias("activity_id"),
        int_or_zero(F.col("parentActivityIdentifier")).alias("parent_activity_id"), (F.coalesce(apple_timestamp_us(F.col("timestamp")), F.lit(0)) * 1000).alias("timestamp_unix_ns"),
        F.coalesce("eventMessage", F.lit("")).alias("message"), F.nullif("formatString", F.lit("")).alias("message_format_string"), F.coalesce("messageType", F.lit("Default")).alias("log_level"),
        F.coalesce(F.try_element_at(events, F.col("eventType")), F.lit("Log")).alias("event_type"), basename(F.col("processImagePath")).alias("process"), plain_uuid(F.col("processImageUUID")).alias("process_uuid"),
    )


def compare_files(a: DataFrame, b: DataFrame) -> DataFrame:
    """(rel_path, verdict): identical, append (a is the beginning of b), shrunk, diverged, only_a, only_b.

    Both have rel_path, sha256, size and content (binary). Digests and sizes are joined first. Content is
    fetched only for paths whose digests differ and whose sizes leave a beginning possible, and of the
    longer side only what stands against the shorter one.
    """
    x = a.select("rel_path", F.struct("sha256", "size").alias("a"))
    y = b.select("rel_path", F.struct("sha256", "size").alias("b"))
    both = written(x.join(y, "rel_path", "full_outer"), "digests")
    unlike = F.col("a.sha256") != F.col("b.sha256")
    open_ = small(written(both.filter(unlike & (F.col("a.size") != F.col("b.size"))).select("rel_path", F.least("a.size", "b.size").cast("int").alias("n")), "unlike"))
    start = lambda side, name: side.select("rel_path", "content").join(open_, "rel_path").select("rel_path", F.sha2(F.substring("content", F.lit(1), F.col("n")), 256).alias(name))
    same = start(a, "p").join(start(b, "q"), "rel_path").filter("p = q").select("rel_path", F.lit(True).alias("begins"))
    verdict = (
        F.when(F.col("b").isNull(), F.lit("only_a")).when(F.col("a").isNull(), F.lit("only_b")).when(~unlike, F.lit("identical"))
        .when(F.col("begins"), F.when(F.col("a.size") < F.col("b.size"), F.lit("append")).otherwise(F.lit("shrunk"))).otherwise(F.lit("diverged"))
    )
    return both.join(same, "rel_path", "left").select("rel_path", verdict.alias("verdict"))


def is_log_data(path) -> object:
    """Whether a path of an archive holds log data, not folders' own files."""
    return path.rlike(r"(?i)\.(tracev3|timesync|atf)$|^(Persist|Special|Signpost|HighVolume|timesync|dsc)/|^[0-9A-Fa-f]{2}/[0-9A-Fa-f]+$")


def file_table(spark, root: str) -> DataFrame:
    """(rel_path, size, sha256, content) of all files below a folder, hashed where they are read.

    Spark's file sources pass over empty files, so those are listed by the driver.
    """
    top = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    base = fs.makeQualified(top).toUri().getPath().rstrip("/") + "/"
    found, empty = fs.listFiles(top, True), []
    while found.hasNext():
        f = found.next()
        if f.getLen() == 0:
            empty.append((f.getPath().toUri().getPath()[len(base) :], 0, bytearray()))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B")))
    full = files.select(F.substring_index(path, base, -1).alias("rel_path"), F.col("length").alias("size"), "content")
    both = full.unionByName(spark.createDataFrame(empty, "rel_path string, size long, content binary"))
    return both.select("rel_path", "size", content_digest(F.col("content")).alias("sha256"), "content")


def custody(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """(rel_path, status): matched, mismatch, missing_file or missing_hash for every file the case recorded."""
    f = fresh.select("rel_path", F.col("sha256").alias("now"))
    status = F.when(F.col("sha256").isNull(), F.lit("missing_hash")).when(F.col("now").isNull(), F.lit("missing_file")).when(F.lower("sha256") == F.lower("now"), F.lit("matched")).otherwise(F.lit("mismatch"))
    return stored.select("rel_path", "sha256").join(f, "rel_path", "left").select("rel_path", status.alias("status"))


def tree_digest(files: DataFrame) -> str:
    """One digest over sorted paths and content digests; a renamed file changes it.

    It is the plain digest of one stream, so that other tools get the same; paths and digests, a row
    for each file, pass the driver one partition at a time and are never held there.
    """
    import hashlib

    h = hashlib.sha256()
    for r in files.select("rel_path", "sha256").orderBy("rel_path").toLocalIterator():
        h.update(r.rel_path.encode() + b"\0" + bytes.fromhex(r.sha256))
    return h.hexdigest()


def ordered_digest(rows: DataFrame, by: list[str], run: int = 10_000) -> str:
    """Digest of all rows in the order ``by``, which tells them apart; equal for equal results however they were computed.

    Rows are numbered and their digests digested in runs of ``run``, wherever they lie; the driver sees one digest for each run.
    """
    import hashlib

    digests = rows.select(*by, F.sha2(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}), 256).alias("_d"))
    runs = numbered(digests, by, "_n").groupBy(F.floor(F.col("_n") / run).alias("r")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_d"))), lambda x: x["_d"]), ""), 256).alias("d"))
    h = hashlib.sha256()
    for r in runs.orderBy("r").toLocalIterator():
        h.update(bytes.fromhex(r.d))
    return h.hexdigest()
