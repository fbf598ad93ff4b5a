"""Physical and merged order of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import UNKNOWN_BOOT_RANK
from ..scratch import written

_OFFSETS = ("tracev3_chunkset_file_offset", "tracev3_firehose_inner_offset", "tracev3_entry_inner_offset", "id")


def source_order(logs: DataFrame, file: str = "tracev3_file_id", by: tuple[str, ...] = _OFFSETS, name: str = "source_order") -> DataFrame:
    """Place within the file. Missing offsets come first; rows without a file are one file."""
    w = Window.partitionBy(file).orderBy(*[F.col(c).asc_nulls_first() for c in by])
    return logs.withColumn(name, F.row_number().over(w).cast("long"))


_ROW = (1 << 33) - 1  # what monotonically_increasing_id has of the row within its partition


def numbered(rows: DataFrame, by: list[str], name: str, label: str = "ordered", first: int = 0) -> DataFrame:
    """``rows`` with ``name``: their places in the order ``by`` (nulls first), counted from ``first``, without one task for all.

    Rows are dealt out by ranges, sorted and written once. A number is that of the row within its range
    and of all rows in the ranges before, of which there is one count for each partition.
    Where ``by`` tells all rows apart, the numbers do not hang on how rows are dealt.
    """
    order = [F.col(c).asc_nulls_first() for c in by]
    ranged = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), label)
    part = F.shiftright("_at", 33).alias("_part")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy(part).agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    out = ranged.select("*", part).join(F.broadcast(starts), "_part")
    return out.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit(_ROW)) + F.lit(first)).drop("_at", "_part", "_before")


def running_total(rows: DataFrame, by: list[str], totals: dict[str, str], label: str = "totals") -> DataFrame:
    """``rows`` with, for each (column, name) of ``totals``, the sum of the column over all rows before, in the order ``by``. Rows in ranges as in :func:`numbered`."""
    at = numbered(rows, by, "_n", label).withColumn("_run", F.shiftright("_n", 16))
    before = Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    sums = at.groupBy("_run").agg(*[F.sum(c).alias(f"_s_{c}") for c in totals])
    sums = sums.select("_run", *[F.coalesce(F.sum(f"_s_{c}").over(before), F.lit(0)).alias(f"_b_{c}") for c in totals])
    within = Window.partitionBy("_run").orderBy("_n").rowsBetween(Window.unboundedPreceding, -1)
    out = at.join(F.broadcast(sums), "_run")
    return out.withColumns({name: F.col(f"_b_{c}") + F.coalesce(F.sum(c).over(within), F.lit(0)) for c, name in totals.items()}).drop("_n", "_run", *[f"_b_{c}" for c in totals])


def event_order(logs: DataFrame, boots: DataFrame | None = None, boot: str = "boot_uuid", by: tuple[str, ...] = ("timestamp_mach", "tracev3_file_id", *_OFFSETS), scalable: bool = True) -> DataFrame:
    """One order over all files: boot rank (unknown boots last), then the monotonic clock, then place. Never the wall clock.

    ``boots`` has (boot, rank); it has a row for each boot of the device, so it is broadcast.
    """
    rows = logs
    if boots is not None:
        ranks = boots.select(F.col(boot).alias("_boot"), F.col("rank").alias("_rank"))
        rows = rows.join(F.broadcast(ranks), rows[boot] == F.col("_boot"), "left").drop("_boot")
        rows = rows.withColumn("_rank", F.coalesce(F.col("_rank").cast("long"), F.lit(UNKNOWN_BOOT_RANK).cast("long")))
    else:
        rows = rows.withColumn("_rank", F.lit(UNKNOWN_BOOT_RANK).cast("long"))
    order = ["_rank", *by]
    if scalable:
        return numbered(rows, order, "event_order", first=1).drop("_rank")
    w = Window.orderBy(*[F.col(c).asc_nulls_first() for c in order])
    return rows.withColumn("event_order", F.row_number().over(w).cast("long")).drop("_rank")


def boot_ranks(records: DataFrame) -> DataFrame:
    """(boot_uuid, rank): boots by first appearance over (file order, offset), from 0."""
    first = records.groupBy("boot_uuid").agg(F.min(F.struct("file_id", "file_offset")).alias("first"))
    return first.select("boot_uuid", (F.row_number().over(Window.orderBy("first")) - 1).cast("long").alias("rank"))


def clock_setbacks(logs: DataFrame, group: str = "boot_uuid", order: str = "event_order", clock: str = "timestamp_unix_ns") -> DataFrame:
    """Rows whose wall clock is before one of an earlier row of the same boot, with that latest one."""
    before = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    seen = logs.filter(F.col(clock) > 0).withColumn("latest_before", F.max(clock).over(before))
    return seen.filter(F.col(clock) < F.col("latest_before"))


def first_of_each(rows: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """The first row for each key, ties by ``by``; an aggregation, so equal keys combine before they are shuffled."""
    rest = [c for c in rows.columns if c not in keys]
    ahead = [*by, *[c for c in rest if c not in by]]
    out = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*ahead)).alias("_first"))
    return out.select(*keys, *[F.col(f"_first.{c}").alias(c) for c in rest]).select(*rows.columns)


def event_window(logs: DataFrame, anchor_id: int, before: int = 20, after: int = 20) -> DataFrame:
    """Rows whose event_order lies around that of the anchor row: by value, not by number of rows."""
    at = logs.filter(F.col("id") == anchor_id).select(F.coalesce("event_order", F.lit(0)).alias("_at")).limit(1)
    near = logs.join(F.broadcast(at), (F.col("event_order") >= F.greatest(F.lit(0), F.col("_at") - before)) & (F.col("event_order") <= F.col("_at") + after))
    return near.drop("_at").orderBy(F.coalesce("event_order", F.lit(0)), "id")
