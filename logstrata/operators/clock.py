"""From ticks of the monotonic clock to wall-clock time, and other joins on ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ticks_to_ns
from ..scratch import small, written

#: Rows up to which ranges are broadcast; beyond, they are joined by bins.
BROADCAST_ROWS = 200_000


def anchor_intervals(anchors: DataFrame) -> DataFrame:
    """Each anchor with the ticks [low, high) that it answers for, within its boot.

    A walk through the records stops at the first one that lies after the target.
    The last record whose running maximum is at or before the target is where it
    stops, also for records out of order and for equal ones, of which the last counts.
    """
    order = Window.partitionBy("boot_uuid").orderBy("record")
    top = anchors.withColumn("low", F.max("kernel_time").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return top.withColumn("high", F.lead("low").over(order)).filter(F.col("high").isNull() | (F.col("high") > F.col("low")))


def range_join(left: DataFrame, right: DataFrame, equal: list[str], point: Column, low: Column, high: Column, closed: bool = False, how: str = "left", few: int = BROADCAST_ROWS) -> DataFrame:
    """Rows of ``left`` with those of ``right`` whose [low, high) (or [low, high]) holds the point, of whole numbers. A missing high is no bound.

    Up to ``few`` ranges are broadcast. More are cut at the bounds of a grid whose levels are powers of
    two: a range is a row in each of the cells, two a level at most, that it is made of, and a point
    looks up the one cell of each level that it lies in. So each side is shuffled by (equal keys, level, cell),
    each meeting is made once, and rows grow with the logarithm of lengths only. ``how`` is left or inner.
    """
    inside = (point >= low) & (high.isNull() | ((point <= high) if closed else (point < high)))
    if right.count() <= few:
        cond = inside
        for k in equal:
            cond = cond & (left[k] == right[k])
        return left.join(F.broadcast(right), cond, how)
    names = left.columns + right.columns
    a = left.select(F.struct(*[left[c] for c in left.columns]).alias("_l"), *[left[k].alias(f"_k{i}") for i, k in enumerate(equal)], point.cast("long").alias("_p")).withColumn("_id", F.monotonically_increasing_id())
    a = written(a, "points")
    end = F.coalesce((high + 1 if closed else high).cast("long"), F.lit(2**62))
    b = right.select(F.struct(*[right[c] for c in right.columns]).alias("_r"), *[right[k].alias(f"_k{i}") for i, k in enumerate(equal)], low.cast("long").alias("_lo"), end.alias("_hi"))
    cells = b.withColumn("_cell", F.explode(_cells(F.col("_lo"), F.col("_hi")))).select("_r", *[f"_k{i}" for i in range(len(equal))], "_cell.level", "_cell.cell")
    levels = [r[0] for r in cells.select("level").distinct().collect()]  # at most 63
    looked = a.select("_id", *[f"_k{i}" for i in range(len(equal))], F.explode(F.array(*[F.struct(F.lit(n).alias("level"), F.shiftright("_p", n).alias("cell")) for n in levels])).alias("_cell") if levels else F.lit(None).alias("_cell"))
    # both joins sort and spill: Spark sizes a side by its compressed files, before it is exploded, and would broadcast millions of rows
    met = looked.select("_id", *[f"_k{i}" for i in range(len(equal))], "_cell.level", "_cell.cell").join(cells.hint("merge"), [*[f"_k{i}" for i in range(len(equal))], "level", "cell"]).select("_id", "_r") if levels else None
    if met is None:
        return left.join(right, F.lit(False), how)
    out = a.select("_id", "_l").join(met.hint("merge"), "_id", how)
    return out.select(*[F.col(f"_l.{c}") for c in left.columns], *[F.col(f"_r.{c}") for c in right.columns]).toDF(*names)


def _cells(low: Column, high: Column) -> Column:
    """The cells (level, cell) that [low, high) is made of: at each level at most one at either end, whose neighbour up the grid isn't wholly inside."""

    def of(n: int) -> Column:
        first, last = F.shiftright(low + ((1 << n) - 1), n), F.shiftright(high, n)  # whole cells of this level: [first, last)
        at_start = (first < last) & (first % 2 != 0)
        at_end = (first < last) & (last % 2 != 0)
        cell = lambda c: F.struct(F.lit(n).alias("level"), c.alias("cell"))
        start, stop = F.when(at_start, cell(first)), F.when(at_end & ~(at_start & (first == last - 1)), cell(last - 1))
        return F.array(start, stop)

    return F.array_compact(F.flatten(F.array(*[of(n) for n in range(62)])))


def resolve_times(logs: DataFrame, anchors: DataFrame) -> DataFrame:
    """``logs`` (boot_uuid, timestamp_mach, preamble_base) with timestamp_unix_ns, timesync_anchor_id and timesync_file_id.

    ``anchors`` has a boot row (is_boot: its time at tick 0) and records for
    each boot. The record at or before the tick counts; without one, the boot row if
    the preamble base is 0, else the first record, which may lie after the tick.
    Without any, the time is 0 and there is no anchor.
    """
    tied = F.struct("anchor_id", "file_id", "kernel_time", "wall_ns", "numerator", "denominator")
    records = anchors.filter(~F.col("is_boot"))
    spans = written(anchor_intervals(records).select(F.col("boot_uuid").alias("_b1"), F.col("low").alias("_low"), F.col("high").alias("_high"), tied.alias("_own")), "spans")
    # the ticks of a boot are cut into cells about as wide as a span, so a log meets the one or two spans of its cell and not all of its boot
    size = spans.agg(F.count("_high").alias("n"), F.sum((F.col("_high") - F.col("_low")).cast("double")).alias("ticks")).first()
    shift = max(0, int(size.ticks // max(size.n, 1)).bit_length()) if size.n else 0
    cells = spans.filter("_high is not null").withColumn("_cell", F.explode(F.sequence(F.shiftright("_low", shift), F.shiftright(F.col("_high") - 1, shift))))
    last = spans.filter("_high is null").select(F.col("_b1").alias("_b4"), F.col("_low").alias("_from"), F.col("_own").alias("_last"))
    first = records.groupBy(F.col("boot_uuid").alias("_b2")).agg(F.min_by(tied, "record").alias("_first"))
    at_boot = F.struct("anchor_id", "file_id", F.lit(0).cast("long").alias("kernel_time"), "wall_ns", "numerator", "denominator")
    boot = anchors.filter("is_boot").groupBy(F.col("boot_uuid").alias("_b3")).agg(F.min_by(at_boot, "record").alias("_boot"))
    ends = first.join(boot, F.col("_b2") == F.col("_b3"), "full_outer").withColumn("_b2", F.coalesce("_b2", "_b3")).drop("_b3")
    ends = small(written(ends.join(last, F.col("_b2") == F.col("_b4"), "left").drop("_b4"), "boots"))
    tick, own_boot = F.col("timestamp_mach"), F.col("boot_uuid")
    near = small(written(cells, "cells"), BROADCAST_ROWS)
    joined = logs.join(near, (own_boot == F.col("_b1")) & (F.shiftright(tick, shift) == F.col("_cell")) & (tick >= F.col("_low")) & (tick < F.col("_high")), "left")
    joined = joined.join(ends, own_boot == F.col("_b2"), "left")
    own = F.coalesce("_own", F.when(tick >= F.col("_from"), F.col("_last")))
    joined = joined.withColumn("_a", F.coalesce(own, F.when(F.col("preamble_base") == 0, F.coalesce("_boot", "_first")).otherwise(F.col("_first"))))
    ns = F.col("_a.wall_ns") + ticks_to_ns(tick - F.col("_a.kernel_time"), F.col("_a.numerator"), F.col("_a.denominator"))
    made = {"timestamp_unix_ns": F.coalesce(ns, F.lit(0)).cast("long"), "timesync_anchor_id": F.col("_a.anchor_id"), "timesync_file_id": F.col("_a.file_id").cast("long")}
    return joined.select(*[logs[c] for c in logs.columns if c not in made], *[v.alias(k) for k, v in made.items()])


def asof_join(left: DataFrame, right: DataFrame, key: str, at: str, right_at: str, value: list[str]) -> DataFrame:
    """Each left row with the latest right row of the same key at or before it, or nulls.

    Both sides are ordered together within the key and the last right row is carried
    forward, so nothing multiplies however long the history of a key is.
    """
    width = F.struct(*[F.col(c) for c in value], F.col(right_at))
    a = left.select(F.col(key).alias("_k"), F.col(at).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.select(width.alias("x")).schema["x"].dataType).alias("_value"))
    b = right.select(F.col(key).alias("_k"), F.col(right_at).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(left.select(F.struct(*left.columns).alias("x")).schema["x"].dataType).alias("_row"), width.alias("_value"))
    w = Window.partitionBy("_k").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = a.unionByName(b).withColumn("_value", F.last("_value", ignorenulls=True).over(w)).filter("_side = 1")
    return both.select("_row.*", *[F.col(f"_value.{c}").alias(f"right_{c}" if c in left.columns else c) for c in [*value, right_at]])
