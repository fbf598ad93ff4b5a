"""The shutdown log: which processes held up each shutdown, and for how long."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_AFTER = r"After ([0-9.]+)s, these clients are still here"
_CLIENT = r"remaining client pid: ([0-9]+) \((.*)\)\s*$"
_TERM = r"SIGTERM: \[([0-9]+)\]"


def parse_shutdown_log(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (n, value: lines in order, numbered) to (events, clients).

    Clients gather until a SIGTERM line closes the event. A client's linger is the longest delay
    under which it was listed; an event's delay is the longest of all, null if 0. The log is one
    small text file for each device, so its running event number is one window.
    """
    order = Window.orderBy("n")
    value = F.col("value")
    term = value.rlike(_TERM)
    x = lines.withColumn("event", F.coalesce(F.sum(term.cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    x = x.withColumn("delay", F.when(value.rlike(_AFTER), F.regexp_extract(value, _AFTER, 1).cast("double")))
    x = x.withColumn("now", F.last("delay", True).over(Window.partitionBy("event").orderBy("n")))
    closed = x.filter(term).select("event", F.regexp_extract(value, _TERM, 1).cast("long").alias("unix_s"))
    found = x.filter(value.rlike(_CLIENT)).select("event", F.regexp_extract(value, _CLIENT, 1).cast("long").alias("pid"), F.regexp_extract(value, _CLIENT, 2).alias("path"), F.coalesce("now", F.lit(0.0)).alias("now"))
    clients = found.join(closed.select("event"), "event", "left_semi").groupBy("event", "pid", "path").agg(F.max("now").alias("lingered_seconds"))
    delays = x.groupBy("event").agg(F.max("delay").alias("d"))
    counts = clients.groupBy("event").agg(F.count("*").alias("client_count"))
    events = closed.join(delays, "event", "left").join(counts, "event", "left").select("event", "unix_s", F.nullif("d", F.lit(0.0)).alias("delay_seconds"), F.coalesce("client_count", F.lit(0)).alias("client_count"))
    return events, clients
