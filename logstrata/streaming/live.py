"""The same operators over a growing folder of JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.compare import KEY, match_key, read_reference


def read_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Log rows from lines as files arrive."""
    return read_reference(spark.readStream.format("text").load(folder))


def without_repeats(logs: DataFrame, within: str = "10 minutes") -> DataFrame:
    """The first of rows with equal keys, remembered for as long as the watermark allows."""
    timed = match_key(logs).withColumn("at", F.timestamp_micros(F.expr("timestamp_unix_ns div 1000")))
    return timed.withWatermark("at", within).dropDuplicatesWithinWatermark(KEY)


def rolling_histogram(logs: DataFrame, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Counts for each level and window of event time."""
    timed = logs.filter("timestamp_unix_ns > 0").withColumn("at", F.timestamp_micros(F.expr("timestamp_unix_ns div 1000")))
    return timed.withWatermark("at", late).groupBy(F.window("at", width), "log_level").agg(F.count("*").alias("n"))
