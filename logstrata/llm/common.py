"""What the corpus operators share: table access, scratch tables, white space."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import BROADCAST_ROWS, drop, drop_all, shared_dir, small, written

__all__ = ["BROADCAST_ROWS", "SPACE", "WORD", "drop", "drop_all", "n_words", "one_spaced", "shared_dir", "small", "table", "written"]

#: ASCII white space as every operator here means it, and its complement.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def one_spaced(text: Column) -> Column:
    """The text, null as empty, with every run of ASCII white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE + "+", " ")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
