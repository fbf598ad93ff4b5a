"""A keyword index of messages: which logs hold a token, in buckets by token.

The index is a table (bucket, token, id), partitioned by bucket and sorted by token,
so a query reads the few row groups of its tokens. What it finds are candidates; a term of
several tokens, which have to stand next to each other, is checked on those alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .filters import keyword_terms, matches_keywords, tokens

#: Buckets of an index. It is a fixed number, as queries compute the bucket of a token from it.
BUCKETS = 256


def bucket_of(token: Column) -> Column:
    return F.pmod(F.crc32(token.cast("binary")), F.lit(BUCKETS)).cast("int")


def keyword_index(logs: DataFrame, text: str = "message") -> DataFrame:
    """(bucket, token, id): each token of each log once. Null and empty texts have none."""
    found = logs.select("id", F.explode(F.array_distinct(tokens(F.col(text)))).alias("token"))
    return found.select(bucket_of(F.col("token")).alias("bucket"), "token", "id")


def candidates(index: DataFrame, query: str) -> DataFrame | None:
    """Ids of logs that hold all tokens of the query; None where no term is left. Only the buckets of its tokens are read."""
    wanted = sorted({t for term in keyword_terms(query) for t in term})
    if not wanted:
        return None
    from zlib import crc32

    places = [(F.col("bucket") == crc32(t.encode()) % BUCKETS) & (F.col("token") == t) for t in wanted]
    hits = index.filter(reduce(lambda a, b: a | b, places))
    if len(wanted) == 1:
        return hits.select("id")
    return hits.groupBy("id").agg(F.count("*").alias("n")).filter(F.col("n") == len(wanted)).select("id")


def indexed_match(logs: DataFrame, index: DataFrame, query: str, text: str = "message") -> DataFrame:
    """Logs that the keyword query matches, by the index; the same rows as a scan gives."""
    ids = candidates(index, query)
    if ids is None:
        return logs
    found = logs.join(ids, "id", "left_semi")
    return found.filter(matches_keywords(F.col(text), query)) if any(len(term) > 1 for term in keyword_terms(query)) else found
