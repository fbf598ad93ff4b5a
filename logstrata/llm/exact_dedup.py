"""Exact deduplication by deterministic block naming.

Every normalised text is cut into blocks of a fixed number of bytes. The distinct
blocks are sorted and numbered, so a name stands for one content and equal contents
have one name, the same in every run and however the rows are dealt. Then adjacent
names are paired and the distinct pairs sorted and numbered in the same way, level by
level, until one name is left for each document. Equal names at one level mean equal
texts, and the other way round.

Blocks are sorted by a key of 128 bits, so that their contents move once and only keys
are sorted and joined. No key is trusted: while the blocks of a key are gathered, the
least and the greatest content are compared, and if any key had two contents, all keys
are made anew from the next seed. Numbers come from range-partitioned rows and the counts of
ranges. A name that very many rows share is joined by broadcast and not by a shuffle
on it. All of it is DataFrame operations.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import numbered
from .common import BROADCAST_ROWS, drop, one_spaced, small, written

#: Bytes in a block.
BLOCK_BYTES = 4096
#: Rows above which those of one name are joined by broadcast; of n rows, at most n / HOT names are so.
HOT = 1_000

def key_of(block: Column, seed: int) -> list[Column]:
    """Two columns, ka and kb: the key of a block."""
    return [F.xxhash64(F.lit(2 * seed), block).alias("ka"), F.xxhash64(F.lit(2 * seed + 1), block).alias("kb")]


def _named(rows: DataFrame, names: DataFrame, by: list[str], label: str, hot: int, few: int) -> DataFrame:
    """``rows`` with ``name`` in place of ``by``. ``names`` (by, n, name) has all that ``rows`` has, and how many rows each is for."""
    if names.count() <= few:
        return rows.join(F.broadcast(names.select(*by, "name")), by).drop(*by)
    often = small(written(names.filter(F.col("n") > hot).select(*by, "name"), f"{label}-often"))
    rest = rows.join(often.select(*by), by, "left_anti").join(names.select(*by, "name"), by)
    return rows.join(often, by).unionByName(rest).drop(*by)


def block_identities(texts: DataFrame, block_bytes: int = BLOCK_BYTES, hot: int = HOT, few: int = BROADCAST_ROWS) -> DataFrame:
    """``texts`` (body binary, and other columns) to the other columns, level and name.

    Two rows get the same (level, name) exactly if their bodies are equal.
    An empty body is one empty block. Rows end at different levels, each at the
    first one that leaves it a single name.
    """
    others = [c for c in texts.columns if c != "body"]
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("body") / F.lit(block_bytes))).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col("body"), i * block_bytes + 1, F.lit(block_bytes)))
    for seed in count():
        pieces = texts.select(F.explode(blocks).alias("block"))
        gathered = pieces.select(*key_of(F.col("block"), seed), "block").groupBy("ka", "kb")
        met = written(gathered.agg(F.count("*").alias("n"), (F.min("block") != F.max("block")).alias("two")), "block-keys")
        if met.filter("two").isEmpty():
            break
    keys = F.transform(blocks, lambda b: F.struct(*key_of(b, seed))).alias("keys")
    base = written(texts.select(*others, keys).withColumn("_rid", F.monotonically_increasing_id()), "block-rows")
    names = written(numbered(met.select("ka", "kb", "n"), ["ka", "kb"], "name", "block-order"), "block-names")

    alone = base.filter("size(keys) = 1").select(*others, F.col("keys")[0]["ka"].alias("ka"), F.col("keys")[0]["kb"].alias("kb"))
    out = _named(alone, names, ["ka", "kb"], "single", hot, few).withColumn("level", F.lit(0))
    long = base.filter("size(keys) > 1")
    rows = long.select("_rid", F.size("keys").alias("n"), F.posexplode("keys").alias("i", "key")).select("_rid", "n", "i", "key.ka", "key.kb")
    rows = written(_named(rows, names, ["ka", "kb"], "level0", hot, few), "level0")
    level, done = 0, []
    while not rows.isEmpty():
        level += 1
        pairs = rows.groupBy("_rid", "n", F.shiftright("i", 1).alias("i")).agg(
            F.max(F.when(F.col("i") % 2 == 0, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(F.col("i") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b")
        )
        pairs = written(pairs.withColumn("n", F.ceil(F.col("n") / 2).cast("int")), f"pairs{level}")
        distinct = pairs.groupBy("a", "b").agg(F.count("*").alias("n"))
        names = written(numbered(distinct, ["a", "b"], "name", f"order{level}"), f"names{level}")
        after = written(_named(pairs, names, ["a", "b"], f"level{level}", hot, few), f"level{level}")
        drop(rows, pairs)
        done.append(after.filter("n = 1").select("_rid", F.lit(level).alias("level"), "name"))
        rows = written(after.filter("n > 1"), f"rest{level}")
    if not done:
        return out.select(*others, "level", "name")
    ends = done[0]
    for d in done[1:]:
        ends = ends.unionByName(d)
    ends = small(written(ends, "long-names"))
    return out.select(*others, "level", "name").unionByName(long.select("_rid", *others).join(ends, "_rid").select(*others, "level", "name"))


def exact_dedup(docs: DataFrame, block_bytes: int = BLOCK_BYTES, hot: int = HOT, few: int = BROADCAST_ROWS) -> DataFrame:
    """Groups of equal texts, one row for each row of ``docs``.

    Reads ``doc_id`` and ``text``; other columns, whatever their names, are not
    touched. Returns doc_id, keep_id (the smallest doc_id of the group, null if
    all are null), group_size, kept, text_sha256.

    Null and empty texts are equal to each other; a text of only white space
    equals every other such text (one space) and not the empty text. A null
    doc_id sorts after all others. Of rows that repeat a doc_id within a group
    exactly one is kept. An empty table gives no rows.
    """
    base = docs.select("doc_id", one_spaced(F.col("text")).alias("t"))
    texts = base.select("doc_id", F.sha2("t", 256).alias("text_sha256"), F.encode("t", "UTF-8").alias("body"))
    ids = written(block_identities(texts, block_bytes, hot, few).withColumn("row", F.monotonically_increasing_id()), "exact-ids")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "row")).alias("first")
    groups = ids.groupBy("level", "name").agg(F.count("*").alias("group_size"), first).filter("group_size > 1")
    groups = small(written(groups.select("level", "name", "group_size", "first"), "exact-groups"))
    met = ids.join(groups, ["level", "name"], "left")
    alone = F.col("group_size").isNull()
    return met.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("first.row"))).alias("kept"),
        "text_sha256",
    )
