"""Mixing sources to target weights by Sainte-Lague apportionment.

Targets come from weights by filling up: a source takes its share of all words,
but no more than ``cap`` times what it has, and what it cannot take goes to the
others by weight. Words are dealt in blocks of equal size. The blocks go to
sources by highest quotients target / (2k + 1), then each source's blocks to its
shards in the same way, by shard size, which gives every shard an integer quota.
A shard's documents stand in a seeded order and are cut into blocks as one
stream; its quota is so many whole passes and a run of adjacent blocks from a
seeded place. All of it is DataFrame operations.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import numbered, running_total
from .common import n_words, small, written

#: Words in a block. A source misses its target by some blocks at most, so a small block keeps small sources near theirs.
BLOCK_WORDS = 16
#: Words a shard is made for, and shards of a source at most; beyond that shards grow, and a task still sorts
#: only the sizes of a shard's documents (some hundred thousand of them where a source has 10^13 words).
SHARD_WORDS, MAX_SHARDS = 65_536, 65_536
SEED = 20_240_601


def fill_targets(sources: DataFrame, weights: Sequence[float], cap: float) -> DataFrame:
    """``sources`` (source, source_size: one row each) with src (place by code point, null last), weight and target.

    Sources may be many: places and running sums come from sorted ranges, and only two totals reach the driver.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("src") % len(weights)).cast("int") + 1)
    ranked = numbered(sources.withColumn("_none", F.col("source").isNull()), ["_none", "source"], "src", "mix-places").drop("_none")
    ranked = ranked.withColumn("weight", w).withColumn("room", F.col("source_size") * F.lit(float(cap))).withColumn("_ratio", F.col("room") / F.col("weight"))
    ranked = written(running_total(ranked, ["_ratio", "src"], {"room": "_room", "weight": "_weight"}, "mix-rooms"), "mix-levels")
    total = ranked.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    level = (F.lit(total["size"]) - F.col("_room")) / (F.lit(total["weight"]) - F.col("_weight"))
    fits = ranked.withColumn("level", level).filter(F.col("level") <= F.col("_ratio") * (1 + 1e-12)).agg(F.max("level")).first()[0]
    target = F.least("room", F.lit(fits).cast("double") * F.col("weight"))
    return ranked.select("source", "src", "source_size", "weight", F.coalesce(target, F.lit(0.0)).alias("target"))


def apportion(parties: DataFrame, group: list[str], party: str, votes: str, seats: Column) -> DataFrame:
    """Seats for each party by highest quotients votes / (2k + 1); ties go to the smaller party.

    Whatever divisor fits lies between V/(S + n/2) and V/(S - n/2), with V votes, S
    seats and n parties. So a party surely has its seats by the larger divisor and
    never more than by the smaller one. Only the quotients between the two are
    ranked, about two for each party however many seats there are. Without a ``group`` all parties are one, and
    may be many: quotients are ranked in sorted ranges. A group is ranked in one task.
    """
    if group:
        w = Window.partitionBy(*group)
        total = {"_v": F.sum(votes).over(w), "_n": F.count("*").over(w)}
    else:
        whole = parties.agg(F.sum(votes).alias("v"), F.count("*").alias("n")).first()
        total = {"_v": F.lit(whole.v), "_n": F.lit(whole.n)}
    p = parties.withColumns({"_seats": seats.cast("double"), "_v": total["_v"], "_n": total["_n"].cast("double")})
    share = F.when(F.col("_v") > 0, F.col(votes) / F.col("_v")).otherwise(F.lit(0.0))
    p = p.withColumn("_low", F.greatest(F.lit(0), F.floor(share * (F.col("_seats") - F.col("_n") / 2) - 0.5) - 1).cast("long"))
    p = p.withColumn("_high", F.greatest(F.col("_low"), F.ceil(share * (F.col("_seats") + F.col("_n") / 2) + 0.5) + 1).cast("long"))
    sure = F.sum("_low").over(Window.partitionBy(*group)) if group else F.lit(p.agg(F.sum("_low")).first()[0])
    p = p.withColumn("_left", F.col("_seats") - sure)
    open_ = p.filter(F.col(votes) > 0).select(*group, party, "_low", "_left", votes, F.explode(F.sequence("_low", "_high")).alias("_k")).withColumn("_q", F.col(votes) / (2 * F.col("_k") + 1))
    if group:
        ranked = open_.withColumn("_rank", F.row_number().over(Window.partitionBy(*group).orderBy(F.col("_q").desc(), F.col(party), F.col("_k"))))
    else:
        ranked = numbered(open_.withColumn("_q", -F.col("_q")), ["_q", party, "_k"], "_rank", "quotients", first=1)
    won = ranked.groupBy(*group, party, "_low").agg(F.sum((F.col("_rank") <= F.col("_left")).cast("long")).alias("_more"))
    return won.select(*group, party, (F.col("_low") + F.col("_more")).alias("seats"))


def mix(
    docs: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: int = 3, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, max_shards: int = MAX_SHARDS, seed: int = SEED
) -> DataFrame:
    """What the mix takes of every row of ``docs``.

    Reads ``doc_id``, ``text`` and ``source``. Returns doc_id, source, size
    (words), source_size, target, passes (times the whole document is taken),
    run_start and run_words (the words taken once more), taken (all words taken).

    A null text has no words; null is a source of its own, last in order, as is
    the empty name, first. Rows that repeat a doc_id count each for itself.
    A document without words takes nothing. If no document has words, all
    targets are 0. Reruns give the same rows whatever the partitioning: every
    choice hangs on doc_id, source, size and seed alone.
    """
    sized = written(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "mix-sizes")
    sources = written(fill_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap), "mix-sources")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    dealt = apportion(sources, [], "src", "target", F.round(F.lit(total) / block_words))
    plan = sources.join(dealt.select("src", "seats"), "src", "left").select(
        "source", "src", "source_size", "target", F.coalesce("seats", F.lit(0)).alias("blocks"), F.greatest(F.lit(1), F.least(F.lit(max_shards), F.ceil(F.col("source_size") / shard_words))).cast("long").alias("shards")
    )
    plan = small(written(plan, "mix-plan"))
    rows = sized.join(plan, sized["source"].eqNullSafe(plan["source"])).select(
        "doc_id", sized["source"], "src", "size", "source_size", "target", "blocks", F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.col("shards")).alias("shard")
    )
    shards = written(rows.groupBy("src", "shard", "blocks").agg(F.sum("size").alias("words")), "mix-shards")
    quotas = apportion(shards, ["src"], "shard", "words", F.col("blocks"))
    quotas = shards.join(quotas, ["src", "shard"], "left").withColumn("m", F.ceil(F.col("words") / block_words))
    quotas = quotas.withColumn("q", F.least(F.coalesce("seats", F.lit(0)), F.col("m") * cap)).filter("m > 0")
    quotas = quotas.withColumn("passes", F.floor(F.col("q") / F.col("m")).cast("long")).withColumn("r", F.col("q") % F.col("m"))
    place = F.pmod(F.xxhash64(F.lit(seed + 1), F.col("src"), F.col("shard")), F.col("m") - F.col("r") + 1)
    quotas = quotas.select("src", "shard", "passes", (place * block_words).alias("run_from"), F.least("words", (place + F.col("r")) * block_words).alias("run_to"))

    order = Window.partitionBy("src", "shard").orderBy(F.xxhash64(F.lit(seed + 2), F.col("doc_id")), "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("end", F.sum("size").over(order)).withColumn("at", F.col("end") - F.col("size"))
    placed = placed.join(quotas, ["src", "shard"], "left")
    run_start = F.greatest(F.lit(0), F.col("run_from") - F.col("at"))
    run_words = F.greatest(F.lit(0), F.least("end", "run_to") - F.greatest("at", "run_from"))
    out = placed.select("doc_id", "source", "size", "source_size", "target", F.coalesce("passes", F.lit(0)).alias("passes"), F.coalesce(run_words, F.lit(0)).alias("run_words"), run_start.alias("s"))
    out = out.withColumn("run_start", F.when(F.col("run_words") > 0, F.col("s")).otherwise(F.lit(0)).cast("long"))
    return out.select("doc_id", "source", "size", "source_size", "target", "passes", "run_start", "run_words", (F.col("passes") * F.col("size") + F.col("run_words")).cast("long").alias("taken"))


def _nth(rows: DataFrame, same: list[str], ties: list[str]) -> DataFrame:
    """``rows`` with _nth: the place of each among those that are equal in ``same``, by ``ties``. Numbers come from sorted ranges, so a group may be of any size."""
    at = written(numbered(rows, [*same, *ties], "_n", "mix-ranges"), "mix-places")
    first = at.groupBy(*[F.col(c).alias(f"_{k}") for k, c in enumerate(same)]).agg(F.min("_n").alias("_from"))
    out = at.join(first, [at[c].eqNullSafe(first[f"_{k}"]) for k, c in enumerate(same)])
    return out.select(*rows.columns, (F.col("_n") - F.col("_from")).alias("_nth"))


def taken_documents(docs: DataFrame, **params) -> DataFrame:
    """The mixed corpus itself, with the columns of ``docs``: a row for every pass over a
    document and one for the run of words taken once more.

    A run that is the whole document keeps the text as it is; a shorter one has
    its words joined by one space. ``n_chars``, if it is there, is counted anew.
    Rows without a word are not taken. Rows are told apart by doc_id, source and size;
    rows equal in all three are taken alike.
    """
    same = ["doc_id", "source", "_size"]
    picked = mix(docs, **params).filter("taken > 0").select("doc_id", "source", F.col("size").alias("_size"), "passes", "run_start", "run_words")
    picked, rows = written(picked, "mix-picked"), docs.select("*", n_words(F.col("text")).alias("_size"))
    if picked.groupBy(*same).agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        picked, rows = picked.withColumn("_nth", F.lit(0)), rows.withColumn("_nth", F.lit(0))
    else:  # only repeated rows have to be told apart, which moves the texts once more
        picked, rows = written(_nth(picked, same, ["passes", "run_start", "run_words"]), "mix-nth"), _nth(rows, same, ["text"])
    near = small(picked)
    on = [rows[c].eqNullSafe(near[c]) for c in same] + [rows["_nth"] == near["_nth"]]
    joined = rows.join(near, on).select(*[rows[c] for c in rows.columns], F.struct(*[near[c] for c in ("passes", "run_start", "run_words")]).alias("_p"))
    whole = joined.select("*", F.explode(F.sequence(F.lit(0), F.col("_p.passes"))).alias("_i"))
    run = F.when(F.col("_p.run_words") == F.col("_size"), F.col("text")).otherwise(
        F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)")), (F.col("_p.run_start") + 1).cast("int"), F.col("_p.run_words").cast("int")), " ")
    )
    out = whole.withColumn("text", F.when(F.col("_i") > 0, F.col("text")).otherwise(run)).filter("_i > 0 or _p.run_words > 0")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
