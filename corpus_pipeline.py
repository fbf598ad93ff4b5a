"""The corpus pipeline: from raw documents to packed sequences, in five stages.

Every stage reads the columns of ``documents`` alone; others, whatever their names, are left
behind. An empty table gives an empty one. Null texts are empty texts, null doc_ids come after all others, and
rows that repeat a doc_id are judged each by its own text. Texts are read whole, whatever their length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logstrata.llm import exact_dedup, mixing, near_dedup, packing, quality_classifier
from logstrata.llm.common import drop, one_spaced, small, table, written
from logstrata.llm.queries import tokenizer_file

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the classifier's threshold.

    Null and empty texts are scored like any other. Equal texts have equal scores, so repeated rows stay or go together.
    """
    model = quality_classifier.train(docs, table(spark, sf_dir, "labels"))
    scored = quality_classifier.score(docs, model, list(COLUMNS))
    return scored.filter(F.col("score") >= quality_classifier.THRESHOLD).select(*COLUMNS)


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _kept(docs: DataFrame, digest: Column, keep: DataFrame, label: str) -> DataFrame:
    """The rows of ``docs`` whose doc_id and ``digest`` are in ``keep`` (doc_id, digest, shared), one for each row of ``keep``.

    Where ``shared`` says that rows may have both in common, the least of them in
    the order of COLUMNS stands for all. No other rows are grouped.
    """
    keep = written(keep, label)
    shared, alone = keep.filter("shared"), keep.filter("not shared")

    def matched(keys: DataFrame) -> DataFrame:
        keys = small(keys.select(F.col("doc_id").alias("kept_id"), F.col("digest").alias("kept_digest")))
        rows = docs.select(*COLUMNS, digest.alias("digest"))
        return rows.join(keys, rows["doc_id"].eqNullSafe(keys["kept_id"]) & (rows["digest"] == keys["kept_digest"]), "left_semi")

    out = matched(alone).select(*COLUMNS)
    if shared.isEmpty():
        return out
    least = matched(shared).groupBy("doc_id", "digest").agg(F.min(F.struct(*COLUMNS)).alias("row"))
    return out.unionByName(least.select("row.*"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row, with the least doc_id.

    Null and empty texts are equal. Of rows that share that doc_id, the least in the order of the columns stays; a null doc_id stays only
    where the whole group has none.
    """
    first = exact_dedup.exact_dedup(docs).filter("doc_id <=> keep_id").groupBy("doc_id", F.unhex("text_sha256").alias("digest"))
    return _kept(docs, _digest(one_spaced(F.col("text"))), first.agg((F.count("*") > 1).alias("shared")), "exact-kept")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates one row, with the least doc_id.

    Texts without words are one class. Ties are settled as in the stage before.
    """
    digest = _digest(F.coalesce("text", F.lit("")))
    return _kept(docs, digest, near_dedup.near_kept(docs, digest), "near-kept")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes, a row for each pass over a document.

    Texts without words are not taken. Null is a source of its own. Equal rows are taken alike, each for itself.
    """
    return mixing.taken_documents(docs.select(*COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences.

    A null or empty text is the end id alone. Repeated rows are packed each for itself; a null doc_id stays null.
    """
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("n-gram Jaccard join", near), ("mixing sources to target weights", mix), ("best-fit packing", pack)]

#: SQL expresses neither the classifier nor the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What stages hand on is dropped once it was read."""
    docs, passed = table(spark, sf_dir, "documents").select(*COLUMNS), []
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        drop(*passed)
        passed = [docs]
    out = STAGES[-1][1](spark, docs, sf_dir)  # its pieces are written by now
    drop(*passed)
    return out
