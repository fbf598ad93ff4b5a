"""The queries over the driver's tables: each a thin digest of its operator's output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, html_extract, mixing, near_dedup, packing, pii, quality_classifier, quality_rules, substring_dedup, token_counts
from .common import table


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "source", "passes", "run_start", "run_words")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.substring_dedup(table(spark, sf_dir, "documents")))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.apply_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(table(spark, sf_dir, "documents"))


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op1 that SQL can state: sizes and targets."""
    return op1_mix_sources(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


def private_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op8 that SQL can state: how many base spans of each kind."""
    return op8_personal_data(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_quality_rules": op3_quality_rules,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_token_counts": op6_token_counts,
    "op7_html_extraction": op7_html_extraction,
    "op8_personal_data": op8_personal_data,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
    "mix_targets": mix_targets,
    "private_base": private_base,
}

ORACLE_SQL = {
    "mix_targets": r"""
        WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS z, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY source),
        w AS (SELECT *, [5, 2, 1][i % 3 + 1] AS w, 3 * z AS room FROM s),
        b AS (SELECT *, sum(z) OVER () AS total, sum(w) OVER () AS weight, sum(room) OVER o - room AS rooms, sum(w) OVER o - w AS weights FROM w WINDOW o AS (ORDER BY room::DOUBLE / w, i)),
        t AS (SELECT source, z, least(room, w * max(CASE WHEN (total - rooms)::DOUBLE / (weight - weights) <= room::DOUBLE / w THEN (total - rooms)::DOUBLE / (weight - weights) END) OVER ()) AS target FROM b)
        SELECT doc_id, size, z AS source_size, round(target, 3) AS target FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
    """,
    "private_base": r"""
        WITH m AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') AS email, regexp_extract_all(coalesce(text, ''), '[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)') AS ip,
                          list_transform(regexp_extract_all(coalesce(text, ''), '[0-9](?:[\x20-]?[0-9])+'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS card,
                          list_transform(regexp_extract_all(coalesce(text, ''), '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS phone FROM documents),
        l AS (SELECT *, list_filter(card, lambda d: length(d) BETWEEN 13 AND 19) AS long FROM m)
        SELECT doc_id, len(email)::BIGINT AS n_email,
               len(list_filter(ip, lambda x: list_max(list_transform(string_split(x, '.'), lambda y: CASE WHEN length(ltrim(y, '0')) > 3 THEN 999 ELSE y::INTEGER END)) <= 255))::BIGINT AS n_ip,
               len(list_filter(long, lambda d: list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN (length(d) - i) % 2 = 0 THEN d[i]::INTEGER WHEN d[i]::INTEGER > 4 THEN 2 * d[i]::INTEGER - 9 ELSE 2 * d[i]::INTEGER END)) % 10 = 0))::BIGINT AS n_card,
               len(list_filter(phone, lambda d: length(d) BETWEEN 9 AND 15))::BIGINT AS n_phone
        FROM l
    """,
    "op10_ngram_jaccard_join": r"""
        WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        u AS (SELECT array_to_string(w, ' ') AS k, any_value(w) AS w, len(any_value(w)) AS n, min(doc_id) AS d FROM t GROUP BY 1),
        g AS (SELECT DISTINCT d, array_to_string(w[i : i + 4], ' ') AS g FROM u, unnest(range(1, greatest(n - 3, 2))) AS r(i) WHERE n > 0),
        z AS (SELECT d, count(*) AS z FROM g GROUP BY d),
        p AS (SELECT a.d AS a, b.d AS b, count(*) AS s FROM g a JOIN g b USING (g) WHERE a.d < b.d GROUP BY ALL),
        l AS (SELECT a, b FROM p JOIN z x ON x.d = a JOIN z y ON y.d = b WHERE 5 * s >= 4 * (x.z + y.z - s)),
        e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r(a, b) AS (SELECT d, d FROM u UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
        c AS (SELECT a, min(b) AS class_id FROM r GROUP BY a),
        n AS (SELECT a, count(*) AS n FROM e GROUP BY a)
        SELECT doc_id, class_id, u.d AS copy_of, coalesce(n.n, 0)::BIGINT AS n_links
        FROM t JOIN u ON array_to_string(t.w, ' ') = u.k JOIN c ON c.a = u.d LEFT JOIN n ON n.a = u.d
    """,
    "op2_substring_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        g AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS g FROM t, unnest(range(1, len(w) - 11)) AS u(i) WHERE len(w) >= 13),
        d AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS lo FROM g) WHERE lo < doc_id),
        gone AS (SELECT doc_id, list(DISTINCT i + j) AS gone FROM d, unnest(range(0, 13)) AS u(j) GROUP BY doc_id)
        SELECT t.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
               sha256(CASE WHEN gone IS NULL THEN array_to_string(w, ' ') ELSE coalesce((SELECT string_agg(x, ' ' ORDER BY p) FROM (SELECT unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p) WHERE NOT list_contains(gone, p)), '') END) AS kept_sha256
        FROM t LEFT JOIN gone USING (doc_id)
    """,
    "op3_quality_rules": quality_rules.SQL,
    "op4_exact_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM t
    """,
}
