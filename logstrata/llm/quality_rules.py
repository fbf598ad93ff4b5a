"""Quality rules: a table of thresholds compiled into one Spark projection.

Each rule bounds a ratio of two measures of the whole text. ``RULES`` is data; the
compiler turns it into column expressions, so the whole verdict is one narrow
projection without a shuffle and without user functions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = tuple(
    """the of and to in a is that it for was on are as with be by he at from this have not or
    der die und den das von zu mit ein eine ist des für auf nicht im dem sich auch es
    de la le les et un une du en que qui est dans pour par sur au pas ne ce
    el los las del y se no por con una para su lo al""".split()
)


@dataclass(frozen=True)
class Rule:
    """``least`` <= over / under <= ``most``; asked only of texts with ``from_words`` words or more."""

    name: str
    over: str
    under: str
    least: float | None = None
    most: float | None = None
    from_words: int = 10


RULES = (
    Rule("mean word length", "word_chars", "n_words", least=2.0, most=12.0),
    Rule("symbols to words", "n_symbols", "n_words", most=0.1),
    Rule("stop words to words", "n_stop_words", "n_words", least=0.02, from_words=50),
    Rule("repeated lines to lines", "n_dup_lines", "n_lines", most=0.3),
    Rule("lines with an ellipsis to lines", "n_ellipsis_lines", "n_lines", most=0.3),
    Rule("bullet lines to lines", "n_bullet_lines", "n_lines", most=0.9),
)
MIN_WORDS, MOST_REPEATED, REPEAT_WINDOW = 10, 0.2, 5


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column, n: Column, window: int = REPEAT_WINDOW) -> Column:
    """How many words lie in windows that occur twice or more in the array ``words`` of size ``n``.

    Windows are compared by 64-bit hash. Most texts repeat none, which a hash set
    tells; only for the others are (hash, place) pairs sorted, so the cost is n log n at
    most: neighbours with equal hashes mark their places, and the places in order give
    the words covered.
    """

    def marked(s: Column) -> Column:
        last = F.size(s) - 1
        place = lambda k: F.get(s, k)
        same = lambda k: (place(k)["h"] == place(k - 1)["h"]) | (place(k)["h"] == place(k + 1)["h"])
        return F.array_sort(F.transform(F.filter(F.sequence(F.lit(0), last), lambda k: F.coalesce(same(k), (place(k)["h"] == place(k - 1)["h"]), (place(k)["h"] == place(k + 1)["h"]), F.lit(False))), lambda k: place(k)["i"]))

    def covered(places: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("c"), F.lit(-window).alias("last"))
        return F.aggregate(places, start, lambda a, p: F.struct((a["c"] + F.least(F.lit(window), p - a["last"])).alias("c"), p.alias("last")), lambda a: a["c"])

    def by_hash(grams: Column) -> Column:
        pairs = F.array_sort(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0).cast("long")).otherwise(covered(bound(pairs, marked)))

    grams = F.transform(F.sequence(F.lit(0), n - window), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(window)]))
    return F.when(n < window, F.lit(0).cast("long")).otherwise(bound(grams, by_hash))


def measures(text: Column) -> Column:
    """A struct of all counts that the base and the rules use, as longs. Null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, SPACE + "+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))

    def of(w: Column) -> Column:
        n = F.size(w)
        n_stop = F.size(F.filter(w, lambda x: x.isin(*STOP_WORDS)))
        return F.struct(n.cast("long").alias("n_words"), n_stop.cast("long").alias("n_stop_words"), repeated_words(w, n).alias("n_repeat_words"))

    def of_lines(x: Column) -> Column:
        return F.struct(
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            F.size(F.filter(x, lambda y: y.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$"))).cast("long").alias("n_ellipsis_lines"),
            F.size(F.filter(x, lambda y: y.rlike(r"^[\x20\x09-\x0D]*[-*•‣]\x20"))).cast("long").alias("n_bullet_lines"),
        )

    return F.struct(
        bound(words, of).alias("w"),
        bound(lines, of_lines).alias("l"),
        F.length(F.regexp_replace(text, SPACE + "+", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
    )


def passes(rule: Rule) -> Column:
    ratio = F.when(F.col(rule.under) > 0, F.col(rule.over) / F.col(rule.under)).otherwise(F.lit(0.0))
    ok = F.lit(True)
    if rule.least is not None:
        ok = ok & (ratio >= rule.least)
    if rule.most is not None:
        ok = ok & (ratio <= rule.most)
    return (F.col("n_words") < rule.from_words) | ok


def apply_rules(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """doc_id, the measures, base_failed and kept for each row of ``docs``.

    kept is false if the base fails (fewer than ``MIN_WORDS`` words, or more than
    ``MOST_REPEATED`` of the words in repeated windows), else true if every rule passes.
    A null or empty text has no words, so its base fails. Each row is judged by its
    own text, whatever other rows hold. Only ``doc_id`` and ``text`` are read.
    """
    m = docs.select("doc_id", measures(F.col("text")).alias("m"))
    m = m.select("doc_id", "m.w.*", "m.l.*", "m.word_chars", "m.n_symbols")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > int(100 * MOST_REPEATED) * F.col("n_words"))
    verdict = F.lit(True)
    for rule in rules:
        verdict = verdict & passes(rule)
    return m.withColumn("base_failed", failed).withColumn("kept", ~failed & verdict)


def _sql_rule(rule: Rule) -> str:
    ratio = f"(CASE WHEN {rule.under} > 0 THEN {rule.over}::DOUBLE / {rule.under} ELSE 0 END)"
    bounds = [f"{ratio} >= {rule.least}"] * (rule.least is not None) + [f"{ratio} <= {rule.most}"] * (rule.most is not None)
    return f"(n_words < {rule.from_words} OR ({' AND '.join(bounds)}))"


#: The same result in DuckDB's SQL, from the same table of rules.
SQL = rf"""
    WITH t AS (
        SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
    ), s AS (
        SELECT r, doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
               list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
               length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
               len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols
        FROM t
    ), m AS (
        SELECT *, len(w) AS n_words, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
               len(list_filter(w, lambda x: x IN ({", ".join(f"'{w}'" for w in STOP_WORDS)}))) AS n_stop_words,
               len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_ellipsis_lines,
               len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•‣]\x20'))) AS n_bullet_lines
        FROM s
    ), g AS (
        SELECT r, i, array_to_string(w[i : i + 4], ' ') AS g FROM m, unnest(range(1, n_words - 3)) AS u(i) WHERE n_words >= 5
    ), d AS (
        SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g) WHERE c > 1
    ), c AS (
        SELECT r, count(DISTINCT i + j) AS n FROM d, unnest(range(0, 5)) AS u(j) GROUP BY r
    ), b AS (
        SELECT m.*, coalesce(c.n, 0) AS n_repeat_words FROM m LEFT JOIN c USING (r)
    ), f AS (
        SELECT *, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {int(100 * MOST_REPEATED)} * n_words) AS base_failed FROM b
    )
    SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
           n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
           NOT base_failed AND {" AND ".join(map(_sql_rule, RULES))} AS kept
    FROM f
"""
