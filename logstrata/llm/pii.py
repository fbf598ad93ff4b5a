"""Personal data: weak supervision over candidate spans, in DataFrame operations alone.

Base spans (e-mail, IP address, card, phone) follow from patterns and stay. Beyond
them, wider patterns propose candidates: long mixed strings (``secret``) and
long digit groups (``number``). Several labelers vote on each candidate, private,
not private or neither: patterns on the span, gazetteers of words before it, and
its context. Expectation-maximisation over the counts of vote patterns estimates how far
each labeler can be relied on, with no labels given. Its posteriors then train a
logistic classifier on votes and span shape, which is compiled into one column
expression and decides each candidate.

What reaches the driver is the histogram of vote patterns, whose size is bounded by the
number of labelers (at most 3 ** votes * shapes for each kind), never rows of the data.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

# The patterns are the stated ones, written so that they never go back over long
# runs: possessive repeats, and starts only where a run starts or the last match ended.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
SECRET = r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{16,}+"
NUMBER = r"(?<![0-9A-Za-z.+-])\(?[0-9][0-9\x20().-]{6,}[0-9](?![0-9A-Za-z])"
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"

KINDS = ("email", "ip", "card", "phone", "secret", "number")
#: Words that announce a secret, and words that announce a personal number.
SECRET_WORDS = "token|secret|password|passwd|pwd|passphrase|api[_-]?key|key|auth|bearer|credential|private"
NUMBER_WORDS = "phone|tel|telephone|call|mobile|cell|fax|card|visa|iban|account|acct|ssn|social|passport|licen[cs]e no|id|whatsapp|telefon|tarjeta|carte|konto"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(x: Column) -> Column:
    none = F.array().cast("array<int>")
    start = F.struct(F.lit(0).alias("s"), none.alias("a"))
    return F.aggregate(x, start, lambda acc, v: F.struct((acc["s"] + v).alias("s"), F.array_append(acc["a"], acc["s"] + v).alias("a")), lambda acc: acc["a"])


def running_sums(steps: Column, chunk: int = 512) -> Column:
    """Running sums of an integer array, in chunks, so that no step copies a long array."""

    def joined(chunks: Column) -> Column:
        before = _running(F.transform(chunks, lambda c: F.element_at(c, -1)))
        return F.flatten(F.transform(chunks, lambda c, i: bound(F.when(i == 0, F.lit(0)).otherwise(F.get(before, i - 1)), lambda b: F.transform(c, lambda v: v + b))))

    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / chunk).cast("int")), lambda c: _running(F.slice(steps, c * chunk + 1, F.lit(chunk))))
    return F.when(F.size(steps) <= chunk, _running(steps)).otherwise(bound(chunks, joined))


_SPAN = "array<struct<start:int,end:int,match:string,before:string,after:string>>"


def find(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches in order, with places in code points (end exclusive) and what stands around them."""

    def placed(matches: Column) -> Column:
        def with_gaps(gaps: Column) -> Column:
            ends = running_sums(F.transform(matches, lambda m, i: F.length(m) + F.length(F.get(gaps, i))))
            return bound(
                ends,
                lambda e: F.transform(
                    matches,
                    lambda m, i: F.struct(
                        (F.get(e, i) - F.length(m)).alias("start"), F.get(e, i).alias("end"), m.alias("match"), F.right(F.get(gaps, i), F.lit(32)).alias("before"), F.left(F.get(gaps, i + 1), F.lit(8)).alias("after")
                    ),
                ),
            )

        return F.when(F.size(matches) == 0, F.array().cast(_SPAN)).otherwise(bound(F.split(text, pattern, -1), with_gaps))

    return bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(d: Column) -> Column:
    def add(acc: Column, i: Column) -> Column:
        x = F.substring(d, i, F.lit(1)).cast("int")
        twice = F.when(x > 4, 2 * x - 9).otherwise(2 * x)
        return acc + F.when((F.length(d) - i) % 2 == 1, twice).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add) % 10 == 0


def _card(s: Column) -> Column:
    return bound(digits(s), lambda d: F.when(F.length(d).between(13, 19), luhn(d)).otherwise(F.lit(False)))


BASE = {
    "email": (EMAIL, lambda s: F.lit(True)),
    "ip": (IP, lambda s: s.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")),
    "card": (CARD, _card),
    "phone": (PHONE, lambda s: F.length(digits(s)).between(9, 15)),
}
WIDER = {
    "secret": (SECRET, lambda s: s.rlike("[0-9]") & s.rlike("[A-Za-z]")),
    "number": (NUMBER, lambda s: F.length(digits(s)).between(7, 19)),
}


@dataclass(frozen=True)
class Labeler:
    """Votes 1 (private) where ``yes`` holds, else -1 where ``no`` holds, else 0."""

    name: str
    yes: Callable[[Column], Column]
    no: Callable[[Column], Column]


def _no(_: Column) -> Column:
    return F.lit(False)


LABELERS = {
    "secret": (
        Labeler("pattern: hexadecimal of a digest's length, or a known prefix", lambda c: c["match"].rlike(r"^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|(?:sk|pk|ghp|gho|xox[a-z]|AKIA|eyJ)[-_A-Za-z0-9]+)$"), _no),
        Labeler("gazetteer: a word for secrets just before", lambda c: c["before"].rlike(rf"(?i)(?:^|[^a-z])(?:{SECRET_WORDS})[^a-z]{{0,6}}$"), lambda c: c["before"].rlike(r"(?i)(?:https?:|www\.|/)[^\x20]*$")),
        Labeler("context: assigned or quoted", lambda c: c["before"].rlike("[=:][\\x20]*[\"']?$"), lambda c: c["before"].rlike(r"[A-Za-z,.]\x20$")),
        Labeler("pattern: letters and digits in turn", lambda c: F.length(digits(c["match"])) * 8 >= F.length(c["match"]), lambda c: F.length(digits(c["match"])) * 16 < F.length(c["match"])),
        Labeler("pattern: words with hyphens or slashes", _no, lambda c: c["match"].rlike(r"^[A-Za-z]{2,}(?:[-_/=][A-Za-z0-9]*)+$")),
    ),
    "number": (
        Labeler("pattern: groups as on cards or phones", lambda c: c["match"].rlike(r"^(?:\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}|[0-9]{4}(?:[\x20-][0-9]{4}){3})$"), lambda c: c["match"].rlike(r"^[0-9]+(?:\.[0-9]+)?$")),
        Labeler("gazetteer: a word for personal numbers just before", lambda c: c["before"].rlike(rf"(?i)(?:^|[^a-z])(?:{NUMBER_WORDS})[^a-z]{{0,6}}$"), lambda c: c["before"].rlike(r"[$€£%]\x20?$")),
        Labeler("context: labelled or in brackets", lambda c: c["before"].rlike(r"[:#(]\x20?$"), lambda c: c["after"].rlike(r"^\x20?(?:[%$€£]|[a-z]{1,3}\b)")),
        Labeler("pattern: a date or a range of years", _no, lambda c: c["match"].rlike(r"(?:^|[^0-9])(?:1[89]|20)[0-9]{2}(?:$|[^0-9])")),
        Labeler("pattern: card length and checksum", _no, lambda c: bound(digits(c["match"]), lambda d: F.length(d).between(13, 19) & ~luhn(d))),
    ),
}
VOTES = max(map(len, LABELERS.values()))


def _votes(kind: str, c: Column) -> Column:
    vote = lambda x: F.when(x.yes(c), F.lit(1)).when(x.no(c), F.lit(-1)).otherwise(F.lit(0))
    return F.array(*[vote(x) for x in LABELERS[kind]], *[F.lit(0)] * (VOTES - len(LABELERS[kind])))


def _shape(c: Column) -> Column:
    """Length and share of digits, each in three steps."""
    n, d = F.length(c["match"]), F.length(digits(c["match"]))
    return F.when(n < 24, F.lit(0)).when(n < 48, F.lit(1)).otherwise(F.lit(2)) * 3 + F.when(d * 3 < n, F.lit(0)).when(d * 3 < 2 * n, F.lit(1)).otherwise(F.lit(2))


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, x))))


def estimate(patterns: list[tuple[tuple[int, ...], float]], rounds: int = 60) -> list[float]:
    """Posterior of private for each vote pattern, by expectation-maximisation.

    Given the class, labelers vote independently; each has a chance for each vote in each class.
    The start is a majority vote. Priors worth one vote in keep chances off 0 and 1
    and on the side on which a labeler is better than chance.
    """
    total = sum(n for _, n in patterns)
    if not total:
        return []
    k = len(patterns[0][0])
    post = [_sigmoid(1.5 * sum(v)) for v, _ in patterns]
    for _ in range(rounds):
        share = (sum(p * n for p, (_, n) in zip(post, patterns)) + 1) / (total + 2)
        chance = []
        for j in range(k):
            table = {(c, v): 1.0 + 2.0 * (v == (1 if c else -1)) for c in (0, 1) for v in (-1, 0, 1)}
            for p, (votes, n) in zip(post, patterns):
                table[1, votes[j]] += p * n
                table[0, votes[j]] += (1 - p) * n
            sums = {c: sum(table[c, v] for v in (-1, 0, 1)) for c in (0, 1)}
            chance.append({(c, v): table[c, v] / sums[c] for c, v in table})
        post = [_sigmoid(math.log(share / (1 - share)) + sum(math.log(chance[j][1, v] / chance[j][0, v]) for j, v in enumerate(votes))) for votes, _ in patterns]
    return post


def fit_classifier(rows: list[tuple[tuple[int, ...], int, float, float]], steps: int = 400, rate: float = 0.5) -> tuple[list[float], list[float], float]:
    """Weights of votes, weights of the nine shapes, and a constant: logistic regression on
    (votes, shape, posterior, count), by gradient descent with a little decay."""
    k, total = len(rows[0][0]), sum(n for *_, n in rows)
    w, shapes, c = [1.0] * k, [0.0] * 9, -0.5
    for _ in range(steps):
        gw, gs, gc = [1e-3 * x for x in w], [1e-2 * x for x in shapes], 0.0
        for votes, shape, post, n in rows:
            d = (_sigmoid(c + shapes[shape] + sum(a * b for a, b in zip(w, votes))) - post) * n / total
            gc += d
            gs[shape] += d
            for j, v in enumerate(votes):
                gw[j] += d * v
        w = [x - rate * g for x, g in zip(w, gw)]
        shapes = [x - rate * g for x, g in zip(shapes, gs)]
        c -= rate * gc
    return w, shapes, c


def _outside(c: Column, base: list[Column]) -> Column:
    ok = F.lit(True)
    for spans in base:
        ok = ok & ~F.exists(spans, lambda s: (s["start"] < c["end"]) & (c["start"] < s["end"]))
    return ok


def _decide(w: list[float], shapes: list[float], constant: float) -> Callable[[Column], Column]:
    """The classifier as an expression over a voted candidate."""

    def private(x: Column) -> Column:
        logit = F.lit(constant) + F.get(F.array(*[F.lit(s) for s in shapes]), x["shape"])
        for j, weight in enumerate(w):
            logit = logit + F.lit(weight) * F.get(x["votes"], F.lit(j))
        return logit >= 0

    return private


def _named(kind: str) -> Column:
    return F.transform(F.col(kind), lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))


def spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, histogram): each document's base spans and voted candidates, and the counts of (kind, votes, shape)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))

    def matching(kind: str, ok: Callable[[Column], Column]) -> Column:
        return F.filter(find(F.col("t"), (BASE | WIDER)[kind][0]), lambda s: ok(s["match"])).alias(kind)

    def voted(kind: str) -> Column:
        free = F.filter(F.col(kind), lambda c: _outside(c, [F.col(k) for k in BASE]))
        return F.transform(free, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), _votes(kind, c).alias("votes"), _shape(c).alias("shape"))).alias(kind)

    def voting(kind: str) -> Column:
        return F.transform(F.col(kind), lambda c: F.struct(F.lit(kind).alias("kind"), c["votes"].alias("votes"), c["shape"].alias("shape")))

    found = docs.select("doc_id", text.alias("t")).select("doc_id", *[matching(k, ok) for k, (_, ok) in (BASE | WIDER).items()])
    places = [F.transform(F.col(k), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias(k) for k in BASE]
    rows = written(found.select("doc_id", *places, *[voted(k) for k in WIDER]), "pii-spans")
    flat = rows.select(F.explode(F.concat(*[voting(k) for k in WIDER])).alias("c"))
    return rows, flat.groupBy("c.kind", "c.votes", "c.shape").agg(F.count("*").alias("n"))


def detect(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans (of all kinds) for each row of ``docs``.

    ``spans`` is kind:start:end of all spans, base ones and those that the method
    adds, by kind as in ``KINDS``, then start; places count code points, end exclusive.
    Added spans never overlap base ones, and those of ``number`` never overlap a ``secret``.
    A null or empty text has no spans. Rows that repeat a doc_id are searched each
    for itself; a null doc_id stays null. Only ``doc_id`` and ``text`` are read.
    """
    rows, histogram = spans(docs)
    counts = histogram.collect()
    chosen = {}
    for kind in WIDER:
        patterns = sorted((tuple(r["votes"]), r["shape"], r["n"]) for r in counts if r["kind"] == kind)
        if not patterns:
            continue
        merged: dict[tuple[int, ...], float] = {}
        for votes, _, n in patterns:
            merged[votes] = merged.get(votes, 0) + n
        post = dict(zip(merged, estimate(list(merged.items()))))
        w, shapes, c = fit_classifier([(votes, shape, post[votes], n) for votes, shape, n in patterns])

        chosen[kind] = F.filter(F.col(kind), _decide(w, shapes, c - math.log(threshold / (1 - threshold))))
    added = {k: chosen.get(k, F.slice(F.col(k), 1, 0)) for k in WIDER}
    rows = rows.select("doc_id", *BASE, *[v.alias(k) for k, v in added.items()])
    rows = rows.withColumn("number", F.filter(F.col("number"), lambda c: _outside(c, [F.col("secret")])))
    named = {k: _named(k) for k in KINDS}
    return rows.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE], F.sha2(F.array_join(F.concat(*[named[k] for k in BASE]), ","), 256).alias("base_sha256"), F.array_join(F.concat(*named.values()), ",").alias("spans"),
        sum((F.size(k) for k in KINDS), F.lit(0)).cast("long").alias("n_spans"),
    )
