"""Substring deduplication with suffix automata of reference shards.

Every run of ``window`` words that also starts in a document with a smaller doc_id
is removed. The reference is the corpus itself, so its automata cannot be
broadcast: there is no bound on their size. They stay where their shard is, and
what has to be compared comes to them:

1. A window of words is sent to a shard by its minimizer, the least hash among
   the short word n-grams in it. Equal windows have equal minimizers. Neighbouring
   windows mostly share theirs and travel as one segment.
2. Minimizers that occur in one document only are set aside by an aggregation over
   (minimizer, doc_id); no window with such a one is in two documents.
3. Of the rest, equal segments are one reference with its least doc_id (combined
   before the shuffle, so a thousand copies send few rows). In a shard, references
   are taken by ascending doc_id: each streams through the suffix automaton of those
   before it, and where the matching statistic reaches ``window`` the words are
   a repeat; then it is added.
4. Spans go back to their documents, where maximal ones are removed.

A minimizer in very many documents, or whose segments hold very many words, would make
one large shard. Its windows are sent one by one instead, by a hash of the whole window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, written
from .shingles import ngrams, split_words, word_hashes
from .workers import lean, values

WINDOW = 13
#: Words in the n-grams among which minimizers are chosen.
GRAM = 3
#: Documents with one minimizer above which its windows travel one by one.
CROWDED = 4_000
#: Words in the segments of one minimizer above which its windows do, too. It bounds what one automaton holds (61 MB at 381 bytes a word).
HEAVY = 160_000
#: Windows in a segment; a longer run of one minimizer, as in a text of one word, is several segments.
LONGEST = 512
#: Rows and bytes of content after which a batch of segments goes out; a long document gives several.
ROWS, BYTES = 5_000, 8_000_000

_LAST = 2**63 - 1


class SuffixAutomaton:
    """Suffix automaton of several word sequences."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]

    def _state(self, length: int, follow: dict, link: int) -> int:
        self.next.append(follow)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, p: int, q: int, word) -> int:
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def add(self, words) -> None:
        last = 0
        for word in words:
            q = self.next[last].get(word)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, q, word)
                continue
            p, new = last, self._state(self.length[last] + 1, {}, 0)
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][word]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, word)
            last = new

    def statistics(self, words) -> list[int]:
        """For each word, the length of the longest run ending there that occurs in a sequence added so far."""
        state = size = 0
        out = []
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if word in self.next[state]:
                state = self.next[state][word]
                size += 1
            out.append(size)
        return out


def minimizers(hashes: np.ndarray, window: int, gram: int) -> np.ndarray:
    """The minimizer of each window. ``hashes`` say in their lowest bit whether a word is short; n-grams with fewer short words come first, as they are rarer."""
    h = ngrams(hashes, gram)
    short = hashes & np.uint64(1)
    few = short[: len(h)].copy()
    for j in range(1, gram):
        few += short[j : j + len(h)]
    least = (h >> np.uint64(3)) | (np.minimum(few, np.uint64(7)) << np.uint64(61))
    have, wide = 1, window - gram + 1  # least of ``have`` neighbours, doubled while it fits
    while have * 2 <= wide:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < wide:
        least = np.minimum(least[: len(least) - (wide - have)], least[wide - have :])
    return least.view(np.int64)


class Windows:
    """The windows of a text: their minimizers, and the words from anywhere to anywhere, joined by one space."""

    def __init__(self, text: str | None, window: int, gram: int):
        self.raw = (text or "").encode()
        hashes, self.starts, self.ends = word_hashes(self.raw)
        short = (self.ends - self.starts < 4).astype(np.uint64)
        self.least = minimizers(hashes & ~np.uint64(1) | short, window, gram) if len(hashes) >= window else np.empty(0, np.int64)

    def mark_gaps(self) -> None:
        """Where words are not one space apart, so that they can't be taken as they stand."""
        gaps = self.ends[:-1]
        wide = (self.starts[1:] - gaps != 1) | (np.frombuffer(self.raw, np.uint8)[gaps] != 32)
        self.wide = np.concatenate(([0], np.cumsum(wide)))

    def words(self, i: int, j: int) -> bytes:
        part = self.raw[self.starts[i] : self.ends[j - 1]]
        return part if self.wide[j - 1] == self.wide[i] else b" ".join(part.split())


def _runs(least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of one minimizer start and end; there is one window at least."""
    starts = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    return starts, np.r_[starts[1:], len(least)]


def _held(least: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct minimizers, and the words that the segments of each hold."""
    if not len(least):
        return least, np.empty(0, np.int64)
    starts, ends = _runs(least)
    sizes = ends - starts
    sizes = sizes + (window - 1) * -(-sizes // LONGEST)
    order = np.argsort(least[starts])
    minis = least[starts][order]
    first = np.flatnonzero(np.r_[True, minis[1:] != minis[:-1]])
    return minis[first], np.add.reduceat(sizes[order], first)


def _keys(window: int, gram: int):
    """Rows (doc, tag, text) to each row's distinct minimizers and the words that travel with each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, words = zip(*(_held(Windows(t, window, gram).least, window) for t in values(batch.column(2)))) if len(batch) else ((), ())
            sizes = [len(f) for f in found]
            for lo in range(0, len(found), 200):  # keeps the batches that go back of a size that the JVM takes lightly
                part, n = found[lo : lo + 200], sizes[lo : lo + 200]
                doc, tag = (np.repeat(batch.column(k).slice(lo, 200).to_numpy(False), n) for k in range(2))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(part), pa.int64()), pa.array(doc, pa.int64()), pa.array(tag, pa.int32()), pa.array(np.concatenate(words[lo : lo + 200]), pa.int64())],
                    names=["mini", "doc", "tag", "words"],
                )

    return lean(run)


def _segments(window: int, gram: int):
    """Rows (doc, sum, text, minis, crowded) to the segments whose minimizer is among ``minis``."""

    def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
        for doc, total, text, minis, crowded in zip(*(values(batch.column(k)) for k in range(5))):
            found = Windows(text, window, gram)
            least, alone = found.least, set(crowded)
            if not len(least):
                continue
            found.mark_gaps()
            starts, ends = _runs(least)
            chosen = np.isin(least[starts], minis)
            for start, end, mini in zip(starts[chosen].tolist(), ends[chosen].tolist(), least[starts[chosen]].tolist()):
                if mini in alone:
                    for k in range(start, end):
                        content = found.words(k, k + window)
                        yield xxhash.xxh3_64_intdigest(content) - 2**63, doc, total, k, 1, xxhash.xxh3_128_digest(content), content
                else:
                    for lo in range(start, end, LONGEST):
                        hi = min(end, lo + LONGEST)
                        content = found.words(lo, hi + window - 1)
                        yield mini, doc, total, lo, hi - lo, xxhash.xxh3_128_digest(content), content

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            held = 0
            for row in rows(batch):
                out.append(row)
                held += len(row[-1])
                if len(out) >= ROWS or held >= BYTES:
                    yield _batch(out)
                    out, held = [], 0
            if out:
                yield _batch(out)

    return lean(run)


_SEGMENT = "key long, doc long, sum long, start int, n int, hash binary, content binary"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["key", "doc", "sum", "start", "n", "hash", "content"])


def _match(window: int):
    """Rows (key, first, hash, content), sorted by the first two, to (key, hash, first, spans): where, in
    windows from the content's start, the content repeats one with a smaller ``first``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = first_now = None
        automaton = None
        waiting: list[list[bytes]] = []  # of this key and this document, not yet in the automaton
        for batch in batches:
            out = []
            for key, first, digest, content in zip(*(values(batch.column(k)) for k in range(4))):
                if key != now:
                    now, first_now, automaton, waiting = key, first, None, []
                elif first != first_now:
                    automaton = automaton or SuffixAutomaton()
                    for words in waiting:
                        automaton.add(words)
                    first_now, waiting = first, []
                words = content.split()
                spans: list[int] = []
                whole = False
                if automaton:
                    sizes = automaton.statistics(words)
                    whole = sizes[-1] == len(words)
                    ends = [i for i, s in enumerate(sizes) if s >= window]
                    for i in ends:
                        if spans and spans[-1] == i - window + 1:
                            spans[-1] += 1
                        else:
                            spans += [i - window + 1, i - window + 2]
                if not whole:
                    waiting.append(words)
                out.append((key, digest, first, spans))
            if out:
                kinds = (pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["key", "hash", "first", "spans"])

    return lean(run)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, spans: from and to alternating) to what is kept."""
    for batch in batches:
        out = []
        for doc_id, text, spans in zip(*(values(batch.column(k)) for k in range(3))):
            words = split_words(text)
            keep = words
            if spans:
                gone = np.zeros(len(words) + 1, np.int64)
                np.add.at(gone, spans[0::2], 1)
                np.add.at(gone, spans[1::2], -1)
                keep = [w for w, g in zip(words, np.cumsum(gone).tolist()) if not g]
            out.append((doc_id, len(words), len(words) - len(keep), b" ".join(keep).decode()))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 4, kinds)], names=["doc_id", "n_words", "n_removed", "kept_text"])


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, crowded: int = CROWDED, heavy: int = HEAVY) -> DataFrame:
    """Every row of ``docs`` without the words of windows that start in a document with a smaller doc_id.

    Returns doc_id, n_words, n_removed, kept_text (kept words joined by one space).
    Windows are judged on the input. A text of fewer than ``window`` words keeps
    all; null has no words. Repeats within a document stay. Rows that share a doc_id
    do not count as smaller than each other. A null doc_id counts as larger
    than any other. An empty table gives no rows. Only ``doc_id`` and ``text``
    are read.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    base = base.withColumn("doc", F.coalesce("doc_id", F.lit(_LAST))).withColumn("sum", F.xxhash64("text"))
    tagged = base.select("doc", F.col("sum").bitwiseAND(F.lit(0xFFFFFF)).cast("int").alias("tag"), "text")
    keys = tagged.mapInArrow(_keys(window, gram), "mini long, doc long, tag int, words long")
    shared = keys.groupBy("mini").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.count("*").alias("c"), F.sum("words").alias("words")).filter("lo < hi")
    shared = written(shared.select("mini", ((F.col("c") > crowded) | (F.col("words") > heavy)).alias("many")), "minimizers")
    wanted = keys.join(shared.hint("shuffle_hash"), "mini").groupBy("doc", "tag").agg(F.collect_list("mini").alias("minis"), F.collect_list(F.when(F.col("many"), F.col("mini"))).alias("crowded"))
    wanted = written(wanted, "wanted")
    rows = base.select("doc", F.col("sum").bitwiseAND(F.lit(0xFFFFFF)).cast("int").alias("tag"), "sum", "text").join(wanted, ["doc", "tag"])
    segments = written(rows.select("doc", "sum", "text", "minis", "crowded").mapInArrow(_segments(window, gram), _SEGMENT), "segments")
    drop(shared, wanted)

    references = segments.groupBy("key", "hash").agg(F.min("doc").alias("first"), F.first("content").alias("content"))
    references = references.repartition("key").sortWithinPartitions("key", "first").select("key", "first", "hash", "content")
    matched = written(references.mapInArrow(_match(window), "key long, hash binary, first long, spans array<int>"), "matched")
    met = segments.select("key", "hash", "doc", "sum", "start", "n").join(matched, ["key", "hash"]).filter("doc > first or size(spans) > 0")
    inner = F.transform("spans", lambda s, i: F.col("start") + s + F.when(i % 2 == 1, F.lit(window - 1)).otherwise(F.lit(0)))
    met = met.select("doc", "sum", F.when(F.col("doc") > F.col("first"), F.array(F.col("start"), F.col("start") + F.col("n") + (window - 1))).otherwise(inner).alias("spans"))
    spans = written(met.groupBy("doc", "sum").agg(F.flatten(F.collect_list("spans")).alias("spans")), "spans")
    drop(segments, matched)
    left = base.join(spans, (base["doc"] == spans["doc"]) & base["sum"].eqNullSafe(spans["sum"]), "left").select("doc_id", "text", "spans")
    return left.mapInArrow(lean(_cut), "doc_id long, n_words long, n_removed long, kept_text string")


def digest(out: DataFrame) -> DataFrame:
    return out.withColumn("kept_sha256", F.sha2("kept_text", 256)).drop("kept_text")
