"""N-gram Jaccard join by MinHash banding.

1. Each text becomes its set of word n-grams and a MinHash signature in bands.
   Band and row counts follow from the threshold and the recall that is asked for.
   Equal word sequences are one text from here on (a class of copies).
2. A shuffle on band hashes finds texts that share a band (a bucket). Each bucket is
   tied to its least member, a text keeps one edge, and what hangs together is a
   candidate component; any two texts that share a band are in the same one.
3. Pairs are verified on their full n-gram sets, in blocks of bounded size. A component
   that fits is one block. A larger one in which most pairs share a band is cut by hash,
   any other by the largest bucket of each text, and only those blocks meet that have members
   of a bucket in common; so the work follows the pairs that share a band, not the square of a
   component that hangs together by chance. A meeting of two blocks is one
   unit of work, wherever it runs, and gives back link counts and a spanning forest, not pairs.
4. Connected components of the verified links are the classes.

No bucket is capped and no pair of a bucket goes unverified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, small, written
from .components import joined
from .shingles import WordHashes, ngrams, split_words
from .workers import lean, values

N, THRESHOLD, RECALL, MOST_HASHES = 5, 0.8, 0.9999, 256
#: A block holds at most about so many texts and so many n-grams.
BLOCK_TEXTS, BLOCK_GRAMS = 1_024, 1_000_000
#: A component of m texts is cut by hash if its buckets have m * m / DENSE pairs or more.
DENSE = 4
SEED = 11

_SIGNED = "doc_id long, key binary, grams long, bands array<long>, digest binary"


def choose_bands(threshold: float, recall: float, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows in a band for which the bands needed to find a pair at the
    threshold with the given recall still fit in ``most`` hashes."""
    best = (1, 1)
    for rows in range(1, most + 1):
        bands = int(np.ceil(np.log1p(-recall) / np.log1p(-(threshold**rows))))
        if bands * rows > most:
            break
        best = (max(bands, 1), rows)
    return best


class Signer:
    """Band hashes of n-gram sets. Each hash is a multiply-add on 32 well mixed bits."""

    def __init__(self, bands: int, rows: int, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.shape = (bands, rows)
        self.a = rng.integers(0, 2**31, bands * rows, np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = rng.integers(0, 2**32, bands * rows, np.uint32)
        self.weights = rng.integers(0, 2**63, rows, np.uint64) * np.uint64(2) + np.uint64(1)
        self.shift = rng.integers(0, 2**63, bands, np.uint64)

    def bands(self, grams: np.ndarray) -> np.ndarray:
        h = (grams >> np.uint64(32)).astype(np.uint32)
        least = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        for at in range(0, len(h), 512):
            part = np.multiply.outer(h[at : at + 512], self.a)
            part += self.b
            np.minimum(least, part.min(axis=0), out=least)
        x = ((least.reshape(self.shape).astype(np.uint64) + np.uint64(1)) * self.weights).sum(axis=1, dtype=np.uint64) + self.shift
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return (x ^ (x >> np.uint64(29))).view(np.int64)


def sign(docs: DataFrame, n: int, bands: int, rows: int, digest: Column | None = None) -> DataFrame:
    """doc_id, key (of the word sequence), grams (set size), bands (none for a text without words), digest as given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, signer = WordHashes(), Signer(bands, rows)
        for batch in batches:
            keys, sizes, found = [], [], []
            for text in values(batch.column(1)):
                words = split_words(text)
                grams = np.unique(ngrams(known.of(words), n))
                keys.append(xxhash.xxh3_128_digest(b" ".join(words)))
                sizes.append(len(grams))
                found.append(signer.bands(grams) if words else np.empty(0, np.int64))
            ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
            arrays = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found) if found else [], pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), arrays, batch.column(2)], names=["doc_id", "key", "grams", "bands", "digest"])

    digest = F.lit(None).cast("binary") if digest is None else digest
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), digest.alias("digest")).mapInArrow(lean(run), _SIGNED)


def shared_grams(one: list[np.ndarray], two: list[np.ndarray] | None = None) -> np.ndarray:
    """How many n-grams each set of ``one`` has in common with each of ``two`` (by default ``one`` again), exactly."""
    sets, m = one + (two or []), len(one)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    met = count[column] > 1  # n-grams of one set alone meet no other
    renamed = np.cumsum(count > 1) - 1
    owner, column = owner[met], renamed[column[met]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((m, len(two) if two else m), np.float32)  # exact: far fewer than 2^24 n-grams
    width = 1024
    for at in range(0, (int(column[-1]) + 1) if len(column) else 0, width):
        lo, hi = np.searchsorted(column, (at, at + width))
        x = np.zeros((len(sets), width), np.float32)
        x[owner[lo:hi], column[lo:hi] - at] = 1
        both += x[:m] @ (x[m:] if two else x).T
    return both


def linked(one: list[np.ndarray], two: list[np.ndarray] | None, threshold: float) -> np.ndarray:
    """Whether each set of ``one`` and each of ``two`` (by default, each other one of ``one``) reach the threshold."""
    here = np.array([len(s) for s in one])
    there = np.array([len(s) for s in two]) if two else here
    out = shared_grams(one, two).astype(np.float64) * (1 + threshold) >= threshold * (here[:, None] + there[None, :]) - 1e-9
    if not two:
        np.fill_diagonal(out, False)
    return out


def forest(links: np.ndarray) -> np.ndarray:
    """For each row the least row that it is connected to."""
    root = np.full(len(links), -1)
    for start in range(len(links)):
        if root[start] < 0:
            front = np.array([start])
            root[start] = start
            while len(front):
                front = np.flatnonzero(links[front].any(axis=0) & (root < 0))
                root[front] = start
    return root


def verify_unit(rows: list[tuple[int, int, str]], i: int, j: int, known: WordHashes, n: int, threshold: float) -> tuple[list[int], np.ndarray, list[int]]:
    """Of the texts (rid, block, text) of a unit: the rids, how many links each has, and the least rid that links lead it to.

    Where ``i`` is ``j`` all pairs are looked at, else those between the two blocks.
    """
    rows = sorted(rows, key=lambda r: (r[1] != i, r[0]))
    sets = [np.unique(ngrams(known.of(split_words(t)), n)) for _, _, t in rows]
    if i == j:
        links = linked(sets, None, threshold)
    else:
        m = sum(b == i for _, b, _ in rows)
        links = np.zeros((len(sets),) * 2, bool)
        if 0 < m < len(sets):
            links[:m, m:] = linked(sets[:m], sets[m:], threshold)
            links[m:, :m] = links[:m, m:].T
    rids = [r for r, _, _ in rows]
    order = np.argsort(rids, kind="stable")
    root = np.empty(len(rids), np.int64)
    root[order] = order[forest(links[np.ix_(order, order)])]
    return rids, links.sum(axis=1), [rids[k] for k in root]


def _verify(n: int, threshold: float):
    """Rows (i, j, block, rid, text), sorted by the first two, to (node, center, links): a row for each text of each unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()

        def close(key, rows):
            rids, links, roots = verify_unit(rows, *key, known, n, threshold)
            return pa.RecordBatch.from_arrays([pa.array(rids, pa.int64()), pa.array(roots, pa.int64()), pa.array(links, pa.int64())], names=["node", "center", "links"])

        now, rows = None, []
        for batch in batches:
            for i, j, block, rid, text in zip(*(values(batch.column(k)) for k in range(5))):
                if (i, j) != now:
                    if rows:
                        yield close(now, rows)
                    now, rows = (i, j), []
                rows.append((rid, block, text))
        if rows:
            yield close(now, rows)

    return lean(run)


def _dealt(texts: DataFrame, block_texts: int, block_grams: int) -> tuple[DataFrame, DataFrame]:
    """Of each text that shares a band with another, its block (node, block); and the meetings (block, i, j) of blocks of large components, those with themselves included."""

    size = F.greatest(F.ceil(F.count("*") / block_texts), F.ceil(F.sum("grams") / block_grams)).cast("int").alias("cuts")
    members = texts.select("rid", F.explode("bands").alias("band"))
    buckets = members.groupBy("band").agg(F.min("rid").alias("center"), F.count("*").alias("size")).filter("size > 1")
    members = written(members.join(buckets, "band").select(F.col("rid").alias("node"), "band", "center", "size"), "members")
    found = joined(members, F.max(F.struct("size", "band"))["band"].alias("largest"), F.sum("size").alias("met"))
    found = written(found.join(texts.select(F.col("rid").alias("node"), "key", "grams"), "node"), "candidates")
    # the sizes of a text's buckets, over all texts: the pairs of all buckets, each twice
    dense = (F.sum("met") * DENSE >= F.count("*") * F.count("*") * 2).alias("dense")
    large = small(written(found.groupBy("label").agg(size, dense).filter("cuts > 1").select("label", "dense"), "large"))
    alone = found.join(large, "label", "left_anti").select("node", F.col("label").alias("block"))
    group = F.when(F.col("dense"), F.col("label")).otherwise(F.xxhash64("label", "largest")).alias("group")
    among = written(found.join(large, "label").select("node", "key", "grams", group), "among")
    cut = among.join(small(written(among.groupBy("group").agg(size), "cuts")), "group")
    # blocks that happen to have the same hash are one block; no pair is lost by that
    blocks = written(cut.select("node", F.xxhash64("group", F.pmod(F.xxhash64("key"), F.col("cuts"))).alias("block")), "blocks")
    held = members.select("node", "band").join(small(blocks), "node").select("band", "block").distinct()
    held = written(held, "held")
    pairs = held.select("band", F.col("block").alias("i")).join(held.select("band", F.col("block").alias("j")), "band").filter("i <= j").select("i", "j").distinct()
    ends = F.explode(F.array_distinct(F.array("i", "j"))).alias("block")
    meetings = written(pairs.select(ends, "i", "j"), "meetings")
    out = written(alone.unionByName(blocks), "dealt")
    drop(members, found, among, held, blocks)
    return out, meetings


def _classes(docs: DataFrame, n: int, threshold: float, recall: float, block_texts: int, block_grams: int, digest: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The signed rows of ``docs``, and of each text its key, label (of its class), class_id, copy_of and n_links."""
    bands, rows = choose_bands(threshold, recall)
    signed = written(sign(docs, n, bands, rows, digest), "signed")
    texts = signed.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("grams").alias("grams"), F.first("bands").alias("bands"))
    texts = written(texts.withColumn("rid", F.monotonically_increasing_id()), "texts")
    blocks, meetings = _dealt(texts, block_texts, block_grams)

    # one row of each text in a block: that of its least doc_id (any of them, if that repeats)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    firsts = written(texts.select("rid", "first", "key").join(small(blocks).withColumnRenamed("node", "rid"), "rid"), "firsts")
    near = small(firsts)
    fetched = source.join(near, source["doc_id"].eqNullSafe(near["first"])).select("rid", "block", "key", "text")
    fetched = fetched.mapInArrow(_same_key, "rid long, block long, text string").dropDuplicates(["rid"])
    units = fetched.join(small(meetings), "block", "left").select(F.coalesce("i", "block").alias("i"), F.coalesce("j", "block").alias("j"), "block", "rid", "text")
    verified = units.repartition("i", "j").sortWithinPartitions("i", "j").mapInArrow(_verify(n, threshold), "node long, center long, links long")
    verified = written(verified, "verified")
    classes = written(joined(verified, F.sum("links").alias("n_links")).join(firsts.select(F.col("rid").alias("node"), "first"), "node"), "classes")
    least = small(written(classes.groupBy("label").agg(F.min("first").alias("class_id")), "least"))
    verdicts = small(written(classes.join(least, "label").select(F.col("node").alias("rid"), "label", "n_links", "class_id"), "verdicts"))
    drop(verified, blocks, meetings, firsts, classes)

    labelled = texts.select("rid", "key", "first").join(verdicts, "rid", "left")
    known = F.col("label").isNotNull()
    return signed, labelled.select("key", F.coalesce("label", "rid").alias("label"), F.when(known, F.col("class_id")).otherwise(F.col("first")).alias("class_id"), F.col("first").alias("copy_of"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def near_dedup(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, block_texts: int = BLOCK_TEXTS, block_grams: int = BLOCK_GRAMS) -> DataFrame:
    """Each row of ``docs`` with its class.

    Returns doc_id, class_id (least doc_id among all documents that links join,
    copies included), copy_of (least doc_id with the same words in the same
    order), n_links (how many other texts have an n-gram Jaccard similarity of
    ``threshold`` or more with this one; copies of one text count as one).

    Words are what stands between ASCII white space. A text of fewer than ``n``
    words is one n-gram of all it has. Texts without a word, null included, have
    no links but are copies of each other. A null doc_id is greater than any
    other. Rows that repeat a doc_id are judged by their texts alone. An empty
    table gives no rows. Only ``doc_id`` and ``text`` are read.
    """
    signed, labelled = _classes(docs, n, threshold, recall, block_texts, block_grams)
    return signed.select("doc_id", "key").join(labelled.drop("label"), "key").select("doc_id", "class_id", "copy_of", "n_links")


def near_kept(docs: DataFrame, digest: Column, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """A row for each class of ``docs``: doc_id and ``digest`` of the row to keep, and whether others may share both.

    It is a row with the least doc_id of the class, null last; of several texts with
    that doc_id the one with the least key and digest. ``digest`` is binary, and rows with
    equal digests have equal words.
    """
    signed, labelled = _classes(docs, n, threshold, recall, BLOCK_TEXTS, BLOCK_GRAMS, digest)
    labelled = written(labelled, "labelled")
    first = F.min(F.struct(F.col("copy_of").isNull().alias("no"), "copy_of", "key")).alias("first")
    best = small(written(labelled.groupBy("label").agg(first).select("label", "first.key", F.col("first.copy_of").alias("least")), "near-first"))
    found = signed.select("doc_id", "key", "digest").join(best, "key").filter("doc_id <=> least")
    return found.groupBy("label").agg(F.first("doc_id").alias("doc_id"), F.min("digest").alias("digest"), (F.count("*") > 1).alias("shared")).drop("label")


def _same_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drops rows whose text isn't that of the key: other rows with the same doc_id."""
    for batch in batches:
        same = [xxhash.xxh3_128_digest(b" ".join(split_words(t))) == k for k, t in zip(values(batch.column("key")), values(batch.column("text")))]
        yield batch.select(["rid", "block", "text"]).filter(pa.array(same, pa.bool_()))
