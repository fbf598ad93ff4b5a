"""Best-fit packing planned on a length histogram.

Documents become token pieces of at most ``capacity`` ids. How many pieces there
are of each length is all the planner sees: best-fit decreasing runs over counts,
placing many equal pieces at once, so its work hangs on the number of lengths (at most
``capacity``), not on the number of documents. Each step of the plan is a run of
ranks within one length. Pieces get ranks within their length in parallel, from
salted groups and their prefix counts, and find their places by joining on
length and rank.
"""

from __future__ import annotations

import bisect
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import written
from .token_counts import byte_symbols
from .workers import Recent, lean, values

CAPACITY = 4096

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


#: The published pre-token pattern of this vocabulary, and what it comes to on lower-case ASCII.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
ASCII_TOKEN = r"'(?:s|t|re|ve|m|ll|d)|[a-z]+|[0-9]|[^\sa-z0-9]+"
#: Pre-tokens that are remembered: new ones cost a merge each, and there are many.
KNOWN = 100_000


class TextIds:
    """A text to its ids as little-endian unsigned 32-bit bytes.

    A text of Latin letters, ASCII white space and visible characters is lowered and cut into pre-tokens here, and only
    the merges are left to the library, each distinct pre-token once. Of any other text the parts between ASCII white space
    go one by one, to the same way or (other scripts, control characters, what might be a special string) to the library as they are.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.merge = self.tokenizer.model.tokenize
        self.cut, self.cut_ascii = regex.compile(PRE_TOKEN).findall, re.compile(ASCII_TOKEN).findall
        self.odd = re.compile("[^!-~¡-\u024f \\t\\n\\x0b\\x0c\\r]|<\\|").search
        self.symbols = byte_symbols()
        self.packers = [struct.Struct(f"<{n}I").pack for n in range(64)]
        self.parts = Recent(self._part, KNOWN)
        self.words = Recent(self._word)

    def _pack(self, ids: list[int]) -> bytes:
        return self.packers[len(ids)](*ids) if len(ids) < 64 else struct.pack(f"<{len(ids)}I", *ids)

    def _part(self, part: str) -> bytes:
        symbols = part if part.isascii() else "".join(map(self.symbols.__getitem__, part.encode()))
        return self._pack([t.id for t in self.merge(symbols)])

    def _plain(self, text: str) -> bytes:
        cut = self.cut_ascii(text.lower()) if text.isascii() else self.cut(unicodedata.normalize("NFC", text).lower())
        return b"".join(map(self.parts.__getitem__, cut))

    def _word(self, word: bytes) -> bytes:
        text = word.decode()
        return self._pack(self.tokenizer.encode(text, add_special_tokens=False).ids) if self.odd(text) else self._plain(text)

    def encode(self, text: str) -> bytes:
        """This tokenizer drops white space and no pre-token of it spans any, so the ids of a
        text are those of its parts between ASCII white space, one after the other."""
        if not self.odd(text):
            return self._plain(text)
        return b"".join([self.words[w] if len(w) < 64 else self._word(w) for w in text.encode().split()])


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each row's ids, then ``end_id``, cut every ``capacity`` ids."""
    end, width = np.array([end_id], "<u4").tobytes(), 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = TextIds(tokenizer_path).encode
        for batch in batches:
            out = []
            for doc_id, text in zip(values(batch.column(0)), values(batch.column(1))):
                ids = encode(text or "") + end
                out += [(doc_id, i, i * capacity, len(p) // 4, zlib.crc32(p)) for i, p in enumerate(ids[k : k + width] for k in range(0, len(ids), width))]
            cols = list(zip(*out)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run), _PIECES)


@dataclass
class Step:
    """Ranks [first, first + count) of ``length``: ``each`` to a sequence, from ``sequence`` on, the first of each at ``offset``."""

    length: int
    first: int
    count: int
    sequence: int
    each: int
    offset: int


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Step]:
    """Best-fit decreasing over counts.

    Open sequences are kept as runs of neighbours with the same room left. A length
    goes to the runs with the least room that holds it; what is left over opens new
    sequences, filled with as many of that length as they hold.
    """
    rooms: dict[int, list[tuple[int, int]]] = {}  # room left -> runs (first sequence, how many)
    sizes: list[int] = []  # the rooms that have runs, ascending
    steps: list[Step] = []
    opened = 0

    def add(room: int, first: int, many: int) -> None:
        if not room:
            return
        if room not in rooms:
            rooms[room] = []
            bisect.insort(sizes, room)
        rooms[room].append((first, many))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left and (at := bisect.bisect_left(sizes, length)) < len(sizes):
            room = sizes[at]
            first, many = rooms[room].pop()
            if not rooms[room]:
                del rooms[room], sizes[at]
            each = room // length
            full = min(many, left // each)
            if full:
                steps.append(Step(length, rank, full * each, first, each, capacity - room))
                rank, left = rank + full * each, left - full * each
                add(room - each * length, first, full)
            if full < many and left and left < each:
                steps.append(Step(length, rank, left, first + full, left, capacity - room))
                add(room - left * length, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            if full < many:
                add(room, first + full, many - full)
        each = capacity // length
        full, over = divmod(left, each)
        if full:
            steps.append(Step(length, rank, full * each, opened, each, 0))
            add(capacity - each * length, opened, full)
            rank, opened = rank + full * each, opened + full
        if over:
            steps.append(Step(length, rank, over, opened, over, 0))
            add(capacity - over * length, opened, 1)
            opened += 1
    return steps


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """Every piece of every row of ``docs`` with its place.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset. Pieces
    longer than any other way allows are never cut further: only documents over
    ``capacity`` are cut. A null or empty text is the end id alone. Rows that repeat a
    doc_id are packed each for itself. An empty table gives no rows. To the
    driver comes the histogram, at most ``capacity`` rows; the plan goes back.
    """
    spark = docs.sparkSession
    cut = written(pieces(docs, tokenizer_path, end_id, capacity), "pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    # about as many salted groups of a length as rows in each
    salts = spark.createDataFrame([(k, max(1, round(n**0.5))) for k, n in histogram.items()], "length long, salts long")
    salted = cut.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("salts"))).drop("salts")
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("nth", F.row_number().over(within).cast("long") - 1).join(counts, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("nth"))

    steps = spark.createDataFrame([(s.length, s.first, s.count, s.sequence, s.each, s.offset) for s in plan(histogram, capacity)], "length long, first long, count long, sequence long, each long, at long")
    s = F.broadcast(steps)
    placed = ranked.join(s, (ranked["length"] == s["length"]) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("count")))
    nth = F.col("rank") - F.col("first")
    return placed.select(
        "doc_id", "piece", "start", ranked["length"], "ids_crc32", (F.col("sequence") + F.floor(nth / F.col("each"))).cast("long").alias("sequence_id"), (F.col("at") + (nth % F.col("each")) * ranked["length"]).cast("long").alias("offset")
    )
