"""Quality classifier: attention-based multiple-instance learning, in numpy.

A document is a bag of passages of ``PASSAGE`` words. Each passage becomes a
feature vector (shares of character classes, word lengths, repetition, hashed words)
and is encoded by one tanh layer. Gated attention weighs the passages, and the
weighted mean of the encodings is scored. All weights are learned together from
labels of documents; no passage has a label.

Training takes at most ``MOST_DOCUMENTS`` labelled rows, those with the least hash of
doc_id, each with all its passages. Scoring encodes every passage of every text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shingles import WordHashes
from .workers import lean, values

PASSAGE = 48
#: Labelled rows that a model is trained on, at most.
MOST_DOCUMENTS = 6_000
THRESHOLD = 0.7
BUCKETS = 32

_CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", ".,;:", "!?", "#*$%&|<>", "'\"`", "()[]{}", "-_/\\=+~^@")
N_CLASSES = len(_CLASSES) + 2  # and non-ASCII, and other ASCII
FEATURES = N_CLASSES + 4 + BUCKETS


def _class_table() -> np.ndarray:
    out = np.full(256, N_CLASSES - 1, np.int64)
    out[128:] = N_CLASSES - 2
    for k, chars in enumerate(_CLASSES):
        out[np.frombuffer(chars.encode(), np.uint8)] = k
    return out


class Encoder:
    """Text to a matrix with a row of features for each passage; an empty text is one passage of zeros."""

    def __init__(self):
        self.table, self.known = _class_table(), WordHashes()

    def __call__(self, text: str | None) -> np.ndarray:
        raw = (text or "").encode()
        words = raw.split()
        if not words:
            return np.zeros((1, FEATURES), np.float32)
        data = np.frombuffer(raw, np.uint8)
        black = (data != 32) & ((data < 9) | (data > 13))
        starts = np.flatnonzero(black & np.r_[True, ~black[:-1]])
        n = -(-len(words) // PASSAGE)
        of_word = np.arange(len(words)) // PASSAGE
        of_byte = np.zeros(len(data), np.int64)
        of_byte[starts[PASSAGE::PASSAGE]] = 1
        of_byte = np.cumsum(of_byte)
        out = np.empty((n, FEATURES), np.float32)
        counts = np.bincount(of_byte * N_CLASSES + self.table[data], minlength=n * N_CLASSES).reshape(n, N_CLASSES)
        out[:, :N_CLASSES] = counts / counts.sum(axis=1, keepdims=True)
        sizes = np.fromiter(map(len, words), np.float64, len(words))
        many = np.bincount(of_word, minlength=n)
        h = self.known.of(words)
        mean = np.bincount(of_word, sizes, n) / many
        out[:, N_CLASSES] = mean / 10
        out[:, N_CLASSES + 1] = np.bincount(of_word, sizes <= 3, n) / many
        distinct = np.unique((h << np.uint64(24)) | (of_word.astype(np.uint64) & np.uint64(0xFFFFFF)))
        out[:, N_CLASSES + 2] = np.bincount((distinct & np.uint64(0xFFFFFF)).astype(np.int64), minlength=n)[:n] / many
        out[:, N_CLASSES + 3] = many / PASSAGE
        bucket = (h >> np.uint64(40)).astype(np.int64) % BUCKETS
        out[:, N_CLASSES + 4 :] = np.bincount(of_word * BUCKETS + bucket, minlength=n * BUCKETS).reshape(n, BUCKETS) / many[:, None]
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class AttentionModel:
    """Gated attention over encoded passages."""

    def __init__(self, hidden: int = 24, gate: int = 12, seed: int = 3):
        rng = np.random.default_rng(seed)
        g = lambda *s: rng.normal(0, s[0] ** -0.5, s)
        self.p = {"W": g(FEATURES, hidden), "b": np.zeros(hidden), "V": g(hidden, gate), "U": g(hidden, gate), "w": g(gate), "q": g(hidden), "c": np.zeros(1)}
        self.mean, self.scale = np.zeros(FEATURES), np.ones(FEATURES)

    def forward(self, x: np.ndarray, starts: np.ndarray):
        """x: passages of several bags one after the other; starts: where each bag begins."""
        p = self.p
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ p["W"] + p["b"])
        v, u = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        s = (v * u) @ p["w"]
        sizes = np.diff(np.r_[starts, len(x)])
        a = np.exp(s - np.repeat(np.maximum.reduceat(s, starts), sizes))
        a /= np.repeat(np.add.reduceat(a, starts), sizes)
        z = np.add.reduceat(a[:, None] * h, starts)
        return x, h, v, u, a, z, sizes, _sigmoid(z @ p["q"] + p["c"])

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        starts = np.cumsum([0, *map(len, bags[:-1])])
        return self.forward(np.concatenate(bags), starts)[-1]

    def gradients(self, x: np.ndarray, starts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        x, h, v, u, a, z, sizes, score = self.forward(x, starts)
        d = (score - y) / len(y)
        dz = np.repeat(d[:, None] * p["q"], sizes, axis=0)
        da = (h * dz).sum(axis=1)
        ds = a * (da - np.repeat(np.add.reduceat(a * da, starts), sizes))
        gate = ds[:, None] * p["w"]
        dv, du = gate * u * (1 - v * v), gate * v * u * (1 - u)
        dh = (a[:, None] * dz + dv @ p["V"].T + du @ p["U"].T) * (1 - h * h)
        return {"W": x.T @ dh, "b": dh.sum(axis=0), "V": h.T @ dv, "U": h.T @ du, "w": (v * u).T @ ds, "q": z.T @ d, "c": np.array([d.sum()])}

    def fit(self, bags: list[np.ndarray], labels: np.ndarray, epochs: int = 30, batch: int = 64, rate: float = 4e-3, decay: float = 1e-4, seed: int = 5) -> AttentionModel:
        rng = np.random.default_rng(seed)
        everything = np.concatenate(bags)
        self.mean, self.scale = everything.mean(axis=0), everything.std(axis=0) + 1e-3
        self.p["c"][:] = np.log((labels.mean() + 1e-3) / (1 - labels.mean() + 1e-3))
        m, s, t = {k: np.zeros_like(v) for k, v in self.p.items()}, {k: np.zeros_like(v) for k, v in self.p.items()}, 0
        steps = epochs * -(-len(bags) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(bags))
            for at in range(0, len(order), batch):
                chosen = order[at : at + batch]
                part = [bags[i] for i in chosen]
                g, t = self.gradients(np.concatenate(part), np.cumsum([0, *map(len, part[:-1])]), labels[chosen]), t + 1
                now = rate * (1 - t / (steps + 1))
                for k in self.p:
                    g[k] = g[k] + decay * self.p[k]
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    s[k] = 0.999 * s[k] + 0.001 * g[k] ** 2
                    self.p[k] = self.p[k] - now * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)
        return self


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 4


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_DOCUMENTS):
    """A model from rows whose remainder is not 2, or the share of label 1 (0.5 without labels) where fewer than two classes are there.

    A doc_id with labels of both classes is left out. Of rows of ``docs`` that repeat a
    doc_id the one with the least text is taken.
    """
    rows = labels.select("doc_id", F.col("quality").cast("int").alias("y")).filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & (remainder(F.col("doc_id")) != 2))
    rows = rows.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("other")).filter("y = other").select("doc_id", "y")
    chosen = F.broadcast(rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder()
        for batch in batches:
            out = [encode(text).astype(np.float32).tobytes() for text in values(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["doc_id", "y", "x"])

    source = docs.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    given = source.join(chosen, "doc_id").groupBy("doc_id").agg(F.first("y").alias("y"), F.min("text").alias("text"))
    found = sorted(given.select(F.col("doc_id").cast("long"), "y", "text").mapInArrow(lean(run), "doc_id long, y int, x binary").collect())
    y = np.array([r.y for r in found], float)
    if len(set(y)) < 2:
        return float(y.mean()) if len(y) else 0.5
    bags = [np.frombuffer(r.x, np.float32).reshape(-1, FEATURES).astype(np.float64) for r in found]
    return AttentionModel().fit(bags, y)


def score(docs: DataFrame, model, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``docs`` and the score of each row's whole text."""
    names = [f"c{i}" for i in range(len(keep))]
    kinds = [docs.schema[c].dataType.simpleString() for c in keep]
    given = [docs[c].alias(n) for c, n in zip(keep, names)]
    at = keep.index("text") if "text" in keep else len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder()
        for batch in batches:
            if isinstance(model, float):
                scores = [model] * batch.num_rows
            else:
                scores = [float(model.score([encode(t).astype(np.float64)])[0]) for t in values(batch.column(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(scores, pa.float64())], names=[*names, "score"])

    read = docs.select(*given) if at < len(keep) else docs.select(*given, docs["text"].cast("string").alias("_text"))
    out = read.mapInArrow(lean(run), ", ".join([*(f"{n} {k}" for n, k in zip(names, kinds)), "score double"]))
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, keep)], "score")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **bounds) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``.

    Only ``doc_id`` and ``text`` of ``docs`` and ``doc_id`` and ``quality`` of ``labels`` are
    read; a score depends on the text alone. Null and empty texts are one
    passage of zeros. A null doc_id is not held out and never trained on. Rows that
    repeat a doc_id are scored each for itself. Labels other than 0 and 1 are
    left out, as is a doc_id that has both. Without labels of both classes each score is the share of label 1,
    or 0.5.
    """
    model = train(docs, labels, **bounds)
    ids = docs.select("doc_id", "text")
    return score(ids, model, ["doc_id"]).select(
        "doc_id", F.coalesce(remainder(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
