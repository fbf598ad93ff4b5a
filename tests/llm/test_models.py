import hashlib
import random
import re
import zlib

import numpy as np
from samples import corpus, make

from logstrata.llm import pii, quality_classifier, quality_rules

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, s):
    d = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        return 13 <= len(d) <= 19 and sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def brute_base(text):
    return {k: [(m.start(), m.end()) for m in re.finditer(p, text or "") if valid(k, m[0])] for k, p in PATTERNS.items()}


def private_texts():
    rng = random.Random(8)
    bits = ["a@b.c_d@e.f", "x.y@mail.example.com", "1.2.3.4", "1.2.3.4.5", "256.1.1.1", "0255.001.1.9", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (017) 555-7713", "+1 2", "+123456789", "é", "日本", "\n", " ", "..", "12", "@", "a", ",", "4111111111111111.2.3.4"]
    out = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(250)]
    return out + [None, "", " ".join(["x@y.zz"] * 1500), "1" * 30_000, "a" * 30_000, "1 " * 9_000, "+1(" + "(" * 5_000]


def check_private(got, docs):
    assert len(got) == len(docs)
    for (d, text), r in zip(docs, got):
        want = brute_base(text)
        assert r.doc_id == d and (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(len(want[k]) for k in PATTERNS)
        named = [f"{k}:{a}:{b}" for k in PATTERNS for a, b in want[k]]
        assert r.base_sha256 == hashlib.sha256(",".join(named).encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert spans[: len(named)] == named and all(s.split(":")[0] in ("secret", "number") for s in spans[len(named) :])


def test_base_spans_match_brute_force(spark):
    texts = private_texts()
    got = sorted(pii.detect(make(spark, texts)).collect(), key=lambda r: r.doc_id)
    check_private(got, list(enumerate(texts)))


def test_method_adds_planted_secrets_and_leaves_clean_texts(spark):
    rng = random.Random(9)
    clean = corpus(9, 60)
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(20)]
    texts = clean + [f'{c} token = "{h}" more words' for c, h in zip(clean, hexes)]
    got = sorted(pii.detect(make(spark, texts)).collect(), key=lambda r: r.doc_id)
    for i, r in enumerate(got):
        want = "" if i < len(clean) else f"secret:{texts[i].index(hexes[i - len(clean)])}:{texts[i].index(hexes[i - len(clean)]) + 40}"
        assert r.spans == want


def test_em_finds_the_reliable_labelers():
    rng = random.Random(3)
    patterns = {}
    for _ in range(2000):
        y = rng.random() < 0.4
        votes = tuple((1 if y else -1) if rng.random() < a else (-1 if y else 1) for a in (0.9, 0.85, 0.55, 0.8))
        patterns[votes, y] = patterns.get((votes, y), 0) + 1
    merged = {}
    for (v, _), n in patterns.items():
        merged[v] = merged.get(v, 0) + n
    post = dict(zip(merged, pii.estimate(list(merged.items()))))
    right = sum(n for (v, y), n in patterns.items() if (post[v] > 0.5) == y) / 2000
    assert right > 0.92


def test_private_awkward(odd, none, awkward):
    order = lambda r: (r[0] is None, r[0] or 0)
    got = pii.detect(odd).collect()
    assert len(got) == len(awkward[0])
    want = sorted((d, *(len(v) for v in brute_base(t).values())) if d is not None else (-1, *(len(v) for v in brute_base(t).values())) for d, t in (r[:2] for r in awkward[0]))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in got) == want
    assert pii.detect(none).count() == 0 and order((1,))


# rules


def brute_rules(text):
    text = text or ""
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.encode().split()]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    twice = {g for g in grams if grams.count(g) > 1} if len(grams) < 3_000 else {g for g, n in __import__("collections").Counter(grams).items() if n > 1}
    covered = {j for i, g in enumerate(grams) if g in twice for j in range(i, i + 5)}
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_rules_match_brute_force(spark):
    texts = corpus(11) + [None, "", "a\na\n \n a\nb", "x " * 500, "# $ | <> &&", "w1 w2 w3 w4 w5 w1 w2 w3 w4 w5", "é ü…\n- x\n- y"]
    for r in quality_rules.apply_rules(make(spark, texts)).collect():
        want = brute_rules(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and not (r.base_failed and r.kept)


def test_rules_awkward(odd, none, awkward):
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality_rules.apply_rules(odd).collect())
    assert got == sorted((-1 if d is None else d, *brute_rules(t)) for d, t in (r[:2] for r in awkward[0]))
    assert quality_rules.apply_rules(none).count() == 0


# classifier


def labelled(spark, n=400):
    rng = random.Random(12)
    good = corpus(12, n)
    texts = [t if rng.random() < 0.7 else " | ".join(t.upper().split()) + "!!" for t in good]
    docs = make(spark, texts)
    labels = spark.createDataFrame([(i, int("!!" not in t), 0) for i, t in enumerate(texts)], "doc_id long, quality int, toxic int")
    return texts, docs, labels


def test_classifier_on_held_out_documents(spark):
    texts, docs, labels = labelled(spark)
    got = quality_classifier.classify(docs, labels).collect()
    held = [r for r in got if r.held_out]
    assert 50 < len(held) < 150 and len(got) == len(texts)
    right = sum(r.predicted == int("!!" not in texts[r.doc_id]) for r in held)
    assert right >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)


def test_gradients():
    rng = np.random.default_rng(1)
    model = quality_classifier.AttentionModel()
    x, starts, y = rng.normal(size=(9, quality_classifier.FEATURES)), np.array([0, 2, 5]), np.array([1.0, 0.0, 1.0])

    def loss():
        s = model.forward(x, starts)[-1]
        return -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s))

    g = model.gradients(x, starts, y)
    for k, v in model.p.items():
        for at in [tuple(rng.integers(0, n) for n in v.shape) for _ in range(4)]:
            was = v[at]
            v[at] = was + 1e-5
            up = loss()
            v[at] = was - 1e-5
            down = loss()
            v[at] = was
            assert abs((up - down) / 2e-5 - g[k][at]) < 1e-6


def test_classifier_awkward(spark, odd, none, awkward):
    _, _, labels = labelled(spark, 60)
    assert quality_classifier.classify(odd, labels).count() == len(awkward[0])
    assert quality_classifier.classify(none, labels).count() == 0
    assert {r.score for r in quality_classifier.classify(odd, labels.limit(0)).collect()} == {0.5}


def brute_features(text):
    """Loop by loop: the features of each passage."""
    import xxhash

    raw, q = (text or "").encode(), quality_classifier
    words, spans, start = [], [], None
    for k, byte in enumerate([*raw, 32]):
        if byte == 32 or 9 <= byte <= 13:
            if start is not None:
                words.append(raw[start:k])
                spans.append(start)
            start = None
        elif start is None:
            start = k
    if not words:
        return [[0.0] * q.FEATURES]
    out = []
    for lo in range(0, len(words), q.PASSAGE):
        part = words[lo : lo + q.PASSAGE]
        begin, end = (spans[lo] if lo else 0), (spans[lo + q.PASSAGE] if lo + q.PASSAGE < len(words) else len(raw))
        shares = [0] * q.N_CLASSES
        for byte in raw[begin:end]:
            kind = next((k for k, chars in enumerate(q._CLASSES) if byte < 128 and chr(byte) in chars), q.N_CLASSES - 2 if byte > 127 else q.N_CLASSES - 1)
            shares[kind] += 1
        buckets = [0] * q.BUCKETS
        for w in part:
            buckets[(xxhash.xxh3_64_intdigest(w) >> 40) % q.BUCKETS] += 1
        n = len(part)
        out.append([s / (end - begin) for s in shares] + [sum(map(len, part)) / n / 10, sum(len(w) <= 3 for w in part) / n, len(set(part)) / n, n / q.PASSAGE] + [b / n for b in buckets])
    return out


def brute_score(model, passages):
    """Loop by loop: gated attention over the passages of one text."""
    import math

    p = {k: v.tolist() for k, v in model.p.items()}
    row = lambda x, m: [sum(a * m[i][j] for i, a in enumerate(x)) for j in range(len(m[0]))]
    encoded, weights = [], []
    for x in passages:
        x = [(a - m) / s for a, m, s in zip(x, model.mean.tolist(), model.scale.tolist())]
        h = [math.tanh(a + b) for a, b in zip(row(x, p["W"]), p["b"])]
        gate = [math.tanh(v) / (1 + math.exp(-u)) for v, u in zip(row(h, p["V"]), row(h, p["U"]))]
        encoded.append(h)
        weights.append(math.exp(sum(g * w for g, w in zip(gate, p["w"]))))
    z = [sum(w * h[j] for w, h in zip(weights, encoded)) / sum(weights) for j in range(len(encoded[0]))]
    return 1 / (1 + math.exp(-sum(a * b for a, b in zip(z, p["q"])) - p["c"][0]))


def test_classifier_matches_brute_force(spark):
    texts, docs, labels = labelled(spark, 80)
    texts = [*texts, None, "", " \n ", "é ü 1,2 (x) \x01", " lead and  trail ", "w " * 500 + "Tail!"]
    for t in texts:
        assert np.allclose(quality_classifier.Encoder()(t), brute_features(t), atol=1e-6)
    model = quality_classifier.train(docs, labels)
    got = {r.doc_id: r.score for r in quality_classifier.score(make(spark, texts), model, ["doc_id"]).collect()}
    for k, t in enumerate(texts):
        assert abs(got[k] - brute_score(model, brute_features(t))) < 1e-4


def test_classifier_trains_on_whole_texts_and_on_clear_labels(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality_classifier.AttentionModel, "fit", lambda self, bags, y: seen.append((list(map(len, bags)), list(y))) or self)
    ids = [k for k in range(40) if zlib.crc32(str(k).encode()) % 4 != 2][:5]
    words = "word " * quality_classifier.PASSAGE
    rows = [(ids[0], words * 300), (ids[1], words), (ids[2], words * 2), (ids[3], "b"), (ids[3], "a " * 100), (ids[3], "b"), (ids[4], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(ids[0], 1), (ids[1], 0), (ids[2], 0), (ids[2], 1), (ids[3], 1), (ids[3], 1), (ids[4], 0), (None, 1)], "doc_id long, quality int")
    quality_classifier.train(docs, labels)
    assert seen == [([300, 1, 3, 1], [1.0, 0.0, 1.0, 0.0])]  # ids[2] has both labels; of ids[3] the least text
