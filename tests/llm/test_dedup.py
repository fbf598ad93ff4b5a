import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F
from samples import corpus, make

from logstrata.llm import exact_dedup, near_dedup, substring_dedup
from logstrata.llm.common import table  # noqa: F401


def rows(df, *keys):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: tuple((r[k] is None, r[k]) for k in keys))


# exact


def brute_exact(docs):
    import re

    norm = [(d, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for d, t in docs]
    least, count = {}, Counter()
    for d, t in norm:
        count[t] += 1
        if d is not None and (least.get(t) is None or d < least[t]):
            least[t] = d
    return [(d, least.get(t), count[t], hashlib.sha256(t.encode()).hexdigest()) for d, t in norm]


def test_exact_matches_brute_force_at_any_block_size(spark):
    texts = corpus(2) + ["x" * 100, "x" * 101, "x" * 99 + "y", None, "", " "]
    want = sorted((d, k, n, h) for d, k, n, h in brute_exact(list(enumerate(texts))))
    for block, hot, few in ((7, 3, 0), (4096, 1000, 1000)):
        got = rows(exact_dedup.exact_dedup(make(spark, texts), block, hot, few), "doc_id")
        assert [(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got] == want
        assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in got)


def test_exact_names_are_the_same_however_rows_are_dealt(spark):
    texts = [(k, t.encode()) for k, t in enumerate(corpus(3, 80))]
    found = []
    for parts, few in ((1, 1000), (7, 0)):
        df = spark.createDataFrame(texts[:: -1 if parts > 1 else 1], "k long, body binary").repartition(parts)
        found.append(sorted(map(tuple, exact_dedup.block_identities(df, 16, 2, few).collect())))
    assert found[0] == found[1]
    names = {}
    for (k, level, name), (_, body) in zip(found[0], texts):
        assert names.setdefault((level, name), body) == body
    assert len(names) == len({b for _, b in texts})


def test_exact_keys_of_two_contents_are_made_anew(spark, monkeypatch):
    from pyspark.sql import functions as F

    made = exact_dedup.key_of
    monkeypatch.setattr(exact_dedup, "key_of", lambda block, seed: made(block, seed) if seed else [F.lit(1).cast("long").alias("ka"), F.length(block).cast("long").alias("kb")])
    df = spark.createDataFrame([(1, b"aaaa"), (2, b"bbbb"), (3, b"aaaa"), (4, b"c")], "k long, body binary")
    got = {r.k: r.name for r in exact_dedup.block_identities(df).collect()}
    assert got[1] == got[3] and sorted({*got.values()}) == [0, 1, 2]


def test_exact_names_differ_where_checksums_do_not(spark):
    """The naming alone decides: bodies of one length, whatever their checksum."""
    df = spark.createDataFrame([(1, b"aaaabbbbcccc"), (2, b"aaaabbbbcccd"), (3, b"aaaabbbbcccc"), (4, b""), (5, b"aaaa"), (6, b"bbbbaaaacccc")], "rid long, body binary")
    got = {r["rid"]: (r["level"], r["name"]) for r in exact_dedup.block_identities(df, 4).collect()}
    assert got[1] == got[3] and len(set(got.values())) == 5


def test_exact_awkward(odd, none, awkward):
    got = exact_dedup.exact_dedup(odd).collect()
    assert len(got) == len(awkward[0])
    assert sorted((r.keep_id, r.group_size) for r in got) == sorted((k, n) for _, k, n, _ in brute_exact([r[:2] for r in awkward[0]]))
    assert sum(r.kept for r in got) == len({r.text_sha256 for r in got})
    assert exact_dedup.exact_dedup(none).count() == 0


# substrings


def brute_substring(docs, w):
    first = {}
    split = [(d, (t or "").encode().split()) for d, t in docs]
    for d, words in split:
        for i in range(len(words) - w + 1):
            k = tuple(words[i : i + w])
            if d is not None:
                first[k] = min(d, first.get(k, d))
    out = []
    for d, words in split:
        gone = set()
        for i in range(len(words) - w + 1):
            f = first.get(tuple(words[i : i + w]))
            if f is not None and (d is None or f < d):
                gone |= set(range(i, i + w))
        out.append((d, len(words), len(gone), b" ".join(x for i, x in enumerate(words) if i not in gone).decode()))
    return out


def key(r):
    return (r[0] is None, *[x if x is not None else 0 for x in r])


def test_substring_matches_brute_force(spark):
    texts = corpus(3) + [None, "", "a b c", " ".join(["is", "on"] * 60), " ".join(["is", "on"] * 40)]
    want = sorted(brute_substring(list(enumerate(texts)), 13), key=key)
    assert sum(r[2] for r in want) > 500
    for crowded in (20_000, 3):
        got = sorted((tuple(r) for r in substring_dedup.substring_dedup(make(spark, texts), crowded=crowded).collect()), key=key)
        assert got == want


def test_substring_awkward(odd, none, awkward):
    got = sorted((tuple(r) for r in substring_dedup.substring_dedup(odd).collect()), key=key)
    assert got == sorted(brute_substring([r[:2] for r in awkward[0]], 13), key=key)
    assert substring_dedup.substring_dedup(none).count() == 0


def test_automaton_statistics():
    import random

    rng = random.Random(1)
    for _ in range(100):
        a, seen = substring_dedup.SuffixAutomaton(), []
        for _ in range(4):
            words = [rng.choice("ab") for _ in range(rng.randint(0, 12))]
            want = [max(k for k in range(i + 2) if k == 0 or any(words[i + 1 - k : i + 1] == s[j : j + k] for s in seen for j in range(len(s)))) for i in range(len(words))]
            assert a.statistics(words) == want
            a.add(words)
            seen.append(words)


# near duplicates


def brute_near(docs, n=5, t=0.8):
    texts, copies = {}, defaultdict(list)
    for d, text in docs:
        words = tuple((text or "").encode().split())
        copies[words].append(d)
        k = min(n, len(words))
        texts[words] = {words[i : i + k] for i in range(len(words) - k + 1)} if k else set()
    keys = list(texts)
    least = {w: min((d for d in copies[w] if d is not None), default=None) for w in keys}
    links, parent = Counter(), {w: w for w in keys}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (u := len(texts[a] | texts[b])) and len(texts[a] & texts[b]) >= t * u:
                links[a] += 1
                links[b] += 1
                parent[find(a)] = find(b)
    group = defaultdict(list)
    for w in keys:
        group[find(w)].append(least[w])
    out = []
    for d, text in docs:
        w = tuple((text or "").encode().split())
        out.append((d, min((x for x in group[find(w)] if x is not None), default=None), least[w], links[w]))
    return out


def test_near_matches_brute_force(spark):
    texts = corpus(4) + [None, "", " ", "a b c", "a b c", "a b d"]
    want = sorted(brute_near(list(enumerate(texts))))
    assert sum(r[3] for r in want) > 15
    for texts_, grams in ((1024, 10**6), (3, 10**6)):
        got = sorted(tuple(r) for r in near_dedup.near_dedup(make(spark, texts), block_texts=texts_, block_grams=grams).collect())
        assert got == want


def test_near_awkward(odd, none, awkward):
    got = sorted((tuple(r) for r in near_dedup.near_dedup(odd).collect()), key=key)
    assert got == sorted(brute_near([r[:2] for r in awkward[0]]), key=key)
    assert near_dedup.near_dedup(none).count() == 0


def test_bands_reach_the_recall():
    for t in (0.5, 0.8, 0.95):
        b, r = near_dedup.choose_bands(t, 0.9999)
        assert b * r <= near_dedup.MOST_HASHES and 1 - (1 - t**r) ** b >= 0.9999 - 1e-9


def test_measured_recall_at_the_threshold():
    import numpy as np

    rng = np.random.default_rng(0)
    b, r = near_dedup.choose_bands(0.8, 0.9999)
    signer, met = near_dedup.Signer(b, r), 0
    for _ in range(400):
        shared, one, two = (rng.integers(0, 2**63, k, np.uint64) for k in (80, 10, 10))
        met += bool((signer.bands(np.r_[shared, one]) == signer.bands(np.r_[shared, two])).any())
    assert met >= 399


# components


def test_components_contract_hubs_chains_and_random_edges(spark):
    import random

    from logstrata.llm.components import components

    rng = random.Random(9)
    edges = [(500, k) for k in range(501, 560)] + [(900 - k, 901 - k) for k in range(60)] + [(rng.randrange(200), rng.randrange(200)) for _ in range(110)] + [(7, 7), (3, 4), (4, 3)]
    parent: dict[int, int] = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in edges:
        if u != v:
            a, b = find(u), find(v)
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in list(parent)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_large_components_are_cut_where_buckets_are_apart(spark):
    """A chain of groups, each near the next only through its boilerplate: all links are found, and not all blocks meet."""
    import random

    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(5))
    texts, last = [], [word() for _ in range(40)]
    for _ in range(12):
        base = last[:22] + [word() for _ in range(18)]
        last = base[18:] + [word() for _ in range(18)]
        for _ in range(6):
            copy = list(base)
            copy[rng.randrange(40)] = word()
            texts.append(" ".join(copy))
    got = sorted(tuple(r) for r in near_dedup.near_dedup(make(spark, texts), block_texts=4).collect())
    assert got == sorted(brute_near(list(enumerate(texts))))


def test_units_between_blocks_count_no_pair_twice():
    import random

    from logstrata.llm.shingles import WordHashes

    rng = random.Random(2)
    base = [f"w{k}" for k in range(60)]
    texts = []
    for k in range(20):
        words = list(base)
        words[rng.randrange(60)] = f"x{k}"
        texts.append((k, 1 if rng.random() < 0.5 else 2, " ".join(words)))
    known, counts = WordHashes(), Counter()
    for i, j in ((1, 1), (1, 2), (2, 2)):
        for rid, n, root in zip(*near_dedup.verify_unit([t for t in texts if t[1] in (i, j)], i, j, known, 5, 0.8)):
            counts[rid] += int(n)
            assert root <= rid
    assert [(k, counts[k]) for k in range(20)] == [(k, n) for k, _, _, n in sorted(brute_near([(k, t) for k, _, t in texts]))]


def test_words_in_numpy_are_those_of_split(monkeypatch):
    import random

    from logstrata.llm import shingles

    monkeypatch.setattr(shingles, "PIECE", 40)
    rng, seen = random.Random(6), {}
    bits = ["a", "bc", "é", " ", "  ", "\n", "\t\x0b", "\x1c", "\x85", "\xa0", "wörd", "x" * 50, "y" * 5000]
    for _ in range(400):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 30)))
        raw = text.encode()
        hashes, starts, ends = shingles.word_hashes(raw)
        words = [raw[a:b] for a, b in zip(starts, ends)]
        assert words == shingles.split_words(text) and len(hashes) == len(words)
        for w, h in zip(words, hashes.tolist()):
            assert seen.setdefault(w, h) == h
        if len(words) >= 13:
            found = substring_dedup.Windows(text, 13, 4)
            found.mark_gaps()
            i = rng.randint(0, len(words) - 1)
            j = rng.randint(i + 1, len(words))
            assert found.words(i, j) == b" ".join(words[i:j])
    assert len(set(seen.values())) == len(seen)


def test_texts_of_one_word_take_bounded_segments(spark, monkeypatch):
    """A million equal words: no segment and no automaton as long as the text."""
    longest = []
    batch = substring_dedup._batch
    monkeypatch.setattr(substring_dedup, "_batch", lambda rows: longest.append(max(r[4] for r in rows)) or batch(rows))
    text = "same " * 1_000_000
    run = substring_dedup._segments(13, 4)
    import pyarrow as pa

    least = substring_dedup.Windows(text, 13, 4).least
    given = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), pa.array([text]), pa.array([[int(least[0])]], pa.list_(pa.int64())), pa.array([[]], pa.list_(pa.int64()))], names=["doc", "sum", "text", "minis", "crowded"])
    made = [b for b in run(iter([given]))]
    assert max(longest) <= substring_dedup.LONGEST and sum(sum(b.column("n").to_pylist()) for b in made) == 1_000_000 - 12
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.substring_dedup(make(spark, [text, "x " + text, "same " * 12, "same " * 20])).collect()}
    assert got == {0: (1_000_000, 0), 1: (1_000_001, 1_000_000), 2: (12, 0), 3: (20, 20)}


def test_segments_of_a_long_document_come_in_batches():
    """A worker holds a bounded part of a document's segments, however long the document and its words are."""
    import pyarrow as pa

    rng = random.Random(9)
    for text, most in ((" ".join(f"w{rng.randint(0, 10**9)}" for _ in range(40_000)), 40_000), (" ".join(f"{i}" * 4_000 for i in range(1_000)), 1_000)):
        minis = np.unique(substring_dedup.Windows(text, 13, 3).least).tolist()
        longs = pa.list_(pa.int64())
        given = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), pa.array([text]), pa.array([minis], longs), pa.array([minis], longs)], names=["doc", "sum", "text", "minis", "crowded"])
        made = list(substring_dedup._segments(13, 3)(iter([given])))
        assert [k for b in made for k in b.column("start").to_pylist()] == list(range(most - 12))
        assert max(b.num_rows for b in made) <= 5_000 and max(b.nbytes for b in made) < 10_000_000


def test_a_minimizer_of_few_long_documents_is_no_large_automaton(spark, monkeypatch):
    """All windows of three documents have one minimizer; no key holds more words than are allowed in an automaton, and spans stay right."""
    rng = random.Random(4)

    def text(n):
        return " ".join("alpha bravo gamma " + " ".join(rng.choice("abcdefgh") + rng.choice("ijklmnop") for _ in range(8)) for _ in range(n))

    texts = [text(6_000), text(6_000), text(3_000)]
    texts[2] += " " + " ".join(texts[0].split()[500:700])
    held = []
    written = substring_dedup.written

    def noted(df, label):
        out = written(df, label)
        if label == "segments":
            held.extend(r.words for r in out.groupBy("key").agg((F.sum("n") + 12 * F.count("*")).alias("words")).collect())
        return out

    monkeypatch.setattr(substring_dedup, "written", noted)
    got = sorted((tuple(r) for r in substring_dedup.substring_dedup(make(spark, texts)).collect()), key=key)
    assert got == sorted(brute_substring(list(enumerate(texts)), 13), key=key) and got[2][2] >= 200
    assert max(held) <= 160_000
