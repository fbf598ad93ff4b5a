import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
from samples import corpus, make
from tokenizers import Tokenizer

from logstrata.llm import mixing, packing, token_counts
from logstrata.llm.queries import tokenizer_file

WORDS, BYTES = tokenizer_file("word_bpe_49k.json"), tokenizer_file("byte_bpe_50k.json")
ODD_TEXTS = ["a  b", "a \n b", "<|endoftext|> x <|startoftext|>", "it's  DON'T x  ", "İstanbul ẞ Ωσς ǅ", "é å", "日本 語 テスト 12½ ٣", "a\x1cb \x85 c\x1f", "x　y  z\n\n", "\t a", "'s 're it'S", " ́x", "<|endoftext| >"]


# packing


def check_packing(got, docs, capacity=4096):
    t = Tokenizer.from_file(WORDS)
    want = Counter()
    for d, text in docs:
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), capacity):
            part = ids[k : k + capacity]
            want[d, k // capacity, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for p in places.values():
        end = 0
        for at, n in sorted(p):
            assert at == end
            end += n
        assert end <= capacity
    return len(places)


def test_packing_round_trip(spark):
    texts = corpus(5) + ODD_TEXTS + [None, ""]
    sequences = check_packing(packing.pack(make(spark, texts), WORDS, capacity=64).collect(), list(enumerate(texts)), 64)
    ids = [len(Tokenizer.from_file(WORDS).encode(t or "", add_special_tokens=False).ids) + 1 for t in texts]
    assert sequences <= 1.03 * -(-sum(ids) // 64) + 1


def test_packing_awkward(odd, none, awkward):
    check_packing(packing.pack(odd, WORDS).collect(), [r[:2] for r in awkward[0]])
    assert packing.pack(none, WORDS).count() == 0


def test_encoders_match_the_library_on_awkward_pieces():
    rng = random.Random(17)
    bits = [*ODD_TEXTS, "a", "B", "é", "É", "ß", "İ", "ʼ", "'s", "'LL", "’", "…", " ", "  ", "\t", "\n\n", "\r", "\x0b", "\x1c", "\x00", "\x85", "\xa0", "\u2003", "<|endoftext|>", "<|", "|>", "12", "४", "!?", "--", "日本", "и", "\u0301", "ﬁ", "½", "x" * 70, "the ", "Words", "don't", "😀", "\u2028", "‐"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(4_000)]
    ids, counts = packing.TextIds(WORDS).encode, token_counts.counter(BYTES, token_counts.proven_whole_tokens(token_counts.plain_tokenizer(BYTES)))
    for text, a, b in zip(texts, Tokenizer.from_file(WORDS).encode_batch(texts, add_special_tokens=False), Tokenizer.from_file(BYTES).encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(ids(text), "<u4").tolist() == a.ids and counts(text) == len(b.ids), repr(text)


def test_remembered_keys_stay_within_their_bound():
    from logstrata.llm.workers import Recent

    made = Counter()
    table = Recent(lambda k: made.update([k]) or k * 2, 10)
    for k in range(1_000):
        assert table[k] == 2 * k and table[-1] == -2 and len(table) <= 10 and len(table.older) <= 10
    assert made[-1] == 1 and max(made.values()) == 1


def test_plan_is_best_fit_decreasing_in_number_of_sequences():
    rng = random.Random(2)
    for _ in range(200):
        h = {rng.randint(1, 50): rng.randint(1, 9) for _ in range(rng.randint(1, 20))}
        room = []
        for length in sorted((k for k, n in h.items() for _ in range(n)), reverse=True):
            fit = min((r for r in room if r >= length), default=None)
            if fit is None:
                room.append(64 - length)
            else:
                room[room.index(fit)] -= length
        steps = packing.plan(h, 64)
        used = {s.sequence + i // s.each for s in steps for i in range(s.count)}
        assert len(used) <= len(room) + 1
        assert sum(s.count for s in steps) == sum(h.values())


# token counts


def test_counts_match_the_library(spark):
    texts = corpus(6) + ODD_TEXTS + [None, ""]
    t = Tokenizer.from_file(BYTES)
    got = {r.doc_id: r for r in token_counts.count_tokens(make(spark, texts), BYTES).collect()}
    for i, text in enumerate(texts):
        n = len(t.encode(text or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((text or "").encode()), n > 512)


def test_proof_holds_one_by_one():
    t = Tokenizer.from_file(BYTES)
    whole = sorted(token_counts.proven_whole_tokens(t))
    assert len(whole) > 40_000
    assert all(len(t.encode(w, add_special_tokens=False).ids) == 1 for w in random.Random(1).sample(whole, 500))


def test_counts_awkward(odd, none, awkward):
    t = Tokenizer.from_file(BYTES)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens) for r in token_counts.count_tokens(odd, BYTES).collect())
    assert got == sorted((d is None, d or 0, len(t.encode(x or "", add_special_tokens=False).ids)) for d, x in (r[:2] for r in awkward[0]))
    assert token_counts.count_tokens(none, BYTES).count() == 0


# mixing


def brute_targets(sizes, weights=(5, 2, 1), cap=3):
    """sizes by source -> targets, in fractions."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = Fraction(sum(sizes.values())), set(names), {}
    while open_:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        full = [s for s in open_ if share[s] > cap * sizes[s]]
        if not full:
            out |= share
            break
        for s in full:
            out[s] = Fraction(cap * sizes[s])
            left -= out[s]
            open_.remove(s)
    return out


def brute_apportion(votes, seats):
    got = dict.fromkeys(votes, 0)
    for _ in range(seats):
        best = max(votes, key=lambda s: (Fraction(votes[s]) / (2 * got[s] + 1), -s))
        got[best] += 1
    return got


def test_apportionment_by_highest_quotients(spark):
    from pyspark.sql import functions as F

    rng = random.Random(3)
    rows, want = [], {}
    for g in range(25):
        votes = {p: rng.choice([0, 1, 1, 2, 7, rng.randint(1, 1000)]) for p in range(rng.randint(1, 12))}
        seats = rng.randint(0, 60) if sum(votes.values()) else 0
        want |= {(g, p): n for p, n in brute_apportion(votes, seats).items() if votes[p]}
        rows += [(g, p, v, seats) for p, v in votes.items()]
    df = spark.createDataFrame(rows, "g long, p long, v long, s long")
    assert {(r.g, r.p): r.seats for r in mixing.apportion(df, ["g"], "p", "v", F.col("s")).collect()} == want


def test_mix_meets_targets(spark):
    rng = random.Random(4)
    sources = ["a", "b", "", None, "zz", "ä", "B"]
    rows = [(i, " ".join("w" * rng.choice([0, 1, 5, 80, 400]) for _ in range(1)) if 0 else " ".join(["w"] * rng.choice([0, 1, 5, 80, 400])), "en", rng.choice(sources[:2] * 9 + sources), 0) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = mixing.mix(df, shard_words=3_000).collect()
    sizes, taken = Counter(), Counter()
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r.size and r.run_start + r.run_words <= r.size and r.taken == r.passes * r.size + r.run_words
    for s, t in brute_targets(sizes).items():
        assert {r.target for r in got if r.source == s} == {next(r.target for r in got if r.source == s)}
        target = next(r.target for r in got if r.source == s)
        assert abs(target - float(t)) < 1e-6 * max(1, target)
        assert abs(taken[s] - target) <= 0.02 * target + 64
    again = mixing.mix(df.repartition(7), shard_words=3_000).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    words = Counter()
    for r in mixing.taken_documents(df, shard_words=3_000).collect():
        words[r.doc_id] += len(r.text.split())
    assert words == Counter({r.doc_id: r.taken for r in got if r.taken})


def test_mix_awkward(odd, none, awkward):
    got = mixing.mix(odd).collect()
    assert len(got) == len(awkward[0]) and all(r.taken <= 3 * r.size for r in got)
    assert mixing.mix(none).count() == 0
    kept = mixing.taken_documents(odd)
    assert kept.columns == odd.columns
    assert sum(len(r.text.encode().split()) for r in kept.collect()) == sum(r.taken for r in got)
