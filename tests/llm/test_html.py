import random

import numpy as np
import pytest
from samples import corpus

from logstrata.llm import html_extract as h

SCHEMA = "page_id long, url string, html string, text string, n_chars string"


def sample(n=120, seed=1):
    rng = random.Random(seed)
    texts = [t for t in corpus(20 + seed, n) if len(t) > 80]
    m = h.Material(texts, [" ".join(t.split()[:6]) for t in texts], [w for t in texts[:30] for w in t.split()[:3]], [" ".join(t.split()[:12]) for t in texts])
    return [h.compose(rng, m) for _ in range(n)]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(i, f"http://x/{i}", p, None, "7") for i, (p, _) in enumerate(sample())], SCHEMA)


@pytest.fixture(scope="module")
def model(pages):
    return h.train(pages)


def test_blocks_read_broken_markup():
    page = """<!DOCTYPE html><title>t</title><body><!-- <p>no</p> --><script>var t="</p><p>no";</script><style>p{}</style>
    <p title="a > b"><b>One &amp;&nbsp; two<br>three &#233;<p>four <a href='x>y'>five</a><ul><li>six<li>seven</ul> eight < 9 <table><tr><td>a<td>b</table>tail <unfinished"""
    assert [b.text for b in h.blocks(page)] == ["One & two three é", "four five", "six", "seven", "eight < 9", "a", "b", "tail <unfinished"]
    assert [b.linked for b in h.blocks(page)][1] == 4
    assert h.blocks(None) == h.blocks("") == h.blocks("<p> </p>") == []


def test_vectors_read_whole_blocks():
    start = "word " * 500
    vector = lambda end: h.vectors(h.blocks(f"<p>{start}{end}</p>"))[0]
    rng = random.Random(3)
    a, b = ("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(2))
    words = slice(2 * h.PATH_DIMS, 2 * h.PATH_DIMS + h.WORD_DIMS)
    assert not np.array_equal(vector(f"{a} " * 400)[words], vector(f"{b} " * 400)[words])
    plain, other = vector("word " * 500), vector("1,A2 " * 500)
    assert list(plain[-8:-5]) == [0, 0, 0] and np.allclose(other[-8:-5], [5000 / 4999, 1000 / 4999, 500 / 4999])


def test_long_pages_train_whole(spark, monkeypatch):
    long = "<article>" + "".join(f"<p>block {i}</p>" for i in range(1500)) + "</article>"
    seen = []
    monkeypatch.setattr(h.BlockLabeller, "loss_and_gradients", lambda self, pages, labels: (seen.append(list(map(len, pages))), (0.0, {k: np.zeros_like(v) for k, v in self.p.items()}))[1])
    h.train(spark.createDataFrame([(i, None, long, None, None) for i in range(8)], SCHEMA), composed=60)
    assert sum(batch.count(1500) for batch in seen) == 8 * 8 and sum(map(len, seen)) == 8 * 68  # pages in each of 8 epochs
    assert all(len(batch) * max(batch) <= 9_600 for batch in seen)
    few, one = h.BlockLabeller(), [np.zeros((n, h.FEATURES)) for n in (3, 12_000)]
    few.fit(one, [np.zeros(len(p)) for p in one], epochs=1)
    assert sorted(seen[-2:]) == [[3], [12_000]]


def test_gradients():
    rng = np.random.default_rng(2)
    pages, labels = [rng.normal(size=(n, h.FEATURES)) for n in (3, 5)], [np.array([1.0, 0, 1]), np.array([0, 1.0, 1, 0, 0])]
    model = h.BlockLabeller(hidden=4)
    _, g = model.loss_and_gradients(pages, labels)
    for k, v in model.p.items():
        for at in [tuple(rng.integers(0, n) for n in v.shape) for _ in range(4)]:
            was = v[at]
            v[at] = was + 1e-5
            up = model.loss_and_gradients(pages, labels)[0]
            v[at] = was - 1e-5
            down = model.loss_and_gradients(pages, labels)[0]
            v[at] = was
            assert abs((up - down) / 2e-5 - g[k][at]) < 1e-6


def test_held_out_pages(spark, model):
    held = sample(seed=2)
    df = spark.createDataFrame([(i, None, p, None, None) for i, (p, _) in enumerate(held)], SCHEMA)
    got = {r.page_id: r.text for r in h.extract(df, model).collect()}
    hit = found = wanted = 0
    for i, (page, main) in enumerate(held):
        want = [b.text for b, y in zip(h.blocks(page), h.labels_of(h.blocks(page), main)) if y]
        have = got[i].split("\n\n") if got[i] else []
        hit, found, wanted = hit + len(set(want) & set(have)), found + len(set(have)), wanted + len(set(want))
    assert hit / found > 0.95 and hit / wanted > 0.95


def test_awkward_pages(spark, model):
    long = "<article>" + "".join(f"<p>Paragraph {i} of a long article, with words in it.</p>" for i in range(3_000)) + "</article>"
    rows = [(1, "u", None, "x", "1"), (2, None, "", None, None), (None, "u", long, None, None), (3, "u", "no markup at all", None, None), (3, "u", "<" * 2_000 + '"', None, None), (3, "u", long, None, None)]
    got = h.extract(spark.createDataFrame(rows, SCHEMA), model).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert [r.text for r in got if r.page_id in (1, 2)] == ["", ""]
    assert sum(r.text.count("\n\n") == 2_999 for r in got) == 2
    assert h.extract(spark.createDataFrame([], SCHEMA)).count() == 0


def brute_chances(model, page):
    """Loop by loop: both directions over the blocks of one page, and the output."""
    import math

    p, h = {k: v.tolist() for k, v in model.p.items()}, model.hidden
    sig = lambda v: 1 / (1 + math.exp(-v))
    states = {}
    for d, order in (("f", range(len(page))), ("b", range(len(page) - 1, -1, -1))):
        state, cell = [0.0] * h, [0.0] * h
        for t in order:
            z = [c + sum(x * w[j] for x, w in zip(page[t].tolist(), p["W" + d])) + sum(s * r[j] for s, r in zip(state, p["R" + d])) for j, c in enumerate(p["c" + d])]
            cell = [sig(z[h + j]) * cell[j] + sig(z[j]) * math.tanh(z[3 * h + j]) for j in range(h)]
            state = [sig(z[2 * h + j]) * math.tanh(cell[j]) for j in range(h)]
            states[d, t] = state
    return [sig(p["oc"][0] + sum(a * b for a, b in zip(states["f", t] + states["b", t], p["o"]))) for t in range(len(page))]


def test_labeller_matches_brute_force(model):
    pages = [h.blocks(p) for p, _ in sample(6, seed=4)] + [h.blocks("alone")]
    for page, chances in zip(pages, model.predict([h.vectors(p) for p in pages])):
        want = brute_chances(model, h.vectors(page))
        assert np.allclose(chances, want) and np.allclose(model.predict_long(page, chunk=3), want)


HAND_WRITTEN = [
    (
        """<!doctype html><html lang=en><head><title>River walks</title><style>p{margin:0}</style></head><body>
        <header class="site-header"><a href="/">The Valley Post</a><nav><ul><li><a href="/n">News</a></li><li><a href="/s">Sport</a></li></ul></nav></header>
        <article><h1>River walks reopen after the flood</h1><p>The paths along the river reopened on Monday, three months after
        the flood that washed away two footbridges &amp; most of the lower bank.</p><p>Volunteers from the town cleared the last of the debris over the weekend, and the council has promised new benches.</p></article>
        <aside class="sidebar"><h3>Most read</h3><ul><li><a href="/1">Bakery closes</a></li><li><a href="/2">New bus times</a></li></ul></aside>
        <footer><p>&copy; The Valley Post</p></footer></body></html>""",
        ["River walks reopen after the flood", "The paths along the river reopened on Monday, three months after the flood that washed away two footbridges & most of the lower bank.", "Volunteers from the town cleared the last of the debris over the weekend, and the council has promised new benches."],
    ),
    (
        """<html><body><div class="cookie-notice">We use cookies. <button>OK</button></div><div id="menu"><ul><li><a href=/a>Home</a><li><a href=/b>Recipes</a></ul></div>
        <div class="post-body"><h2>Bread without kneading</h2><p>Mix the flour, the water and the salt, and leave the dough alone for a night.<p>In the morning fold it twice and let it rest while the oven gets hot.
        <blockquote><p>Time does the work that hands would do.</p></blockquote></div>
        <div class="comments"><h3>2 comments</h3><div class="comment"><p>Mine came out flat, what did I do wrong?</p></div><div class="comment"><p>Lovely crust, thank you!</p></div></div>
        <div class="footer">Imprint &middot; Contact</div>""",
        ["Bread without kneading", "Mix the flour, the water and the salt, and leave the dough alone for a night.", "In the morning fold it twice and let it rest while the oven gets hot.", "Time does the work that hands would do."],
    ),
    (
        """<body><nav><a href=1>One</a> <a href=2>Two</a></nav><main><h1>Counting birds</h1><script>track("<p>x</p>")</script><p>Every winter the same ten people count birds in the same ten gardens.</p>
        <div class="ad"><p>Buy a better pair of binoculars today.</p></div><p>The count has shown fewer sparrows and more crows, year after year.</p></main>
        <form><label>E-mail</label><input name=e><button>Subscribe</button></form><footer>All rights reserved</footer></body>""",
        ["Counting birds", "Every winter the same ten people count birds in the same ten gardens.", "The count has shown fewer sparrows and more crows, year after year."],
    ),
]


def test_hand_written_pages(spark, model):
    df = spark.createDataFrame([(i, None, p, None, None) for i, (p, _) in enumerate(HAND_WRITTEN)], SCHEMA)
    got = {r.page_id: r.text for r in h.extract(df, model).collect()}
    assert [got[i].split("\n\n") for i in range(len(HAND_WRITTEN))] == [want for _, want in HAND_WRITTEN]


def test_hostile_pages_take_time_in_proportion(model):
    import time

    deep = "".join(f"<div class=a{i % 7}><span>x{i}" for i in range(50_000))
    unmatched = "<div>" * 50_000 + "</b></em>x" * 50_000
    items = "<ul>" + "<div>" * 30_000 + "<li>a</li>" * 30_000
    spans = "<span>" * 30_000 + "<p>t" * 30_000
    many = "<article>" + "<p>word and word.</p>" * 100_000 + "</article>"
    for page, n in ((deep, 50_000), (unmatched, 50_000), (items, 30_000), (spans, 30_000), (many, 100_000)):
        began = time.process_time()
        found = h.blocks(page)
        assert len(found) in (n, 1) and time.process_time() - began < 15
    assert len(found) == 100_000
    chances = model.predict_long(found)
    assert len(chances) == 100_000 and chances.mean() > 0.9


def test_sample_of_pages_is_settled_without_their_texts(spark):
    """Ids that repeat, null ids and equal rows: the same pages come in any order, each once."""
    rows = [(k % 5 if k % 7 else None, None, f"<article><p>page {k % 11} has words.</p></article>", None, None) for k in range(60)]
    one = h.train(spark.createDataFrame(rows, SCHEMA), composed=4)
    two = h.train(spark.createDataFrame(rows[::-1], SCHEMA).repartition(5), composed=4)
    assert all(np.array_equal(one.p[k], two.p[k]) for k in one.p)
