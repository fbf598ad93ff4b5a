"""Main text of web pages: a recurrent block labeller in numpy.

A page becomes the sequence of its leaf blocks. Each block is a vector: hashed tags
and class words of its path, hashed words of its text, and a few shares. A
bidirectional LSTM reads the sequence, so each block is judged with the whole page
around it, and a logistic layer says whether it belongs to the article.

There are no labelled pages. Training material is a bounded sample of the pages themselves
(``MOST_PAGES`` of those of at most ``MOST_CHARS`` characters, with the least hash of
page_id), labelled where the markup says so (article or main elements against menus
and the like), and pages composed from the sample's blocks in varied layouts,
whose labels are known by construction. Extraction reads every whole page, in time in
proportion to its length however deep its elements nest: what a block needs of its path is
kept with each open element, made from that of the element around it.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workers import STEP, lean

MOST_PAGES, MOST_CHARS, COMPOSED = 300, 100_000, 800
PATH_DIMS, WORD_DIMS, HIDDEN = 64, 24, 20

# A tag with its attributes (quoted values may hold ">"), a comment, or a declaration.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[/!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
_NAMES = re.compile(r"(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "noscript", "template", "svg", "iframe", "object", "math")}

# Elements that end a block, elements without content, and which open element each start tag closes.
BLOCK = set("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol optgroup option p pre search section select summary table tbody td textarea tfoot th thead title tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head", "title"}}
_BOUNDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}, "body": set()}


#: What a tag counts for from one element to the one within it.
FADE = 0.8


class Open:
    """An open element, with what its path from the root comes to."""

    __slots__ = ("tag", "path", "told", "head", "heading")

    def __init__(self, tag: str, names: tuple[str, ...], around: Open | None):
        self.tag = tag
        self.path = path = np.zeros(2 * PATH_DIMS, np.float32) if around is None else around.path.copy()
        path[:PATH_DIMS] *= FADE
        k, s = _slot("t:" + tag, PATH_DIMS)
        path[k] += s
        for name in names:
            k, s = _slot("n:" + name, PATH_DIMS)
            path[PATH_DIMS + k] += s
        self.told = told(tag, names, around.told if around else None)
        self.head = tag in ("head", "title") or around is not None and around.head
        self.heading = tag[0] == "h" and tag[1:].isdigit() or around is not None and around.heading


class Block:
    """A leaf block: its text, the element it stands in (None at the root), and how many of its characters are links."""

    __slots__ = ("text", "within", "linked")

    def __init__(self, text: str, within: Open | None, linked: int = 0):
        self.text, self.within, self.linked = text, within, linked


class _Stack:
    """The open elements, and where in the stack those of each tag stand."""

    def __init__(self):
        self.open: list[Open] = []
        self.at: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def push(self, tag: str, names: tuple[str, ...]) -> None:
        k = len(self.open)
        self.open.append(Open(tag, names, self.open[-1] if k else None))
        self.at.setdefault(tag, []).append(k)
        if tag in BLOCK:
            self.blocks.append(k)

    def top(self, tag: str) -> int:
        found = self.at.get(tag)
        return found[-1] if found else -1

    def cut(self, k: int) -> None:
        """Closes the element at ``k`` and all within it."""
        for element in reversed(self.open[k:]):
            self.at[element.tag].pop()
        del self.open[k:]
        while self.blocks and self.blocks[-1] >= k:
            self.blocks.pop()

    def make_room(self, tag: str) -> None:
        """Closes what the start of a block element closes: an open paragraph, and items of its own kind."""
        closes = CLOSES.get(tag, ())
        for k in reversed(self.blocks):
            if self.open[k].tag == "p":  # any block ends a paragraph
                self.cut(k)
                break
            if self.open[k].tag not in closes:
                break
        if closes:
            k = max(map(self.top, closes))
            if k >= 0 and k > max(map(self.top, _BOUNDS[tag]), default=-1):
                self.cut(k)


def blocks(page: str | None) -> list[Block]:
    """The leaf blocks of a page in order: no empty ones, white space as single spaces, references decoded."""
    page = page or ""
    out: list[Block] = []
    stack = _Stack()
    parts: list[str] = []
    linked = at = 0

    def close() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            within = stack.open[-1] if stack.open else None
            if text and not (within and within.head):
                out.append(Block(text, within, min(linked, len(text))))
            parts.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            parts.append(raw)
            if stack.top("a") >= 0:
                linked += len(raw.strip())

    while True:
        m = _TOKEN.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        end, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if end:
            if tag in BLOCK:
                close()
            if (k := stack.top(tag)) >= 0:
                stack.cut(k)
            continue
        if tag in _RAW:
            if not attributes.rstrip().endswith("/"):
                e = _RAW[tag].search(page, at)
                at = e.end() if e else len(page)
            continue
        if tag in BLOCK:
            close()
            stack.make_room(tag)
        elif tag == "br":
            parts.append(" ")
        if tag not in VOID:
            names = [n for g in _NAMES.findall(attributes) for n in g if n] if attributes else []
            stack.push(tag, tuple(p.lower() for n in names for p in _PARTS.findall(n)))
    close()
    return out


@lru_cache(maxsize=4_096)
def _slot(token: str, dims: int) -> tuple[int, float]:
    h = zlib.crc32(token.encode())
    return h % dims, 1.0 if h >> 16 & 1 else -1.0


FEATURES = 2 * PATH_DIMS + WORD_DIMS + 10
#: Blocks of a page whose vectors stand in memory at one time.
CHUNK = 4_096


def vectors(page: list[Block], lo: int = 0, hi: int | None = None, starts: np.ndarray | None = None) -> np.ndarray:
    """A row for each block of page[lo:hi], of all its words and characters. ``starts``: :func:`text_starts` of the page."""
    starts = text_starts(page) if starts is None else starts
    hi = len(page) if hi is None else hi
    out = np.zeros((hi - lo, FEATURES), np.float32)
    total = int(starts[-1]) or 1
    for x, i in zip(out, range(lo, hi)):
        b = page[i]
        n = len(b.text)
        if b.within is not None:
            x[: 2 * PATH_DIMS] = b.within.path
        words = b.text.split()
        for w in words:
            k, s = _slot("w:" + w.lower(), WORD_DIMS)
            x[2 * PATH_DIMS + k] += s / len(words)
        x[-10:] = (
            np.log1p(n) / 5, b.linked / n, sum(c in ".,;!?" for c in b.text) / n * 10, sum(c.isdigit() for c in b.text) / n, sum(c.isupper() for c in b.text) / n,
            b.text[-1] in ".!?…\"”»", i / len(page), starts[i] / total, min(1.0, np.log1p(len(page)) / 5), n / total,
        )
    return out


def text_starts(page: list[Block]) -> np.ndarray:
    """How many characters of text stand before each block, and at the end all of them."""
    return np.cumsum([0, *(len(b.text) for b in page)])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class BlockLabeller:
    """Bidirectional LSTM over block vectors, a logistic output for each block. Pages in a batch are padded at the end."""

    def __init__(self, hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        self.p: dict[str, np.ndarray] = {"o": rng.normal(0, hidden**-0.5, 2 * hidden), "oc": np.zeros(1)}
        for d in "fb":
            self.p["W" + d] = rng.normal(0, FEATURES**-0.5, (FEATURES, 4 * hidden))
            self.p["R" + d] = rng.normal(0, hidden**-0.5, (hidden, 4 * hidden))
            self.p["c" + d] = np.r_[np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)]

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str):
        """The states of one direction, and what backpropagation needs of each step."""
        steps, many, h = x.shape[0], x.shape[1], self.hidden
        pre = x @ self.p["W" + d] + self.p["c" + d]
        state, cell = np.zeros((many, h)), np.zeros((many, h))
        out, kept = np.zeros((steps, many, h)), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = pre[t] + state @ self.p["R" + d]
            i, f, o, g = _sigmoid(z[:, :h]), _sigmoid(z[:, h : 2 * h]), _sigmoid(z[:, 2 * h : 3 * h]), np.tanh(z[:, 3 * h :])
            after = f * cell + i * g
            tanh = np.tanh(after)
            kept.append((t, state, cell, i, f, o, g, tanh))
            m = mask[t][:, None]
            state, cell = m * (o * tanh) + (1 - m) * state, m * after + (1 - m) * cell
            out[t] = state
        return out, kept

    def _back(self, x, mask, d, kept, dout, grads):
        h = self.hidden
        ds, dc = np.zeros(dout.shape[1:]), np.zeros(dout.shape[1:])
        dz = np.zeros((*dout.shape[:2], 4 * h))
        for t, state, cell, i, f, o, g, tanh in reversed(kept):
            m = mask[t][:, None]
            ds = ds + dout[t]
            inner, dcell = m * ds, m * dc
            dcell = dcell + inner * o * (1 - tanh * tanh)
            z = np.concatenate([dcell * g * i * (1 - i), dcell * cell * f * (1 - f), inner * tanh * o * (1 - o), dcell * i * (1 - g * g)], axis=1)
            dz[t] = z
            grads["R" + d] += state.T @ z
            ds, dc = (1 - m) * ds + z @ self.p["R" + d].T, (1 - m) * dc + dcell * f
        grads["W" + d] += np.einsum("tbi,tbj->ij", x, dz, optimize=True)
        grads["c" + d] += dz.sum(axis=(0, 1))

    @staticmethod
    def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        x = np.zeros((max(map(len, pages)), len(pages), FEATURES))
        mask = np.zeros(x.shape[:2])
        for k, p in enumerate(pages):
            x[: len(p), k], mask[: len(p), k] = p, 1
        return x, mask

    def _votes(self, x: np.ndarray, mask: np.ndarray, d: str, state: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What one direction adds to the output of each block, and its last state and cell. Keeps nothing of a step."""
        h, o = self.hidden, self.p["o"][: self.hidden] if d == "f" else self.p["o"][self.hidden :]
        pre = x @ self.p["W" + d] + self.p["c" + d]
        out = np.zeros(mask.shape)
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            z = pre[t] + state @ self.p["R" + d]
            gates = _sigmoid(z[:, : 3 * h])
            after = gates[:, h : 2 * h] * cell + gates[:, :h] * np.tanh(z[:, 3 * h :])
            m = mask[t][:, None]
            state, cell = m * (gates[:, 2 * h :] * np.tanh(after)) + (1 - m) * state, m * after + (1 - m) * cell
            out[t] = state @ o
        return out, state, cell

    def predict(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Chances for the blocks of each page; pages have at least one block."""
        x, mask = self.padded(pages)
        zero = np.zeros((len(pages), self.hidden))
        s = _sigmoid(self._votes(x, mask, "f", zero, zero)[0] + self._votes(x, mask, "b", zero, zero)[0] + self.p["oc"])
        return [s[: len(p), k] for k, p in enumerate(pages)]

    def predict_long(self, page: list[Block], chunk: int = CHUNK) -> np.ndarray:
        """Chances for the blocks of one page of any length: its vectors are made chunk by chunk, on the way there and on the way back."""
        starts, total = text_starts(page), np.zeros(len(page))
        cuts = [(lo, min(lo + chunk, len(page))) for lo in range(0, len(page), chunk)]
        for d, order in (("f", cuts), ("b", cuts[::-1])):
            state = cell = np.zeros((1, self.hidden))
            for lo, hi in order:
                x = vectors(page, lo, hi, starts).astype(float)[:, None]
                votes, state, cell = self._votes(x, np.ones((hi - lo, 1)), d, state, cell)
                total[lo:hi] += votes[:, 0]
        return _sigmoid(total + self.p["oc"])

    def loss_and_gradients(self, pages: list[np.ndarray], labels: list[np.ndarray]) -> tuple[float, dict[str, np.ndarray]]:
        x, mask = self.padded(pages)
        y = np.zeros(mask.shape)
        for k, v in enumerate(labels):
            y[: len(v), k] = v
        (f, kf), (b, kb) = self._run(x, mask, "f"), self._run(x, mask, "b")
        both = np.concatenate([f, b], axis=2)
        s = _sigmoid(both @ self.p["o"] + self.p["oc"])
        total = mask.sum()
        loss = float(-(mask * (y * np.log(s + 1e-12) + (1 - y) * np.log(1 - s + 1e-12))).sum() / total)
        d = mask * (s - y) / total
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["o"], g["oc"] = np.einsum("tb,tbi->i", d, both), np.array([d.sum()])
        dboth = d[:, :, None] * self.p["o"]
        self._back(x, mask, "f", kf, dboth[:, :, : self.hidden], g)
        self._back(x, mask, "b", kb, dboth[:, :, self.hidden :], g)
        return loss, g

    def fit(self, pages: list[np.ndarray], labels: list[np.ndarray], epochs: int = 8, batch: int = 24, rate: float = 8e-3, seed: int = 1, padded: int = 9_600) -> BlockLabeller:
        """Trains on all of ``pages``, each whole. A batch has at most ``batch`` pages and, unless it is one page, ``padded`` blocks with its padding."""
        rng = np.random.default_rng(seed)
        m, s, t = {k: np.zeros_like(v) for k, v in self.p.items()}, {k: np.zeros_like(v) for k, v in self.p.items()}, 0
        order = sorted(range(len(pages)), key=lambda i: len(pages[i]))  # pages of like length share a batch
        batches: list[list[int]] = []
        for i in order:
            if not batches or len(batches[-1]) == batch or (len(batches[-1]) + 1) * len(pages[i]) > padded:
                batches.append([])
            batches[-1].append(i)
        steps = epochs * len(batches)
        for _ in range(epochs):
            for k in rng.permutation(len(batches)):
                _, g = self.loss_and_gradients([pages[i] for i in batches[k]], [labels[i] for i in batches[k]])
                norm = np.sqrt(sum((v**2).sum() for v in g.values()))
                t += 1
                for name, v in self.p.items():
                    grad = g[name] * min(1.0, 2.0 / (norm + 1e-9)) + 1e-5 * v
                    m[name] = 0.9 * m[name] + 0.1 * grad
                    s[name] = 0.99 * s[name] + 0.01 * grad**2
                    self.p[name] = v - rate * (1 - t / (steps + 1)) * (m[name] / (1 - 0.9**t)) / (np.sqrt(s[name] / (1 - 0.99**t)) + 1e-8)
        return self


# What markup says outright. Class words are compared whole.
MAIN_TAGS, MAIN_NAMES = {"article", "main"}, {"article", "main", "content", "post", "entry", "story"}
OTHER_TAGS = set("nav header footer aside form button select option label menu dialog textarea fieldset".split())
OTHER_NAMES = set("ad ads advert advertisement banner breadcrumb breadcrumbs comment comments cookie copyright disclaimer footer header login menu modal nav navbar navigation newsletter notice pager pagination popup promo promoted related reply replies respond search share sharing sidebar signup social sponsor sponsored subscribe tags toolbar widget".split())


def told(tag: str, names: tuple[str, ...], around: bool | None) -> bool | None:
    """What markup says of an element within one of which it says ``around``: main text (True), something else (False, with all within it), or nothing (None)."""
    if around is False or tag in OTHER_TAGS and not (tag == "header" and around):
        return False
    if tag not in ("html", "body") and any(n in OTHER_NAMES for n in names):
        return False
    return True if tag in MAIN_TAGS else around


def said(block: Block) -> bool | None:
    """Whether the markup calls a block main text (True) or something else (False); None where it says nothing."""
    return block.within.told if block.within else None


def weak_labels(page: list[Block]) -> np.ndarray | None:
    """Labels of a page that has an article or main element; None for others."""
    marks = [said(b) for b in page]
    return np.array([m is True for m in marks], float) if any(marks) else None


@dataclass
class Material:
    """Block texts of the sample, for composed pages."""

    prose: list[str] = field(default_factory=list)
    titles: list[str] = field(default_factory=list)
    links: list[str] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)


def material(pages: list[list[Block]]) -> Material:
    out = Material()
    for page in pages:
        for b in page:
            heading, paragraph = (b.within.heading, b.within.tag == "p") if b.within else (False, False)
            kind = out.titles if heading else out.links if b.linked * 2 > len(b.text) else out.prose if len(b.text) > 60 or paragraph else out.notes
            kind.append(b.text)
    fill = ["Read more", "The day was long and the road went on.", "Home", "About us"]
    for name in ("prose", "titles", "links", "notes"):
        setattr(out, name, getattr(out, name) or fill)
    return out


def compose(rng: random.Random, m: Material) -> tuple[str, list[str]]:
    """A page in a random layout and the blocks of its article, in order."""
    esc = html.escape
    pick = lambda kind: rng.choice(kind)
    some = lambda *x: rng.choice(x)
    main: list[str] = []

    def attribute(*names: str) -> str:
        if rng.random() < 0.12:
            return ""
        name = some(*names)
        name = some(name, name, f"{name}-{some('wrap', 'inner', 'box', 'area', 'block', '1')}", f"{some('site', 'page', 'c', 'js')}-{name}")
        return f" {some('class', 'class', 'id')}={name}" if rng.random() < 0.1 else f' {some("class", "class", "id")}="{name}"'

    def snippet() -> str:
        return " ".join(pick(m.prose).split()[: rng.randint(2, 25)])

    def links(n: int) -> str:
        return "".join(f'<li><a href="/{i}">{esc(pick(m.links))}</a></li>' for i in range(n))

    def menu() -> str:
        return some(f"<nav{attribute('nav', 'menu', 'main-menu')}><ul>{links(rng.randint(2, 9))}</ul></nav>", f"<nav><ul>{links(rng.randint(2, 9))}</ul></nav>", f'<div class="{some("menu", "navbar", "topnav", "navigation")}"><ul>{links(rng.randint(3, 8))}</ul></div>')

    def advert() -> str:
        tag = some("div", "div", "aside", "section")
        return f'<{tag} class="{some("ad", "ads", "advert", "advertisement", "banner", "promo", "sponsored", "ad-slot")}">{some("", "<p>")}{esc(some(snippet(), pick(m.notes)))}</{tag}>'

    def notice() -> str:
        tag = some("div", "div", "section", "aside", "p")
        return f'<{tag} class="{some("cookie", "cookie-notice", "notice", "consent", "gdpr-banner", "alert", "popup", "modal", "warning")}">{esc(some("We use cookies to improve this site.", "Please accept our terms.", "This site uses cookies.", "Subscribe to continue reading.", snippet(), snippet()))}{some("", "<button>OK</button>", "<button>Accept</button>")}</{tag}>'

    def sidebar() -> str:
        tag, name = some(("aside", ""), ("aside", ' class="sidebar"'), ("div", ' class="sidebar"'), ("div", ' id="sidebar"'), ("div", ' class="widget"'), ("section", ' class="related"'), ("div", ' class="related-posts"'))
        inner = "".join(some(f"<h3>{esc(pick(m.titles))}</h3>", f"<p>{esc(snippet())}</p>", f"<ul>{links(rng.randint(1, 5))}</ul>", f"<p>{esc(pick(m.prose))}</p>") for _ in range(rng.randint(1, 4)))
        return f"<{tag}{name}>{inner}</{tag}>"

    def comments() -> str:
        tag = some("section", "div", "div", "ol")
        item = lambda: f'<{"li" if tag == "ol" else "div"} class="{some("comment", "comment-body", "reply", "user-comment")}">{some("", f"<span>{esc(pick(m.links))}</span> ", f"<b>{esc(pick(m.links))}</b>")}<p>{esc(some(snippet(), pick(m.prose)))}</p></{"li" if tag == "ol" else "div"}>'
        return f'<{tag} {some("class", "id")}="{some("comments", "comment-list", "responses", "discussion", "disqus")}">{some("", "<h3>Comments</h3>", f"<h2>{rng.randint(1, 90)} comments</h2>")}{"".join(item() for _ in range(rng.randint(1, 5)))}</{tag}>'

    def form() -> str:
        return f'<form{attribute("search", "newsletter", "signup", "login", "contact")}>{some("", f"<p>{esc(snippet())}</p>")}<label>{some("E-mail", "Name", "Search", "Your message")}</label><input name=q>{some("", "<select><option>1</option><option>2</option></select>")}<button>{some("Send", "Go", "Sign up", "Search")}</button></form>'

    def share() -> str:
        return f'<div class="{some("share", "social", "sharing", "share-buttons", "tags", "breadcrumb", "breadcrumbs", "pagination", "byline-links")}">{some("", "Share: ")}<a href=#>{some("Twitter", "Facebook", "Print", "Home")}</a> <a href=#>{esc(pick(m.links))}</a></div>'

    def text(tag: str, kind: list[str]) -> str:
        words = pick(kind)
        main.append(" ".join(words.split()))
        raw = esc(words)
        if rng.random() < 0.15:
            raw = f"<b>{raw}</b>"
        return f"<{tag}>{raw}" + ("" if tag in ("p", "li") and rng.random() < 0.1 else f"</{tag}>")

    def article() -> str:
        inner = [text(some("h1", "h1", "h2"), m.titles)] if rng.random() < 0.85 else []
        for _ in range(rng.choice([1, 2, 3, 4, 6, 9, 14, 14, 60])):
            r = rng.random()
            if r < 0.78:
                inner.append(text("p", m.prose) if rng.random() < 0.9 else text("p", m.notes))
            elif r < 0.83:
                inner.append(text(some("h2", "h3"), m.titles))
            elif r < 0.87:
                inner.append("<ul>" + "".join(text("li", some(m.prose, m.notes)) for _ in range(rng.randint(1, 4))) + "</ul>")
            elif r < 0.9:
                inner.append("<blockquote>" + text("p", m.prose) + "</blockquote>")
            elif r < 0.93:
                inner.append("<table><tr>" + text("td", m.notes) + text("td", m.notes) + "</tr></table>")
            else:
                inner.append(some(advert, share, form, notice, sidebar)())
        if rng.random() < 0.12:
            inner.append(comments())
        plain = "".join(inner)
        frame = rng.random()
        if frame < 0.5:
            return f"<article{attribute('post', 'entry', 'story') if rng.random() < 0.3 else ''}>{plain}</article>"
        if frame < 0.62:
            return f"<main>{plain}</main>"
        if frame < 0.7:
            return f"<main><article>{plain}</article></main>"
        name = some("content", "post", "entry-content", "article-body", "story", "main-content", "post-body", "text", "article", "body-text", "page-content")
        return f'<{(t := some("div", "div", "section", "td"))} {some("class", "id")}="{name}">{plain}</{t}>'

    def header() -> str:
        return some(f"<header{attribute('header', 'masthead', 'site-header')}>{some('<h1>', '<p>', '<div>')}{esc(pick(m.titles))}</header>", f'<div class="{some("header", "top", "masthead", "logo")}"><a href=/>{esc(pick(m.links))}</a> {esc(snippet())}</div>')

    def footer() -> str:
        inner = some(f"&copy; {some('example.com', '2020 Example', 'site')} &middot; {esc(snippet())}", f"<p>{esc(snippet())}</p><ul>{links(3)}</ul>", f"<ul>{links(rng.randint(2, 6))}</ul>", esc(pick(m.prose)))
        return some(f"<footer>{inner}</footer>", f"<footer{attribute('footer', 'site-footer')}>{inner}</footer>", f'<div class="{some("footer", "bottom", "copyright", "site-footer")}">{inner}</div>')

    before = [f() for f, chance in ((notice, 0.3), (header, 0.4), (menu, 0.85), (share, 0.15), (advert, 0.5), (form, 0.2), (sidebar, 0.25)) if rng.random() < chance]
    rng.shuffle(before)
    body = article()
    after = [f() for f, chance in ((sidebar, 0.35), (share, 0.25), (comments, 0.45), (form, 0.25), (advert, 0.3), (menu, 0.15), (notice, 0.2)) if rng.random() < chance]
    rng.shuffle(after)
    whole = "".join(before) + body + "".join(after) + (footer() if rng.random() < 0.9 else "")
    if rng.random() < 0.3:
        whole = f'<div class="{some("wrapper", "container", "page", "site")}">{whole}</div>'
    return f"<!DOCTYPE html><html><head><title>{esc(pick(m.titles))}</title></head><body>{whole}" + ("</body></html>" if rng.random() < 0.8 else ""), main


def labels_of(page: list[Block], main: list[str]) -> np.ndarray:
    """Which blocks of a composed page are those of its article: in order, each once."""
    out, at = np.zeros(len(page)), 0
    for i, b in enumerate(page):
        if at < len(main) and b.text == main[at] and said(b) is not False:
            out[i], at = 1, at + 1
    return out


def train(pages: DataFrame, most: int = MOST_PAGES, composed: int = COMPOSED, seed: int = 13) -> BlockLabeller:
    """A labeller from a bounded sample of ``pages`` (page_id, html) and pages composed from it."""
    usable = pages.select("page_id", F.col("html").cast("string").alias("html")).filter(F.length("html") <= MOST_CHARS)
    marked = usable.select("page_id", F.xxhash64("html").alias("sum"), "html")
    # which pages is settled on their ids and checksums alone; then only those pages come here, each once
    chosen = F.broadcast(marked.select(F.col("page_id").alias("id"), F.col("sum").alias("s")).distinct().orderBy(F.xxhash64("id"), "id", "s").limit(most))
    fetched = marked.join(chosen, marked["page_id"].eqNullSafe(chosen["id"]) & (marked["sum"] == chosen["s"])).groupBy("id", "s").agg(F.min("html").alias("html"))
    sample = [r["html"] for r in fetched.orderBy(F.xxhash64("id"), "id", "s").collect()]
    found = [b for b in map(blocks, sample) if b]
    x, y = [], []
    for page in found:
        labels = weak_labels(page)
        if labels is not None:
            x.append(vectors(page))
            y.append(labels)
    rng, stuff = random.Random(seed), material(found)
    for _ in range(composed):
        text, main = compose(rng, stuff)
        page = blocks(text)
        x.append(vectors(page))
        y.append(labels_of(page, main))
    x, y = zip(*[(a, b) for a, b in zip(x, y) if len(a)])
    return BlockLabeller().fit(list(x), list(y))


def extract(pages: DataFrame, model: BlockLabeller | None = None, at_once: int = 64) -> DataFrame:
    """page_id, url, text, n_chars for each row of ``pages``.

    text is the blocks that the labeller keeps, in page order, joined by an empty
    line; none are dropped or cut for length. A null or empty html, or one
    without text, gives an empty text. Rows that repeat a page_id are read each
    for itself; a null page_id or url stays null. Only ``page_id``, ``url`` and
    ``html`` are read. ``model`` is trained on ``pages`` where none is given.
    """
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    model = model or train(source)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole, lo in ((b, k) for b in batches for k in range(0, b.num_rows, STEP)):
            batch = whole.slice(lo, STEP)
            found = [blocks(h) for h in batch.column(2).to_pylist()]
            texts = [""] * len(found)
            order = sorted((i for i in range(len(found)) if found[i]), key=lambda i: len(found[i]))
            at = 0
            while at < len(order):
                # like lengths together, so little is padding; long pages in smaller groups, very long ones alone
                part = order[at : at + max(1, min(at_once, CHUNK * 4 // len(found[order[min(at + at_once, len(order)) - 1]])))]
                at += len(part)
                longest = len(found[part[-1]])
                judged = model.predict([vectors(found[i]) for i in part]) if longest <= CHUNK else [model.predict_long(found[i]) for i in part]
                for i, chances in zip(part, judged):
                    texts[i] = "\n\n".join(b.text for b, c in zip(found[i], chances) if c >= 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return source.mapInArrow(lean(run), "page_id long, url string, text string, n_chars long")
