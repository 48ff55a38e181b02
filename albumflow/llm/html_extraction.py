"""Main text of web pages by a recurrent block labeller.

A page is a sequence of leaf blocks (``page_blocks``).  Each block becomes a vector: the sum of learned
vectors of its tag path's hashed features (element names by distance, words of classes and ids), the mean of
learned vectors of its hashed words, and a few numbers (length, share of links, place).  A bidirectional
LSTM in numpy reads all blocks of the page, so every block is judged with the whole document around it, and an output
layer gives the probability that the block belongs to the article.

Pages carry no labels.  The network learns from a bounded sample of pages (``SAMPLE``), labelled by their own
landmarks where they have any (article or main against nav, footer, aside and the like), and from the same
texts dealt anew into invented layouts whose classes, nesting and order vary, where labels are known.

Edge cases: a null or empty page, and one without blocks of the article, has an empty text; rows that repeat
a page or its id each have a row; pages of any length are labelled whole; an empty table gives an empty result; only
page_id, url and html are read.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator
from functools import lru_cache
from html import escape
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from albumflow.llm.kernels import MARKS, U64, split_words, table, text_slices, word_hashes
from albumflow.llm.page_blocks import Block, Element, page_blocks
from albumflow.llm.shared import arrow_schema, sample

SAMPLE = 300  # pages that the network learns from, at most
LAYOUTS = 4  # invented layouts of each
LONGEST = 80  # blocks of a training sequence
PATHS, WORDS = 1 << 12, 1 << 12  # buckets of hashed features
WIDTH, WORD_WIDTH, HIDDEN, NUMBERS = 24, 8, 24, 6
EPOCHS, TOGETHER, RATE = 5, 24, 0.01
CELLS = 1 << 13  # blocks, padding included, that are labelled together

# Landmarks and class words of training pages' labels and of invented layouts.
ARTICLE = ["article", "main"]
OTHER = ["nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select"]
REGIONS = {
    "menu": ("nav ul div", "menu nav navbar navigation topnav breadcrumb breadcrumbs toc pagination tabs"),
    "head": ("header div", "header masthead site-header topbar banner branding logo page-header"),
    "foot": ("footer div", "footer site-footer colophon copyright bottom legal credits"),
    "side": ("aside div section", "sidebar side rail widget related recommended popular trending tags archive"),
    "note": ("div section aside", "cookie cookies consent notice alert gdpr privacy modal popup overlay disclaimer paywall"),
    "advert": ("div aside section", "ad ads advert advertisement sponsor sponsored promo promotion banner-ad adsense"),
    "form": ("form div section", "form search newsletter subscribe signup login contact feedback"),
    "talk": ("section div ol ul", "comments comment comment-list discussion replies responses respond disqus reader-comments"),
    "share": ("div ul", "share sharing social buttons follow toolbar meta byline author tools"),
}
MAIN = ("article main div section", "article content post entry main story body post-content entry-content article-body story-text text")
NEUTRAL = "wrapper container page row col inner outer grid layout site app root block group box column"
PHRASES = {
    "note": "We use cookies to improve this site.|Accept all|By continuing you agree to our terms.", "form": "Subscribe to our newsletter|Your e-mail address|Search|Send|Log in",
    "advert": "Advertisement|Sponsored|Buy now and save", "talk": "Comments|Leave a reply|Reply|Posted by a reader", "share": "Share this|Follow us|Print",
    "foot": "© All rights reserved.|Privacy|Imprint|Terms of use", "side": "Related articles|Most read|Tags", "menu": "Home|About|Contact|News", "head": "Skip to content|Menu",
}


def landmark_labels(blocks: list[Block]) -> list[bool] | None:
    """Whether each block is in the article by the page's own landmarks; None if it has no article."""
    hints = {w for _, words in REGIONS.values() for name in words.split() for w in name.split("-")} - {"page", "content", "banner", "meta", "text"}

    def inside(path: tuple[Element, ...]) -> bool:
        depth = max((i for i, e in enumerate(path) if e.name in ARTICLE), default=-1)
        bad = max((i for i, e in enumerate(path) if e.name in OTHER or hints & set(e.hints)), default=-1)
        return depth > bad

    labels = [inside(b.path) for b in blocks]
    return labels if any(labels) else None


def invented_page(article: list[str], others: list[str], rng: random.Random) -> tuple[str, list[bool]]:
    """A page of the given texts in a layout of random elements, and which of its blocks are the article's."""
    out: list[str] = []
    labels: list[bool] = []
    others = others or ["…"]

    def opened(kind: tuple[str, str], bare: float = 0.15) -> str:
        name = rng.choice(kind[0].split())
        marks = rng.sample(kind[1].split(), rng.choice([1, 1, 2]))
        telling = name in (*ARTICLE, *OTHER)
        where = "" if rng.random() < (0.5 if telling else bare * 0.3) else f' {rng.choice(["class", "class", "class", "id"])}="{" ".join(marks)}"'
        out.append(f"<{name}{where}>")
        return name

    def block(tag: str, text: str, label: bool, linked: bool = False) -> None:
        if not text.split():
            return
        text = escape(text, quote=False)
        inner = f'<a href="#">{text}</a>' if linked else f"<{s}>{text}</{s}>" if (s := rng.choice(["", "", "", "", "b", "em", "span"])) else text
        out.append(f"<{tag}>{inner}" + ("" if tag in ("p", "li") and rng.random() < 0.2 else f"</{tag}>"))
        labels.append(label)

    def words(low: int, high: int) -> str:
        text = rng.choice(others if rng.random() < 0.5 else article).split()
        n = rng.randint(low, high)
        at = rng.randrange(max(1, len(text) - n + 1))
        return " ".join(text[at : at + n])

    def region(kind: str) -> None:
        name = opened(REGIONS[kind])
        phrase = lambda: rng.choice(PHRASES[kind].split("|")) if rng.random() < 0.4 else words(1, 12)
        if kind in ("menu", "share") or name in ("ul", "ol") and kind != "talk":
            inner = name not in ("ul", "ol")
            out.append("<ul>" if inner else "")
            for _ in range(rng.randint(1, 8)):
                block("li", words(1, 3) if rng.random() < 0.8 else phrase(), False, linked=rng.random() < 0.9)
            out.append("</ul>" if inner else "")
        elif kind == "talk":
            if rng.random() < 0.6 and name not in ("ul", "ol"):
                block(rng.choice(["h2", "h3", "p"]), phrase(), False)
            for _ in range(rng.randint(1, 4)):
                item = "li" if name in ("ul", "ol") else rng.choice(["div", "article", "div"])
                out.append(f'<{item} class="{rng.choice(["comment", "comment-body", "reply", "comment-item"])}">')
                for _ in range(rng.randint(1, 2)):
                    block("p", words(3, 60), False)
                out.append(f"</{item}>")
        elif kind == "form":
            block(rng.choice(["label", "p", "legend"]) if name == "form" else "p", phrase(), False)
            if rng.random() < 0.6:
                block("button", phrase(), False)
        else:
            for _ in range(rng.randint(1, 3)):
                block(rng.choice(["p", "p", "div", "h3", "h4"]), phrase() if rng.random() < 0.6 else words(2, 40), False, linked=rng.random() < 0.2)
        out.append(f"</{name}>")

    def regions(kinds: str, chance: float) -> None:
        for kind in kinds.split():
            if rng.random() < chance:
                region(kind)

    wrappers = [rng.choice(["div", "div", "section"]) for _ in range(rng.randint(0, 3))]
    out.append("<!DOCTYPE html><html><head><title>t</title></head><body>")
    early = rng.random() < 0.5
    regions("head menu note advert", 0.5) if early else None
    out.extend(f'<{w} class="{rng.choice(NEUTRAL.split())}">' if rng.random() < 0.7 else f"<{w}>" for w in wrappers)
    regions("note head form menu advert side", 0.3)
    name = opened(MAIN, bare=0.3)
    regions("share menu", 0.1)
    for i, text in enumerate(article):
        if i == 0:
            block("h1", " ".join(text.split()[:12]), True)
        shape = rng.random()
        if shape < 0.08:
            out.append("<ul>")
            for piece in filter(None, (text[:80], text[80:200])):
                block("li", piece, True, linked=rng.random() < 0.1)
            out.append("</ul>")
        elif shape < 0.14:
            block(rng.choice(["h2", "h3"]), " ".join(text.split()[:6]), True)
            block("p", text, True)
        else:
            block(rng.choices(["p", "blockquote", "div", "pre", "td"][:4], [20, 1, 2, 1])[0], text, True, linked=rng.random() < 0.02)
        if rng.random() < 0.08:
            region(rng.choice(["advert", "share", "side", "form", "note"]))
    regions("share talk form side", 0.15)
    out.append(f"</{name}>")
    regions("share talk side form advert", 0.3)
    out.extend(f"</{w}>" for w in reversed(wrappers))
    regions("side foot note", 0.4)
    region("foot") if rng.random() < 0.7 else None
    out.append("</body></html>")
    return "".join(out), labels


# Vectors of blocks.


@lru_cache(1 << 14)
def _path_features(path: tuple[Element, ...]) -> tuple[int, ...]:
    marks = {f"in {e.name}" for e in path} | {f"hint {h}" for e in path for h in e.hints}
    for distance, e in enumerate(reversed(path[-3:])):
        marks |= {f"{distance} {e.name}"} | {f"{distance} hint {h}" for h in e.hints}
    return tuple(sorted({zlib.crc32(m.encode()) % PATHS for m in marks}))


class Features(NamedTuple):
    """Features of the blocks of many pages, one after the other."""

    path: np.ndarray  # all path features, and the block of each
    path_block: np.ndarray
    word: np.ndarray
    word_block: np.ndarray
    numbers: np.ndarray
    sizes: np.ndarray  # blocks of each page


def features(pages: list[list[Block]]) -> Features:
    sizes = np.array([len(p) for p in pages], dtype=np.int64)
    blocks = [b for p in pages for b in p]
    paths = [_path_features(b.path) for b in blocks]
    word, owner = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    count = np.zeros(len(blocks))
    for part in text_slices(pa.array([b.text for b in blocks], pa.large_string())):
        words = split_words(part, MARKS)
        own = np.diff(words.bounds)
        count[part.first : part.first + part.count] = own
        word.append((word_hashes(part, words, fold=True) % U64(WORDS)).astype(np.int64))
        owner.append(np.repeat(np.arange(part.first, part.first + part.count), own))
    size = np.array([len(b.text) for b in blocks], dtype=float)
    linked = np.array([b.linked for b in blocks], dtype=float)
    place = np.arange(len(blocks)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    ends = np.array([b.text[-1] in ".!?…:" for b in blocks], dtype=float)
    numbers = [np.log1p(count) / 4, np.minimum(linked / np.maximum(size, 1), 1), np.log1p(size) / 6, ends, place == 0, place / np.maximum(np.repeat(sizes, sizes), 1)]
    return Features(
        np.fromiter((x for p in paths for x in p), np.int64), np.repeat(np.arange(len(blocks)), [len(p) for p in paths]).astype(np.int64), np.concatenate(word), np.concatenate(owner),
        np.stack(numbers, axis=1).astype(np.float32) if blocks else np.zeros((0, NUMBERS), np.float32), sizes,
    )


def _sum_rows(values: np.ndarray, owner: np.ndarray, count: int) -> np.ndarray:
    """Sums of the rows of each owner, owners being in order."""
    out = np.zeros((count, values.shape[1]), dtype=values.dtype)
    own, first = np.unique(owner, return_index=True)
    if len(own):
        out[own] = np.add.reduceat(values, first, axis=0)
    return out


def _scattered(values: np.ndarray, bucket: np.ndarray, block: np.ndarray, count: int) -> np.ndarray:
    """Sums of the blocks' rows that each bucket occurs in."""
    order = np.argsort(bucket, kind="stable")
    return _sum_rows(values[block[order]], bucket[order], count)


# The network.


class Model(NamedTuple):
    paths: np.ndarray  # (PATHS, WIDTH)
    words: np.ndarray  # (WORDS, WORD_WIDTH)
    into: np.ndarray  # (2, WIDTH + WORD_WIDTH + NUMBERS, 4 * HIDDEN): inputs of each direction's gates
    again: np.ndarray  # (2, HIDDEN, 4 * HIDDEN): the state's
    bias: np.ndarray  # (2, 4 * HIDDEN)
    out: np.ndarray  # (2 * HIDDEN + 1,)


def new_model(seed: int = 7) -> Model:
    rng = np.random.default_rng(seed)
    size = WIDTH + WORD_WIDTH + NUMBERS
    bias = np.zeros((2, 4 * HIDDEN))
    bias[:, HIDDEN : 2 * HIDDEN] = 1  # remember at first
    parts = (
        rng.normal(0, 0.1, (PATHS, WIDTH)), rng.normal(0, 0.1, (WORDS, WORD_WIDTH)), rng.normal(0, size**-0.5, (2, size, 4 * HIDDEN)),
        rng.normal(0, HIDDEN**-0.5, (2, HIDDEN, 4 * HIDDEN)), bias, rng.normal(0, 0.1, 2 * HIDDEN + 1),
    )
    return Model(*(p.astype(np.float32) for p in parts))


def _inputs(f: Features, m: Model) -> np.ndarray:
    n = len(f.numbers)
    mean = _sum_rows(m.words[f.word], f.word_block, n) / np.maximum(np.bincount(f.word_block, minlength=n), 1)[:, None]
    return np.hstack([_sum_rows(m.paths[f.path], f.path_block, n), mean, f.numbers]).astype(m.into.dtype)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class _Steps(NamedTuple):
    """Which block each page reads at each step, longest pages first."""

    at: np.ndarray  # (steps, pages)
    active: np.ndarray  # pages that still have a block, by step


def _steps(sizes: np.ndarray, backward: bool) -> _Steps:
    """Steps of pages whose blocks follow one another; ``sizes`` falls."""
    first = np.cumsum(sizes) - sizes
    step = np.arange(int(sizes.max(initial=0)))[:, None]
    at = first + (sizes - 1 - step if backward else step)
    return _Steps(np.clip(at, 0, max(0, int(sizes.sum()) - 1)), (step < sizes).sum(axis=1))


def _read(x: np.ndarray, again: np.ndarray, steps: _Steps) -> tuple[np.ndarray, list]:
    """States after every block, and what the way back needs."""
    states = np.zeros((len(x), HIDDEN), dtype=x.dtype)
    h = np.zeros((steps.at.shape[1], HIDDEN), dtype=x.dtype)
    c, kept = h.copy(), []
    for at, n in zip(steps.at, steps.active.tolist(), strict=True):
        at, before, cell = at[:n], h[:n], c[:n]
        z = x[at] + before @ again
        gates = _sigmoid(z[:, : 3 * HIDDEN])
        i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
        g = np.tanh(z[:, 3 * HIDDEN :])
        c = f * cell + i * g
        t = np.tanh(c)
        h = o * t
        states[at] = h
        kept.append((at, before, cell, i, f, o, g, t))
    return states, kept


def _read_back(grad: np.ndarray, again: np.ndarray, kept: list) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the gates' inputs and of ``again``."""
    dx, d_again = np.zeros((len(grad), 4 * HIDDEN), dtype=grad.dtype), np.zeros_like(again)
    dh = dc = np.zeros((0, HIDDEN), dtype=grad.dtype)
    for at, before, cell, i, f, o, g, t in reversed(kept):
        n = len(at)
        more = np.zeros((n - len(dh), HIDDEN), dtype=grad.dtype)
        dh, dc = np.vstack([dh, more]) + grad[at], np.vstack([dc, more])
        dc = dc + dh * o * (1 - t * t)
        dz = np.hstack([dc * g * i * (1 - i), dc * cell * f * (1 - f), dh * t * o * (1 - o), dc * i * (1 - g * g)])
        dx[at] = dz
        d_again += before.T @ dz
        dh, dc = dz @ again.T, dc * f
    return dx, d_again


def _forward(f: Features, m: Model) -> tuple[np.ndarray, tuple]:
    """Log-odds of every block; pages come longest first."""
    x = _inputs(f, m)
    both = [_read(x @ m.into[d] + m.bias[d], m.again[d], _steps(f.sizes, bool(d))) for d in (0, 1)]
    states = np.hstack([both[0][0], both[1][0]])
    return states @ m.out[:-1] + m.out[-1], (x, states, both)


def gradients(f: Features, labels: np.ndarray, m: Model) -> tuple[float, Model]:
    """Mean log loss of the blocks, and its gradient."""
    score, (x, states, both) = _forward(f, m)
    p = _sigmoid(score)
    n = len(labels)
    loss = float(-np.mean(np.where(labels, np.log(p + 1e-9), np.log(1 - p + 1e-9))))
    d = ((p - labels) / n).astype(x.dtype)
    spread = d[:, None] * m.out[:-1]
    dx, into, again, bias = np.zeros_like(x), [], [], []
    for k in (0, 1):
        dz, d_again = _read_back(spread[:, k * HIDDEN : (k + 1) * HIDDEN], m.again[k], both[k][1])
        into.append(x.T @ dz)
        again.append(d_again)
        bias.append(dz.sum(axis=0))
        dx += dz @ m.into[k].T
    share = dx[:, WIDTH : WIDTH + WORD_WIDTH] / np.maximum(np.bincount(f.word_block, minlength=len(x)), 1)[:, None].astype(x.dtype)
    paths, words = _scattered(dx[:, :WIDTH], f.path, f.path_block, PATHS), _scattered(share, f.word, f.word_block, WORDS)
    return loss, Model(paths, words, np.stack(into), np.stack(again), np.stack(bias), np.append(d @ states, d.sum()))


def fit(pages: list[list[Block]], labels: list[list[bool]], seed: int = 7) -> Model:
    """Train on labelled pages, by Adam on batches of pages of like length."""
    m, rng = new_model(seed), np.random.default_rng(seed)
    first, second = ([np.zeros_like(p) for p in m] for _ in range(2))
    kept = [i for i, p in enumerate(pages) if p]
    kept.sort(key=lambda i: -len(pages[i]))
    batches = [kept[i : i + TOGETHER] for i in range(0, len(kept), TOGETHER)]
    ready = [(features([pages[i] for i in b]), np.concatenate([labels[i] for i in b])) for b in batches]
    step = 0
    for epoch in range(EPOCHS):
        for b in rng.permutation(len(ready)):
            step += 1
            _, grad = gradients(*ready[b], m)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad))
            rate = RATE * (1 - epoch / EPOCHS) * (1 - 0.999**step) ** 0.5 / (1 - 0.9**step)
            for p, g, u, v in zip(m, grad, first, second, strict=True):
                g = g * min(1.0, 1 / max(norm, 1e-9))
                u += 0.1 * (g - u)
                v += 0.001 * (g * g - v)
                p -= (rate * u / (np.sqrt(v) + 1e-8)).astype(p.dtype)
    return m


def _trained_on(htmls: list[str], seed: int) -> tuple[list[list[Block]], list[list[bool]]]:
    rng = random.Random(seed)
    pages, labels = [], []
    for html in htmls:
        blocks = page_blocks(html)[:LONGEST]
        own = landmark_labels(blocks)
        if own is not None:
            pages.append(blocks)
            labels.append(own)
        article = [b.text for b, inside in zip(blocks, own or [len(b.text) > 80 for b in blocks], strict=True) if inside]
        others = [b.text for b, inside in zip(blocks, own or [len(b.text) > 80 for b in blocks], strict=True) if not inside]
        for _ in range(LAYOUTS if article else 0):
            some = article[: rng.choice([1, 2, 4, 8, 30])]
            page, marks = invented_page(some, others, rng)
            invented = page_blocks(page)
            if len(invented) == len(marks):
                pages.append(invented[: 2 * LONGEST])
                labels.append(marks[: 2 * LONGEST])
    return pages, labels


def train(pages: DataFrame, seed: int = 7) -> Model:
    """A model of at most ``SAMPLE`` pages (those of the smallest hashes of page_id)."""
    rows = sample(pages.where("html is not null").select("page_id", "html"), SAMPLE, "page_id").collect()
    return fit(*_trained_on([r.html for r in rows], seed), seed)


def label(pages: list[list[Block]], m: Model) -> list[np.ndarray]:
    """The probability that each block of each page is the article's."""
    out: list[np.ndarray] = [np.zeros(0)] * len(pages)
    order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: -len(pages[i]))
    while order:
        most = max(1, CELLS // len(pages[order[0]]))
        chosen, order = order[:most], order[most:]
        score, _ = _forward(features([pages[i] for i in chosen]), m)
        for i, own in zip(chosen, np.split(_sigmoid(score), np.cumsum([len(pages[i]) for i in chosen])[:-1]), strict=True):
            out[i] = own
    return out


def _labelled(htmls: list[str | None], m: Model) -> Iterator[tuple[list[Block], np.ndarray]]:
    pages = [page_blocks(h or "") for h in htmls]
    yield from zip(pages, label(pages, m), strict=True)


def extract(pages: DataFrame, model: Model) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks, n_kept of every page."""
    ddl = "page_id bigint, url string, text string, n_chars bigint, n_blocks bigint, n_kept bigint"
    schema = arrow_schema(ddl)
    spread = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                rows = []
                for blocks, p in _labelled(part.column(2).to_pylist(), spread.value):
                    kept = [b.text for b, own in zip(blocks, p.tolist(), strict=True) if own >= 0.5]
                    text = "\n".join(kept)
                    rows.append((text, len(text), len(blocks), len(kept)))
                yield table(schema, part.column(0), part.column(1), *zip(*rows, strict=True))

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, ddl)
