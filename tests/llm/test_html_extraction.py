"""The page scanner by example, the labeller's gradient by differences, and extraction on held-out pages."""

from __future__ import annotations

import random
import re
import time
from html import unescape

import numpy as np
import pytest

from albumflow.llm import html_extraction as hx
from albumflow.llm import queries
from albumflow.llm.page_blocks import page_blocks

SF = "/root/testdata/sf0.001"
PAGES = "page_id bigint, url string, html string"


@pytest.mark.parametrize(
    "page, texts",
    [
        ("", []), ("  \n ", []), ("a<b>b</b>\n <i>c</i>", ["ab c"]), ("<p>x &amp; y&nbsp;z<br>w<p>q", ["x & y z w", "q"]), ("<ul><li>1<li>2 <a href=x>l</a></ul>3 < 4", ["1", "2 l", "3 < 4"]),
        ("<table><tr><td>u<td>v<tr><td>w</table>x", ["u", "v", "w", "x"]), ('e<script>var a="<p>no</p>"</script>f<!-- > <p>c -->g', ["efg"]), ("<p title='a>b'>t</p>", ["t"]),
        ("<head><title>no</title><style>p{}</style></head><body>yes", ["yes"]), ("<head><title>no</title><p>yes", ["yes"]), ("<svg><text>no</text></svg>yes<template>no<p>no</p></template>", ["yes"]),
        ("<svg><g>no<p>yes", ["yes"]), ("a<p class=", ["a"]), ("a<!-- b", ["a"]), ("a</p>b</nope>c", ["a", "bc"]), ("<textarea>no</textarea>x<noscript>no</noscript>", ["x"]), ("&lt;p&gt; &#233;&#xe9; &am", ["<p> éé &am"]),
        ("<dl><dt>a<dd>b<dt>c</dl>", ["a", "b", "c"]), ("<P CLASS=A>x</P>", ["x"]), ("<p><b>x<br><p>y</b>z", ["x", "yz"]), ("a<![CDATA[ x ]]>b<?php z ?>c", ["abc"]),
    ],
)
def test_blocks(page, texts):
    assert [b.text for b in page_blocks(page)] == texts


def test_paths_and_links():
    (a, b) = page_blocks('<body class="Home page-top"><div id=sideBar role="x"><p>one <a>two</a></p></div><p>three')
    assert [e.name for e in a.path] == ["body", "div", "p"] and a.path[0].hints == ("home", "page", "top") and a.path[1].hints == ("side", "bar", "x") and a.linked == 3
    assert [e.name for e in b.path] == ["body", "p"] and b.linked == 0
    assert len(page_blocks("<div>" * 500 + "x")[0].path) <= 20


@pytest.mark.parametrize("piece", ['<a "', "<p><b>", "<div>", '<p title="', "<svg>", "</b>", "<li><button>", "&am", "<!--", "<script>", "<table><tr><td>", "<p>x", "<a>", "<"])
def test_time_is_linear(piece):
    began = time.perf_counter()
    page_blocks(piece * 100_000)
    assert time.perf_counter() - began < 20


def test_gradient():
    pages = [page_blocks(f"<article><p>one two {i}<p>three</article><nav><li>a<li>b {i}</nav>" * (3 - i)) for i in range(3)]
    labels = np.array([e.path[0].name == "article" for p in pages for e in p])
    f = hx.features(pages)
    m = hx.Model(*(p.astype(np.float64) for p in hx.new_model(3)))
    _, grad = hx.gradients(f, labels, m)
    rng = np.random.default_rng(1)
    for name, p, g in zip(m._fields, m, grad, strict=True):
        flat, slope = p.reshape(-1), g.reshape(-1)
        used = np.flatnonzero(slope)
        for at in rng.choice(used, min(8, len(used)), replace=False):
            was, ends = flat[at], []
            for step in (1e-5, -1e-5):
                flat[at] = was + step
                ends.append(hx.gradients(f, labels, m)[0])
            flat[at] = was
            assert slope[at] == pytest.approx((ends[0] - ends[1]) / 2e-5, rel=1e-3, abs=1e-8), name


@pytest.fixture(scope="module")
def model(spark):
    return hx.train(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


def article(html):
    """The text of the pages at hand, whose articles are marked: headings and paragraphs between the article's tags."""
    inner = re.search(r"<article>(.*)</article>", html, re.S)[1]
    blocks = (" ".join(unescape(re.sub(r"<[^>]*>", " " if "br" in x else "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner))
    return "\n".join(b for b in blocks if b)


def test_held_out_pages(spark, model):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").where("page_id % 5 = 0")
    want = {r.page_id: (r.url, article(r.html)) for r in pages.collect()}
    rows = hx.extract(pages, model).collect()
    assert len(rows) == len(want) and all((r.url, r.text) == want[r.page_id] and r.n_chars == len(r.text) for r in rows)


def test_invented_layouts(model):
    """Blocks and whole pages of layouts that training never saw."""
    rng, right, whole = random.Random(5), [], []
    texts = [" ".join(rng.choice("ka lo mi ten ur sa be the of".split()) for _ in range(rng.randint(5, 60))).capitalize() + "." for _ in range(400)]
    for _ in range(150):
        page, labels = hx.invented_page(rng.sample(texts, rng.randint(1, 12)), rng.sample(texts, 6), rng)
        blocks = page_blocks(page)
        assert len(blocks) == len(labels)
        (p,) = hx.label([blocks], model)
        right += ((p >= 0.5) == labels).tolist()
        whole.append(bool(((p >= 0.5) == labels).all()))
    assert np.mean(right) > 0.98 and np.mean(whole) > 0.8


def test_a_common_page(model):
    page = """<html><body><header><a href=/>Site</a></header><nav class="main-nav"><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav><div class="cookie-notice"><p>We use cookies.</p></div>
    <main><article class="post"><h1>A title &amp; more</h1><p>The first   paragraph of the
    article, long enough to be read by somebody.</p><div class="ad"><p>Buy now and save</p></div><p>The <b>second</b> paragraph, which ends here.</p></article>
    <section class="comments"><h3>Comments</h3><div class="comment"><p>I do not agree with any of this at all, sorry.</p></div></section></main>
    <aside class="sidebar"><h3>Related</h3><ul><li><a href=/x>Other story</a></ul></aside><form class="newsletter"><label>Your e-mail</label><button>Subscribe</button></form><footer>&copy; Site</footer></body></html>"""
    blocks = page_blocks(page)
    (p,) = hx.label([blocks], model)
    kept = [b.text for b, x in zip(blocks, p, strict=True) if x >= 0.5]
    assert kept == ["A title & more", "The first paragraph of the article, long enough to be read by somebody.", "The second paragraph, which ends here."]


def test_odd_tables(spark, model):
    rows = [(1, "u", None), (2, None, ""), (None, "v", "<article><p>x y z.</p></article>"), (4, "w", "<nav><li>a</nav>"), (4, "w", "<nav><li>a</nav>"), (5, "z", "<article>" + "<p>word word</p>" * 30_000 + "</article>")]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], PAGES + ", text string, n_chars int").repartition(2)
    out = hx.extract(pages, model)
    assert [c for c, _ in out.dtypes][:4] == ["page_id", "url", "text", "n_chars"]
    got = {(r.page_id, r.url): r for r in out.collect()}
    assert out.count() == len(rows) and got[1, "u"].text == got[2, None].text == "" and got[4, "w"].n_chars == 0
    assert got[None, "v"].text == "x y z." and got[5, "z"].text == "\n".join(["word word"] * 30_000)


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], PAGES).write.parquet(str(tmp_path / "pages.parquet"))
    assert queries.op11_html_extraction(spark, str(tmp_path)).count() == 0


def test_query(spark):
    out = queries.op11_html_extraction(spark, SF)
    assert out.dtypes == [("page_id", "bigint"), ("url", "string"), ("text", "string"), ("n_chars", "bigint")]
    want = {r.page_id: article(r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert {r.page_id: r.text for r in out.collect()} == want
