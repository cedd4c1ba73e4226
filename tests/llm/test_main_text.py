"""Main text: pages whose noise is longer than the article, pages of noise only, text beside containers, broken markup in linear time, host votes."""

import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quern.llm import main_text
from quern.llm.main_text import Page


def extract(html, path=None):
    """The text of a page, by ``path`` if it has it."""
    page = Page(html)
    found, own = page.choices()
    ranges, around = next(((r, a) for p, _, r, a in found if p == path), own)
    where, upward = page.beside()
    taken, above = {i for lo, hi in ranges for i in range(lo, hi)}, set()
    while around >= 0:
        above.add(around)
        around = upward[around]
    return "\n".join(t for i, (_, t, _) in enumerate(page.blocks) if i in taken or where[i] in above)


STORY = "A story of some length, told in one sentence, and no more than that, but for this."


@pytest.mark.parametrize("times", [1, 5, 6, 7, 100])
@pytest.mark.parametrize("box", ['<div class="cookie-banner"><p>%s</p></div>', '<div class="alert">%s</div>', '<div id="site-message"><p>%s</p></div>', "<form><p>%s</p><input></form>", '<div class="comments"><article><p>%s</p></article></div>'])
@pytest.mark.parametrize("story", ["<div class=story><p>%s</p></div>", "<article>%s</article>", "<main><p>%s</p></main>", "<p>%s</p>"])
def test_noise_of_any_size_is_noise(times, box, story):
    noise = box % ("We use things here, and tell you so at length. " * times)
    for html in (noise + story % STORY, story % STORY + noise):
        assert extract(html) == STORY


def test_comments_longer_than_the_article():
    comments = "".join(f"<div class=comment><p>Reader {i} has a lot to say of all this. {'And more. ' * 30}</p></div>" for i in range(20))
    assert extract(f"<article><p>{STORY}</p></article><div id=comments>{comments}</div>") == STORY


@pytest.mark.parametrize("html", ["<div class=cookie>We use cookies</div>", "<form><p>Your name <input></p></form>", "<form>Name: <input><p>What is it?</p></form>", "<nav><p>Home.</p></nav><div class=sidebar><p>More.</p></div>", "<div class=comments><article><p>I say.</p></article></div>"])
def test_pages_of_noise_are_empty(html):
    assert extract(html) == ""


def test_articles_within_layout_of_noisy_names():
    body = f"<h1>Head</h1><p>{STORY}</p>"
    for html in (
        f"<div class='modal'>{body}</div>", f"<div class='social'><article>{body}</article></div><div class=ad>Buy!</div>", f"<form><input><nav>x</nav>{body}</form>",
        f"<form><input type=hidden><header>Site</header><div>{body}</div><footer>x</footer></form><div class=cookie><p>We do.</p></div>", f"<div class='comments'><main>{body}</main></div>",
        f"<form>{body}<div class=comments><p>Reader.</p></div></form>",
    ):
        assert extract(html) == f"Head\n{STORY}", html


def test_text_beside_the_container():
    p = "".join(f"<p>Paragraph {i} of the body.</p>" for i in range(6))
    want = "Title\n" + "\n".join(f"Paragraph {i} of the body." for i in range(6))
    assert extract(f"<div class=page><h1>Title</h1><div class=body>{p}</div><p>Closing words.</p></div>") == f"{want}\nClosing words."
    assert extract(f"<body><h1>Title</h1><div class=body>{p}</div><p>Closing words.</p><p>&copy; Firm Inc.</p></body>") == f"{want}\nClosing words."
    assert extract(f"<main><header><h1>Title</h1></header><div><div class=body>{p}</div></div></main>") == want
    assert extract(f"<p>Before.</p><article><h1>Title</h1>{p}</article><p>After.</p>") == want  # an article is whole


N = 1 << 20
BROKEN = {
    "lists": "<ul><li>x" * (N // 9), "b and i": "<b>x</i>" * (N // 8), "div and i": "<div>x</i>" * (N // 10), "cells": "<i><table><td>" + "<div>x</i>" * (N // 10), "titles": "<title>x" * (N // 8),
    "templates": "<head><template>" + "<div>" * (N // 5), "paragraphs": "<b><p>x" * (N // 7), "two deep branches": ("<div>x" * (N // 24) + "</div>" * (N // 24)) * 2, "rows": "<table>" + "<tr><td>x" * (N // 9),
    "forms": "<form><div><p>x</p>" * (N // 19), "noise": "<div class=ad><p>x</p>" * (N // 22), "headings": "<div class=ad><h1>x</h1>" * (N // 24), "tables": "<table><tr><td>x" * (N // 16),
}


def test_broken_markup_takes_linear_time():
    began = time.process_time()
    for html in BROKEN.values():
        page = Page(html)
        page.choices(), page.beside()
    assert time.process_time() - began < 5 * len(BROKEN)


def test_host_votes_are_those_of_a_plain_count(spark, sf):
    """Pages of given and made hosts, against votes counted a page at a time."""
    p = lambda n, k: "".join(f"<p>Sentence {i} of text {k}.</p>" for i in range(n))
    made = [(10_000 + i, f"http://made{i % 3}.example/{i}", f"<div class='a{i}'>{p(i % 7, 1)}</div><div class='b'><div class=c>{p(3, 2)}</div></div><h2>Under</h2>") for i in range(40)]
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").unionByName(spark.createDataFrame(made, "page_id long, url string, html string"))
    rows = [(r["page_id"], r["url"].split("/")[2].lower(), r["html"]) for r in pages.collect()]
    votes = defaultdict(lambda: defaultdict(int))
    for _, host, html in rows:
        found, _ = Page(html).choices()
        total = sum(s for _, s, _, _ in found)
        for path, score, _, _ in found:
            votes[host][path] += round(1e6 * score / total)
    best = {host: min(v, key=lambda x: (-v[x], x)) for host, v in votes.items()}
    got = {r["page_id"]: r["text"] for r in main_text.main_text(pages).collect()}
    assert got == {i: extract(html, best.get(host)) for i, host, html in rows}


def test_clashing_columns_and_nulls(spark):
    df = spark.createDataFrame([(1, "http://x/", "<p>Yes.</p>"), (None, None, None), (1, "http://x/", "")], "page_id long, url string, html string")
    for name in ("key", "blocks", "beside", "next", "paths", "own", "chosen", "text", "host"):
        df = df.withColumn(name, F.lit(0))
    assert sorted((r["page_id"] or 0, r["text"]) for r in main_text.main_text(df).collect()) == [(0, ""), (1, ""), (1, "Yes.")]
