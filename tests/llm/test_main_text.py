"""Main text of pages: planted parts, odd markup, and the articles of the given pages read another way."""

from __future__ import annotations

import html as entities
import re

import pytest

from vetline.llm import main_text
from vetline.llm.queries import QUERIES

BODY = "The first paragraph of the story is long enough to be told from a menu by its length alone, as stories are."
NOISE = """<nav><ul><li><a href="/">Home</a><li><a href="/x">Sport</a></ul></nav><header><h1>The Daily Page</h1><p>News since 1901, every day and for all of you out there who read it</p></header>
<div class="cookie-notice">We use cookies to give you the best experience on our site. Read more about all of them here.</div>
<div id="sidebar"><h3>Most read</h3><p>A teaser text of some length that stands in the column beside the story itself.</p></div>
<aside>Did you know that this box has nothing to do with the story that you came here for?</aside>
<form action="/s"><label>Search</label><input name=q><button>Go</button><p>Type the words that you want to find in all of our pages.</p></form>
<div class="ad banner-top">Buy our wonderful product today and get another one for free if you call us in the next hour!</div>
<noscript>Please enable JavaScript to see all of this page as we want it to be seen by you.</noscript>"""
AFTER = """<section id="comments"><h2>2 comments</h2><article class="comment"><p>I do not agree with a single word of this story, and I told you so before.</p></article>
<article><p>Me neither, and I will not read this page again, at least not before tomorrow morning.</p></article></section>
<footer>&copy; 2020 The Daily Page. All rights reserved. No part of this may be copied by anyone at all.</footer>"""


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main>{}</main>", "<div class='page has-sidebar'><article class='post'>{}</article></div>",
                                  "<div id=main-content>{}</div>", "<main><article>{}</article><p>Beside the article, in the same main part, something else of length.</p></main>",
                                  "<div class=sidebar-layout><article>{}</article></div>"])
def test_article_among_everything_else(wrap):
    inner = f"<header><h1>Title &amp; more</h1><span>By us</span></header><p>{BODY}<p>Short.<ul><li><a href=x>Linked</a></li><li>two</ul><p>a<br>b  c&nbsp;d<b>e</b></p><div class='share-buttons'>Share</div><script>if (a</b) '<p>x'</script>"
    page = f"<!doctype html><html><head><title>T</title><style>p > a {{}}</style></head><body>{NOISE}{wrap.format(inner)}{AFTER}</body></html>"
    got = main_text.main_text(page)
    assert got.split("\n\n") == ["Title & more", BODY, "Short.", "Linked", "two", "a b c de"]


def test_page_without_an_article_by_the_distribution():
    page = f"<div class=top>{NOISE}</div><table><tr><td><a href=a>One</a><td><a href=b>Two</a></table><div><h2>Head</h2><p>{BODY}</p><p>End.</p></div>{AFTER}"
    assert main_text.main_text(page) == f"Head\n\n{BODY}\n\nEnd."
    assert main_text.main_text("<div><a href=x>Home</a></div><div>Login</div>") == ""


def test_spans():
    assert main_text.spans([0, 5, 90, 0, 7, 0, 0, 0, 70], 3, 60) == [(0, 5), (6, 9)]
    assert main_text.spans([], 3, 60) == [] and main_text.spans([10, 10], 3, 60) == []


@pytest.mark.parametrize("page, want", [
    (None, ""), ("", ""), ("  \n ", ""), ("<", ""), ("<article>a < b &lt; c &#233;</article>", "a < b < c é"), ("<article>x<!-- <p>no</p> -->y", "xy"),
    ("<article><p title='a>b'>one</p><p title=\"<p>\">two", "one\n\ntwo"), ("<article>a<script>never closed <p>b", "a"), ("<article>a<p", "a"),
    ("<article><pre>a\n b</pre><TABLE><tr><td>1<td>2<tr><td>3</TABLE></article>after", "a b\n\n1 2\n\n3"),
    ("<article>one<nav>two</nav>three", "one\n\nthree"), ("<article><p hidden>no</p><p style='display: none'>no</p>yes", "yes"), ("<article>a</div></p>b</article>", "a\n\nb")])
def test_odd_markup(page, want):
    assert main_text.main_text(page) == want


def test_long_pages_take_time_in_proportion():
    for piece in ("<a href=\"", "<p x='", "<!--", "<div>", "<b", "< ", "<p>word ", "<script>", "=\"", "<a b=\"c'\"d=' "):
        main_text.main_text("<article>" + piece * 60000)


def test_given_pages_equal_their_articles(spark, sf_dir):
    got = {r["page_id"]: r for r in QUERIES["op11_main_text"](spark, sf_dir).collect()}
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    assert len(got) == len(pages)
    for r in pages:
        inner = re.search(r"<article>(.*?)(</article>|\Z)", r["html"], re.S)[1].replace("<br>", " ")
        blocks = [" ".join(entities.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:h1|p)>", inner)]
        want = "\n\n".join(b for b in blocks if b)
        assert (got[r["page_id"]]["text"], got[r["page_id"]]["n_chars"], got[r["page_id"]]["url"]) == (want, len(want), r["url"])


def test_odd_rows(spark):
    schema = "page_id long, url string, html string, text string, n_chars long, part string"
    rows = [(1, None, None, "x", 1, "y"), (None, "u", "<article>a</article>", "x", 1, "y"), (1, "u", "<article>" + "<p>w " * 50000, "x", 1, "y")]
    got = main_text.extract(spark.createDataFrame(rows + rows[1:2], schema)).collect()
    assert sorted((r["page_id"] or 0, r["url"] or "", len(r["text"]), r["n_chars"]) for r in got) == [
        (0, "u", 1, 1), (0, "u", 1, 1), (1, "", 0, 0), (1, "u", 50000 * 3 - 2, 50000 * 3 - 2)]
    assert main_text.extract(spark.createDataFrame([], schema)).count() == 0
