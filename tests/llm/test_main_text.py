"""Main text: hand-written pages, the table's pages by a plain rule, made pages that nothing was learned from, markup that is broken."""

import html as library
import re

import numpy as np
import pytest

from isospark.llm import main_text
from isospark.llm.common import table
from isospark.llm.dom import Page, attribute_tokens
from tests.llm.helpers import rows_of


@pytest.fixture(scope="module")
def model():
    return main_text.model()


def text_of(model, page):
    return next(main_text.main_texts([page], *model))


def plain(page):
    """Of a page of the table: what its article element holds."""
    body = re.search(r"(?s)<article>(.*?)(?:</article>|\Z)", page).group(1)
    blocks = [" ".join(library.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", body)]
    return "\n".join(x for x in blocks if x)


def test_pages_of_the_table(spark):
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    got = {r["page_id"]: r for r in rows_of(main_text.extracted(pages))}
    want = {r["page_id"]: (r["url"], plain(r["html"])) for r in pages.collect()}
    assert {i: (r["url"], r["text"]) for i, r in got.items()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


LONG = "The harbour was built in two stages, first the mole and then, ten years later, the long eastern quay that still stands today."
#: Pages of other makes than the made ones, with what is their article.
PAGES = [
    (f"<body><header class='site-header'><a href=/>Home</a> <a href=/a>About</a></header><main><h1>Harbour</h1><p>{LONG}</p><p>{LONG}</p></main><aside class=sidebar><h3>More</h3><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></aside><footer>&copy; 2020 Us</footer></body>", ["Harbour", LONG, LONG]),
    (f"<div id='cookie-banner'>We use cookies to improve this site. <button>Accept</button></div><div class='post-content'><h2>Harbour</h2><p>{LONG}</p><blockquote>{LONG}</blockquote></div><section id='comments'><h3>Comments</h3><div class=comment><p>Ann</p><p>I was there too, it is lovely in spring.</p></div></section>", ["Harbour", LONG, LONG]),
    (f"<nav class=menu><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul></nav><article><h1>Harbour</h1><div class='ad'>Buy three lamps and get one for free.</div><p>{LONG}</p><ul><li>{LONG}</li><li>{LONG}</li></ul><form class='newsletter-form'><label>Your mail</label><input name=m><button>Go</button></form><p>{LONG}</p></article>", ["Harbour", LONG, LONG, LONG, LONG]),
    (f"<table><tr><td class='nav'><a href=1>One</a><br><a href=2>Two</a><br><a href=3>Three</a></td><td class='content'><h1>Harbour</h1><p>{LONG}<p>{LONG}<p>{LONG}</td></tr></table><div class='footer'>All rights reserved. <a href=i>Imprint</a></div>", ["Harbour", LONG, LONG, LONG]),
]


@pytest.mark.parametrize("k", range(len(PAGES)))
def test_other_pages(model, k):
    assert text_of(model, PAGES[k][0]).split("\n") == PAGES[k][1]


def test_made_pages_that_nothing_was_learned_from(model):
    lost = extra = total = 0
    for seed in range(50_000, 50_150):
        page = Page(main_text.made_page(seed))
        want = page.text([page.attribute(i, "data-y") == "1" for i in range(len(page.tags))]).split("\n")
        got = text_of(model, main_text.made_page(seed)).split("\n")
        lost, extra, total = lost + len(set(want) - set(got)), extra + len(set(got) - set(want)), total + len(want)
    assert lost < 0.02 * total
    assert extra < 0.04 * total


def test_text_is_decoded_and_white_space_is_one_space(model):
    page = f"<article><h1>A &amp; B &lt;C&gt; &#233;&eacute;&#x4e2d;</h1><p>  {LONG}\n\t<b>bold</b>ly&nbsp;&nbsp;said<br/>next  line </p><p></p><p> </p><p>{LONG}</p></article>"
    assert text_of(model, page).split("\n") == ["A & B <C> éé中", f"{LONG} boldly said next line", LONG]


def test_decoding_has_no_contradictions():
    rng = np.random.default_rng(2)
    for _ in range(200):
        n = int(rng.integers(1, 60))
        page = Page("")
        page.parents = [-1, *[int(rng.integers(0, i)) for i in range(1, n)]]
        page.tags = ["html", *rng.choice(["p", "div"], n - 1).tolist()]
        kept = main_text.decoded(page, rng.random(n))
        for i in range(1, n):
            path = []
            while i >= 0:
                path.append(kept[i])
                i = page.parents[i]
            changes = sum(a != b for a, b in zip(path, path[1:], strict=False))
            assert changes <= (1 if path[0] else 2)  # outside, inside, left for good


def test_decoding_is_the_likeliest_choice():
    """Against all choices of small trees."""
    from itertools import product

    rng = np.random.default_rng(3)
    for _ in range(40):
        n = int(rng.integers(2, 8))
        page = Page("")
        page.parents, page.tags = [-1, *[int(rng.integers(0, i)) for i in range(1, n)]], ["html", *rng.choice(["p", "div"], n - 1).tolist()]
        p = rng.uniform(0.05, 0.95, n)

        def cost(states):
            total = -np.log(np.where(np.array(states) == 1, p, 1 - p)).sum()
            for i in range(1, n):
                above, own = states[page.parents[i]], states[i]
                if (above, own) not in ((0, 0), (0, 1), (1, 1), (1, 2), (2, 2)):
                    return np.inf
                total += main_text.ENTER if (above, own) == (0, 1) else (main_text.LEAVE_TEXT if page.tags[i] == "p" else main_text.LEAVE) if (above, own) == (1, 2) else 0
            return total

        best = min((s for s in product(range(3), repeat=n) if s[0] == 0), key=cost)
        got = main_text.decoded(page, p)
        assert np.isclose(min(cost(s) for s in product(range(3), repeat=n) if s[0] == 0 and [x == 1 for x in s] == got), cost(best))


def test_blocks_of_broken_markup():
    read = lambda h: Page(h).text([True] * len(Page(h).tags))
    assert read("<p>a<p>b</div></p><b>c<p>d</b>e") == "a\nb\nc\nde"
    assert read("<ul><li>a<li>b<ul><li>c</ul>d</ul>e<") == "a\nb\nc\nd\ne<"
    assert read("<table><tr><td>a<td>b<tr><th>c</table>d") == "a\nb\nc\nd"
    assert read("<script>if (a < b) '</p>'; x</script>a<style>p{}</style><!-- <p>no</p> -->b<textarea><p>no</textarea>c<script>never ended <p>x") == "abc"
    assert read("<title>no<p></title><p title='a > b'>one</p><p title=\"it's\">two") == "one\ntwo"
    assert read("<head><meta charset=utf-8><body>a<button>no<p>b") == "a\nb"
    assert read("a & b &amp;lt; 1 < 2 <3 </ p> <a href='x>y") == "a & b &lt; 1 < 2 <3 y"
    assert read("") == read("<div><br></div>") == ""


def test_attributes():
    assert attribute_tokens(" class='site-Header navBar_2' id=Top data-x=no style='display: none'") == {"site", "header", "nav", "bar", "top", "display", "none", "hidden"}
    assert attribute_tokens("") == attribute_tokens(" href='/nav'") == set()


def test_edges(spark):
    """Null, empty, repeated and very long pages, null ids, columns that clash, deep nesting; an empty table."""
    long = "<article><h1>T</h1>" + f"<p>{LONG}</p>" * 8000 + "</article>"
    rows = [(1, "u", None), (2, None, ""), (2, None, ""), (None, "u", "<p>"), (3, "u", long), (4, "u", "<div>" * 3000 + "x" + "</div>" * 10), (5, "u", "<" * 5000 + '"' * 999)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS id", "2 AS text", "3 AS n_chars")
    got = rows_of(main_text.extracted(pages))
    assert sorted((r["page_id"] or 0, r["url"] or "") for r in got) == sorted((i or 0, u or "") for i, u, _ in rows)
    assert next(r["text"] for r in got if r["page_id"] == 3) == "\n".join(["T", *[LONG] * 8000])
    assert all(r["text"] == "" for r in got if r["page_id"] in (1, 2, None))
    assert main_text.extracted(pages.limit(0)).count() == 0
