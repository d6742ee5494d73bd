"""Main text of pages: the cut against all labellings, pages of many layouts, broken markup, whole tables."""

from __future__ import annotations

import html
import itertools
import random
import re

import pytest
from conftest import DATA

from deskstream.llm import maincontent as m

BODY = "The committee met on Tuesday to discuss the new budget, which will cover roads and schools. Members voted after two hours of debate."


def test_cut_is_the_cheapest_labelling():
    rng = random.Random(5)
    for _ in range(300):
        n = rng.randrange(1, 9)
        excess = [rng.randrange(-9, 10) for _ in range(n)]
        edges = [(a, b, rng.randrange(0, 6)) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.5]

        def cost(labels):
            ends = sum(max(x, 0) if not on else max(-x, 0) for x, on in zip(excess, labels))
            return ends + sum(w for a, b, w in edges if labels[a] != labels[b])

        got = m.minimum_cut(excess, edges)
        assert cost(got) == min(cost(x) for x in itertools.product([False, True], repeat=n))


def test_cut_of_a_long_chain_ends():
    rng = random.Random(6)
    excess = [rng.randrange(-3000, 3000) for _ in range(30_000)]
    labels = m.minimum_cut(excess, [(k, k + 1, 1000) for k in range(len(excess) - 1)])
    assert any(labels) and not all(labels)


PAGES = [
    (
        f'<body class="has-sidebar"><div id="header"><a href="/">My Site</a> Tagline here</div><ul class="menu"><li><a>Home</a><li><a>About us</a></ul>'
        f'<div id="content"><h1>Budget agreed</h1><p>{BODY}<p>Short.<p>{BODY}<ul><li>One item of it</li></ul></div><div id="sidebar"><h3>Recent posts</h3>'
        "<ul><li><a>Post one</a></ul><p>About me: I write about budgets and other things.</p></div><div id=comments><p>Great article, I really liked this a lot.</p></div>"
        '<div class="footer">Copyright 2020 Someone. All rights reserved.</div>',
        f"Budget agreed {BODY} Short. {BODY} One item of it",
    ),
    (
        f'<div class="cookie-notice"><p>We use cookies to make this site better for you. By using it you agree.</p><button>OK</button></div><main><h1>Title</h1><p>{BODY}</p>'
        f"<form><label>Email</label><input><p>Subscribe to our newsletter to receive updates every week.</p></form><p>{BODY}</p><aside>Related: other story to read today.</aside>"
        f'<p>Ends.</p></main><section id="comments"><article class="comment"><p>{BODY}</p></article></section>',
        f"Title {BODY} {BODY} Ends.",
    ),
    (f'<form id="form1"><div><p>{BODY}</p><p>{BODY}</p></div><input></form>', f"{BODY} {BODY}"),
    (
        f'<article class="post comments-open"><header><h1>Head</h1></header><div class="entry-content"><p>{BODY}</p><pre>code()</pre></div><footer>Tags: a, b</footer></article>',
        f"Head {BODY} code()",
    ),
    (f"<p>{BODY} <b>bold <i>it</b> ta<u>il</u>s</i> &amp; 3 &lt; 4 &nbsp;&#120;<br>y\n\tz<!-- never closed <p>gone</p>", f"{BODY} bold it tails & 3 < 4 x y z"),
    (f'<article><p>{BODY}<p hidden>secret words are in here.</p></article><noscript>Enable scripts please now.</noscript><script>var t="</p>";</script><style>p{{}}</style>', BODY),
    (f"<div><div><a>A</a> | <a>B</a> | <a>C</a></div><div>{BODY}<br><br>{BODY}</div><div><a>Next page</a></div></div>", f"{BODY} {BODY}"),
    ('<article><p>Hello <span class="ad">Buy now!</span> world of text.</p></article>', "Hello world of text."),
    (f"<nav><a>One</a><a>Two</a></nav><article><p>{BODY}</p><nav>Part 1 of 2, see the other part of this.</nav></article><div role=alert>Your account will expire soon.</div>", BODY),
    (f"<head><title>T</title><p>{BODY}", BODY),
    (f"<TABLE><TR><TD><A HREF=1>x</A><TD><P>{BODY}</P><P>{BODY}</TABLE><p class='advert'>{BODY}", f"{BODY} {BODY}"),
    ("<ul><li><a>One</a></li><li><a>Two</a></li></ul>", ""),
    ("Just text without markup.", "Just text without markup."),
    ("<div", ""),
    ("<script>never closed", ""),
    ("<!-- x", ""),
    ("   ", ""),
]


@pytest.mark.parametrize("page,want", PAGES)
def test_layouts(page, want):
    assert m.main_text(page) == want


def test_deep_and_long_pages_end():
    assert m.main_text("<div>" * 20_000 + f"<p>{BODY}</p>" + "</div>" * 20_000) == BODY
    long = "<article>" + "".join(f"<p>{BODY} {k}.</p>" for k in range(20_000)) + "</article>"
    assert len(m.main_text(f"<nav><a>x</a></nav>{long}").split()) == 20_000 * 24


def test_whole_table(spark):
    """The generated pages hold their text in one article: a plain reading of that element is the reference."""
    rows = m.extract(spark.read.parquet(f"{DATA}/pages.parquet")).collect()
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        inside = re.search("<article>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        inside = re.sub("<[^>]*>", "", re.sub("</?(?:p|h1)>|<br>", "\x01", inside))
        assert r["text"] == " ".join(html.unescape(inside).replace("\x01", " ").split()) and r["n_chars"] == len(r["text"])


def test_awkward_rows(spark):
    schema = "page_id bigint, url string, html string, text string, n_chars int"
    rows = [(1, None, None, "x", 1), (1, "u", "", "x", 1), (None, "u", f"<p>{BODY}", None, 1), (None, "u", f"<p>{BODY}", None, 1), (2, "u", "<p>\U0001f600 é.", None, 2)]
    got = m.extract(spark.createDataFrame(rows, schema).repartition(2)).collect()
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in got) == [(0, BODY, len(BODY))] * 2 + [(1, "", 0)] * 2 + [(2, "\U0001f600 é.", 4)]
    assert m.extract(spark.createDataFrame([], schema)).count() == 0
