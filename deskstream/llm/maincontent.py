"""Main text of web pages by minimum-cut labelling.

A page becomes blocks: runs of text between block-level tags, each with the chain of elements around it.
A classifier gives every block log-odds of being content (``log_odds``): from its words, sentence marks and
share of link text, and from what the elements around it say by tag, role, id and class. The log-odds are
capacities to the two terminals, adjacency in page order and nearness in the element tree are capacities
between blocks (``edges``), and a maximum flow gives the labelling of least total cost: blocks that the
source still reaches are content. So a short or odd paragraph between content stays, and a sentence among
links goes. Capacities are integers, so equal pages give equal texts everywhere. Pages are narrow work:
no row is shuffled.

Defined results: a null or empty page, and one without content, gives the empty string. Markup may be
broken: unclosed and unmatched tags are read as browsers read them in the common cases, an unfinished tag or
comment at the end is dropped. Repeated rows give repeated rows, an empty table none. Long pages are read
whole, one at a time. Only page_id, url and html are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from math import log1p

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskstream.llm import common as c

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*)(?:(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|(?P<loose>[^>]*)(?:>|\Z))",
    re.S,
)
ATTRIBUTE = re.compile(r"([A-Za-z][\w:-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
SENTENCE = re.compile(r"[.!?…。！？][\"'”’»)]*(?:\s|\Z)")

SEPARATORS = " \t\r\n\xa0|·•»›/,-–—"  # between links these are not text

# elements by kind
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li main menu nav object ol optgroup option p pre search section select summary svg table tbody td template tfoot th"
    " thead tr ul".split()
)
UNSEEN = frozenset("audio canvas datalist math noscript object option select svg template video".split())
#: A start tag of the key ends an open element of the value, unless one of FENCE stands between.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
FENCE = frozenset("article aside body button div dl form main ol section table ul".split())
ENDS_NOT_P = frozenset("body button html option optgroup td th tr tbody thead tfoot object svg template select".split())

# what elements say about the text in them: log-odds
TAG_FOR = {"article": 4.0, "main": 3.0, "p": 0.8, "h1": 0.8, "h2": 0.6, "h3": 0.6, "blockquote": 0.6, "pre": 0.6}
TAG_AGAINST = {
    "nav": 14.0, "menu": 14.0, "footer": 10.0, "aside": 10.0, "dialog": 14.0, "button": 10.0, "label": 6.0, "legend": 6.0,
    "header": 8.0, "search": 14.0, "fieldset": 8.0,
}
ROLE_FOR = {"main": 3.0, "article": 4.0}
ROLE_AGAINST = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar status form tablist".split())
NAMES_FOR = {"article": 2.0, "articlebody": 4.0, "story": 2.0, "post": 1.5, "entry": 1.5, "content": 1.0, "main": 1.0, "body": 0.5, "text": 0.5}
NAMES_AGAINST = frozenset(
    "ad ads adbox advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification alert popup modal"
    " overlay newsletter subscribe subscription signup signin login register sidebar sidebars widget widgets rail related recommended recommendations trending popular share sharing social"
    " follow breadcrumb breadcrumbs menu menus nav navbar navigation pagination pager footer masthead topbar toolbar search comment comments commentlist reply replies respond disqus"
    " feedback skip copyright legal disclaimer hidden header sitemap tagcloud teaser teasers paywall form".split()
)
NAMES_NEUTRAL = frozenset("reader readers user list item box block wrap wrapper container section area inner outer site page bar link links top bottom left right".split())
NAME_AGAINST, ROLE_COST, UNSEEN_COST, FORM_COST = 12.0, 14.0, 60.0, 8.0
ARTICLE = 3.0  # evidence from here on marks the element as the page's article
OUTSIDE = 4.0
NEAR, NEAR_DECAY, SIBLING, COUSIN = 0.8, 0.75, 0.4, 0.2
SCALE = 1000

SCHEMA = "page_id bigint, url string, text string"


@lru_cache(1 << 14)
def evidence(tag: str, attrs: str) -> tuple[float, float]:
    """What an element says for and against its text, from its tag and attributes."""
    plus, minus = TAG_FOR.get(tag, 0.0), TAG_AGAINST.get(tag, 0.0)
    if tag in UNSEEN:
        minus += UNSEEN_COST
    if not attrs or attrs.isspace():
        return plus, minus
    whole = tag in ("html", "body", "main", "article")
    for match in ATTRIBUTE.finditer(attrs):
        name = match[1].lower()
        value = unescape(match[2] or match[3] or match[4] or "")
        if name == "role":
            role = value.strip().lower()
            plus, minus = max(plus, ROLE_FOR.get(role, 0.0)), minus + (ROLE_COST if role in ROLE_AGAINST else 0.0)
        elif name == "itemprop" and value.lower() == "articlebody":
            plus = max(plus, 4.0)
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            minus += UNSEEN_COST if not whole else 0.0
        elif name in ("class", "id"):
            for one in value.split():
                words = {w.lower() for w in NAME_WORD.findall(one)} - ({"form"} if tag == "form" else set())
                bad = words & NAMES_AGAINST
                # the page's outer elements carry state in their names ("comments-open"): there a name counts if it says nothing else
                if bad and (not whole or (tag not in ("html", "body") and words <= NAMES_AGAINST | NAMES_NEUTRAL)):
                    minus = max(minus, NAME_AGAINST)
                elif not bad:
                    plus = max([plus, *(NAMES_FOR[w] for w in words & NAMES_FOR.keys()), 4.0 if one.lower() == "articlebody" else 0.0])
    return plus, minus


class Page:
    """The blocks of a page and the elements around them."""

    def __init__(self, html: str) -> None:
        self.parent, self.depth, self.plus, self.minus, self.tags, self.form = [-1], [0], [0.0], [0.0], [""], [0]
        self.texts: list[str] = []
        self.linked: list[float] = []
        self.node: list[int] = []
        self._open = [0]
        self._links = 0
        self._parts: list[str] = []
        self._link_chars = self._chars = 0
        at = 0
        position = 0
        while match := TOKEN.search(html, position):
            if match.start() > at:
                self._text(html[at : match.start()])
            at = position = match.end()
            if not match["tag"]:
                continue
            tag = match["tag"].lower()
            if match["end"]:
                self._close(tag)
            elif tag in RAW:
                ending = re.compile(f"</{tag}(?=[\\s/>]|\\Z)", re.I).search(html, at)
                at = position = ending.start() if ending else len(html)
            else:
                self._start(tag, match["attrs"] or match["loose"] or "")
        self._text(html[at:])
        self._flush()

    def _text(self, raw: str) -> None:
        if raw:
            text = unescape(raw)
            self._parts.append(text)
            size = len(text.strip(None if self._links else SEPARATORS))
            self._chars += size
            if self._links:
                self._link_chars += size

    def _flush(self) -> None:
        if self._parts:
            text = " ".join("".join(self._parts).split())
            if text:
                self.texts.append(text)
                self.linked.append(self._link_chars / max(self._chars, 1))
                self.node.append(self._open[-1])
            self._parts, self._link_chars, self._chars = [], 0, 0

    def _start(self, tag: str, attrs: str) -> None:
        if tag in VOID or tag == "head":  # what a head holds is void, raw or unseen; its end is often missing
            if tag == "br":
                self._parts.append(" ")
            elif tag == "hr":
                self._flush()
            return
        plus, minus = evidence(tag, attrs)
        block = tag in BLOCK or minus > 0
        if block:
            self._flush()
            if tag not in ENDS_NOT_P and tag in BLOCK:
                self._end_open(("p",))
        if tag in ENDS:
            self._end_open(ENDS[tag])
        up = self._open[-1]
        # an element inside an article says little more for its text; a header of the article is part of it
        if tag == "header" and self.plus[up] >= ARTICLE:
            minus = max(0.0, minus - TAG_AGAINST["header"])
        self.parent.append(up)
        self.depth.append(self.depth[up] + block)
        self.plus.append(max(self.plus[up], plus))
        self.minus.append(self.minus[up] + minus)
        self.tags.append(tag)
        self.form.append(len(self.parent) - 1 if tag == "form" else self.form[up])
        self._open.append(len(self.parent) - 1)
        self._links += tag == "a"

    def _end_open(self, tags: tuple[str, ...]) -> None:
        for k in range(len(self._open) - 1, 0, -1):
            tag = self.tags[self._open[k]]
            if tag in tags:
                self._pop(k)
                return
            if tag in FENCE:
                return

    def _close(self, tag: str) -> None:
        for k in range(len(self._open) - 1, 0, -1):
            if self.tags[self._open[k]] == tag:
                self._pop(k)
                return
            if tag not in BLOCK and self.tags[self._open[k]] in FENCE:
                return  # the end of an inline element does not end the blocks in it

    def _pop(self, k: int) -> None:
        gone = self._open[k:]
        if any(self.tags[x] in BLOCK or self.minus[x] > self.minus[self.parent[x]] for x in gone):
            self._flush()
        self._links -= sum(self.tags[x] == "a" for x in gone)
        del self._open[k:]

    def holder(self, node: int) -> int:
        """The nearest block-level element at or above ``node``."""
        while node and self.depth[node] == self.depth[self.parent[node]]:
            node = self.parent[node]
        return node

    def log_odds(self) -> list[float]:
        """The classifier: log-odds of content for each block."""
        sizes: dict[int, int] = {}
        for text, node in zip(self.texts, self.node):
            sizes[self.form[node]] = sizes.get(self.form[node], 0) + len(text)
        half = sum(sizes.values()) / 2  # a form around most of the page is its frame, not a form to fill in
        article = any(self.plus[x] >= ARTICLE and self.minus[x] == 0 for x in self.node)
        out = []
        for text, linked, node in zip(self.texts, self.linked, self.node):
            words = text.count(" ") + 1
            z = -1.6 + min(1.1 * log1p(words), 5.0) + 0.6 * bool(SENTENCE.search(text)) - 4.0 * linked - 3.0 * text.startswith("©")
            z += self.plus[node] - self.minus[node] - FORM_COST * bool(self.form[node] and sizes[self.form[node]] < half)
            if article and self.plus[node] < ARTICLE:
                z -= OUTSIDE
            out.append(z)
        return out

    def edges(self) -> list[tuple[int, int, float]]:
        """Smoothness: (block, later block, weight) for neighbours in page order and for neighbours below one parent or grandparent."""
        out = []
        holders = [self.holder(x) for x in self.node]
        near: dict[tuple[int, int], int] = {}
        for k, low in enumerate(holders):
            up = self.holder(max(self.parent[low], 0))
            above = self.holder(max(self.parent[up], 0))
            if k:
                out.append((k - 1, k, NEAR * NEAR_DECAY ** (self.distance(holders[k - 1], low) - 1) if holders[k - 1] != low else NEAR))
            for level, (name, weight) in enumerate(((up, SIBLING), (above, COUSIN))):
                before = near.get((level, name))
                if before is not None:
                    out.append((before, k, weight))
                near[level, name] = k
        return out

    def distance(self, one: int, other: int) -> int:
        """Block-level steps between two elements through their common ancestor."""
        steps = self.depth[one] + self.depth[other]
        while one != other:
            if one > other:
                one = self.parent[one]
            else:
                other = self.parent[other]
        return steps - 2 * self.depth[one]


def minimum_cut(excess: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """True for nodes on the source side of a minimum cut.

    A positive ``excess`` is the capacity from the source, a negative one that to the sink; an edge holds its
    capacity both ways. Maximum flow by level graphs and blocking flows, from all sources at once.
    """
    n = len(excess)
    left = list(excess)
    to: list[int] = []
    room: list[int] = []
    arcs: list[list[int]] = [[] for _ in range(n)]
    for a, b, weight in edges:
        arcs[a].append(len(to))
        arcs[b].append(len(to) + 1)
        to += [b, a]
        room += [weight, weight]
    while True:
        level = [-1] * n
        line = [x for x in range(n) if left[x] > 0]
        for x in line:
            level[x] = 0
        reached = False
        for x in line:
            reached |= left[x] < 0
            for arc in arcs[x]:
                if room[arc] and level[to[arc]] < 0:
                    level[to[arc]] = level[x] + 1
                    line.append(to[arc])
        if not reached:
            return [x >= 0 for x in level]
        begun = [0] * n
        for source in line:
            if level[source]:
                break
            path: list[int] = []
            x = source
            while left[source] > 0:
                if left[x] < 0:
                    push = min(left[source], -left[x], *(room[arc] for arc in path))
                    left[source] -= push
                    left[x] += push
                    for arc in path:
                        room[arc] -= push
                        room[arc ^ 1] += push
                    # back to the first arc that is full
                    full = next((k for k, arc in enumerate(path) if not room[arc]), None)
                    if full is not None:
                        x = to[path[full] ^ 1]
                        del path[full:]
                    continue
                while begun[x] < len(arcs[x]):
                    arc = arcs[x][begun[x]]
                    if room[arc] and level[to[arc]] == level[x] + 1:
                        break
                    begun[x] += 1
                else:
                    if not path:
                        break
                    x = to[path.pop() ^ 1]
                    begun[x] += 1
                    continue
                path.append(arc)
                x = to[arc]


def main_text(html: str | None) -> str:
    """Texts of a page's content blocks, in page order."""
    if not html:
        return ""
    page = Page(html)
    excess = [round(z * SCALE) for z in page.log_odds()]
    if not any(x > 0 for x in excess):
        return ""
    if any(x < 0 for x in excess):
        content = minimum_cut(excess, [(a, b, round(w * SCALE)) for a, b, w in page.edges()])
    else:
        content = [True] * len(excess)
    return " ".join(text for text, good in zip(page.texts, content) if good)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(html.as_py()) for html in batch.column(2)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts], names=["page_id", "url", "text"])

    c.ready(pages.sparkSession)
    return pages.select("page_id", "url", "html").mapInArrow(run, SCHEMA).withColumn("n_chars", F.length("text").cast("bigint"))
