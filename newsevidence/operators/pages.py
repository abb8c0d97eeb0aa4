"""Article text from landed web pages."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from html.parser import HTMLParser
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import (
    LOW_QUALITY, MIN_ARTICLE_CHARS, MIN_ARTICLE_PARAGRAPHS, col, join_paragraphs, keep_paragraphs, passes_quality,
)
from ..functions.web import blocked_suspected, content_type_error, fetch_error

# Tags, markers, phrases and weights of the extraction rules.
DROPPED_TAGS = {"script", "style", "nav", "footer", "header", "aside", "form", "noscript"}
BOILERPLATE_TAGS = {"nav", "footer", "header", "aside", "form", "button", "dialog", "noscript"}
BOILERPLATE_MARKERS = [
    "subscribe", "newsletter", "cookie", "advert", "sponsor", "promo", "related", "recommended", "comments",
    "share", "social", "signin", "sign-in",
]
BOILERPLATE_PHRASES = ["accept cookies", "subscribe", "sign in"]
MAX_LINK_SHARE = 0.35
ANCESTRY = 8
MIN_CONTAINER_PARAGRAPHS = 3
SCORED_PARAGRAPHS = 30
DEPTH_WEIGHT = 50
MAX_DEPTH = 10
# The parts of the HTML standard the tree builder follows.
VOID_TAGS = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
HEAD_TAGS = {"head", "title", "meta", "link", "script", "style", "base", "noscript"}
CLOSES_P = {
    "address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main",
    "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "ul", "li", "dd", "dt",
}
P_SCOPE = {"button", "caption", "html", "object", "table", "td", "template", "th"}
CLOSES_SELF = {
    "li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "option": {"option"}, "tr": {"tr", "td", "th"},
    "td": {"td", "th"}, "th": {"td", "th"},
}
SELF_SCOPE = {"ul", "ol", "dl", "select", "table", "body", "html"}
BLOCK_TAGS = CLOSES_P | {"body", "html", "td", "th", "tr", "tbody", "thead", "option"}
_BLANKS = np.array([ord(c) for c in " \t\n\f\r\xa0"], np.uint32)


#: What an answer says about the version of its page.
VALIDATORS = ("http_etag", "http_last_modified")
UNREADABLE = "Page can't be read: "


class _Node:
    """Element of a page. ``at``/``end`` number it and its subtree in document order, ``lo``/``hi`` its text pieces."""

    __slots__ = ("tag", "attrs", "parent", "children", "depth", "at", "end", "lo", "hi")

    def __init__(self, tag: str, attrs: dict, parent: "_Node | None"):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []
        self.depth = 0 if parent is None else parent.depth + 1

    def lineage(self, most: int):
        node = self
        while node is not None and most > 0:
            yield node
            node, most = node.parent, most - 1


class _Tree(HTMLParser):
    """Lenient tree of a page. Dropped tags are parsed but never attached."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = _Node("html", {}, None)
        self.body: _Node | None = None
        self.open = [self.root]
        self.counts: Counter = Counter()
        self.feed(html)
        self.close()
        self.nodes: list[_Node] = []
        self.pieces: list[str] = []
        self._number()
        self._lay_out()

    def _number(self) -> None:
        """One walk with a stack of its own: document order, and the text pieces below each element."""
        stack: list = [(self.root, False)]
        while stack:
            item, leaving = stack.pop()
            if isinstance(item, str):
                self.pieces.append(item)
            elif leaving:
                item.end, item.hi = len(self.nodes), len(self.pieces)
                if item.tag in BLOCK_TAGS:
                    self.pieces.append(" ")
            else:
                if item.tag == "br" or item.tag in BLOCK_TAGS:
                    self.pieces.append(" ")
                item.at, item.lo = len(self.nodes), len(self.pieces)
                self.nodes.append(item)
                stack.append((item, True))
                stack.extend((child, False) for child in reversed(item.children))

    def _lay_out(self) -> None:
        """The text of the whole page, runs of blanks made one, and where each piece of it begins."""
        raw = np.frombuffer("".join(self.pieces).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
        blank = np.isin(raw, _BLANKS)
        raw[blank] = 32
        keep = np.ones(len(raw), bool)
        keep[1:] = ~(blank[1:] & blank[:-1])
        place = np.concatenate(([0], np.cumsum(keep)))
        ends = np.cumsum([0] + [len(piece) for piece in self.pieces])
        self.flat = raw[keep].tobytes().decode("utf-32-le", "surrogatepass")
        self.place = place[ends].tolist()

    def span(self, node: _Node) -> tuple[int, int]:
        """Where the text of an element lies in the page's, blanks at its ends left out."""
        low, high = self.place[node.lo], self.place[node.hi]
        # A run of blanks that the element shares with what stands before it is counted there.
        if low < high and self.flat[low] == " ":
            low += 1
        if low < high and self.flat[high - 1] == " ":
            high -= 1
        return low, max(low, high)

    def text(self, node: _Node) -> str:
        low, high = self.span(node)
        return self.flat[low:high]

    def _cut(self, i: int) -> None:
        for node in self.open[i:]:
            self.counts[node.tag] -= 1
        del self.open[i:]

    def _ensure_body(self) -> None:
        if self.body is None:
            self.body = _Node("body", {}, self.root)
            self.root.children.append(self.body)
        self._cut(1)
        self.open.append(self.body)
        self.counts["body"] += 1

    def _pop_to(self, tags: set[str], stop: set[str]) -> bool:
        if not any(self.counts[t] for t in tags):
            return False
        for i in range(len(self.open) - 1, 0, -1):
            tag = self.open[i].tag
            if tag in tags:
                self._cut(i)
                return True
            if tag in stop:
                return False
        return False

    def handle_starttag(self, tag, attrs):
        if tag == "html":
            return
        if tag == "body":
            self._ensure_body()
            self.body.attrs = dict(attrs)
            return
        if self.body is None and tag not in HEAD_TAGS:
            self._ensure_body()
        if tag in CLOSES_P:
            self._pop_to({"p"}, P_SCOPE)
        if tag in CLOSES_SELF:
            self._pop_to(CLOSES_SELF[tag], SELF_SCOPE)
        node = _Node(tag, dict(attrs), self.open[-1])
        if tag not in DROPPED_TAGS:
            self.open[-1].children.append(node)
        if tag not in VOID_TAGS:
            self.open.append(node)
            self.counts[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in ("html", "body"):
            return
        self._pop_to({tag}, {"html", "body"} if tag in BLOCK_TAGS | DROPPED_TAGS else BLOCK_TAGS - {"p"})

    def handle_data(self, data):
        if self.body is None and data.strip() and self.open[-1] is self.root:
            self._ensure_body()
        self.open[-1].children.append(data)


def _container(tree: _Tree, paragraphs: list[_Node], lengths: list[int]) -> _Node | None:
    wanted = (
        lambda n: n.tag == "article",
        lambda n: n.attrs.get("itemprop") == "articleBody",
        lambda n: n.tag == "main",
    )
    for test in wanted:
        found = next((n for n in tree.nodes[1:] if test(n)), None)
        if found is not None:
            return found
    order = [p.at for p in paragraphs]
    filled = [i for i, n in enumerate(lengths) if n]
    summed = [0, *accumulate(lengths[i] for i in filled)]
    best, best_score = tree.body, 0
    for node in tree.nodes:
        if node.tag not in ("div", "section"):
            continue
        first, last = bisect_right(order, node.at), bisect_left(order, node.end)
        if last - first < MIN_CONTAINER_PARAGRAPHS:
            continue
        low = bisect_left(filled, first)
        high = min(low + SCORED_PARAGRAPHS, bisect_left(filled, last))
        points = summed[high] - summed[low] - DEPTH_WEIGHT * min(MAX_DEPTH, node.depth)
        if points > best_score:
            best, best_score = node, points
    return best


def _is_boilerplate(p: _Node, text: str, linked: int) -> bool:
    if not text or any(n.tag in BOILERPLATE_TAGS for n in p.lineage(ANCESTRY)):
        return True
    if linked / len(text) > MAX_LINK_SHARE:
        return True
    names = f"{p.attrs.get('class') or ''} {p.attrs.get('id') or ''}".lower()
    lower = text.lower()
    return any(m in names for m in BOILERPLATE_MARKERS) or any(m in lower for m in BOILERPLATE_PHRASES)


def page_paragraphs(html: str) -> list[str]:
    """Paragraph texts of the main container that are not boilerplate.

    The page is walked once. Lengths of texts and links are differences of running sums, so the time follows the length
    of the page and of what comes out, whatever the nesting.
    """
    tree = _Tree(html)
    paragraphs = [n for n in tree.nodes if n.tag == "p"]
    spans = [tree.span(p) for p in paragraphs]
    container = _container(tree, paragraphs, [b - a for a, b in spans])
    if container is None:
        return []
    anchors = [n for n in tree.nodes if n.tag == "a"]
    order = [n.at for n in anchors]
    # The links of a paragraph count with a blank between them.
    linked = [0, *accumulate(b - a + 1 for a, b in map(tree.span, anchors))]
    first = bisect_right(paragraphs, container.at, key=lambda n: n.at)
    last = bisect_left(paragraphs, container.end, key=lambda n: n.at)
    out = []
    for p, (a, b) in zip(paragraphs[first:last], spans[first:last]):
        text, low, high = tree.flat[a:b], bisect_right(order, p.at), bisect_left(order, p.end)
        if not _is_boilerplate(p, text, max(0, linked[high] - linked[low] - 1)):
            out.append(text)
    return out


@F.pandas_udf(T.StructType([T.StructField("paragraphs", T.ArrayType(T.StringType())), T.StructField("error", T.StringType())]))
def _paragraphs(pages: pd.Series) -> pd.DataFrame:
    """A page that can't be read says why; it does not end the job."""
    rows = []
    for html in pages:
        try:
            rows.append((None if html is None else page_paragraphs(html), None))
        except Exception as e:  # noqa: BLE001
            rows.append(([], f"{type(e).__name__}: {e}"))
    return pd.DataFrame(rows, columns=["paragraphs", "error"])


# Marked so that filters on its result are not pushed below it, which would parse pages twice.
_walk_once = _paragraphs.asNondeterministic()


def paragraphs(html) -> Column:
    """Kept paragraphs of a page; the length and repeat rules run natively after the tree walk."""
    return keep_paragraphs(_walk_once(col(html))["paragraphs"])


def extract_pages(pages: DataFrame, html: str = "html", *, min_paragraphs: int = MIN_ARTICLE_PARAGRAPHS,
                  min_chars: int = MIN_ARTICLE_CHARS) -> DataFrame:
    """Adds ``n_paragraphs``, ``extracted_text`` and ``extraction_error`` to page rows.

    A page that the walk fails on has no paragraphs and names the fault.
    """
    read = pages.withColumn("_read", _walk_once(col(html)))
    parsed = read.withColumn("_p", keep_paragraphs(F.col("_read.paragraphs")))
    joined = parsed.withColumn("_text", join_paragraphs("_p")).withColumn("n_paragraphs", F.size("_p"))
    ok = passes_quality("_text", "n_paragraphs", min_paragraphs, min_chars)
    return joined.select(
        *pages.columns,
        "n_paragraphs",
        F.when(ok, F.col("_text")).alias("extracted_text"),
        F.when(F.col("_read.error").isNotNull(), F.concat(F.lit(UNREADABLE), "_read.error"))
        .when(~ok, F.lit(LOW_QUALITY)).alias("extraction_error"),
    )


def fetch_results(pages: DataFrame, *, keep: tuple[str, ...] = (), min_paragraphs: int = MIN_ARTICLE_PARAGRAPHS,
                  min_chars: int = MIN_ARTICLE_CHARS) -> DataFrame:
    """Fetch results of landed ``pages(page_id, url, http_status, content_type, body)``.

    Only 2xx HTML bodies are parsed. Columns in ``keep`` are passed through, and so are the validators of an answer
    (``http_etag``, ``http_last_modified``) where it was landed with them, whatever its status.
    """
    keep = (*[c for c in VALIDATORS if c in pages.columns and c not in keep], *keep)
    noted = pages.select(
        "page_id",
        F.col("url").alias("final_url"),
        "http_status",
        blocked_suspected("http_status", "body").alias("blocked_suspected"),
        fetch_error("http_status", "body").alias("fetch_error"),
        content_type_error("http_status", "content_type").alias("_type_error"),
        "body",
        *keep,
    )
    usable = F.col("fetch_error").isNull() & F.col("_type_error").isNull()
    parsed = extract_pages(
        noted.withColumn("_html", F.when(usable, F.col("body"))).drop("body"), "_html",
        min_paragraphs=min_paragraphs, min_chars=min_chars,
    )
    return parsed.select(
        "page_id",
        "final_url",
        "http_status",
        "blocked_suspected",
        "fetch_error",
        F.when(usable, F.col("extraction_error")).otherwise(F.col("_type_error")).alias("extraction_error"),
        F.when(usable, F.col("extracted_text")).alias("extracted_text"),
        *keep,
    )
