"""Main text of web pages: flat text blocks judged by a small decision tree.

A page becomes a flat list of text blocks, cut at block-level tags. Each block has its
word count and link density, those of its neighbours, and four marks of its markup:
inside an article or main element, inside boilerplate (nav, footer, aside, form, or a
class, id or role whose words all say so), being a heading, and inside something whose
name only hints at boilerplate. A CART tree trained on the small labelled table below
decides which blocks are main text.

Scripts, styles, comments, hidden templates and the head have no text. Character
references are decoded, white space inside a block becomes one space, blocks are joined by
one ``\n``. Tags that end with the page are dropped; unclosed ones end with it. A null
page is empty. Rows may repeat: each gives a row. An empty table gives an empty result;
columns other than page_id, url and html are left out.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

TAG = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|$)|</[^>]*(?:>|$)", re.S)
HINTS = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
# What elements mean.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q ruby rp rt s samp small span strike strong sub sup time tt u var wbr".split())
SILENT = frozenset("noscript template head select option svg math iframe object canvas audio video".split())
RAW = frozenset("script style textarea title".split())
IN_HEAD = frozenset("base link meta noscript script style template title".split())
BREAKS = frozenset("article aside blockquote body div dl footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILER = frozenset("nav footer aside form menu dialog button fieldset header".split())
MAIN = frozenset(["article", "main"])
# Words in class, id and role that name boilerplate, that hint at it, and that say nothing.
BOILER_WORDS = frozenset(
    "ad ads advert adverts advertisement breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer hidden login menu modal nav navbar "
    "navigation newsletter pagination pager popup promo promoted replies search share sharing sidebar signup social sponsor sponsored sponsors subscribe".split()
)
HINT_WORDS = frozenset("banner copyright disclaimer foot header legal masthead notice recommended recommendations related side toolbar widget widgets".split())
PLAIN_WORDS = frozenset("area bar block bottom box center col column container form group inner item items left links list outer panel right row section site top wrap wrapper".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
FEATURES = ("words", "links", "words before", "links before", "words after", "links after", "in article", "in boilerplate", "heading", "hint")
# The labelled table: features in the order above, then 1 for main text.
LABELLED = [
    # menus and link lists
    (1, 1.0, 0, 0.0, 1, 1.0, 0, 1, 0, 0, 0), (2, 1.0, 1, 1.0, 2, 1.0, 0, 1, 0, 0, 0), (1, 1.0, 1, 1.0, 8, 0.0, 0, 1, 0, 0, 0), (3, 1.0, 2, 1.0, 4, 1.0, 0, 0, 0, 0, 0),
    (5, 1.0, 6, 1.0, 5, 1.0, 0, 0, 0, 0, 0), (12, 0.9, 9, 1.0, 10, 1.0, 0, 0, 0, 0, 0), (2, 1.0, 0, 0.0, 3, 1.0, 0, 0, 0, 0, 0), (7, 0.8, 60, 0.0, 9, 1.0, 0, 0, 0, 0, 0),
    # adverts, notices, footers, forms, comments
    (8, 0.0, 1, 1.0, 11, 0.0, 0, 1, 0, 0, 0), (14, 0.0, 1, 1.0, 10, 0.0, 0, 1, 0, 0, 0), (40, 0.1, 80, 0.0, 0, 0.0, 0, 1, 0, 0, 0), (60, 0.0, 45, 0.0, 20, 0.0, 0, 1, 0, 0, 0),
    (6, 0.0, 50, 0.0, 0, 0.0, 0, 1, 0, 0, 0), (3, 0.0, 70, 0.0, 2, 0.0, 1, 1, 0, 0, 0), (25, 0.0, 60, 0.0, 30, 0.0, 1, 1, 0, 0, 0), (9, 0.0, 90, 0.0, 40, 0.0, 0, 1, 1, 0, 0),
    (4, 0.0, 0, 0.0, 2, 1.0, 0, 0, 0, 0, 0), (5, 0.2, 3, 0.5, 0, 0.0, 0, 0, 0, 0, 0), (6, 0.0, 5, 1.0, 4, 1.0, 0, 0, 0, 0, 0), (2, 0.0, 1, 1.0, 3, 0.0, 0, 0, 0, 0, 0),
    # articles: headings, long and very short paragraphs, paragraphs with links, lists
    (11, 0.0, 8, 0.0, 90, 0.0, 1, 0, 1, 0, 1), (4, 0.0, 60, 0.0, 70, 0.0, 1, 0, 1, 0, 1), (90, 0.0, 11, 0.0, 40, 0.0, 1, 0, 0, 0, 1), (40, 0.0, 90, 0.0, 2, 0.0, 1, 0, 0, 0, 1),
    (1, 0.0, 40, 0.0, 2, 0.0, 1, 0, 0, 0, 1), (2, 0.0, 1, 0.0, 6, 0.0, 1, 0, 0, 0, 1), (6, 0.0, 120, 0.0, 7, 0.2, 1, 0, 0, 0, 1), (3, 0.0, 12, 0.0, 5, 0.0, 1, 0, 0, 0, 1),
    (50, 0.2, 60, 0.0, 70, 0.1, 1, 0, 0, 0, 1), (30, 0.4, 50, 0.0, 20, 0.0, 1, 0, 0, 0, 1), (1, 0.0, 11, 0.0, 8, 0.0, 1, 0, 0, 0, 1), (15, 0.0, 20, 0.0, 0, 0.0, 1, 0, 0, 0, 1), (4, 1.0, 60, 0.0, 50, 0.0, 1, 0, 0, 0, 1),
    # pages without an article element: long text with few links, and what stands between such text
    (60, 0.0, 5, 0.0, 50, 0.0, 0, 0, 0, 0, 1), (35, 0.1, 40, 0.0, 60, 0.1, 0, 0, 0, 0, 1), (80, 0.2, 2, 1.0, 1, 1.0, 0, 0, 0, 0, 1), (22, 0.0, 3, 0.0, 2, 0.0, 0, 0, 0, 0, 1),
    (5, 0.0, 60, 0.0, 50, 0.0, 0, 0, 0, 0, 1), (8, 0.0, 4, 1.0, 70, 0.0, 0, 0, 1, 0, 1), (3, 0.0, 45, 0.0, 55, 0.0, 0, 0, 1, 0, 1), (10, 0.0, 30, 0.1, 25, 0.0, 0, 0, 0, 0, 1),
    # under a name that hints at boilerplate: slogans, notices, link lists; and text that goes on like an article's
    (6, 0.0, 0, 0.0, 3, 1.0, 0, 0, 0, 1, 0), (9, 0.0, 2, 1.0, 12, 0.0, 0, 0, 0, 1, 0), (30, 0.1, 5, 1.0, 0, 0.0, 0, 0, 0, 1, 0), (18, 0.0, 50, 0.0, 4, 1.0, 0, 0, 0, 1, 0), (7, 1.0, 60, 0.0, 6, 1.0, 1, 0, 0, 1, 0),
    (90, 0.0, 60, 0.0, 70, 0.0, 1, 0, 0, 1, 1), (60, 0.0, 50, 0.0, 40, 0.0, 0, 0, 0, 1, 1), (45, 0.1, 80, 0.0, 60, 0.0, 0, 0, 0, 1, 1), (55, 0.0, 8, 0.0, 65, 0.0, 0, 0, 0, 1, 1), (6, 0.0, 60, 0.0, 70, 0.0, 1, 0, 1, 1, 1),
    # boilerplate between long text
    (70, 0.0, 60, 0.0, 80, 0.0, 0, 1, 0, 0, 0), (40, 0.0, 100, 0.0, 60, 0.0, 1, 1, 0, 0, 0), (90, 0.05, 0, 0.0, 120, 0.0, 0, 1, 0, 0, 0), (120, 0.0, 90, 0.0, 40, 0.0, 1, 1, 0, 0, 0), (12, 0.0, 90, 0.0, 90, 0.0, 1, 1, 0, 0, 0),
    (25, 0.3, 40, 0.0, 60, 0.0, 0, 1, 0, 0, 0), (55, 0.0, 70, 0.0, 90, 0.0, 0, 1, 0, 0, 0), (3, 1.0, 0, 0.0, 50, 0.0, 0, 1, 0, 0, 0), (65, 0.0, 60, 0.0, 55, 0.0, 0, 1, 0, 1, 0), (4, 0.0, 60, 0.0, 60, 0.0, 0, 1, 1, 0, 0),
    # text that stands alone, or between long text; links beside it
    (60, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 0, 1), (150, 0.05, 0, 0.0, 0, 0.0, 0, 0, 0, 0, 1), (40, 0.0, 0, 0.0, 50, 0.0, 0, 0, 0, 0, 1), (26, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 0, 1), (100, 0.0, 120, 0.0, 110, 0.0, 1, 0, 0, 0, 1),
    (80, 0.0, 90, 0.0, 100, 0.0, 1, 0, 0, 0, 1), (12, 0.0, 100, 0.0, 120, 0.0, 1, 0, 0, 0, 1), (100, 0.0, 120, 0.0, 100, 0.0, 0, 0, 0, 0, 1), (2, 0.0, 100, 0.0, 120, 0.0, 1, 0, 0, 0, 1), (30, 0.0, 1, 1.0, 1, 1.0, 0, 0, 0, 0, 1),
    (1, 1.0, 0, 0.0, 60, 0.0, 0, 0, 0, 0, 0), (3, 1.0, 2, 1.0, 80, 0.0, 0, 0, 0, 0, 0), (2, 1.0, 90, 0.0, 0, 0.0, 0, 0, 0, 0, 0), (6, 0.9, 100, 0.0, 3, 1.0, 0, 0, 0, 0, 0), (20, 0.95, 60, 0.0, 70, 0.0, 0, 0, 0, 0, 0),
    # headings that follow a menu
    (1, 0.0, 1, 1.0, 60, 0.0, 1, 0, 1, 0, 1), (5, 0.0, 2, 1.0, 80, 0.0, 1, 0, 1, 0, 1), (4, 0.0, 3, 1.0, 50, 0.0, 0, 0, 1, 0, 1), (2, 0.0, 1, 1.0, 30, 0.0, 1, 0, 1, 0, 1),
    # link lists inside an article
    (4, 1.0, 3, 1.0, 4, 1.0, 1, 0, 0, 0, 0), (5, 1.0, 50, 0.0, 4, 1.0, 1, 0, 0, 0, 0), (3, 1.0, 4, 1.0, 2, 1.0, 1, 0, 0, 0, 0),
]
# The same for every mix of neighbours: plain text in an article is main text, and so is long text without an article;
# boilerplate and link lists never are, nor is short text among short text.
BESIDE = ((0, 0.0), (2, 1.0), (5, 0.0), (60, 0.0))
LABELLED += [(w, k, *before, *after, 1, 0, 0, 0, 1) for w in (1, 6, 40, 90) for k in (0.0, 0.3) for before in BESIDE for after in BESIDE]
LABELLED += [(w, k, *before, *after, 0, 0, 0, 0, 1) for w in (30, 60, 120) for k in (0.0, 0.2) for before in BESIDE for after in BESIDE]
LABELLED += [(w, 1.0, *before, *after, 0, 0, 0, 0, 0) for w in (1, 4, 15) for before in BESIDE for after in BESIDE]
LABELLED += [(w, 0.0, *before, *after, 0, 0, 0, 0, 0) for w in (2, 9) for before in BESIDE[:3] for after in BESIDE[:3]]
LABELLED += [(w, k, *before, *after, article, 1, 0, 0, 0) for w in (1, 12, 80) for k in (0.0, 1.0) for article in (0, 1) for before in BESIDE for after in BESIDE]


def train(table: list[tuple], least: int = 1) -> dict:
    """A CART tree by Gini impurity; leaves hold the majority, ties 0."""
    rows = np.array(table, dtype=float)

    def grow(at: np.ndarray) -> dict:
        y = at[:, -1]
        if y.min() == y.max() or len(at) <= least:
            return {"leaf": int(y.mean() > 0.5)}
        best = (np.inf, 0, 0.0)
        for f in range(at.shape[1] - 1):
            values = np.unique(at[:, f])
            for cut in (values[1:] + values[:-1]) / 2:
                side = at[:, f] <= cut
                score = sum(len(s) * s.mean() * (1 - s.mean()) for s in (y[side], y[~side]))
                best = min(best, (round(score, 9), f, cut))
        if best[0] == np.inf:
            return {"leaf": int(y.mean() > 0.5)}
        side = at[:, best[1]] <= best[2]
        return {"feature": best[1], "cut": best[2], "low": grow(at[side]), "high": grow(at[~side])}

    return grow(rows)


def judge(tree: dict, x: tuple) -> int:
    while "leaf" not in tree:
        tree = tree["low"] if x[tree["feature"]] <= tree["cut"] else tree["high"]
    return tree["leaf"]


def named(attributes: str) -> int:
    """16 if a class, id or role says boilerplate, 32 if one hints at it: all parts of a name must be such words or say nothing."""
    kind = 0
    for hit in HINTS.findall(attributes):
        for token in "".join(hit).lower().split():
            parts = set(re.split(r"[-_]+", token)) - PLAIN_WORDS - {""}
            if parts and parts <= BOILER_WORDS | HINT_WORDS:
                kind |= 16 if parts & BOILER_WORDS else 32
    return kind


def blocks(page: str | None) -> list[tuple[str, int, int, bool, bool, bool, bool]]:
    """Text, words, linked words, in article, in boilerplate, heading, hint of each block.

    The head ends where something begins that can't stand in it. Other silent elements
    that are never closed end with the element around them, and vector graphics and
    selections where a block begins.
    """
    page = page or ""
    out, parts = [], []
    # open elements and the marks inside: 1 main, 2 boilerplate element, 4 heading, 8 link, 16 boilerplate by name, 32 hint
    stack: list[tuple[str, int]] = []
    flags = at = 0
    hush = ""

    def close() -> None:
        text = " ".join("".join(t for t, _ in parts).split())
        if text:
            linked = sum(len(t.split()) for t, f in parts if f & 8)
            kind = next(f for t, f in parts if t.strip())
            out.append((text, len(text.split()), linked, bool(kind & 1), bool(kind & 18), bool(kind & 4), bool(kind & 32)))
        parts.clear()

    for m in TAG.finditer(page):
        if m.start() < at:
            continue
        if m.start() > at and not hush:
            parts.append((html.unescape(page[at : m.start()]), flags))
        at = m.end()
        name, ends, rest = (m[2] or "").lower(), m[1], m[3] or ""
        if not name:
            continue
        if name in RAW and not ends:  # the next end tag of that name ends it
            end = re.compile(rf"</{name}\b[^>]*(?:>|$)", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if hush:
            if ends:
                inside = name != hush and any(n == name for n, _ in stack)
                if name == hush or inside:
                    hush = ""
                if not inside:
                    continue
            elif hush == "head" and name not in IN_HEAD or hush in ("svg", "math", "select") and name in BREAKS:
                hush = ""
            else:
                continue
        if name in SILENT:
            if not ends and not rest.rstrip().endswith("/"):
                hush = name
            continue
        if name not in INLINE:
            close()
        elif name == "br":
            parts.append((" ", flags))
        if ends:
            if any(n == name for n, _ in stack):
                while stack.pop()[0] != name:
                    pass
                flags = stack[-1][1] if stack else 0
        elif name not in VOID and not rest.rstrip().endswith("/"):
            kind = (name in MAIN) | 4 * (name in HEADINGS) | 8 * (name == "a")
            if name in BOILER and not (name == "header" and flags & 1):
                kind |= 2
            if "=" in rest and name not in ("html", "body", *MAIN) and name not in INLINE:
                kind |= named(rest)
            if kind or name not in INLINE and name not in ("p", "li", "dt", "dd", "tr", "td", "th"):
                # an article is one whatever the names of what holds it
                flags = (flags & ~48 if name in MAIN else flags) | kind
                stack.append((name, flags))
    if at < len(page) and not hush:
        parts.append((html.unescape(page[at:]), flags))
    close()
    return out


def main_text(page: str | None, tree: dict) -> str:
    found = blocks(page)
    near = [(w, k / w) for _, w, k, *_ in found]
    near = [(0, 0.0), *near, (0, 0.0)]
    keep = []
    for i, (text, w, k, *marks) in enumerate(found, 1):
        if judge(tree, (w, k / w, *near[i - 1], *near[i + 1], *marks)):
            keep.append(text)
    return "\n".join(keep)


def extract(pages: DataFrame, table: list[tuple] = LABELLED) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every page; the tree is trained once, on the driver, from ``table``."""
    tree = train(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                text = [main_text(x, tree) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.selectExpr("cast(page_id as long) page_id", "cast(url as string) url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
