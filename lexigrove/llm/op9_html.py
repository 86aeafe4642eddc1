"""HTML extraction: flat text blocks classified by a decision tree.

A page is cut into flat blocks of text at block-level tags. A block is described by its number of words and its link
density, those of the blocks before and after it, and where it stands (inside article or main; inside a container
whose tag, class or id names boilerplate; heading). A decision tree (CART, Gini impurity), grown from the small
labelled table below, decides which blocks are main text. On pages that mark neither an article nor boilerplate, words and link
density of the neighbours decide: a short line among prose is text, the same line among links belongs to a menu.

Null html counts as empty and gives empty text. Broken markup never fails: what is still open at the end ends with the
page, stray end tags are ignored, a lone ``<`` is text, and a container whose content is not text (a button, an object...) but which
is never closed is ignored, so that it drops nothing. Boilerplate inside a paragraph is taken out of it; the
paragraph stays one block. Pages of any length are read whole, in time linear in their length. Repeated rows get
equal results, extra columns are ignored, no rows give no rows; ties of splits go to the first in the order of ``grow``.
"""

from __future__ import annotations

import re
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lexigrove.llm.common import rows

# HTML elements by how they are read.
BLOCK_TAGS = frozenset(["address", "article", "aside", "blockquote", "body", "button", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "search", "section", "select", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul"])
VOID = frozenset(["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"])
#: Their content is no markup and is dropped up to the end tag, or to the end of the page.
RAW = frozenset(["script", "style", "textarea", "title"])
#: Their content is no text of the article; without an end tag they are ignored.
EMBEDDED = frozenset(["noscript", "template", "svg", "math", "iframe", "object", "canvas", "audio", "video", "select", "button"])
BOILER_TAGS = frozenset(["nav", "footer", "aside", "form", "menu", "dialog", "search", "fieldset"])
HEADER_TAGS = frozenset(["header", "hgroup"])
CONTENT_TAGS = frozenset(["article", "main"])
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
#: Words in class or id that name what is not the article.
BOILER_NAMES = frozenset(["ad", "ads", "adv", "advert", "adverts", "advertisement", "adsense", "sponsor", "sponsored", "promo", "promotion", "banner", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "footer", "sidebar", "aside", "widget", "toolbar", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "share", "sharing", "social", "related", "recommended", "comment", "comments", "disqus", "reply", "replies", "respond", "form", "search", "pagination", "pager", "copyright", "legal", "skip", "masthead", "topbar"])
HEADER_NAMES = frozenset(["header", "head", "top"])
#: Of these, words that also stand on articles' own lists, quotes and lines, where links and neighbours decide.
WEAK_NAMES = HEADER_NAMES | frozenset(["menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "pagination", "pager", "related", "recommended", "share", "sharing", "social", "search", "skip", "toolbar", "topbar", "legal", "copyright", "form", "widget"])
#: So many words joined in one name say something else than the word alone.
LONG_NAME = 3
CONTENT_NAMES = frozenset(["article", "content", "post", "entry", "story", "main"])

TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)|<!--|<!\[CDATA\[|<[!?/]")
MARKS = re.compile("[>\"']")
ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
NAME = re.compile(r"[a-z]+")

#: Small labelled table: words, link density, words and link density before, words and link density after, place
#: (1 in article or main, 0 outside on a page that has one, 0.5 on a page without), boilerplate (1 by its tag or a clear
#: name, 0.5 by a weak name), heading
#: -> main text or not.
LABELLED = [
    # in the article: all but what a container names boilerplate
    ((40, 0.00, 8, 0.00, 35, 0.00, 1, 0, 0), 1), ((1, 0.00, 50, 0.00, 1, 0.00, 1, 0, 0), 1), ((2, 0.00, 0, 0.00, 0, 0.00, 1, 0, 0), 1),
    ((7, 0.00, 12, 0.00, 60, 0.00, 1, 0, 1), 1), ((3, 0.00, 6, 1.00, 20, 0.00, 1, 0, 1), 1), ((300, 0.01, 2, 0.00, 4, 0.00, 1, 0, 0), 1),
    ((12, 0.33, 50, 0.00, 45, 0.00, 1, 0, 0), 1), ((9, 0.90, 40, 0.00, 35, 0.00, 1, 0, 0), 1), ((4, 1.00, 3, 1.00, 5, 1.00, 1, 0, 0), 1),
    ((5, 0.00, 4, 1.00, 2, 1.00, 1, 0, 0), 1), ((11, 0.00, 1, 1.00, 0, 0.00, 1, 0, 0), 1), ((30, 0.80, 5, 1.00, 8, 0.90, 1, 0, 0), 1),
    ((2, 1.00, 2, 1.00, 1, 0.00, 1, 0, 0), 1), ((3, 1.00, 2, 1.00, 60, 0.00, 1, 0, 0), 1), ((2, 1.00, 40, 0.00, 0, 0.00, 1, 0, 0), 1),
    ((5, 1.00, 3, 1.00, 0, 0.00, 1, 0, 0), 1), ((1, 1.00, 2, 1.00, 9, 0.00, 1, 0, 0), 1),
    ((10, 0.00, 40, 0.00, 20, 0.00, 1, 1, 0), 0), ((45, 0.00, 60, 0.00, 30, 0.00, 1, 1, 0), 0), ((3, 0.00, 30, 0.00, 25, 0.00, 1, 1, 1), 0),
    ((20, 0.10, 15, 0.00, 70, 0.00, 1, 1, 0), 0), ((2, 1.00, 45, 0.00, 2, 1.00, 1, 1, 0), 0), ((1, 0.00, 60, 0.00, 40, 0.00, 1, 1, 0), 0),
    # outside it, on a page that has one
    ((1, 1.00, 0, 0.00, 1, 1.00, 0, 1, 0), 0), ((8, 0.00, 1, 1.00, 9, 0.00, 0, 1, 0), 0), ((60, 0.00, 1, 1.00, 9, 0.00, 0, 1, 0), 0),
    ((12, 0.00, 80, 0.00, 0, 0.00, 0, 1, 0), 0), ((5, 0.00, 2, 1.00, 2, 1.00, 0, 0, 0), 0), ((30, 0.00, 9, 0.00, 50, 0.00, 0, 0, 0), 0),
    ((4, 0.00, 0, 0.00, 6, 0.00, 0, 0, 1), 0), ((90, 0.02, 4, 0.00, 12, 0.50, 0, 0, 0), 0), ((14, 0.40, 3, 1.00, 4, 0.00, 0, 0, 0), 0),
    ((80, 0.00, 90, 0.00, 70, 0.00, 0, 0, 0), 0), ((2, 0.00, 100, 0.00, 0, 0.00, 0, 0, 0), 0), ((18, 0.00, 25, 0.00, 60, 0.00, 0, 0, 0), 0),
    # so too among links, as lists of sources and captions are
    ((1, 0.00, 2, 1.00, 2, 1.00, 1, 0, 0), 1), ((1, 0.00, 40, 0.00, 3, 1.00, 1, 0, 0), 1), ((1, 0.00, 0, 0.00, 5, 1.00, 1, 0, 0), 1), ((1, 0.00, 6, 1.00, 30, 0.00, 1, 0, 0), 1),
    ((1, 1.00, 2, 1.00, 2, 1.00, 1, 0, 0), 1), ((1, 1.00, 40, 0.00, 3, 1.00, 1, 0, 0), 1), ((1, 1.00, 0, 0.00, 5, 1.00, 1, 0, 0), 1), ((1, 1.00, 6, 1.00, 30, 0.00, 1, 0, 0), 1),
    ((3, 0.00, 2, 1.00, 2, 1.00, 1, 0, 0), 1), ((3, 0.00, 40, 0.00, 3, 1.00, 1, 0, 0), 1), ((3, 0.00, 0, 0.00, 5, 1.00, 1, 0, 1), 1), ((3, 0.00, 6, 1.00, 30, 0.00, 1, 0, 0), 1),
    ((3, 1.00, 2, 1.00, 2, 1.00, 1, 0, 0), 1), ((3, 1.00, 40, 0.00, 3, 1.00, 1, 0, 0), 1), ((3, 1.00, 0, 0.00, 5, 1.00, 1, 0, 0), 1), ((3, 1.00, 6, 1.00, 30, 0.00, 1, 0, 0), 1),
    ((8, 0.00, 2, 1.00, 2, 1.00, 1, 0, 0), 1), ((8, 0.00, 40, 0.00, 3, 1.00, 1, 0, 0), 1), ((8, 0.00, 0, 0.00, 5, 1.00, 1, 0, 0), 1), ((8, 0.00, 6, 1.00, 30, 0.00, 1, 0, 0), 1),
    ((8, 1.00, 2, 1.00, 2, 1.00, 1, 0, 0), 1), ((8, 1.00, 40, 0.00, 3, 1.00, 1, 0, 0), 1), ((8, 1.00, 0, 0.00, 5, 1.00, 1, 0, 0), 1), ((8, 1.00, 6, 1.00, 30, 0.00, 1, 0, 0), 1),
    ((20, 0.00, 2, 1.00, 2, 1.00, 1, 0, 0), 1), ((20, 0.00, 40, 0.00, 3, 1.00, 1, 0, 0), 1), ((20, 0.00, 0, 0.00, 5, 1.00, 1, 0, 0), 1), ((20, 0.00, 6, 1.00, 30, 0.00, 1, 0, 0), 1),
    ((20, 1.00, 2, 1.00, 2, 1.00, 1, 0, 0), 1), ((20, 1.00, 40, 0.00, 3, 1.00, 1, 0, 0), 1), ((20, 1.00, 0, 0.00, 5, 1.00, 1, 0, 0), 1), ((20, 1.00, 6, 1.00, 30, 0.00, 1, 0, 0), 1),
    # there, with a weak name: prose, quotes and the items of a list of the article; single lines and links are none
    ((40, 0.00, 35, 0.00, 30, 0.00, 1, .5, 0), 1), ((15, 0.00, 20, 0.00, 40, 0.00, 1, .5, 0), 1), ((25, 0.05, 4, 0.00, 6, 0.00, 1, .5, 0), 1), ((90, 0.00, 3, 1.00, 0, 0.00, 1, .5, 0), 1),
    ((5, 0.00, 4, 0.00, 6, 0.00, 1, .5, 0), 1), ((3, 0.00, 5, 0.00, 4, 0.00, 1, .5, 0), 1), ((7, 0.00, 6, 0.00, 5, 0.00, 1, .5, 0), 1), ((4, 0.00, 30, 0.00, 5, 0.00, 1, .5, 0), 1),
    ((4, 0.00, 5, 0.00, 30, 0.00, 1, .5, 0), 1), ((2, 0.00, 3, 0.00, 45, 0.00, 1, .5, 0), 1), ((18, 0.10, 60, 0.00, 2, 0.00, 1, .5, 0), 1), ((2, 0.00, 40, 0.00, 3, 0.00, 1, .5, 1), 1),
    ((3, 0.00, 18, 0.00, 3, 0.00, 1, .5, 0), 1), ((3, 0.00, 3, 0.00, 2, 0.00, 1, .5, 0), 1), ((2, 0.00, 3, 0.00, 18, 0.00, 1, .5, 0), 1), ((1, 0.00, 1, 0.00, 1, 0.00, 1, .5, 0), 1),
    ((2, 0.00, 2, 0.00, 2, 0.00, 1, .5, 0), 1), ((3, 0.00, 2, 0.00, 3, 0.00, 1, .5, 0), 1), ((4, 0.00, 60, 0.00, 3, 0.00, 1, .5, 0), 1), ((2, 0.00, 4, 0.00, 4, 0.00, 1, .5, 0), 1),
    ((2, 0.00, 18, 0.00, 18, 0.00, 1, .5, 0), 0), ((3, 0.00, 12, 0.00, 15, 0.00, 1, .5, 0), 0), ((2, 0.00, 20, 0.00, 25, 0.00, 1, .5, 0), 0), ((5, 0.00, 16, 0.00, 40, 0.00, 1, .5, 0), 0),
    ((2, 0.00, 50, 0.00, 60, 0.00, 1, .5, 0), 0), ((3, 0.00, 40, 0.00, 30, 0.00, 1, .5, 0), 0), ((5, 0.00, 35, 0.00, 25, 0.00, 1, .5, 0), 0), ((1, 1.00, 45, 0.00, 2, 1.00, 1, .5, 0), 0),
    ((2, 1.00, 2, 1.00, 1, 1.00, 1, .5, 0), 0), ((4, 1.00, 3, 1.00, 40, 0.00, 1, .5, 0), 0), ((12, 0.80, 5, 1.00, 30, 0.00, 1, .5, 0), 0), ((2, 0.00, 30, 0.00, 2, 1.00, 1, .5, 0), 0),
    ((3, 0.00, 2, 1.00, 4, 1.00, 1, .5, 0), 0), ((30, 0.90, 40, 0.00, 50, 0.00, 1, .5, 0), 0), ((2, 1.00, 60, 0.00, 50, 0.00, 1, .5, 0), 0), ((6, 1.00, 5, 0.00, 0, 0.00, 1, .5, 0), 0),
    # with a weak name on a page without an article
    ((30, 0.00, 40, 0.00, 30, 0.00, .5, .5, 0), 1), ((60, 0.00, 5, 0.00, 50, 0.00, .5, .5, 0), 1), ((20, 0.05, 3, 0.00, 25, 0.00, .5, .5, 0), 1), ((14, 0.00, 0, 0.00, 40, 0.00, .5, .5, 0), 1),
    ((3, 0.00, 40, 0.00, 30, 0.00, .5, .5, 0), 0), ((2, 1.00, 2, 1.00, 2, 1.00, .5, .5, 0), 0), ((4, 0.00, 2, 1.00, 40, 0.00, .5, .5, 0), 0), ((9, 0.80, 5, 1.00, 0, 0.00, .5, .5, 0), 0),
    # on a page without one: prose, and short lines beside prose
    ((70, 0.00, 6, 0.00, 80, 0.00, .5, 0, 0), 1), ((45, 0.05, 50, 0.00, 60, 0.00, .5, 0, 0), 1), ((22, 0.00, 40, 0.00, 3, 0.00, .5, 0, 0), 1),
    ((28, 0.00, 2, 1.00, 2, 1.00, .5, 0, 0), 1), ((35, 0.00, 3, 1.00, 4, 0.90, .5, 0, 0), 1), ((18, 0.10, 20, 0.10, 35, 0.00, .5, 0, 0), 1),
    ((8, 0.00, 1, 1.00, 70, 0.00, .5, 0, 1), 1), ((5, 0.00, 2, 1.00, 45, 0.00, .5, 0, 1), 1), ((9, 0.00, 60, 0.00, 55, 0.00, .5, 0, 0), 1),
    ((3, 0.00, 40, 0.00, 30, 0.00, .5, 0, 0), 1), ((6, 0.00, 45, 0.00, 0, 0.00, .5, 0, 0), 1), ((12, 0.00, 38, 0.00, 0, 0.00, .5, 0, 0), 1),
    ((4, 0.00, 30, 0.00, 3, 1.00, .5, 0, 0), 1), ((2, 0.00, 5, 0.00, 40, 0.00, .5, 0, 0), 1), ((1, 0.00, 4, 0.00, 3, 0.00, .5, 0, 0), 1),
    ((7, 0.00, 0, 0.00, 60, 0.00, .5, 0, 0), 1), ((3, 0.00, 0, 0.00, 0, 0.00, .5, 0, 0), 1), ((6, 0.00, 6, 0.00, 5, 0.00, .5, 0, 0), 1),
    ((16, 0.60, 60, 0.00, 50, 0.00, .5, 0, 0), 1), ((8, 0.90, 45, 0.00, 40, 0.00, .5, 0, 0), 1), ((25, 0.70, 30, 0.00, 35, 0.00, .5, 0, 0), 1),
    ((45, 0.00, 3, 1.00, 60, 0.00, .5, 0, 0), 1), ((30, 0.00, 2, 1.00, 0, 0.00, .5, 0, 0), 1), ((20, 0.05, 1, 1.00, 40, 0.00, .5, 0, 0), 1),
    ((60, 0.00, 5, 0.90, 3, 0.00, .5, 0, 0), 1), ((24, 0.10, 4, 1.00, 30, 0.00, .5, 0, 0), 1),
    # the same lines among links
    ((4, 0.00, 2, 1.00, 3, 1.00, .5, 0, 0), 0), ((2, 0.00, 3, 1.00, 2, 1.00, .5, 0, 0), 0), ((5, 0.00, 2, 0.90, 4, 1.00, .5, 0, 1), 0),
    ((7, 0.00, 4, 1.00, 2, 0.90, .5, 0, 0), 0), ((6, 0.00, 8, 0.80, 0, 0.00, .5, 0, 0), 0), ((3, 0.00, 1, 1.00, 2, 1.00, .5, 0, 1), 0),
    ((1, 1.00, 2, 1.00, 1, 1.00, .5, 0, 0), 0), ((1, 1.00, 0, 0.00, 1, 1.00, .5, 0, 0), 0), ((30, 0.80, 5, 1.00, 8, 0.90, .5, 0, 0), 0),
    ((3, 1.00, 2, 1.00, 60, 0.00, .5, 0, 0), 0), ((4, 0.90, 50, 0.00, 4, 1.00, .5, 0, 0), 0), ((2, 1.00, 3, 1.00, 0, 0.00, .5, 0, 0), 0),
    # named boilerplate there
    ((25, 0.00, 30, 0.00, 20, 0.00, .5, 1, 0), 0), ((60, 0.00, 80, 0.00, 12, 0.00, .5, 1, 0), 0), ((4, 0.90, 3, 1.00, 4, 1.00, .5, 1, 0), 0),
    ((7, 0.00, 50, 0.00, 2, 1.00, .5, 1, 1), 0), ((1, 0.00, 40, 0.00, 40, 0.00, .5, 1, 0), 0), ((12, 0.00, 80, 0.00, 0, 0.00, .5, 1, 0), 0),
]


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8):
    """CART: (feature, cut, below or equal, above), or a class. The first best split wins ties."""
    if depth == 0 or y.min() == y.max():
        return int(2 * y.sum() >= len(y))
    best = (1e9, 0, 0.0)
    for f in (7, 6, 1, 0, 2, 4, 3, 5, 8):
        values = np.unique(x[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= cut
            g = sum(len(p) * 2 * p.mean() * (1 - p.mean()) for p in (y[low], y[~low]))
            if g < best[0] - 1e-9:
                best = (g, f, float(cut))
    if best[0] > 1e8:
        return int(2 * y.sum() >= len(y))
    _, f, cut = best
    low = x[:, f] <= cut
    return f, cut, grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1)


def default_tree():
    return grow(np.array([r for r, _ in LABELLED], float), np.array([c for _, c in LABELLED]))


def classify(tree, row) -> int:
    while not isinstance(tree, int):
        f, cut, low, high = tree
        tree = low if row[f] <= cut else high
    return tree


class Scanner:
    """Ends of tags, in time linear in the page: whatever is once not found ahead is not looked for again."""

    def __init__(self, html: str):
        self.html, self.quotes, self.last = html, True, html.rfind(">")
        self.gone: set[str] = set()
        self.closing: dict[str, int] = {}

    def find(self, what: str, at: int) -> int:
        if what in self.gone:
            return -1
        found = self.html.find(what, at)
        if found < 0:
            self.gone.add(what)
        return found

    def tag_end(self, at: int) -> int:
        """Place of the ``>`` that ends a tag whose name ends at ``at``, one in quotes only if there is no other; -1 for none."""
        if self.last < at:
            return -1
        i = at
        while self.quotes:
            m = MARKS.search(self.html, i)
            if not m:
                self.quotes = False
            elif m[0] == ">":
                return m.start()
            else:
                close = self.find(m[0], m.end())
                i = close + 1 if close >= 0 else m.end()
        return self.html.find(">", at)

    def closed(self, tag: str, at: int) -> bool:
        """Whether an end tag of this name stands behind ``at``."""
        if tag not in self.closing:
            self.closing[tag] = max((m.start() for m in re.finditer(rf"</{tag}(?![a-z0-9:-])", self.html, re.I)), default=-1)
        return self.closing[tag] >= at


def boilerplate(tag: str, attrs: str, content: bool) -> tuple[int, int, int]:
    """(adds to content, to boilerplate, to what only weak names call so) by tag, class, id and role."""
    c, b, weak = int(tag in CONTENT_TAGS), int(tag in BOILER_TAGS or tag in EMBEDDED), 0
    if tag in HEADER_TAGS and not content:
        b = 1
    if attrs and tag not in ("html", "body"):
        for name, v1, v2, v3 in ATTR.findall(attrs):
            name, value = name.lower(), (v1 or v2 or v3).lower()
            if name in ("class", "id", "role"):
                for one in value.split():
                    words = NAME.findall(one)
                    known = [w for w in words if w in BOILER_NAMES or w in HEADER_NAMES and not content]
                    if known and not c:
                        clear = len(words) < LONG_NAME and any(w not in WEAK_NAMES for w in known)
                        b, weak = b or int(clear), weak or int(not clear)
                    elif not (b or weak) and tag in ("div", "section") and any(w in CONTENT_NAMES for w in words):
                        c = 1
                if value in ("complementary", "contentinfo"):
                    b = 1
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
                b = 1
    return c, b, 0 if b else weak


class Open:
    """An open element: what it adds to the counts, and for boilerplate inside a paragraph the text around it."""

    __slots__ = ("tag", "content", "boiler", "weak", "heading", "around")

    def __init__(self, tag: str, content: int = 0, boiler: int = 0, weak: int = 0, heading: int = 0, around=None):
        self.tag, self.content, self.boiler, self.weak, self.heading, self.around = tag, content, boiler, weak, heading, around


class Blocks:
    """The flat blocks of a page, built from its tags and texts in order."""

    def __init__(self):
        self.out: list[tuple[str, int, int, int, float, int]] = []
        self.parts: list[str] = []
        self.linked = 0
        self.state = (0, 0, 0)
        self.stack: list[Open] = []
        self.open: dict[str, int] = {}
        self.blocks: list[int] = []  # places of block-level elements in the stack
        self.content = self.boiler = self.weak = self.heading = 0

    def flush(self) -> None:
        if self.parts:
            words = "".join(self.parts).split()
            if words:
                self.out.append((" ".join(words), len(words), min(self.linked, len(words)), *self.state))
            self.parts, self.linked = [], 0

    def text(self, raw: str) -> None:
        if not raw:
            return
        t = unescape(raw) if "&" in raw else raw
        if not self.parts:
            if t.isspace():
                return
            self.state = (int(self.content > 0), 1 if self.boiler else 0.5 if self.weak else 0, int(self.heading > 0))
        self.parts.append(t)
        if self.open.get("a"):
            self.linked += len(t.split())

    def push(self, tag: str, content: int, boiler: int, weak: int) -> None:
        x = Open(tag, content, boiler, weak, int(tag in HEADINGS))
        if tag in BLOCK_TAGS:
            self.blocks.append(len(self.stack))
        elif boiler and not self.boiler:  # boilerplate in a line: its text is a block of its own
            x.around = (self.parts, self.linked, self.state)
            self.parts, self.linked = [], 0
        self.stack.append(x)
        self.open[tag] = self.open.get(tag, 0) + 1
        self.content, self.boiler, self.weak, self.heading = self.content + content, self.boiler + boiler, self.weak + weak, self.heading + x.heading

    def pop(self) -> str:
        x = self.stack.pop()
        if x.around is not None:
            self.flush()
            self.parts, self.linked, self.state = x.around
        self.open[x.tag] -= 1
        if self.blocks and self.blocks[-1] == len(self.stack):
            self.blocks.pop()
        self.content, self.boiler, self.weak, self.heading = self.content - x.content, self.boiler - x.boiler, self.weak - x.weak, self.heading - x.heading
        return x.tag

    def close(self, tag: str) -> None:
        """Ends the innermost open element of this name and what is open inside it."""
        if tag in BLOCK_TAGS:
            self.flush()
        if self.open.get(tag):
            while self.pop() != tag:
                pass
            if tag in BLOCK_TAGS:
                self.flush()

    def end_paragraph(self, tag: str) -> None:
        """A new p or li ends an open one, unless another block-level element was opened since."""
        if self.blocks and self.stack[self.blocks[-1]].tag == tag:
            self.close(tag)


def blocks(html: str) -> list[tuple[str, int, int, int, float, int]]:
    """(text, words, linked words, in content, boilerplate (0.5 by a weak name), heading) of every block that has text."""
    b, scan = Blocks(), Scanner(html)
    at, end = 0, len(html)
    while at < end:
        lt = html.find("<", at)
        if lt < 0:
            b.text(html[at:])
            break
        m = TAG.match(html, lt)
        if not m:
            b.text(html[at : lt + 1])
            at = lt + 1
            continue
        tag = m[2]
        if not tag:
            b.text(html[at:lt])
            until = {"<!--": "-->", "<![CDATA[": "]]>"}.get(m[0], ">")
            close = scan.find(until, m.end())
            if m[0] == "<![CDATA[":
                b.text(html[m.end() : close if close >= 0 else end])
            at = close + len(until) if close >= 0 else end
            continue
        close = scan.tag_end(m.end())
        if close < 0:  # no tag any more
            b.text(html[at:])
            break
        b.text(html[at:lt])
        tag, attrs, at = tag.lower(), html[m.end() : close], close + 1
        if m[1]:
            b.close(tag)
            continue
        if tag in RAW:
            if tag in BLOCK_TAGS:
                b.flush()
            if scan.closed(tag, at):
                stop = re.compile(rf"</{tag}[^>]*>?", re.I).search(html, at)
                at = stop.end()
            elif tag in ("title", "textarea"):  # without an end it holds the text up to the next tag
                at = html.find("<", at) if html.find("<", at) >= 0 else end
            else:
                at = end
            continue
        single = attrs.rstrip().endswith("/")
        if tag in EMBEDDED and (single or not scan.closed(tag, at)):
            continue
        if tag in BLOCK_TAGS:
            b.flush()
        elif tag == "br":
            b.text(" ")
        if tag in VOID or single and tag not in BLOCK_TAGS:
            continue
        if tag == "p" or tag == "li":
            b.end_paragraph(tag)
        b.push(tag, *boilerplate(tag, attrs, b.content > 0))
    while b.stack:
        b.pop()
    b.flush()
    return b.out


def main_text(html: str | None, tree) -> str:
    """Main blocks in page order, one a line."""
    found = blocks(html or "")
    has = any(b[3] for b in found)
    out = []
    for i, (text, n, linked, content, boiler, heading) in enumerate(found):
        before, after = found[i - 1] if i else None, found[i + 1] if i + 1 < len(found) else None
        row = (n, linked / n, *((before[1], before[2] / before[1]) if before else (0, 0.0)), *((after[1], after[2] / after[1]) if after else (0, 0.0)), 1 if content else 0 if has else 0.5, boiler, heading)
        if classify(tree, row):
            out.append(text)
    return "\n".join(out)


SCHEMA = "page_id long, url string, text string, n_chars long"


def extract(pages: DataFrame, tree=None) -> DataFrame:
    """page_id, url, text, n_chars for every row; extra columns are ignored."""
    tree = tree or default_tree()

    def run(batches):
        for b in batches:
            texts = [main_text(h, tree) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows(pages.select("page_id", "url", "html"), run, SCHEMA)
