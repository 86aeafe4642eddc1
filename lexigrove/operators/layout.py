"""Layout of pages from spans: reading order, columns, tables, formula and table regions.

A page is one row (doc_id, page, page_w, page_h, spans) with the spans as an array of structs (text, x1, y1, x2, y2) in
extraction order; ``page_rows`` makes such rows from single spans. Operators read page by page in Arrow batches, so nothing
larger than a page is in memory and no operator shuffles.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from statistics import median
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexigrove.functions import formulas as M
from lexigrove.functions.symbols import formula_like

SPAN = "struct<text:string,x1:double,y1:double,x2:double,y2:double>"
REGION = "struct<type:string,x1:double,y1:double,x2:double,y2:double,score:double,method:string,notes:array<string>>"
# Points. Lines of words, gaps within a formula, bands of headers and footers, margins of regions.
LINE, ROW, JOIN, HEADER, EDGE, PAD = 4.0, 10.0, 26.0, 40.0, 60.0, 4.0
CAPTION_GAP, CAPTION_SLOP, PANEL_GAP = 18.0, 3.0, 30.0


class Span(NamedTuple):
    text: str
    x1: float
    y1: float
    x2: float
    y2: float

    @property
    def cx(self) -> float:
        return (self.x1 + self.x2) / 2

    @property
    def cy(self) -> float:
        return (self.y1 + self.y2) / 2

    @property
    def box(self) -> tuple[float, float, float, float]:
        return self[1:]


Box = tuple[float, float, float, float]


def hull(boxes: Iterable[Box]) -> Box:
    a, b, c, d = zip(*boxes)
    return min(a), min(b), max(c), max(d)


def page_rows(spans: DataFrame) -> DataFrame:
    """From (doc_id, page, span_ord, text, box, page_w, page_h): one row a page."""
    b = F.col("box")
    one = F.struct("span_ord", F.struct(F.coalesce("text", F.lit("")).alias("text"), *(b[k].cast("double").alias(k) for k in ("x1", "y1", "x2", "y2"))).alias("s"))
    g = spans.where(b.isNotNull()).groupBy("doc_id", "page").agg(F.max("page_w").cast("double").alias("page_w"), F.max("page_h").cast("double").alias("page_h"), F.sort_array(F.collect_list(one)).alias("o"))
    return g.select("doc_id", "page", "page_w", "page_h", F.col("o.s").alias("spans"))


def per_page(pages: DataFrame, f: Callable[[list[Span], float, float], tuple], columns: str) -> DataFrame:
    """``pages`` without spans, with the values of ``f(spans, page_w, page_h)`` as ``columns`` (a schema string)."""
    kept = [c for c in pages.columns if c != "spans"]
    schema = StructType(list(pages.select(*kept).schema.fields))
    for field in pages.sparkSession.createDataFrame([], columns).schema.fields:
        schema = schema.add(field)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches):
        for b in batches:
            at = {n: b.schema.get_field_index(n) for n in b.schema.names}
            rows = zip(b.column(at["spans"]).to_pylist(), b.column(at["page_w"]).to_pylist(), b.column(at["page_h"]).to_pylist())
            out = [f([Span(**s) for s in spans or []], w or 0.0, h or 0.0) for spans, w, h in rows]
            new = [pa.array(list(x), t) for x, t in zip(zip(*out), arrow.types[len(kept) :])] if out else [pa.array([], t) for t in arrow.types[len(kept) :]]
            yield pa.RecordBatch.from_arrays([*(b.column(at[c]).cast(arrow.field(c).type) for c in kept), *new], names=arrow.names)

    return pages.mapInArrow(run, schema)


# -- lines, rows, columns ---------------------------------------------------------------------------------------------


def anchored(items: list, place: Callable, reach: float) -> list[list]:
    """Runs of items in order whose places stay within reach of the first of their run."""
    out: list[list] = []
    for x in items:
        if out and abs(place(x) - place(out[-1][0])) <= reach:
            out[-1].append(x)
        else:
            out.append([x])
    return out


def lines(spans: list[Span]) -> list[list[Span]]:
    """Visual lines: spans whose tops lie within LINE of the line's first, from left to right."""
    found = anchored(sorted(spans, key=lambda s: (s.y1, s.x1)), lambda s: s.y1, LINE)
    return [sorted(x, key=lambda s: s.x1) for x in found]


def rows(spans: list[Span], reach: float = ROW) -> list[list[Span]]:
    return anchored(sorted(spans, key=lambda s: (s.cy, s.x1)), lambda s: s.cy, reach)


def drifting_rows(spans: list[Span], share: float = 0.6) -> list[list[Span]]:
    """Rows of recognised words: near the mean height of the row so far, in parts of the taller of row and word."""
    out: list[list[Span]] = []
    y = h = 0.0
    for s in sorted(spans, key=lambda s: (s.cy, s.cx)):
        tall = max(1.0, s.y2 - s.y1)
        if out and abs(s.cy - y) <= share * max(h, tall):
            n = len(out[-1])
            y, h = (y * n + s.cy) / (n + 1), (h * n + tall) / (n + 1)
            out[-1].append(s)
        else:
            out.append([s])
            y, h = s.cy, tall
    return [sorted(r, key=lambda s: s.cx) for r in out]


def line_text(spans: list[Span]) -> str:
    return " ".join(t for s in spans if (t := s.text.strip()))


def gutter_in(line: list[Span], width: float, share: float = 0.08) -> int | None:
    """How many spans of a line are left of its widest gap across the page's middle; None if it has none."""
    need, mid = width * share, width / 2
    gaps = [(b.x1 - a.x2, -i) for i, (a, b) in enumerate(zip(line, line[1:]), 1) if b.x1 - a.x2 >= need and a.x2 <= mid + need / 4 and b.x1 >= mid - need / 4]
    return -max(gaps)[1] if gaps else None


def reading_order(spans: list[Span], width: float, height: float = 0.0) -> tuple[str, int, bool, list[str]]:
    """(text, columns, likely a table, notes). Two columns when at least two lines, and 35 in a hundred, have a gutter.

    A line across both columns ends what stands beside each other above it.
    """
    if not spans or width <= 0:
        return "", 1, False, []
    table = table_like(spans, width)
    notes = ["table_like_span_density"] * table
    found = [(x, gutter_in(x, width)) for x in lines(spans)]
    cut = sum(at is not None for _, at in found)
    if cut < 2 or cut < 0.35 * len(found):
        return "\n".join(t for x, _ in found if (t := line_text(x))), 1, table, notes
    blocks: list[list[list[str]]] = [[[], []]]
    parts: list[str] = []
    for x, at in [*found, ([], None)]:
        if at is not None:
            blocks[-1][0].append(line_text(x[:at]))
            blocks[-1][1].append(line_text(x[at:]))
            continue
        parts += ["\n".join(filter(None, side)) for side in blocks[-1]]
        parts.append(line_text(x))
        blocks.append([[], []])
    return "\n\n".join(filter(None, parts)), 2, table, [f"two_column_split lines={cut}", *notes]


def histogram(values: list[float], bins: int) -> tuple[np.ndarray, np.ndarray]:
    return np.histogram(np.asarray(values, float), bins=bins)


def table_like(spans: list[Span], width: float) -> bool:
    """Thirty spans or more, nearly half of them short, over three or more crowded stripes."""
    if len(spans) < 30 or width <= 0:
        return False
    n, _ = histogram([s.cx for s in spans], 12)
    return int((n >= max(3, 0.45 * n.max())).sum()) >= 3 and sum(len(s.text.strip()) <= 12 for s in spans) >= 0.45 * len(spans)


def two_ocr_columns(spans: list[Span], width: float, least: int = 24) -> bool:
    if len(spans) < least or width <= 0:
        return False
    x = np.array([s.cx for s in spans])
    left = int((x < width / 2).sum())
    return 0.28 <= left / len(x) <= 0.72 and (abs(x - width / 2) < 0.06 * width).mean() <= 0.12 and min(left, len(x) - left) >= 8


def ocr_text(spans: list[Span], width: float, height: float = 0.0) -> tuple[str, int, int, float, bool]:
    """(text, columns, text lines, share of short pieces, formulas suspected) of recognised words."""
    if not spans:
        return "", 1, 0, 0.0, False
    short = sum(len(s.text.strip()) <= 3 for s in spans) / len(spans)
    sides = [spans]
    if two := two_ocr_columns(spans, width):
        sides = [[s for s in spans if s.cx < width / 2], [s for s in spans if s.cx >= width / 2]]
    found = [drifting_rows(side) for side in sides]
    text = "\n\n".join("\n".join(t for r in side if (t := line_text(r))) for side in found if side)
    return text, 1 + two, sum(map(len, found)), short, short >= 0.28 and len(spans) >= 20


def peaks(xs: list[float], bins: int, merge: float) -> list[float]:
    """Middles of crowded stripes; close ones are put together, one after another."""
    n, edges = histogram(xs, bins)
    out: list[float] = []
    for i in np.flatnonzero(n >= max(2.0, 0.35 * n.max())):
        p = (edges[i] + edges[i + 1]) / 2
        if out and p - out[-1] <= merge:
            out[-1] = (out[-1] + p) / 2
        else:
            out.append(float(p))
    return out


def column_peaks(xs: list[float], least: int = 3) -> list[float]:
    found = peaks(xs, max(8, min(18, len(xs) // 2)), 18.0) if len(xs) >= least else []
    return found if len(found) >= least else []


def two_prose_columns(found: list[list[Span]], width: float) -> bool:
    """Two columns of wide, wordy spans; not a table."""
    all_ = [s for r in found for s in r if s.text.strip()]
    if width <= 0 or len(found) < 4 or len(all_) < 12:
        return False
    n, _ = histogram([s.cx for s in all_], 12)
    top = np.flatnonzero(n >= max(3, 0.45 * n.max()))
    return len(top) == 2 and top[1] - top[0] >= 3 and median(max(0.0, s.x2 - s.x1) for s in all_) > 0.22 * width and median(len(s.text.strip()) for s in all_) >= 28


def body(spans: list[Span], height: float) -> list[Span]:
    """Without blank spans and the bands of headers and footers."""
    return [s for s in spans if s.text.strip() and HEADER < s.cy < height - HEADER]


def text_heavy(spans: list[Span]) -> bool:
    text = "".join(s.text for s in spans)
    return len(text) > 2000 and sum(c in M.MARKERS and c != "-" for c in text) + len(M._P["symbol"].findall(text)) < 5


def no_fragments(spans: list[Span], width: float, height: float) -> bool:
    """Pages on which broken formulas are not looked for: contents, references, two columns of prose, heavy text."""
    inner = body(spans, height)
    texts = [s.text for s in inner]
    return M.contents_like(texts) or M.bibliography_like(texts) or two_prose_columns(rows(inner), width) or text_heavy(inner)


# -- tables from spans ------------------------------------------------------------------------------------------------


def markdown(grid: list[list[str]]) -> str:
    line = lambda cells: "| " + " | ".join(cells) + " |"
    return "\n".join([line(grid[0]), line(["---"] * len(grid[0])), *map(line, grid[1:])])


def table_quality(md: str) -> tuple[float, int, int]:
    """(score, rows, columns) of a Markdown table: even rows, filled and meaningful cells, five rows; less for what looks like something else."""
    import re

    found = [x for x in (md or "").splitlines() if "|" in x and not re.match(r"\s*\|?\s*-+", x)]
    if not found:
        return (0.1 if (md or "").strip() else 0.0), 0, 0
    counts = [x.count("|") - x.strip().startswith("|") for x in found]
    columns, n = int(median(counts)), len(found)
    cells = [c.strip() for x in found for c in x.strip("|").split("|")]
    share = lambda test: sum(map(bool, map(test, cells))) / max(1, len(cells))
    meaning = share(lambda c: any(map(str.isalnum, c)))
    score = 0.35 * sum(abs(c - columns) <= 1 for c in counts) / n + 0.30 * share(bool) + 0.20 * meaning + 0.15 * min(1.0, n / 5)
    dots, numbers = sum(bool(re.search(r"\.\.\.|…|\.\s*\.\s*\.", c)) for c in cells), sum(bool(re.fullmatch(r"\d{1,3}", c)) for c in cells)
    for holds, factor in (
        (n < 5 and any(len(c) > 180 for c in cells), 0.35), (dots >= max(2, n // 2) or numbers >= max(3, n // 2) and columns <= 3, 0.15),
        (meaning < 0.25, 0.4), (columns < 2 or n < 2, 0.5), (columns >= 10 and meaning < 0.35, 0.25),
    ):
        score *= factor if holds else 1.0
    return score, n, columns


def cell_text(raw: str) -> str:
    """A cell for Markdown: formulas between dollars; Greek without an operator is not readable."""
    from lexigrove.functions.symbols import _G

    if _G.search(raw) and not any(c in "=^_\\/+-−×÷∑∫√" for c in raw) and not any("Ѐ" <= c <= "ӿ" for c in raw):
        return "UNREADABLE"
    if formula_like(raw):
        return raw if raw.startswith("$") and raw.endswith("$") else f"${raw}$"
    return raw.replace("|", r"\|")


def table_in(spans: list[Span], box: Box, pad: float = 4.0) -> tuple[str, float] | None:
    """(Markdown, confidence) of the table in a box: rows by height, columns by crowded stripes; None if there is none."""
    inside = [s for s in spans if s.text.strip() and box[0] - pad <= s.cx <= box[2] + pad and box[1] - pad <= s.cy <= box[3] + pad]
    found = rows(inside)
    stripes = peaks([s.cx for s in inside], max(6, min(14, len(inside))), 16.0) if len(inside) >= 6 else []
    if len(found) < 2 or len(stripes) < 2:
        return None
    grid = []
    for r in found:
        cells: list[list[str]] = [[] for _ in stripes]
        for s in sorted(r, key=lambda s: s.x1):
            cells[min(range(len(stripes)), key=lambda k: abs(stripes[k] - s.cx))].append(cell_text(s.text.strip()))
        grid.append([" ".join(c) for c in cells])
    while len(grid[0]) > 2 and not any(r[-1] for r in grid):
        grid = [r[:-1] for r in grid]
    if sum(bool(c) for r in grid for c in r) < 0.30 * len(grid) * len(grid[0]):
        return None
    md = markdown(grid)
    return md, max(table_quality(md)[0], 0.55)


def html_table(html: str | None) -> str:
    """Rows and cells of HTML as Markdown, short rows filled up; empty without cells."""
    from html.parser import HTMLParser

    class Cells(HTMLParser):
        def __init__(self):
            super().__init__()
            self.grid: list[list[str]] = []
            self.row: list[str] = []
            self.cell: list[str] | None = None

        def handle_starttag(self, tag, attrs):
            if tag == "tr":
                self.row = []
            elif tag in ("td", "th"):
                self.cell = []

        def handle_endtag(self, tag):
            if tag in ("td", "th") and self.cell is not None:
                self.row.append(" ".join("".join(self.cell).split()))
                self.cell = None
            elif tag == "tr" and self.row:
                self.grid.append(self.row)
                self.row = []

        def handle_data(self, data):
            if self.cell is not None:
                self.cell.append(data)

    p = Cells()
    p.feed(html or "")
    wide = max(map(len, p.grid), default=0)
    return markdown([r + [""] * (wide - len(r)) for r in p.grid]) if p.grid else ""


def table_regions(spans: list[Span], width: float, height: float) -> list[dict]:
    """Bands of rows of short cells over three or more stable columns, numbers among them."""
    inner = body(spans, height) if len(spans) >= 12 and width > 0 and height > 0 else []
    if len(inner) < 12 or M.contents_like([s.text for s in inner]):
        return []
    found = rows(inner, max(8.0, 0.012 * height))
    if two_prose_columns(found, width):
        return []
    numeric = lambda s: any(map(str.isdigit, s.text))
    kept = []
    for r in found:
        cells = [s for s in sorted(r, key=lambda s: s.x1) if len(s.text.strip()) <= 18 or s.x2 - s.x1 <= 0.18 * width or numeric(s)]
        wordy = len(cells) <= 3 and sum(len(s.text.strip()) for s in cells) > 22 * len(cells)
        if len(cells) >= 3 and not wordy and not M.contents_like([s.text for s in cells]):
            kept.append(cells)
    bands: list[list[list[Span]]] = []
    for r in kept:
        if bands and r[0].cy - bands[-1][-1][0].cy <= max(42.0, 0.06 * height):
            bands[-1].append(r)
        else:
            bands.append([r])
    out = []
    for band in bands:
        cells = [s for r in band for s in r]
        columns = column_peaks([s.cx for s in cells]) if len(band) >= 3 else []
        aligned = sum(sum(any(abs(s.cx - p) <= 22 for s in r) for p in columns) >= min(3, len(columns)) for r in band)
        a, b, c, d = hull(s.box for s in cells)
        box = max(0.0, a - 6), max(0.0, b - 6), min(width, c + 6), min(height, d + 6)
        w, h, share = box[2] - box[0], box[3] - box[1], sum(map(numeric, cells)) / len(cells)
        if len(columns) >= 3 and aligned >= max(3, int(0.6 * len(band))) and w * h <= 0.40 * width * height and h >= 0.035 * height and w >= 0.25 * width and share >= 0.30:
            score = min(0.95, 0.40 + 0.08 * min(len(columns), 6) + 0.05 * min(len(band), 8) + 0.20 * share)
            out.append(region("table", box, score, "span_cell_grid", [f"rows={len(band)}", f"cols={len(columns)}", f"numeric_ratio={share:.2f}"]))
    return out


def region(kind: str, box: Box, score: float, method: str, notes: list[str]) -> dict:
    return {"type": kind, **dict(zip(("x1", "y1", "x2", "y2"), map(float, box))), "score": float(score), "method": method, "notes": notes}


# -- formulas from spans ----------------------------------------------------------------------------------------------


class Groups:
    """Connected items: union by the smaller number, so that groups come in the order of their first items."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def top(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = sorted((self.top(i), self.top(j)))
        self.up[b] = a

    def lists(self) -> list[list[int]]:
        out: dict[int, list[int]] = {}
        for i in range(len(self.up)):
            out.setdefault(self.top(i), []).append(i)
        return list(out.values())


def _gap(a1: float, a2: float, b1: float, b2: float) -> float:
    return max(0.0, max(a1, b1) - min(a2, b2))


def close_pairs(spans: list[Span], reach: float) -> Iterator[tuple[int, int]]:
    """(i, j), i before j in the list, of spans whose vertical gap is at most ``reach``; a sweep from the top, so rows far apart never meet."""
    order = sorted(range(len(spans)), key=lambda i: spans[i].y1)
    tops = [spans[i].y1 for i in order]
    for k, i in enumerate(order):
        for j in order[k + 1 : bisect_right(tops, spans[i].y2 + reach)]:
            yield (i, j) if i < j else (j, i)


def separate_rows(a: Span, b: Span) -> bool:
    """Two whole equations on rows of their own."""
    return M.display_equation(a.text) and M.display_equation(b.text) and abs(a.cy - b.cy) > 9


def joinable(a: Span, b: Span, height: float) -> bool:
    y = _gap(a.y1, a.y2, b.y1, b.y2)
    return not separate_rows(a, b) and y <= (0.04 if not y else 0.02) * height and _gap(a.x1, a.x2, b.x1, b.x2) <= JOIN


def stacked_gap(top: Span, low: Span) -> float | None:
    """Gap between a span and the one right below it, which share half of the narrower's width; None if not so."""
    gap, tall = low.y1 - top.y2, [max(1.0, s.y2 - s.y1) for s in (top, low)]
    under = min(top.x2, low.x2) - max(top.x1, low.x1) >= 0.5 * min(top.x2 - top.x1, low.x2 - low.x1)
    return gap if top.cy < low.cy and under and -0.4 * min(tall) <= gap <= 0.8 * max(tall) else None


def fractions(spans: list[Span], bar: Callable[[Span, Span], bool] | None = None) -> dict[tuple[int, int], bool]:
    """(numerator, denominator) -> bar seen. The closest pairs first; a span is in one pair and on one side of it.

    ``bar``: a port that looks for the bar in the image; with it, pairs without a bar don't count.
    """
    tallest = max((max(1.0, s.y2 - s.y1) for s in spans), default=1.0)
    near = ((i, j) for pair in close_pairs(spans, 0.8 * tallest) for i, j in (pair, pair[::-1]))
    pairs = sorted((g, i, j) for i, j in near if (g := stacked_gap(spans[i], spans[j])) is not None)
    taken: set[int] = set()
    out = {}
    for _, i, j in pairs:
        if i in taken or j in taken:
            continue
        seen = bool(bar and bar(spans[i], spans[j]))
        if bar is None or seen:
            taken |= {i, j}
            out[i, j] = seen
    return out


def layout_weight(members: list[int], spans: list[Span], pairs: dict[tuple[int, int], bool]) -> int:
    """Weight of the fractions in a group; those of mere digits count only beside one with variables."""
    strong = digits = 0
    for (i, j), seen in pairs.items():
        if i in members and j in members:
            letters = [bool(M._P["variable"].search(spans[k].text)) for k in (i, j)]
            if seen and any(letters):
                strong += M.WEIGHTS["bar"]
            elif all(letters):
                strong += M.WEIGHTS["stacked"]
            else:
                digits += M.WEIGHTS["stacked"]
    return strong + digits if strong else 0


def merged_fragments(spans: list[Span], width: float, height: float, bar=None) -> list[Span]:
    """Formulas that were read in pieces, each as one span."""
    if width <= 0 or height <= 0 or no_fragments(spans, width, height):
        return []
    pieces = [s for s in body(spans, height) if M.fragment(s.text)]
    pairs, groups = fractions(pieces, bar), Groups(len(pieces))
    for i, j in close_pairs(pieces, 0.04 * height):
        a, b = pieces[i], pieces[j]
        if joinable(a, b, height) and (min(a.y2, b.y2) > max(a.y1, b.y1) or (i, j) in pairs or (j, i) in pairs):
            groups.join(i, j)
    out = []
    for members in groups.lists():
        parts = [pieces[i] for i in members]
        box = hull(s.box for s in parts)
        text = " ".join(s.text.strip() for s in sorted(parts, key=lambda s: (s.cy, s.x1)))
        fits = len(parts) > 1 and box[2] - box[0] <= 0.72 * width and box[3] - box[1] <= 0.22 * height
        if fits and not M.rule_line(text) and M.signal(text) and M.real_formula(text, layout_weight(members, pieces, pairs)) and not M.contents_like([text]):
            out.append(Span(text, *box))
    return out


def page_gutter(spans: list[Span], width: float) -> float | None:
    """Middle of the widest gap of 70 points or more between two columns of three spans or more."""
    xs = sorted(s.cx for s in spans if s.text.strip() and not M.equation_number(s.text))
    if width <= 0 or len(xs) < 8:
        return None
    mids = [(b - a, -i, (a + b) / 2) for i, (a, b) in enumerate(zip(xs, xs[1:]), 1) if b - a >= 70 and 0.28 * width <= (a + b) / 2 <= 0.72 * width and 3 <= i <= len(xs) - 3]
    return max(mids)[2] if mids else None


def right_limit(spans: list[Span], box: Box, width: float) -> float:
    """How far right a formula may reach without crossing into the next column."""
    gutter = page_gutter(spans, width)
    return width if gutter is None or (box[0] + box[2]) / 2 >= gutter else max(box[2], gutter - 4)


def grown_right(box: Box, spans: list[Span], limit: float, gap: float = 36.0) -> Box:
    """The box with what adjoins it on the right, word by word, but for prose and equation numbers."""
    able = sorted((s for s in spans if not M.equation_number(s.text) and not ((M._P["word"].search(s.text) or M._P["cyrillic"].search(s.text)) and not M.signal(s.text)) and s.y2 >= box[1] - 8 and s.y1 <= box[3] + 8 and s.x1 <= limit), key=lambda s: s.x1)
    x2, left = box[2], able
    while near := [s for s in left if x2 - 2 <= s.x1 <= x2 + gap]:
        s = near[0]
        x2 = max(x2, min(s.x2 + 4, limit))
        left = [t for t in left if t is not s]
    return box[0], box[1], min(limit, x2), box[3]


def formula_lines(spans: list[Span], width: float, height: float) -> list[Span]:
    """Pieces of one formula on one row of one column, as one span."""
    out = []
    for r in rows(body(spans, height), 7.0):
        groups: list[list[Span]] = []
        for s in sorted(r, key=lambda s: s.x1):
            last = groups[-1][-1] if groups else None
            if last is None or s.x1 - last.x2 > JOIN or M.equation_number(s.text) or M.prose_piece(s.text) or M.prose_piece(last.text):
                groups.append([s])
            else:
                groups[-1].append(s)
        for g in groups:
            text, box = line_text(g), hull(s.box for s in g)
            if M.math_score(text) >= 0.55 and not M.rule_line(text) and len(M._P["long"].findall(text)) < 2 and 12 <= box[2] - box[0] <= 0.72 * width:
                out.append(Span(text, *box))
    return out


def formula_regions(spans: list[Span], width: float, height: float, bar=None) -> list[dict]:
    """Regions of mathematical lines that adjoin each other, then of merged fragments where none is yet."""
    from lexigrove.operators.regions import overlapping

    scored = [(s, v) for s in spans if not M.rule_line(s.text) and (v := M.math_score(s.text)) >= 0.55]
    scored += [(s, M.math_score(s.text)) for s in formula_lines(spans, width, height)]
    groups = Groups(len(scored))
    loose = [M.equation_number(s.text) or M.prose_piece(s.text) for s, _ in scored]
    for i, j in close_pairs([s for s, _ in scored], 18):
        a, b = scored[i][0], scored[j][0]
        if not (loose[i] or loose[j]) and _gap(a.x1, a.x2, b.x1, b.x2) <= JOIN and not separate_rows(a, b):
            groups.join(i, j)

    def padded(box: Box) -> tuple[Box, float]:
        seed = max(0.0, box[0] - PAD), max(0.0, box[1] - PAD), min(width, box[2] + PAD), min(height, box[3] + PAD)
        limit = right_limit(spans, seed, width)
        return (seed[0], seed[1], min(seed[2], limit), seed[3]), limit

    out = []
    for members in groups.lists():
        part = [scored[i] for i in members]
        own = hull(s.box for s, _ in part)
        seed, limit = padded(own)
        box = grown_right(seed, spans, limit)
        if own[1] >= EDGE and own[3] <= height - EDGE and (box[2] - box[0]) * (box[3] - box[1]) <= 0.25 * width * height:
            out.append(region("formula", box, float(np.mean([v for _, v in part])), "span_math_heuristic", [f"n_spans={len(part)}", "text=" + " | ".join(s.text.strip() for s, _ in part)]))
    for s in merged_fragments(spans, width, height, bar):
        box, _ = padded(s.box)
        if not any(overlapping(box, (r["x1"], r["y1"], r["x2"], r["y2"])) for r in out):
            ratio = M.markers(s.text) / (len("".join(s.text.split())) or 1)
            out.append(region("formula", box, min(0.85, 0.60 + 0.25 * min(1.0, ratio)), "span_fragment_merge", ["merged_fragments", f"text={s.text}"]))
    return out


# -- frames -----------------------------------------------------------------------------------------------------------


def read_pages(pages: DataFrame) -> DataFrame:
    """Text in reading order: text, n_columns, likely_table, notes."""
    return per_page(pages, reading_order, "text string, n_columns int, likely_table boolean, notes array<string>")


def read_ocr(pages: DataFrame) -> DataFrame:
    """Text of recognised words: text, n_columns, n_lines, short_ratio, formula_suspect."""
    return per_page(pages, ocr_text, "text string, n_columns int, n_lines int, short_ratio double, formula_suspect boolean")


def detect(pages: DataFrame) -> DataFrame:
    """Formula and table regions of every page, as an array of REGION."""
    return per_page(pages, lambda s, w, h: (formula_regions(s, w, h) + table_regions(s, w, h),), f"regions array<{REGION}>")
