"""Ink of page images, as rows: strokes, coverage, profiles, components, bars, ruled grids, figures.

A stroke is a run of dark pixels in one line of a page's image: (doc_id, page, y, x1, x2), x2 excluded; a page's strokes do not
overlap. ``strokes`` makes them from grey rasters, ``drawn`` from boxes; with ``turned`` lines are columns. All else is joins on
(page, line), windows and sums over strokes, so pages of any number are spread and a page of any size is many small rows. Only
connected components and crossing rules need a page's strokes together: a page is the unit there, and a task takes many pages at once.

Slabs (``filled``) are strokes with ``y2``: the same stroke in all lines from y to y2, y2 excluded. A page's slabs are cut at the same
lines, so those that begin in one line end in one line. A page of few boxes has few of them, however tall it is, and they stay with
their page: what ``filled`` returns is dealt by page. ``area``, ``inside``, ``agreement``, ``labelled``, ``components``, ``rules`` and ``grids``
take either.

Boxes are structs x1, y1, x2, y2; in pixels here, from points by ``boxes.points_to_pixels``. ``pages`` are (doc_id, page, page_w,
page_h in points, width, height in pixels, dpi). Extra columns are dropped; pages without strokes have no rows unless said.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrove.functions import boxes as B
from lexigrove.functions.linked import roots, touching, whole_groups

KEY = ["doc_id", "page"]
STROKE = "doc_id string, page long, y int, x1 int, x2 int"

# What is dark against the median, against the paper, and around a pixel; how bars are told from rules.
PAPER, BELOW_PAPER, FAR_BELOW, FLOOR = 85.0, 8.0, 30.0, 40.0
AROUND, BELOW_AROUND = 15, 10
# Figures by ink (share of the page at least and at most, side in pixels, sides' ratio, how many), and tightening.
FIGURE_SHARE, FIGURE_MOST, FIGURE_SIDE, FIGURE_RATIO, FIGURES = 0.03, 0.55, 80, 8.0, 8
DENSE, BRIDGE, PAD, LEAST_INK, LEAST_SIDE = 0.1, 18.0, 6.0, 40, 12
# Ruled grids (share of a page's side a rule needs at least, the same in pixels, share of the page, lines each way).
RULE, RULE_PIXELS, GRID_LEAST, GRID_MOST, GRID_WIDE, GRID_TALL, GRID_LINES, GRID_INK = 35, 22, 0.015, 0.55, 0.20, 0.04, 3, 1.2


def below_median(by: float) -> Callable[[np.ndarray], np.ndarray]:
    return lambda g: g < np.median(g) - by


def below_paper(percentile: float = PAPER) -> Callable[[np.ndarray], np.ndarray]:
    """Darker than the paper, which is the brightness that most of the page reaches."""

    def dark(g: np.ndarray) -> np.ndarray:
        paper = float(np.percentile(g, percentile))
        return g < min(paper - BELOW_PAPER, max(paper - FAR_BELOW, FLOOR))

    return dark


def below_around(size: int = AROUND, by: float = BELOW_AROUND) -> Callable[[np.ndarray], np.ndarray]:
    """Darker than the mean of the square around a pixel, the border's pixels repeated outside."""

    def dark(g: np.ndarray) -> np.ndarray:
        half = size // 2
        sums = np.pad(np.pad(g.astype(np.int64), half, "edge"), ((1, 0), (1, 0))).cumsum(0).cumsum(1)
        around = sums[size:, size:] - sums[:-size, size:] - sums[size:, :-size] + sums[:-size, :-size]
        return g <= np.rint(around / size**2) - by

    return dark


def strokes(rasters: DataFrame, dark: Callable[[np.ndarray], np.ndarray], turned: bool = False) -> DataFrame:
    """Strokes of grey rasters (doc_id, page, width, height, gray: one byte a pixel, row by row); rasters of another size have none."""

    def run(batches):
        for b in batches:
            for doc, page, w, h, gray in zip(*(b.column(i).to_pylist() for i in range(5))):
                if not w or not h or gray is None or len(gray) != w * h:
                    continue
                ink = dark(np.frombuffer(gray, np.uint8).reshape(h, w))
                ink = ink.T if turned else ink
                edge = np.diff(np.pad(ink, ((0, 0), (1, 1))).astype(np.int8), axis=1)
                y, begin = np.nonzero(edge > 0)
                end = np.nonzero(edge < 0)[1]
                yield pa.RecordBatch.from_arrays([pa.array([doc] * len(y), pa.string()), pa.array([page] * len(y), pa.int64()), *(pa.array(v.astype(np.int32)) for v in (y, begin, end))], ["doc_id", "page", "y", "x1", "x2"])

    return rasters.select(F.col("doc_id").cast("string"), F.col("page").cast("long"), F.col("width").cast("int"), F.col("height").cast("int"), "gray").mapInArrow(run, STROKE)


def _lines(boxes: DataFrame, *more: str, turned: bool = False) -> DataFrame:
    """One row for each line (column if ``turned``) of each pixel box that has any: doc_id, page, y, x1, x2 and ``more``."""
    b = F.col("box")
    a, z, lo, hi = ("x1", "x2", "y1", "y2") if turned else ("y1", "y2", "x1", "x2")
    own = boxes.where((b[z] > b[a]) & (b[hi] > b[lo]))
    return own.select(*KEY, F.explode(F.sequence(b[a].cast("int"), b[z].cast("int") - 1)).alias("y"), b[lo].cast("int").alias("x1"), b[hi].cast("int").alias("x2"), *more)


def _islands(rows: DataFrame, by: list[str], begin: str, end: str, reach) -> DataFrame:
    """``rows`` with ``island``: intervals whose gap to what stands before them is at most ``reach`` belong together."""
    order = Window.partitionBy(*by).orderBy(begin, end)
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce(F.col(begin) - before > reach, F.lit(True))
    return rows.withColumn("_fresh", fresh.cast("int")).withColumn("island", F.sum("_fresh").over(order)).drop("_fresh")


def drawn(boxes: DataFrame, turned: bool = False) -> DataFrame:
    """Strokes of filled pixel boxes (doc_id, page, box), where they overlap or adjoin as one."""
    by = [*KEY, "y"]
    return _islands(_lines(boxes, turned=turned), by, "x1", "x2", 0).groupBy(*by, "island").agg(F.min("x1").alias("x1"), F.max("x2").alias("x2")).drop("island")


def _bands(boxes: DataFrame, *more: str, turned: bool = False) -> DataFrame:
    """Pixel boxes cut at the upper and lower edges of all boxes of their page: doc_id, page, y, y2, x1, x2 and ``more``.

    A box has no more bands than lines.
    """
    b = F.col("box")
    a, z, lo, hi = ("x1", "x2", "y1", "y2") if turned else ("y1", "y2", "x1", "x2")
    whole = boxes.select(*KEY, *(b[c].cast("int").alias(k) for k, c in (("y", a), ("_low", z), ("x1", lo), ("x2", hi))), *more).where("_low > y AND x2 > x1")
    page = Window.partitionBy(*KEY)
    cut = whole.withColumn("_cuts", F.array_union(F.collect_set("y").over(page), F.collect_set("_low").over(page)))
    own = cut.withColumn("_cuts", F.array_sort(F.filter("_cuts", lambda c: (c >= F.col("y")) & (c <= F.col("_low")))))
    at = own.select(*KEY, "_cuts", "x1", "x2", *more, F.explode(F.sequence(F.lit(0), F.size("_cuts") - 2)).alias("_at"))
    return at.select(*KEY, F.get("_cuts", F.col("_at")).alias("y"), F.get("_cuts", F.col("_at") + 1).alias("y2"), "x1", "x2", *more)


def filled(boxes: DataFrame, turned: bool = False) -> DataFrame:
    """Slabs of filled pixel boxes (doc_id, page, box), where they overlap or adjoin as one."""
    by = [*KEY, "y", "y2"]
    return _islands(_bands(boxes, turned=turned), by, "x1", "x2", 0).groupBy(*by, "island").agg(F.min("x1").alias("x1"), F.max("x2").alias("x2")).drop("island")


def _tall(found: DataFrame) -> Column:
    """Lines that a stroke or slab takes."""
    return F.col("y2") - F.col("y") if "y2" in found.columns else F.lit(1)


def _as_boxes(slabs: DataFrame) -> DataFrame:
    return slabs.select(*KEY, B.box(F.col("x1"), F.col("y"), F.col("x2"), F.col("y2")).alias("box"))


def common(a: DataFrame, b: DataFrame) -> DataFrame:
    """Strokes where both have ink; ``b`` may have more columns, which stay."""
    more = [c for c in b.columns if c not in (*KEY, "y", "x1", "x2")]
    j = a.select(*KEY, "y", F.col("x1").alias("a1"), F.col("x2").alias("a2")).join(b, [*KEY, "y"])
    j = j.select(*KEY, "y", F.greatest("a1", "x1").alias("x1"), F.least("a2", "x2").alias("x2"), *more)
    return j.where("x2 > x1")


def without(a: DataFrame, b: DataFrame) -> DataFrame:
    """Strokes of ``a`` where ``b`` (strokes) has none, in pieces: each end of a stroke of ``b`` within one of ``a`` begins a new piece."""
    cuts = common(a.withColumn("_", F.lit(0)).drop("_"), b.select(*KEY, "y", "x1", "x2"))
    by = [*KEY, "y"]
    # a piece lies between two events in a line where a's depth is one and b's is zero
    ends = lambda df, side: df.select(*by, F.col("x1").alias("x"), F.lit(1).alias(side)).union(df.select(*by, F.col("x2").alias("x"), F.lit(-1).alias(side)))
    events = ends(a, "a").withColumn("b", F.lit(0)).unionByName(ends(cuts, "b").withColumn("a", F.lit(0))).groupBy(*by, "x").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    order = Window.partitionBy(*by).orderBy("x")
    depth = events.select(*by, F.col("x").alias("x1"), F.lead("x").over(order).alias("x2"), F.sum("a").over(order).alias("a"), F.sum("b").over(order).alias("b"))
    return depth.where("a > 0 AND b = 0").select(*by, "x1", "x2")


def area(found: DataFrame) -> DataFrame:
    """(doc_id, page, ink): pixels with ink on each page that has any."""
    return found.groupBy(*KEY).agg(F.sum((F.col("x2") - F.col("x1")) * _tall(found)).alias("ink"))


def shared(slabs: DataFrame, boxes: DataFrame) -> DataFrame:
    """(doc_id, page, ink, text, both): pixels of the slabs, of the pixel boxes (doc_id, page, box), and of both, of each page with any."""
    text = F.col("text")
    rows = _bands(_as_boxes(slabs).withColumn("text", F.lit(False)).unionByName(boxes.select(*KEY, "box").withColumn("text", F.lit(True))), "text")
    before = Window.partitionBy(*KEY, "y").orderBy("x1", "x2").rowsBetween(Window.unboundedPreceding, -1)
    fresh = lambda own: F.greatest(F.lit(0), F.col("x2") - F.greatest("x1", F.coalesce(F.max(own).over(before), F.col("x1")))) * (F.col("y2") - F.col("y"))
    own = lambda side: F.when(side, F.col("x2"))
    sums = rows.select(*KEY, F.when(~text, fresh(own(~text))).otherwise(0).alias("ink"), F.when(text, fresh(own(text))).otherwise(0).alias("text"), fresh(F.col("x2")).alias("any"))
    return sums.groupBy(*KEY).agg(F.sum("ink").alias("ink"), F.sum("text").alias("text"), (F.sum("ink") + F.sum("text") - F.sum("any")).alias("both"))


def _ink_within(slabs: DataFrame, boxes: DataFrame) -> DataFrame:
    """(doc_id, page, box_id, ink) of the pixel boxes that hold any of the slabs; one sweep through each band, whatever meets there."""
    asked = boxes.select(*KEY, "box", "box_id", F.lit(True).alias("asked"))
    rows = _bands(_as_boxes(slabs).withColumn("asked", F.lit(False)).unionByName(asked, allowMissingColumns=True), "box_id", "asked")
    ends = F.array(F.struct(F.col("x1").alias("x"), F.lit(-1).alias("side")), F.struct(F.col("x2").alias("x"), F.lit(1).alias("side")))
    slab = F.array(F.struct(F.col("x1").alias("x"), F.lit(0).alias("side")))
    points = rows.select(*KEY, "y", "y2", "x2", "box_id", F.explode(F.when(F.col("asked"), ends).otherwise(slab)).alias("p")).select(*KEY, "y", "y2", "x2", "box_id", "p.x", "p.side")
    # ink to the left of a point: slabs that begin before it, less what the last of them has behind it
    order, slab = Window.partitionBy(*KEY, "y").orderBy("x").rowsBetween(Window.unboundedPreceding, 0), F.col("side") == 0
    left = F.coalesce(F.sum(F.when(slab, F.col("x2") - F.col("x"))).over(order), F.lit(0)) - F.greatest(F.lit(0), F.coalesce(F.max(F.when(slab, F.col("x2"))).over(order) - F.col("x"), F.lit(0)))
    swept = points.withColumn("part", F.col("side") * left * (F.col("y2") - F.col("y")))
    return swept.where(~slab).groupBy(*KEY, "box_id").agg(F.sum("part").alias("ink")).where("ink > 0")


def inside(found: DataFrame, boxes: DataFrame) -> DataFrame:
    """(doc_id, page, box_id, ink, share) of every pixel box (doc_id, page, box_id, box): its pixels with ink, and their share of it."""
    b = F.col("box")
    if "y2" in found.columns:
        hit = _ink_within(found, boxes)
    else:
        hit = common(found, _lines(boxes, "box_id")).groupBy(*KEY, "box_id").agg(F.sum(F.col("x2") - F.col("x1")).alias("ink"))
    out = boxes.select(*KEY, "box_id", "box").join(hit, [*KEY, "box_id"], "left")
    ink = F.coalesce("ink", F.lit(0))
    return out.select(*KEY, "box_id", ink.alias("ink"), (ink / F.greatest(F.lit(1), (b["x2"] - b["x1"]) * (b["y2"] - b["y1"]))).alias("share"))


def pixel_boxes(spans: DataFrame, pages: DataFrame, grow: int = 0) -> DataFrame:
    """``spans`` (doc_id, page, box in points) with boxes in whole pixels, ``grow`` wider, within the image."""
    b = B.points_to_pixels(F.col("box"), F.col("dpi"))
    zero = F.lit(0)
    put = B.box(F.greatest(zero, b["x1"] - grow), F.greatest(zero, b["y1"] - grow), F.least(F.col("width"), b["x2"] + grow), F.least(F.col("height"), b["y2"] + grow))
    return spans.join(pages.select(*KEY, "width", "height", "dpi"), KEY).withColumn("box", put).drop("width", "height", "dpi")


def agreement(found: DataFrame, spans: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, page, visual, ink_ratio, text_cover, ink_in_text, both) of every page: how well the text layer's boxes cover the ink.

    ``both``: pixels with ink that a box covers.

    No spans: 0. Boxes that cover nothing: 0.2. Ink on more than 2 % of a page whose text covers less than 0.5 %: 0.25 at most.
    """
    text = pixel_boxes(spans, pages)
    if "y2" in found.columns:
        sums = [shared(found, text)]
    else:
        text = drawn(text)
        sums = [area(found), area(text).withColumnRenamed("ink", "text"), area(common(found, text)).withColumnRenamed("ink", "both")]
    sums = [*sums, spans.groupBy(*KEY).agg(F.count("*").alias("spans"))]
    out = pages.select(*KEY, (F.col("width") * F.col("height")).cast("double").alias("size"))
    for s in sums:
        out = out.join(s, KEY, "left")
    out = out.na.fill(0)
    ratio, cover = F.col("ink") / F.col("size"), F.col("text") / F.col("size")
    in_text = F.col("both") / F.greatest(F.col("text"), F.lit(1))
    score = 0.55 * in_text + 0.45 * F.least(F.lit(1.0), 3 * F.col("both") / (F.col("ink") + 1e-6))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))
    score = F.when((ratio > 0.02) & (cover < 0.005), F.least(score, F.lit(0.25))).otherwise(score)
    return out.select(*KEY, F.when(F.col("spans") == 0, 0.0).when(cover < 1e-6, 0.2).otherwise(score).alias("visual"), ratio.alias("ink_ratio"), cover.alias("text_cover"), in_text.alias("ink_in_text"), "both")


# -- profiles -----------------------------------------------------------------------------------------------------------


def _longest(dense: DataFrame, by: list[str], reach) -> DataFrame:
    """The longest stretch (a, z) of intervals [x1, x2) with holes bridged; the first of equal ones. ``reach``: least distance of two dense lines that is not bridged, less one."""
    runs = _islands(dense, by, "x1", "x2", reach).groupBy(*by, "island").agg(F.min("x1").alias("a"), F.max("x2").alias("z"))
    return runs.groupBy(*by).agg(F.min_by(F.struct("a", "z"), F.struct((F.col("a") - F.col("z")).alias("size"), F.col("a").alias("a"))).alias("run"))


def column_counts(found: DataFrame, by: list[str]) -> DataFrame:
    """(by, x1, x2, n): between x1 and x2 each column holds ``n`` (1 or more) of the strokes."""
    ends = found.select(*by, F.col("x1").alias("x"), F.lit(1).alias("d")).union(found.select(*by, F.col("x2").alias("x"), F.lit(-1).alias("d")))
    order = Window.partitionBy(*by).orderBy("x")
    events = ends.groupBy(*by, "x").agg(F.sum("d").alias("d"))
    return events.select(*by, F.col("x").alias("x1"), F.lead("x").over(order).alias("x2"), F.sum("d").over(order).alias("n")).where("n > 0 AND x2 > x1")


def tightened(found: DataFrame, boxes: DataFrame, pages: DataFrame, pad: float = PAD, relative: float = DENSE) -> DataFrame:
    """``boxes`` (doc_id, page, box_id, box in points) shrunk to the densest block of ink: doc_id, page, box_id, box.

    A line counts when its share of ink is at least ``relative`` of the densest line's; the longest run of such lines is kept,
    holes of up to BRIDGE points bridged; the same for columns within these lines. Boxes under LEAST_SIDE pixels or with less
    than LEAST_INK pixels of ink stay as they are.
    """
    by = [*KEY, "box_id"]
    facts = pixel_boxes(boxes.select(*by, "box"), pages).join(pages.select(*KEY, "width", "height", "dpi"), KEY).select(*by, F.col("box").alias("px"), "width", "height", "dpi", F.greatest(F.lit(2), (BRIDGE * F.col("dpi") / B.POINTS).cast("int")).alias("gap"))
    p = F.col("px")
    able = facts.where((p["x2"] - p["x1"] >= LEAST_SIDE) & (p["y2"] - p["y1"] >= LEAST_SIDE))
    held = common(found, _lines(able.withColumn("box", p), "box_id"))
    lines = held.groupBy(*by, "y").agg(F.sum(F.col("x2") - F.col("x1")).alias("n"))
    # bridged where b - a <= gap for two dense lines a < b, that is b - (a + 1) <= gap - 1
    whole = Window.partitionBy(*by)
    lines = lines.withColumn("peak", F.max("n").over(whole)).withColumn("ink", F.sum("n").over(whole)).where(F.col("ink") >= LEAST_INK)
    lines = lines.join(able, by)
    wide = p["x2"] - p["x1"]
    dense = lines.where(F.col("n") / wide >= F.greatest(F.lit(1e-4), relative * (F.col("peak") / wide)))
    rows = _longest(dense.select(*by, F.col("y").alias("x1"), (F.col("y") + 1).alias("x2"), "gap"), by, F.col("gap") - 1)
    band = held.join(rows, by).where((F.col("y") >= F.col("run.a")) & (F.col("y") < F.col("run.z"))).drop("run")
    counts = column_counts(band, by).withColumn("peak", F.max("n").over(whole)).join(rows, by).join(able.select(*by, "gap"), by)
    tall = F.col("run.z") - F.col("run.a")
    dense = counts.where(F.col("n") / tall >= F.greatest(F.lit(1e-4), relative * (F.col("peak") / tall)))
    columns = _longest(dense.select(*by, "x1", "x2", "gap"), by, F.col("gap") - 1).withColumnRenamed("run", "across")
    margin = F.greatest(F.lit(1), (pad * F.col("dpi") / B.POINTS).cast("int"))
    own = B.cropped(B.box(F.col("across.a"), F.col("run.a"), F.col("across.z"), F.col("run.z")), margin, F.col("width"), F.col("height"))
    tight = facts.join(rows, by).join(columns, by).select(*by, B.pixels_to_points(own, F.col("dpi")).alias("tight"))
    return boxes.select(*by, "box").join(tight, by, "left").select(*by, F.coalesce("tight", F.col("box").cast("struct<x1:double,y1:double,x2:double,y2:double>")).alias("box"))


def extended(found: DataFrame, formulas: DataFrame, pages: DataFrame, reach: float = 220.0, gap: float = 18.0) -> DataFrame:
    """``formulas`` (doc_id, page, box_id, box in points, limit: where a column ends, or null) grown to a fraction on their right.

    Only tall ink counts: columns of a band around the formula that are at least 0.28 dark and 0.45 of the darkest one. A white
    gap of ``gap`` points ends the search. The box then reaches from the first to the last dense line around it.
    """
    by = [*KEY, "box_id"]
    f = formulas.join(pages.select(*KEY, "page_w", "page_h", "width", "height", "dpi"), KEY)
    b, dpi = F.col("box"), F.col("dpi")
    px = lambda c: (c * dpi / B.POINTS).cast("int")
    limit = F.least(F.col("page_w"), F.coalesce("limit", F.col("page_w")))
    zero = F.lit(0)
    band = B.box(F.greatest(zero, px(b["x1"])), F.greatest(zero, px(F.greatest(F.lit(0.0), b["y1"] - 18))), F.least(F.col("width"), px(F.least(limit, b["x2"] + reach))), F.least(F.col("height"), px(F.least(F.col("page_h"), b["y2"] + 18))))
    f = f.withColumn("limit", limit).withColumn("band", band).withColumn("hole", F.greatest(F.lit(2), px(F.lit(gap))))
    d = F.col("band")
    f = f.where((d["x2"] - d["x1"] >= 8) & (d["y2"] - d["y1"] >= 8)).withColumn("origin", d["x1"] + F.greatest(zero, F.least(d["x2"] - d["x1"] - 1, px(b["x2"] - b["x1"]))))
    held = common(found, _lines(f.select(*by, d.alias("box")), "box_id"))
    whole = Window.partitionBy(*by)
    counts = column_counts(held, by).withColumn("peak", F.max("n").over(whole)).join(f, by)
    tall = d["y2"] - d["y1"]
    most = F.col("peak") / tall
    dense = counts.where((most >= 0.02) & (F.col("n") / tall >= F.greatest(F.lit(0.28), 0.45 * most)) & (F.col("x2") > F.col("origin")))
    dense = dense.select(*by, F.greatest("x1", "origin").alias("x1"), "x2", "origin", "hole")
    # the scan goes on while no hole is wider; it starts at the origin
    order = Window.partitionBy(*by).orderBy("x1")
    before = F.coalesce(F.lag("x2").over(order), F.col("origin") + 1)
    broken = F.sum((F.col("x1") - before > F.col("hole")).cast("int")).over(order)
    last = dense.withColumn("broken", broken).where("broken = 0").groupBy(*by).agg((F.max("x2") - 1).alias("last"))
    grown = f.join(last, by).where(F.col("last") > F.col("origin") + 4)
    right = F.least(F.col("limit"), (F.col("last") + 1) * B.POINTS / dpi + 4)
    up = px(F.lit(20.0))
    search = B.box(F.greatest(zero, px(b["x1"])), F.greatest(zero, F.greatest(zero, px(b["y1"])) - up), F.least(F.col("width"), px(right)), F.least(F.col("height"), F.least(F.col("height"), px(b["y2"]) + px(F.lit(36.0))) + up))
    grown = grown.withColumn("search", search)
    rows = common(found, _lines(grown.select(*by, F.col("search").alias("box")), "box_id")).groupBy(*by, "y").agg(F.sum(F.col("x2") - F.col("x1")).alias("n")).withColumn("peak", F.max("n").over(whole))
    wide = F.col("search.x2") - F.col("search.x1")
    rows = rows.join(grown.select(*by, "search"), by).where(F.col("n") / wide >= F.greatest(F.lit(0.02), 0.15 * (F.col("peak") / wide))).groupBy(*by).agg(F.min("y").alias("top"), (F.max("y") + 1).alias("low"))
    new = B.box(F.col("search.x1"), F.col("top"), F.least(F.col("width"), F.col("last") + 1), F.col("low"))
    plain = B.box(b["x1"], b["y1"], right, b["y2"])
    got = grown.join(rows, by, "left").select(*by, F.when(F.col("top").isNull(), plain).otherwise(B.pixels_to_points(new, dpi)).alias("grown"))
    return formulas.select(*by, "box").join(got, by, "left").select(*by, F.coalesce("grown", F.col("box").cast("struct<x1:double,y1:double,x2:double,y2:double>")).alias("box"))


def fraction_bars(found: DataFrame, pairs: DataFrame, pages: DataFrame) -> DataFrame:
    """``pairs`` (doc_id, page, pair_id, top, low: boxes in points) that have a bar between them: doc_id, page, pair_id.

    A bar is a stroke (holes of up to three pixels closed) that covers 0.7 of the narrower side, meets the pair, and goes past
    it by half of its width at most: a longer one is a rule.
    """
    t, o = F.col("top"), F.col("low")
    s = F.col("dpi") / B.POINTS
    left, right = F.least(t["x1"], o["x1"]), F.greatest(t["x2"], o["x2"])
    wide = F.greatest(F.lit(1.0), right - left)
    narrow = F.greatest(F.lit(1.0), F.least(t["x2"] - t["x1"], o["x2"] - o["x1"]))
    whole = lambda c: c.cast("int")
    y1 = F.least(t["y2"] - 0.25 * (t["y2"] - t["y1"]), o["y1"])
    y2 = F.greatest(o["y1"] + 0.25 * (o["y2"] - o["y1"]), t["y2"])
    roi = B.box(whole(F.greatest(F.lit(0.0), (left - wide) * s)), whole(F.greatest(F.lit(0.0), y1 * s)), whole(F.least(F.col("width").cast("double"), (right + wide) * s)), whole(F.least(F.col("height").cast("double"), y2 * s)))
    p = pairs.join(pages.select(*KEY, "width", "height", "dpi"), KEY)
    p = p.select(*KEY, "pair_id", roi.alias("box"), whole(left * s).alias("c1"), whole(right * s).alias("c2"), whole(0.5 * wide * s).alias("slack"), F.greatest(F.lit(6), whole(0.7 * narrow * s)).alias("least"))
    b = F.col("box")
    p = p.where((b["x2"] - b["x1"] >= 4) & (b["y2"] - b["y1"] >= 1))
    held = common(found, _lines(p, "pair_id", "c1", "c2", "slack", "least"))
    by = [*KEY, "pair_id", "y"]
    runs = _islands(held, by, "x1", "x2", 3).groupBy(*by, "island", "c1", "c2", "slack", "least").agg(F.min("x1").alias("x1"), F.max("x2").alias("x2"))
    a, z = F.col("x1"), F.col("x2")
    good = (z - a >= F.col("least")) & (z > F.col("c1")) & (a < F.col("c2")) & (a >= F.col("c1") - F.col("slack")) & (z <= F.col("c2") + F.col("slack"))
    return runs.where(good).select(*KEY, "pair_id").distinct()


# -- components, figures, grids ------------------------------------------------------------------------------------------


def _numbers(t: pa.Table, *names: str) -> list[np.ndarray]:
    return [t.column(c).to_numpy().astype(np.int64) for c in names]


def _parts(t: pa.Table, at: np.ndarray) -> np.ndarray:
    """The first of the strokes or slabs (sorted by page, line, place) that each hangs together with; ``at``: where pages begin."""
    y, y2, a, z = _numbers(t, "y", "y2", "x1", "x2")
    page = np.zeros(len(y), bool)
    page[at] = True
    # lines that adjoin on the page have numbers in a row, all others are further apart
    line = np.zeros(len(y), np.int64)
    apart = page[1:] | (y[1:] != y2[:-1])
    line[1:] = np.where(page[1:] | (y[1:] != y[:-1]), 1 + apart, 0)
    return roots(len(y), *touching(np.cumsum(line), a, z))


def _by_page(found: DataFrame, *order: str) -> DataFrame:
    """Each page in one task and its rows in a row, numbered by ``n`` from one; keys as string and long.

    The window is what keeps a page together: a repartition may be left out where a join below is dealt anew while it runs.
    """
    keyed = found.withColumn("doc_id", F.col("doc_id").cast("string")).withColumn("page", F.col("page").cast("long"))
    return keyed.withColumn("n", F.row_number().over(Window.partitionBy(*KEY).orderBy(*order)))


def _stacked(found: DataFrame) -> DataFrame:
    return _by_page(found.select(*KEY, "y", (F.col("y") + _tall(found)).alias("y2"), "x1", "x2"), "y", "x1")


def labelled(found: DataFrame) -> DataFrame:
    """Strokes (slabs) with ``component``, the number of the first stroke (by line, place) of those they hang together with, corners included.

    A page's strokes meet in one task, as four numbers each.
    """
    names = [c for c in (*KEY, "y", "y2", "x1", "x2") if c in found.columns]

    def run(batches):
        for t, at in whole_groups(batches):
            part = _parts(t, at)
            yield from t.select(names).append_column("component", pa.array(part - at[np.searchsorted(at, part, "right") - 1])).to_batches()

    own = _stacked(found)
    return own.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in own.select(*names).dtypes) + ", component long")


def components(found: DataFrame) -> DataFrame:
    """(doc_id, page, component, box in pixels, ink) of the connected parts of each page."""

    def run(batches):
        for t, at in whole_groups(batches):
            part = _parts(t, at)
            y, y2, a, z = _numbers(t, "y", "y2", "x1", "x2")
            order = np.argsort(part, kind="stable")
            begin = np.flatnonzero(np.diff(part[order], prepend=-1))
            first = part[order][begin]
            each = lambda how, v: pa.array(how.reduceat(v[order], begin).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [*(t.column(c).combine_chunks().take(pa.array(first)) for c in KEY), pa.array(first - at[np.searchsorted(at, first, "right") - 1]), each(np.minimum, a), each(np.minimum, y), each(np.maximum, z), each(np.maximum, y2), pa.array(np.add.reduceat(((z - a) * (y2 - y))[order], begin))],
                [*KEY, "component", *"abcd", "ink"],
            )

    g = _stacked(found).mapInArrow(run, "doc_id string, page long, component long, a int, b int, c int, d int, ink long")
    return g.select(*KEY, "component", B.box(*(F.col(x) for x in "abcd")).alias("box"), "ink")


def ink_figures(found: DataFrame, spans: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, page, box in points, score, method): large connected ink that is no text, at most FIGURES a page by the size of their boxes."""
    text = drawn(pixel_boxes(spans.select(*KEY, "box"), pages, 2))
    parts = components(without(found, text)).join(pages.select(*KEY, (F.col("width") * F.col("height")).alias("size"), "page_w", "page_h", "dpi"), KEY)
    b = F.col("box")
    w, h = b["x2"] - b["x1"], b["y2"] - b["y1"]
    fits = (F.col("ink") >= FIGURE_SHARE * F.col("size")) & (F.col("ink") <= FIGURE_MOST * F.col("size")) & (w >= FIGURE_SIDE) & (h >= FIGURE_SIDE) & (w <= FIGURE_RATIO * h) & (h <= FIGURE_RATIO * w)
    parts = parts.where(fits).select(*KEY, F.col("component").alias("box_id"), B.pixels_to_points(b, F.col("dpi")).alias("box"), F.least(F.lit(1.0), F.col("ink") / (0.15 * F.col("size"))).alias("score"))
    tight = tightened(found, parts, pages).join(parts.select(*KEY, "box_id", "score"), [*KEY, "box_id"]).join(pages.select(*KEY, "page_w", "page_h"), KEY)
    tight = tight.where(B.figure_fault(F.col("box"), F.col("page_w"), F.col("page_h")).isNull())
    order = Window.partitionBy(*KEY).orderBy(B.area(F.col("box")).desc(), "box_id")
    return tight.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= FIGURES).select(*KEY, "box", "score", F.lit("nontext_ink_cc").alias("method"))


def embedded_figures(images: DataFrame, found: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, page, box in points, score, method) of embedded images (doc_id, page, box_id, box) that can be figures, shrunk to their ink.

    A box that stands at the foot of the page with its sides swapped has its origin at the bottom left and is turned.
    """
    p = images.join(pages.select(*KEY, "page_w", "page_h"), KEY)
    b, h = F.col("box"), F.col("page_h")
    low = (b["y1"] > 0.5 * h) & (b["y2"] > 0.85 * h) & (b["y1"] > b["y2"])
    sides = B.box(F.least(b["x1"], b["x2"]), F.least(b["y1"], b["y2"]), F.greatest(b["x1"], b["x2"]), F.greatest(b["y1"], b["y2"]))
    p = p.select(*KEY, "box_id", F.when(low, B.flipped(b, h)).otherwise(sides).alias("box"))
    tight = tightened(found, p, pages).join(pages.select(*KEY, "page_w", "page_h"), KEY)
    good = tight.where(B.figure_fault(F.col("box"), F.col("page_w"), F.col("page_h")).isNull())
    return good.select(*KEY, "box", F.lit(0.80).alias("score"), F.lit("pdf_image").alias("method"))


def rules(found: DataFrame, pages: DataFrame, turned: bool = False) -> DataFrame:
    """Strokes that are long enough for a rule: a 35th of the page's side, at least 22 pixels."""
    side = F.col("height" if turned else "width")
    p = pages.select(*KEY, F.greatest(F.floor(side / RULE), F.lit(RULE_PIXELS)).alias("least"))
    long = found.join(p, KEY).where(F.col("x2") - F.col("x1") >= F.col("least")).drop("least")
    return long.withColumn("y", F.explode(F.sequence("y", F.col("y2") - 1))).drop("y2") if "y2" in found.columns else long


def grids(across: DataFrame, down: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, page, box in pixels, n_h, n_v, score) of ruled tables: rules that cross, directly or by way of others.

    ``across`` and ``down`` are strokes by lines and by columns (``turned``). A table has GRID_LINES lines each way, where rows
    of pixels that hold a rule for an eighth of its side count, those within six pixels as one line.
    """
    row = [*KEY, "y", "x1", "x2"]
    both = rules(across, pages).select(*row, F.lit(False).alias("turned")).union(rules(down, pages, True).select(*row, F.lit(True).alias("turned")))
    schema = "doc_id string, page long, turned boolean, y int, x1 int, x2 int, component long"

    def run(batches):
        for t, at in whole_groups(batches):
            y, a, z = _numbers(t, "y", "x1", "x2")
            turned = t.column("turned").to_numpy()
            page = np.repeat(np.arange(len(at)), np.diff(at, append=len(y))) * (int(max(y.max(), z.max())) + 2)
            h, v = np.flatnonzero(~turned), np.flatnonzero(turned)
            v = v[np.argsort((page + y)[v], kind="stable")]
            place = (page + y)[v]
            lo, hi = np.searchsorted(place, (page + a)[h]), np.searchsorted(place, (page + z)[h])
            size = hi - lo
            total = np.cumsum(size)
            i = np.repeat(h, size)
            j = v[np.repeat(lo - (total - size), size) + np.arange(total[-1] if len(h) else 0)]
            cross = (y[i] >= a[j]) & (y[i] < z[j])
            part = roots(len(y), i[cross], j[cross])
            met = np.zeros(len(y), bool)  # rules that cross none are no table
            met[i[cross]] = met[j[cross]] = True
            own = t.append_column("component", pa.array(part - at[np.searchsorted(at, part, "right") - 1])).filter(pa.array(met))
            yield from own.select(["doc_id", "page", "turned", "y", "x1", "x2", "component"]).to_batches()

    key = lambda df: df.withColumn("doc_id", F.col("doc_id").cast("string")).withColumn("page", F.col("page").cast("long"))
    lines = _by_page(both, "turned", "y").mapInArrow(run, schema).join(key(pages.select(*KEY, "width", "height")), KEY)
    # joined by page, so that all that follows stays where the page is
    by = [*KEY, "component"]
    hulled, t = Window.partitionBy(*by), F.col("turned")
    sides = {"a": F.min(F.when(t, F.col("y")).otherwise(F.col("x1"))), "b": F.min(F.when(t, F.col("x1")).otherwise(F.col("y"))), "c": F.max(F.when(t, F.col("y") + 1).otherwise(F.col("x2"))), "d": F.max(F.when(t, F.col("x2")).otherwise(F.col("y") + 1))}
    lines = lines.select("*", *(v.over(hulled).alias(k) for k, v in sides.items()))
    wide, tall = F.col("c") - F.col("a"), F.col("d") - F.col("b")
    size = F.col("width") * F.col("height")
    lines = lines.where((wide * tall).between(GRID_LEAST * size, GRID_MOST * size) & (wide >= GRID_WIDE * F.col("width")) & (tall >= GRID_TALL * F.col("height")))
    rows = lines.groupBy(*by, *sides, "turned", "y").agg(F.sum(F.col("x2") - F.col("x1")).alias("n"))
    peak = F.col("n") >= F.greatest(F.lit(3.0), 0.12 * F.when(t, tall).otherwise(wide))
    before = F.max(F.when(peak, F.col("y"))).over(Window.partitionBy(*by, "turned").orderBy("y").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("fresh", (peak & F.coalesce(F.col("y") - before > 6, F.lit(True))).cast("int"))
    total = lambda c, side, name: F.sum(F.when(side, F.col(c)).otherwise(0)).alias(name)
    out = rows.groupBy(*by, *sides).agg(total("fresh", ~t, "n_h"), total("fresh", t, "n_v"), total("n", ~t, "ink_h"), total("n", t, "ink_v"))
    mean = lambda c: 255.0 * F.col(c) / (wide * tall)
    out = out.where((F.col("n_h") >= GRID_LINES) & (F.col("n_v") >= GRID_LINES) & (mean("ink_h") >= GRID_INK) & (mean("ink_v") >= GRID_INK))
    score = F.least(F.lit(1.0), 0.35 + 0.08 * F.least(F.col("n_h"), F.lit(8)) + 0.08 * F.least(F.col("n_v"), F.lit(8)) + (mean("ink_h") + mean("ink_v")) / 50)
    return out.select(*KEY, B.box(*(F.col(x) for x in "abcd")).alias("box"), "n_h", "n_v", score.alias("score"))


# -- figures at their captions, and all ways together -----------------------------------------------------------------------

# How far a figure reaches above and below its caption (share of the page, points), least window, what counts as the same.
ABOVE, BELOW, WINDOW_LEAST, SAME, ON_ROW = (0.52, 400.0), (0.40, 280.0), (40.0, 50.0), 0.35, 20.0
_WINDOW = "struct<caption:int,text:string,lead:boolean,cap:struct<y1:double,y2:double>,box:struct<x1:double,y1:double,x2:double,y2:double>>"


def caption_windows(spans: list, width: float, height: float) -> tuple[list[dict]]:
    """Where the figure of each caption may be: above and below it, up to the next body text and halfway to captions beside it."""
    from lexigrove.operators import regions as R

    captions = [g for g in R.caption_groups(spans) if R._CAPTION.match(g[0])]
    own = {id(s) for *_, group in captions for s in group}
    blockers = [s for s in spans if id(s) not in own and (sum(c.isalpha() for c in s.text) >= 15 or s.x2 - s.x1 >= 0.40 * width)]
    left, right = R.body_bounds(spans, width)
    out = []
    for n, (text, cap, _) in enumerate(captions):
        _, y1, _, y2 = cap
        beside = [b for _, b, _ in captions if b != cap and abs((b[1] + b[3]) / 2 - (y1 + y2) / 2) < ON_ROW]
        low, high = R.neighbour_bounds(cap, beside, width)
        a, z = max(left, low), min(right, high)
        if z - a < WINDOW_LEAST[0]:
            a, z = left, right
        top = max([s.y2 for s in blockers if s.y2 < y1 - 1], default=8.0)
        foot = min([s.y1 for s in blockers if s.y1 > y2 + 1], default=height - 8)
        above = max(top + 6, y1 - min(ABOVE[0] * height, ABOVE[1]), 8.0), max(y1 - 3, 12.0)
        below = min(height - 12, y2 + 3), min(foot - 6, y2 + min(BELOW[0] * height, BELOW[1]), height - 8)
        for b, c in (above, below):
            if c - b >= WINDOW_LEAST[1] and z - a >= WINDOW_LEAST[0]:
                out.append({"caption": n, "text": text, "lead": bool(R._MARK.match(text)), "cap": {"y1": y1, "y2": y2}, "box": {"x1": a, "y1": b, "x2": z, "y2": c}})
    return (out,)


def caption_figures(found: DataFrame, spans: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, page, box in points, score, method, text) of figures found from their captions, ``spans`` as in layout.page_rows.

    Of the windows above and below, the one whose dense ink stands closer to the caption counts, then the one that shrinks more;
    a window without ink is none. Of figures that overlap, the one closer to its caption stays.
    """
    from lexigrove.operators import layout

    seen = layout.per_page(layout.page_rows(spans), caption_windows, f"windows array<{_WINDOW}>")
    w = seen.select(*KEY, "page_w", "page_h", F.posexplode("windows").alias("box_id", "w")).select(*KEY, "page_w", "page_h", "box_id", "w.*")
    tight = tightened(found, w.select(*KEY, "box_id", "box"), pages).withColumnRenamed("box", "tight")
    t, b, cap = F.col("tight"), F.col("box"), F.col("cap")
    j = w.join(tight, [*KEY, "box_id"]).where((t != b) & B.figure_fault(t, F.col("page_w"), F.col("page_h")).isNull())
    gap = F.when(t["y2"] <= cap["y1"], cap["y1"] - t["y2"]).when(t["y1"] >= cap["y2"], t["y1"] - cap["y2"]).otherwise(0.0)
    before, after = F.greatest(B.width(b), F.lit(1.0)) * F.greatest(B.height(b), F.lit(1.0)), F.greatest(B.width(t), F.lit(0.0)) * F.greatest(B.height(t), F.lit(0.0))
    order = F.struct((~F.col("lead")).alias("a"), gap.alias("b"), ((after - before) / before).alias("c"), *(t[k].alias(k) for k in ("x1", "y1", "x2", "y2")), F.col("text"))
    chosen = j.withColumn("order", order).groupBy(*KEY, "caption").agg(F.min("order").alias("order"))
    # at most one row a caption, so a page's list is short
    listed = chosen.groupBy(*KEY).agg(F.sort_array(F.collect_list("order")).alias("all"))
    fold = lambda kept, x: F.when(F.exists(kept, lambda k: B.iou(k, x) >= SAME), kept).otherwise(F.concat(kept, F.array(x)))
    kept = listed.select(*KEY, F.explode(F.aggregate("all", F.slice("all", 1, 0), fold)).alias("o"))
    o = F.col("o")
    return kept.select(*KEY, B.box(*(o[k] for k in ("x1", "y1", "x2", "y2"))).alias("box"), F.lit(0.74).alias("score"), F.lit("caption_anchor").alias("method"), o["text"].alias("text"))


def as_regions(figures: DataFrame, kind: str = "figure") -> DataFrame:
    """(doc_id, page, found): figures of a page as an array of layout.REGION, for ``regions.with_detections``."""
    b = F.col("box")
    note = F.array(F.concat(F.lit("caption="), F.substring("text", 1, 80))) if "text" in figures.columns else F.array().cast("array<string>")
    one = F.struct(F.lit(kind).alias("type"), *(b[k].cast("double").alias(k) for k in ("x1", "y1", "x2", "y2")), F.col("score").cast("double").alias("score"), F.col("method"), note.alias("notes"))
    return figures.groupBy(*KEY).agg(F.sort_array(F.collect_list(one)).alias("found"))
