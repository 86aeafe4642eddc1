"""Ink as strokes, against plain loops over pixels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigrove.functions import pixels
from lexigrove.functions.linked import roots
from lexigrove.operators import images as images_
from lexigrove.operators import ink

BOX = "struct<x1:double,y1:double,x2:double,y2:double>"
DPI = 72


def image(seed, h=90, w=120, boxes=5):
    rng = np.random.default_rng(seed)
    g = np.full((h, w), 250, np.uint8)
    for _ in range(boxes):
        y, x = rng.integers(0, h - 12), rng.integers(0, w - 12)
        g[y : y + rng.integers(1, 30), x : x + rng.integers(1, 40)] = rng.integers(0, 60)
    g[rng.random((h, w)) < 0.01] = 10
    return g


def rasters(spark, images):
    return spark.createDataFrame([("d", i, g.shape[1], g.shape[0], bytearray(g.tobytes())) for i, g in enumerate(images)], "doc_id string, page long, width int, height int, gray binary")


def pages(spark, images, dpi=DPI):
    rows = [("d", i, g.shape[1] * 72 / dpi, g.shape[0] * 72 / dpi, g.shape[1], g.shape[0], dpi) for i, g in enumerate(images)]
    return spark.createDataFrame(rows, "doc_id string, page long, page_w double, page_h double, width int, height int, dpi int")


def painted(found, images, turned=False):
    """The strokes drawn again; fails where two overlap."""
    out = [np.zeros(g.shape[::-1] if turned else g.shape, int) for g in images]
    for r in found.collect():
        out[r.page][r.y, r.x1 : r.x2] += 1
    assert max(o.max() for o in out) <= 1
    return [o.astype(bool) for o in out]


@pytest.fixture(scope="module")
def images():
    return [image(s) for s in range(6)] + [np.full((40, 50), 255, np.uint8)]


@pytest.fixture(scope="module")
def boxes():
    rng = np.random.default_rng(7)
    out = []
    for page in range(6):
        for i in range(8):
            x, y = rng.integers(0, 100), rng.integers(0, 70)
            out.append(("d", page, i, (float(x), float(y), float(x + rng.integers(0, 60)), float(y + rng.integers(0, 40)))))
    return out


def framed(spark, boxes, *names):
    return spark.createDataFrame(boxes, f"doc_id string, page long, box_id long, box {BOX}")


def test_strokes_of_rasters(spark, images):
    for dark in (ink.below_median(12), ink.below_paper(), ink.below_around()):
        for turned in (False, True):
            got = painted(ink.strokes(rasters(spark, images), dark, turned), images, turned)
            assert all((p == (dark(g).T if turned else dark(g))).all() for p, g in zip(got, images))
    bad = spark.createDataFrame([("d", 1, 3, 3, bytearray(b"xx")), ("d", 2, 0, 0, None)], "doc_id string, page long, width int, height int, gray binary")
    assert ink.strokes(bad, ink.below_median(1)).count() == 0


def test_the_mean_around_a_pixel():
    g, dark = image(3, 20, 25), ink.below_around(5, 3)
    p = np.pad(g.astype(int), 2, "edge")
    want = np.array([[g[y, x] <= np.rint(p[y : y + 5, x : x + 5].mean()) - 3 for x in range(25)] for y in range(20)])
    assert (dark(g) == want).all()


def test_boxes_areas_and_shares(spark, images, boxes):
    found = ink.strokes(rasters(spark, images), ink.below_median(12))
    dark = [ink.below_median(12)(g) for g in images]
    masks = [np.zeros(g.shape, bool) for g in images]
    for _, page, _, (x1, y1, x2, y2) in boxes:
        masks[page][int(y1) : int(y2), int(x1) : int(x2)] = True
    inside = framed(spark, boxes).withColumn("box", F.col("box"))
    clipped = ink.pixel_boxes(inside, pages(spark, images))
    text = ink.drawn(clipped)
    assert all((a == b).all() for a, b in zip(painted(text, images), masks))
    assert all((a == b).all() for a, b in zip(painted(ink.common(found, text), images), [d & m for d, m in zip(dark, masks)]))
    assert all((a == b).all() for a, b in zip(painted(ink.without(found, text), images), [d & ~m for d, m in zip(dark, masks)]))
    assert {r.page: r.ink for r in ink.area(found).collect()} == {i: int(d.sum()) for i, d in enumerate(dark) if d.any()}
    got = {(r.page, r.box_id): (r.ink, r.share) for r in ink.inside(found, clipped).collect()}
    assert len(got) == len(boxes)
    for _, page, i, (x1, y1, x2, y2) in boxes:
        part = dark[page][int(y1) : int(y2), int(x1) : int(x2)]
        assert got[page, i] == (int(part.sum()), pytest.approx(part.mean() if part.size else 0.0))


def test_agreement_of_text_and_ink(spark, images, boxes):
    found, spans = ink.strokes(rasters(spark, images), ink.below_median(12)), framed(spark, [b for b in boxes if b[1] != 3] + [("d", 3, 0, (5.0, 5.0, 5.0, 9.0))])
    got = {r.page: r.visual for r in ink.agreement(found, spans, pages(spark, images)).collect()}
    for i, g in enumerate(images):
        dark, mask = ink.below_median(12)(g), np.zeros(g.shape, bool)
        for _, page, _, (x1, y1, x2, y2) in boxes:
            if page == i:
                mask[int(y1) : int(y2), int(x1) : int(x2)] = True
        both = (dark & mask).sum()
        want = min(1.0, 0.55 * both / max(1, mask.sum()) + 0.45 * min(1.0, 3 * both / (dark.sum() + 1e-6)))
        want = {3: 0.2, 6: 0.0}.get(i, min(want, 0.25) if dark.mean() > 0.02 and mask.mean() < 0.005 else want)
        assert got[i] == pytest.approx(want)


def longest(dense, gap):
    at, best, run = np.flatnonzero(dense), None, None
    for i in at:
        run = (run[0], i) if run and i - run[1] <= max(gap, 1) else (i, i)
        if best is None or run[1] - run[0] > best[1] - best[0]:
            best = run
    return best and (best[0], best[1] + 1)


def test_boxes_shrink_to_dense_ink(spark, images, boxes):
    found = ink.strokes(rasters(spark, images), ink.below_paper())
    for dpi in (72, 36):
        got = {(r.page, r.box_id): tuple(r.box) for r in ink.tightened(found, framed(spark, boxes), pages(spark, images, dpi)).collect()}
        assert len(got) == len(boxes)
        shrunk = 0
        for _, page, i, (x1, y1, x2, y2) in boxes:
            want, s = (x1, y1, x2, y2), dpi / 72
            h, w = images[page].shape
            a, b, c, d = (int(v * s) for v in want)
            part = ink.below_paper()(images[page])[b : min(d, h), a : min(c, w)]
            if part.shape[0] >= 12 and part.shape[1] >= 12 and part.sum() >= 40:
                gap = max(2, int(18 * dpi / 72))
                lines = part.mean(1)
                top, low = longest(lines >= max(1e-4, 0.1 * lines.max()), gap)
                cols = part[top:low].mean(0)
                left, right = longest(cols >= max(1e-4, 0.1 * cols.max()), gap)
                pad = max(1, int(6 * dpi / 72))
                want = tuple(v / s for v in (max(0, a + left - pad), max(0, b + top - pad), min(w, a + right + pad), min(h, b + low + pad)))
                shrunk += 1
            assert got[page, i] == pytest.approx(want), (page, i)
        assert shrunk >= 2


def flood(dark):
    label, n = np.zeros(dark.shape, int), 0
    for y, x in zip(*np.nonzero(dark)):
        if label[y, x]:
            continue
        n += 1
        todo = [(y, x)]
        while todo:
            p, q = todo.pop()
            if 0 <= p < dark.shape[0] and 0 <= q < dark.shape[1] and dark[p, q] and not label[p, q]:
                label[p, q] = n
                todo += [(p + i, q + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    return label


def test_components_are_those_of_a_flood(spark, images):
    rng = np.random.default_rng(5)
    many = [*images, np.where(rng.random((60, 70)) < 0.35, 0, 255).astype(np.uint8)]
    got: dict = {}
    for r in ink.components(ink.strokes(rasters(spark, many), ink.below_paper())).collect():
        got.setdefault(r.page, []).append((tuple(r.box), r.ink))
    for i, g in enumerate(many):
        label = flood(ink.below_paper()(g))
        want = []
        for k in range(1, label.max() + 1):
            y, x = np.nonzero(label == k)
            want.append(((x.min(), y.min(), x.max() + 1, y.max() + 1), len(y)))
        assert sorted(got.get(i, [])) == sorted(want)
    x, y = rng.integers(0, 500, (2, 300))
    assert (roots(500, x, y) <= np.arange(500)).all() and roots(3, np.array([2]), np.array([1])).tolist() == [0, 1, 1]


def test_figures_by_ink(spark):
    g = np.full((800, 600), 255, np.uint8)
    g[100:300, 100:350] = 20  # a figure
    g[400:410, 50:550] = 20  # a thin rule
    g[500:620, 100:400] = 20  # covered by text
    spans = spark.createDataFrame([("d", 0, 0, (100.0, 500.0, 400.0, 620.0))], f"doc_id string, page long, box_id long, box {BOX}")
    found = ink.strokes(rasters(spark, [g]), ink.below_median(15))
    got = ink.ink_figures(found, spans, pages(spark, [g])).collect()
    assert [(tuple(r.box), r.method) for r in got] == [((94.0, 94.0, 356.0, 306.0), "nontext_ink_cc")] and got[0].score == pytest.approx(200 * 250 / (0.15 * 480000))
    images = spark.createDataFrame([("d", 0, 0, (80.0, 80.0, 380.0, 330.0)), ("d", 0, 1, (0.0, 0.0, 600.0, 800.0)), ("d", 0, 2, (80.0, 720.0, 380.0, 690.0))], f"doc_id string, page long, box_id long, box {BOX}")
    assert [tuple(r.box) for r in ink.embedded_figures(images, found, pages(spark, [g])).collect()] == [(94.0, 94.0, 356.0, 306.0)] * 2


def test_bars_between_numerators_and_denominators(spark):
    g = np.full((100, 200), 255, np.uint8)
    g[30, 50:80] = 0
    g[30, 62:64] = 255  # noise breaks the bar
    g[70, 5:195] = 0  # a rule
    pairs = spark.createDataFrame([("d", 0, 1, (52.0, 15.0, 78.0, 28.0), (55.0, 33.0, 75.0, 45.0)), ("d", 0, 2, (52.0, 55.0, 78.0, 68.0), (55.0, 73.0, 75.0, 85.0)), ("d", 0, 3, (100.0, 15.0, 126.0, 28.0), (100.0, 33.0, 126.0, 45.0))], f"doc_id string, page long, pair_id long, top {BOX}, low {BOX}")
    assert [r.pair_id for r in ink.fraction_bars(ink.strokes(rasters(spark, [g]), ink.below_median(80)), pairs, pages(spark, [g])).collect()] == [1]


def test_cut_formulas_grow_to_a_fraction(spark):
    g = np.full((200, 500), 255, np.uint8)
    g[100:110, 50:120] = 0  # the line that was found
    g[85:125, 200:203] = 0
    g[85:125, 212:260] = 0  # a fraction behind a gap wider than 18 points: not reached from 120
    g[85:125, 130:150] = 0  # one within reach
    g[160:170, 300:400] = 0
    boxes = spark.createDataFrame([("d", 0, 1, (50.0, 100.0, 120.0, 110.0), None), ("d", 0, 2, (50.0, 100.0, 120.0, 110.0), 125.0), ("d", 0, 3, (300.0, 160.0, 400.0, 170.0), None)], f"doc_id string, page long, box_id long, box {BOX}, `limit` double")
    got = {r.box_id: tuple(r.box) for r in ink.extended(ink.strokes(rasters(spark, [g]), ink.below_paper(90)), boxes, pages(spark, [g])).collect()}
    assert got == {1: (50.0, 85.0, 150.0, 125.0), 2: (50.0, 100.0, 120.0, 110.0), 3: (300.0, 160.0, 400.0, 170.0)}


def test_ruled_grids(spark):
    g = np.full((700, 600), 255, np.uint8)
    for y in (100, 140, 180, 220):
        g[y : y + 2, 100:401] = 0
    for x in (100, 200, 300, 400):
        g[100:222, x] = 0
    g[400:402, 50:550] = 0  # a lone rule
    for y in (500, 650):  # a frame, two lines each way
        g[y, 100:400] = 0
    for x in (100, 399):
        g[500:651, x] = 0
    r = rasters(spark, [g])
    got = ink.grids(ink.strokes(r, ink.below_median(15)), ink.strokes(r, ink.below_median(15), True), pages(spark, [g])).collect()
    assert [(tuple(x.box), x.n_h, x.n_v) for x in got] == [((100, 100, 401, 222), 4, 4)] and 0.9 < got[0].score <= 1


def test_figures_from_their_captions(spark):
    g = np.full((800, 600), 255, np.uint8)
    g[110:290, 120:330] = 20  # above the first caption
    g[430:560, 60:280] = 20  # below a caption whose other side is body text
    text = [("Фиг. 1. Схема", 120.0, 300.0, 330.0, 312.0), ("Body text that is long enough to block", 40.0, 340.0, 560.0, 352.0), ("Another body line that blocks windows", 40.0, 380.0, 560.0, 392.0), ("Рис. 2", 60.0, 410.0, 120.0, 422.0), ("see Fig. 3", 60.0, 700.0, 120.0, 712.0)]
    spans = spark.createDataFrame([("d", 0, i, t, tuple(b), 600.0, 800.0) for i, (t, *b) in enumerate(text)], f"doc_id string, page long, span_ord int, text string, box {BOX}, page_w double, page_h double")
    found = ink.strokes(rasters(spark, [g]), ink.below_paper())
    figures = ink.caption_figures(found, spans, pages(spark, [g]))
    got = {r.text: tuple(r.box) for r in figures.collect()}
    assert got == {"Фиг. 1. Схема": (114.0, 104.0, 336.0, 296.0), "Рис. 2": (54.0, 424.0, 286.0, 566.0)}
    row = ink.as_regions(figures).collect()
    assert len(row) == 1 and [r.notes for r in row[0].found] and {r.method for r in row[0].found} == {"caption_anchor"}


def test_image_measures_and_steps(spark):
    rng = np.random.default_rng(1)
    flat = np.full((300, 240), 128, np.uint8)
    page = np.full((300, 240), 250, np.uint8)
    for y in range(30, 270, 20):
        page[y : y + 8, 30:210] = 10
    tilted = pixels.turned(page, 4.0)
    noisy = np.clip(page + rng.normal(0, 60, page.shape), 0, 255).astype(np.uint8)
    rows = [("d", i, g.shape[1], g.shape[0], 200, bytearray(g.tobytes())) for i, g in enumerate((flat, page, tilted, noisy))] + [("d", 9, 3, 3, 200, bytearray(b"x"))]
    judged = images_.assessed(spark.createDataFrame(rows, "doc_id string, page long, width int, height int, dpi int, gray binary"), True)
    got = {r.page: r for r in judged.collect()}
    assert got[0].blur == 0 and got[0].contrast == 0 and got[0].skew == 1 and got[9].score is None and got[9].plan is None
    assert got[1].contrast == 1 and got[1].blur == 1 and abs(got[1].skew_deg) < 0.5 and 3 < abs(got[2].skew_deg) < 5 and got[3].noise < got[1].noise
    assert got[1].level == "good" and got[1].plan == ["render", "deskew", "binarize"] and got[0].level != "good"
    p = page.astype(float)
    inner = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]
    assert (pixels.laplacian(page)[1:-1, 1:-1] == inner).all()
    done = {r.page: np.frombuffer(r.gray, np.uint8) for r in images_.prepared(judged).collect() if r.page != 9}
    assert set(np.unique(done[1]).tolist()) <= {0, 255} and len(done[3]) == 300 * 240
    straight = pixels.turned(tilted, got[2].skew_deg if abs(pixels.skew(pixels.turned(tilted, got[2].skew_deg))) < 1 else -got[2].skew_deg)
    assert abs(pixels.skew(straight)) < 1
    assert pixels.smoothed(noisy, 60.0).std() < noisy.std() and (pixels.smoothed(flat, 10.0) == 128).all() and pixels.equalized(tilted, 2.0).shape == tilted.shape


def scattered(spark, seed=3, pages=40):
    rng = np.random.default_rng(seed)
    rows = []
    for page in range(pages):
        for i in range(int(rng.integers(1, 12))):
            x, y = rng.integers(0, 80, 2)
            rows.append(("d" if page % 3 else "e", page // 2, i, (float(x), float(y), float(x + rng.integers(0, 40)), float(y + rng.integers(0, 40)))))
    return framed(spark, rows)


def same(a, b):
    rows = lambda df: sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)
    assert rows(a) == rows(b) and a.count() > 0


def test_slabs_are_the_strokes_of_their_lines(spark):
    b = scattered(spark)
    for turned in (False, True):
        slabs = ink.filled(b, turned)
        same(slabs.withColumn("y", F.explode(F.sequence("y", F.col("y2") - 1))).drop("y2"), ink.drawn(b, turned))
        same(ink.rules(slabs, b.select("doc_id", "page", F.lit(700).alias("width"), F.lit(700).alias("height")).distinct(), turned), ink.rules(ink.drawn(b, turned), b.select("doc_id", "page", F.lit(700).alias("width"), F.lit(700).alias("height")).distinct(), turned))
    slabs, lines = ink.filled(b), ink.drawn(b)
    same(ink.area(slabs), ink.area(lines))
    same(ink.inside(slabs, b), ink.inside(lines, b))
    same(ink.components(slabs).drop("component"), ink.components(lines).drop("component"))
    p = b.select("doc_id", "page").distinct().select("doc_id", "page", F.lit(120.0).alias("page_w"), F.lit(120.0).alias("page_h"), F.lit(120).alias("width"), F.lit(120).alias("height"), F.lit(72).alias("dpi"))
    odd, even = b.where("box_id % 2 = 1"), b.where("box_id % 2 = 0")
    same(ink.agreement(ink.filled(odd), even, p), ink.agreement(ink.drawn(odd), even, p))


def test_tall_boxes_are_few_slabs(spark):
    """A box is a row for each edge that cuts it, not for each of its lines."""
    b = framed(spark, [("d", 0, 0, (0.0, 0.0, 10.0, 5000.0)), ("d", 0, 1, (20.0, 100.0, 30.0, 4000.0))])
    assert sorted((r.y, r.y2, r.x1, r.x2) for r in ink.filled(b).collect()) == [(0, 100, 0, 10), (100, 4000, 0, 10), (100, 4000, 20, 30), (4000, 5000, 0, 10)]


def test_pages_go_on_over_batches(spark):
    """Pages that end within, with and behind an Arrow batch; components and crossings are those of the page alone."""
    b = scattered(spark, 9)
    want = sorted(map(tuple, ink.labelled(ink.filled(b)).collect()), key=repr)
    for n in ("1", "2", "7"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
        try:
            assert sorted(map(tuple, ink.labelled(ink.filled(b)).collect()), key=repr) == want
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
