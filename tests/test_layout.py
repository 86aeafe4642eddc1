import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigrove.functions import boxes as B
from lexigrove.functions import formulas as M
from lexigrove.operators import evaluate, layout, regions
from lexigrove.operators.layout import Span

W, H = 600.0, 800.0


def words(y, *cells, h=10):
    return [Span(t, x, y, x + 6 * len(t), y + h) for x, t in cells]


def test_one_column_keeps_lines():
    spans = words(100, (50, "one"), (100, "two")) + words(102, (150, "three")) + words(120, (50, "next"))
    assert layout.reading_order(spans[::-1], W)[:2] == ("one two three\nnext", 1)


def test_two_columns_and_a_full_line():
    spans = words(50, (50, "A title that runs over the whole page from left to right and further on"))
    for i in range(4):
        spans += words(80 + 14 * i, (50, f"left{i}"), (350, f"right{i}"))
    text, n, table, notes = layout.reading_order(spans, W)
    assert n == 2 and text.split("\n\n")[1:] == ["left0\nleft1\nleft2\nleft3", "right0\nright1\nright2\nright3"] and notes == ["two_column_split lines=4"] and not table
    assert layout.reading_order([], W) == ("", 1, False, [])


def test_rows_of_recognised_words():
    spans = words(100, (10, "a")) + words(104, (30, "b")) + words(125, (10, "c"))
    assert layout.ocr_text(spans, W)[:3] == ("a b\nc", 1, 2)
    columns = [Span("word here", x, 20 * i, x + 60, 20 * i + 10) for i in range(14) for x in (50, 400)]
    text, n, lines, short, suspect = layout.ocr_text(columns, W)
    assert n == 2 and lines == 28 and text.count("\n\n") == 1 and not suspect


def table(x0=60, y0=200, rows=5):
    out = words(y0, (x0, "Name"), (x0 + 150, "Mass"), (x0 + 300, "Span"))
    for i in range(1, rows):
        out += words(y0 + 20 * i, (x0, f"item{i}"), (x0 + 150, f"{i}.5"), (x0 + 300, f"{10 * i}"))
    return out


def test_tables():
    found = layout.table_regions(table(), W, H)
    assert len(found) == 1 and found[0]["method"] == "span_cell_grid"
    md, confidence = layout.table_in(table(), (50, 190, 500, 320))
    assert md.split("\n")[:3] == ["| Name | Mass | Span |", "| --- | --- | --- |", "| item1 | 1.5 | 10 |"] and confidence >= 0.55
    assert layout.table_in(table(), (0, 0, 10, 10)) is None
    contents = [Span(f"Chapter {i} ........ {i}", 50, 100 + 15 * i, 300, 110 + 15 * i) for i in range(14)]
    assert layout.table_regions(contents, W, H) == []
    assert layout.table_quality("")[0] == 0 and layout.table_quality("no bars")[0] == 0.1 and layout.table_quality("| a | b |\n| --- | --- |\n| 1 | 2 |")[1:] == (2, 2)
    assert layout.cell_text("αβγδ") == "UNREADABLE" and layout.cell_text("a=b") == "$a=b$" and layout.cell_text("x|y") == "x\\|y"
    assert layout.html_table("<table><tr><th>a</th><th>b</th></tr><tr><td> 1\n2</td></tr></table>") == "| a | b |\n| --- | --- |\n| 1 2 |  |"
    assert layout.html_table("<p>x</p>") == layout.html_table(None) == ""


def test_formula_texts():
    assert M.real_formula("L = x^2 + y") and not M.real_formula("88 89 90") and not M.real_formula("_____") and not M.real_formula("это слово = a+b")
    assert M.fragment("αR") and not M.fragment("слово") and not M.fragment("kak") and M.fragment("η =") and not M.fragment("a = b + c")
    assert M.equation_number("(9.78)") and M.left_side("χ =") and M.display_equation("j = -j") and not M.display_equation("η =")
    assert M.contents_like(["Contents", "A .... 1", "B .... 2"]) and not M.contents_like(["1.2 Scope", "text"]) and M.bibliography_like(["References", "x"])


def test_columns_agree_with_functions(spark):
    texts = ["a = b + c", "_____", "слово", "M =", "x/y", "α β", "plain words here now", "f. g.", "\\frac{a}{b}", "(1.2)", "2 + 2", "", "and"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, c string")
    for f, g in ((M.line_math_score, M.math_score), (M.marker_count, M.markers), (M.is_rule_line, M.rule_line), (M.has_formula_signal, M.signal), (M.is_prose_piece, M.prose_piece), (M.is_equation_number, M.equation_number), (M.is_left_side, M.left_side), (M.is_display_equation, M.display_equation)):
        assert [r[0] for r in df.orderBy("i").select(f(F.col("c"))).collect()] == pytest.approx([g(t) for t in texts]), f.__name__


def test_formula_regions():
    spans = words(300, (100, "L"), (112, "="), (124, "x^2 + 1"))
    found = layout.formula_regions(spans, W, H)
    assert len(found) == 1 and found[0]["type"] == "formula" and found[0]["x1"] == 96
    assert layout.formula_regions(words(20, (100, "a = b + c")), W, H) == []  # in the header band
    pair = [Span("σ_a", 100, 300, 120, 310), Span("τ_b", 100, 314, 120, 324), Span("η =", 70, 305, 95, 315)]
    assert layout.fractions(pair) == {(0, 1): False} and layout.stacked_gap(pair[0], pair[1]) == 4
    gutter = [Span("w", x, 10 * i, x + 10, 10 * i + 8) for i in range(6) for x in (100, 450)]
    assert layout.page_gutter(gutter, W) == 280 and layout.right_limit(gutter, (90, 0, 150, 10), W) == 276
    assert layout.grown_right((0, 0, 10, 10), [Span("+ b", 15, 0, 30, 10), Span("= c", 60, 0, 80, 10), Span("word", 36, 0, 50, 10)], 500) == (0, 0, 84.0, 10)


def region(kind, box, score=0.5, method="m"):
    return layout.region(kind, box, score, method, [])


def test_suppression_and_conflicts():
    a, b = region("formula", (0, 0, 100, 20), 0.9), region("formula", (5, 0, 100, 20), 0.8)
    t = region("table", (0, 0, 300, 300))
    assert regions.suppressed([b, a]) == [a] and regions.suppressed([a, t]) == [t]
    f, t2 = region("figure", (0, 0, 100, 100)), region("table", (0, 0, 100, 100))
    assert len(regions.suppressed([f, t2])) == 2  # equal rank
    assert regions.best_figures([region("figure", (0, 0, 99, 99), 0.9, "nontext_ink_cc"), region("figure", (0, 0, 100, 100), 0.1, "pdf_image")])[0]["method"] == "pdf_image"
    strong = region("formula", (10, 10, 60, 40), 0.9, "span_math_heuristic")
    kept = regions.settled([region("figure", (0, 0, 80, 60), 0.5, "pdf_image"), strong], W, H)
    assert [r["type"] for r in kept] == ["formula"]
    assert regions.panels([(0, 0, 100, 50), (0, 70, 100, 120), (300, 0, 400, 50)]) == [(0, 0, 100, 120), (300, 0, 400, 50)]
    assert regions.settled([region("figure", (0, 0, 20, 20))], W, H) == []


def test_captions():
    spans = words(500, (100, "Fig."), (130, "1.9"), (155, "Positive"), (210, "corona")) + words(300, (100, "see (Fig. 2)"))
    (text, box, group), *rest = regions.caption_groups(spans)
    assert text == "Fig. 1.9 Positive corona" and len(group) == 4 and not rest and box[0] == 100
    assert [s.text for s in regions.with_captions_joined(spans)] == ["Fig. 1.9 Positive corona", "see (Fig. 2)"]
    assert regions.nearest_caption((100, 300, 300, 480), [("far", (100, 700, 200, 710)), ("near", (100, 490, 200, 500))]) == "near"
    assert regions.neighbour_bounds((200, 0, 300, 10), [(0, 0, 100, 10), (500, 0, 560, 10)], W) == (150.0, 390.0)
    pics = regions.figures_from_hits([region("figure", (100, 300, 300, 480), 0.9), region("figure", (5, 5, 40, 40), 0.9)], [("Fig. 1", (100, 490, 200, 500))], [], W, H)
    assert len(pics) == 1 and pics[0]["notes"][-1] == "caption=Fig. 1"


def test_recognised_lines():
    lines = [{"text": "abc", "box": (0, 0, 10, 10), "confidence": 0.9}, {"text": "ab", "box": (0, 0, 10, 11), "confidence": 0.5}, {"text": "zz", "box": (0, 0, 10, 10), "confidence": 0.4}]
    assert [x["text"] for x in regions.deduplicated(lines)] == ["abc", "zz"]
    got = regions.matched_heads([{"text": "текст здесь", "box": (0, 0, 50, 10), "confidence": 0.9}], {"latin": [{"text": "TeKcT 3gecb", "box": (0, 0, 50, 10), "confidence": 0.95}]})
    assert got[0]["text"] == "текст здесь" and got[0]["head"] == "cyrillic"


def test_frames(spark):
    rows = [("d", 1, i, s.text, tuple(map(float, s.box)), W, H) for i, s in enumerate(table() + words(600, (100, "a = b + c")))] + [("d", 2, 0, None, None, W, H)]
    spans = spark.createDataFrame(rows, "doc_id string, page long, span_ord int, text string, box struct<x1:double,y1:double,x2:double,y2:double>, page_w double, page_h double")
    pages = layout.page_rows(spans)
    read = {r.page: (r.n_columns, r.text.endswith("a = b + c")) for r in layout.read_pages(pages).collect()}
    assert read == {1: (2, True)}  # the wide gap before the last column; page 2 has no span with a place
    found = layout.detect(pages)
    blocks = regions.blocks(regions.settle(found)).collect()
    assert sorted(r.type for r in blocks) == ["formula", "table"] and {r.region_id[-3:] for r in blocks} == {"_00", "_01"}
    assert layout.read_ocr(pages.limit(0)).collect() == []


def test_box_metrics(spark):
    box = "struct<x1:double,y1:double,x2:double,y2:double>"
    gold = spark.createDataFrame([("a", 1, 0, (0.0, 0.0, 10.0, 10.0)), ("a", 1, 1, (1.0, 0.0, 11.0, 10.0)), ("b", 1, 0, (0.0, 0.0, 1.0, 1.0))], f"doc_id string, page long, gold_ord long, box {box}")
    found = spark.createDataFrame([("a", 1, (0.0, 0.0, 10.0, 10.0)), ("a", 2, (0.0, 0.0, 5.0, 5.0)), ("c", 1, (0.0, 0.0, 5.0, 5.0))], f"doc_id string, page long, box {box}")
    m = evaluate.matched_boxes(gold, found)
    assert [(r.doc_id, r.gold_ord, r.hit) for r in m.orderBy("doc_id", "gold_ord").collect()] == [("a", 0, True), ("a", 1, False), ("b", 0, False)]
    got = {r.doc_id: (r.tp, r.fp, r.fn) for r in evaluate.box_scores(m, found).collect()}
    assert got == {"a": (1, 1, 1), "b": (0, 0, 1), "c": (0, 1, 0), None: (1, 2, 2)}


def test_box_columns(spark):
    b = B.box(10.0, 20.0, 110.0, 60.0)
    one = spark.range(1).select(
        B.points_to_pixels(b, F.lit(144)).x2.alias("px"), B.flipped(b, F.lit(100.0)).y1.alias("flip"), B.figure_fault(b, F.lit(W), F.lit(H)).alias("fault"), B.is_corner_logo(B.box(0.0, 0.0, 40.0, 40.0), F.lit(W), F.lit(H)).alias("logo"),
        B.caption_near(B.box(10.0, 65.0, 90.0, 75.0), b).alias("near"), B.near_figure(B.box(10.0, 70.0, 50.0, 80.0), b).alias("below"), B.crop_ok(b, F.lit("span_fragment_merge"), F.lit(120), F.lit(100)).alias("crop"), B.from_polygon(F.array(F.lit(3.0), F.lit(1.0)), F.array(F.lit(4.0), F.lit(9.0))).x1.alias("poly"),
    ).first()
    assert (one.px, one.flip, one.fault, one.logo, one.near, one.below, one.crop, one.poly) == (220, 40.0, "too_small", True, True, True, False, 1.0)


def test_attempts_to_read_formulas(spark):
    rows = [
        ("a", "unimernet", 0.9, "x =", True, "truncated"), ("a", "unimernet_wider", 0.8, "x = y", True, ""), ("b", "unimernet", 0.2, "{", False, "x"), ("b", "vlm_recovery", 0.5, "title", True, "caption_or_header"),
        ("c", "unimernet", 0.9, "12", True, "pure_numbers"), ("d", "unimernet", 0.9, "{x", False, ""), ("e", "unimernet", 0.9, "a = b", True, ""), ("e", "unimernet_retry", 0.9, "a = c", True, ""),
    ]
    df = spark.createDataFrame(rows, "region_id string, method string, confidence double, latex_fixed string, valid boolean, reason string")
    got = {r.region_id: (r.method, r.status) for r in regions.accepted_formula(df).collect()}
    assert got == {"a": ("unimernet_wider", "ok"), "b": ("vlm_recovery", "caption_or_header"), "c": ("unimernet", "suspicious_semantic"), "d": ("unimernet", "suspicious"), "e": ("unimernet", "ok")}


def test_attempts_to_read_tables(spark):
    rows = [("a", "span_cells", "| x |", 0.3), ("a", "docling", "| y |", 0.6), ("b", "docling", "| x |", 0.3), ("b", "vlm", "", 0.9), ("c", "vlm", " ", 0.1)]
    df = spark.createDataFrame(rows, "region_id string, method string, markdown string, confidence double")
    got = regions.accepted_attempt(df, ["span_cells", "cell_ocr", "docling", "ppstructure", "img2table", "vlm"])
    assert {r.region_id: (r.method, r.status) for r in got.collect()} == {"a": ("docling", "ok"), "b": ("docling", "suspicious"), "c": (None, "failed")}
    q = {r.region_id: tuple(r.q) for r in got.select("region_id", regions.block_quality(F.col("status"), F.col("confidence")).alias("q")).collect()}
    assert q["a"] == (True, 0.0) and q["b"] == (False, 0.6) and q["c"][1] == 1.0


def test_detections_of_ports(spark):
    from lexigrove.operators.layout import REGION

    def row(*r):
        return [tuple(x.values()) for x in r]

    df = spark.createDataFrame([("d", 1, W, H, row(region("formula", (10.0, 10.0, 60.0, 40.0), 0.9)), row(region("table", (0.0, 0.0, 300.0, 300.0))), None)], f"doc_id string, page long, page_w double, page_h double, regions array<{REGION}>, ruled array<{REGION}>, figures array<{REGION}>")
    assert [r.type for r in regions.with_detections(df, "ruled", "figures").first().regions] == ["table"]
    c = spark.createDataFrame([("PictureItem", [" a", "", "b"]), ("CAPTION", None), ("sub_figure", []), ("Table", ["x"])], "label string, cells array<string>")
    assert [(r[0], r[1]) for r in c.select(regions.label_name(F.col("label")), regions.cluster_text(F.col("cells"))).collect()] == [("picture", "a b"), ("caption", None), ("picture", ""), ("table", "x")]
    t = spark.createDataFrame([(None, " Fig.  1 ", "x"), ("", None, None)], "v string, o string, n string").select(regions.figure_text(F.col("v"), F.col("o"), F.col("n"))).collect()
    assert [r[0] for r in t] == ["Fig. 1", ""]
    b = spark.range(1).select(regions.band_spans(F.array(F.struct(F.lit("t").alias("text"), *(F.lit(v).alias(k) for k, v in (("x1", 0.0), ("y1", 1.0), ("x2", 2.0), ("y2", 3.0))))), F.lit(100.0))).first()[0]
    assert b[0].y1 == 101.0 and b[0].y2 == 103.0
    assert regions.longest_run([True, False, True, True], 0) == (2, 4) and regions.longest_run([True, False, True, False, False, True], 2) == (0, 3) and regions.longest_run([False]) is None


def test_figure_captions_of_a_frame(spark):
    box = "struct<x1:double,y1:double,x2:double,y2:double>"
    figures = spark.createDataFrame([("d", 1, "figure_00", (100.0, 100.0, 300.0, 300.0)), ("d", 1, "figure_01", (100.0, 600.0, 300.0, 700.0))], f"doc_id string, page long, region_id string, box {box}")
    spans = spark.createDataFrame([("d", 1, 0, "see Fig. 9", (100.0, 310.0, 200.0, 320.0)), ("d", 1, 1, "Fig. 1.2 Corona", (100.0, 310.0, 200.0, 320.0)), ("d", 1, 2, "Fig. 3", (100.0, 320.0, 200.0, 330.0))], f"doc_id string, page long, span_ord int, text string, box {box}")
    got = {r.region_id: (r.caption, r.number) for r in regions.figure_captions(figures, spans).collect()}
    assert got == {"figure_00": ("Fig. 1.2 Corona", "Fig. 1.2"), "figure_01": (None, None)}


def test_sweeps_find_what_all_pairs_find():
    rng = np.random.default_rng(4)
    for _ in range(20):
        spans = [layout.Span("x", x, y, x + w, y + h) for x, y, w, h in rng.uniform((0, 0, 1, 1), (300, 200, 60, 30), (40, 4)).tolist()]
        for reach in (0.0, 7.0, 40.0):
            want = {(i, j) for i, a in enumerate(spans) for j, b in enumerate(spans) if i < j and layout._gap(a.y1, a.y2, b.y1, b.y2) <= reach}
            assert sorted(layout.close_pairs(spans, reach)) == sorted(want)
        pairs = sorted((g, i, j) for i, a in enumerate(spans) for j, b in enumerate(spans) if i != j and (g := layout.stacked_gap(a, b)) is not None)
        taken, out = set(), {}
        for _, i, j in pairs:
            if not {i, j} & taken:
                taken |= {i, j}
                out[i, j] = False
        assert layout.fractions(spans) == out
    many = [layout.Span("a = b", 50.0 * (i % 10), 14.0 * (i // 10), 50.0 * (i % 10) + 40, 14.0 * (i // 10) + 10) for i in range(6000)]
    began = time.process_time()
    assert layout.merged_fragments(many, 600.0, 9000.0) is not None and layout.fractions(many) is not None
    assert time.process_time() - began < 20
