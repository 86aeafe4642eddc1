"""Queries of ink and recognised LaTeX over pages and formulas that are made of the driver's rows; conventions as in ``queries``.

An order is a page of 120 by 120 pixels (72 dpi) and its lines are filled boxes on it, or it is a page with as many rules each way
as its keys say.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexigrove.functions import boxes as B
from lexigrove.functions import latex as X
from lexigrove.operators import ink
from lexigrove.queries import _t, query
from lexigrove.queries_more import _BOX, _box_rows

_SIDE = 120
#: Boxes with a number of their own on the page, as an order may hold a line number twice.
_NUMBERED = f"(SELECT page, row_number() OVER (PARTITION BY page ORDER BY o, x1, y1, x2) AS o, x1, y1, x2, y2 FROM {_BOX})"
#: Pixels of each line of each page that boxes of ``{part}`` cover, boxes that overlap counted once.
_UNION = "SELECT {by}, sum(greatest(0, x2 - greatest(x1, before)))::BIGINT AS ink FROM (SELECT *, coalesce(max(x2) OVER (PARTITION BY {by}, y ORDER BY x1, x2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), x1) AS before FROM (SELECT *, unnest(range(y1::BIGINT, y2::BIGINT)) AS y FROM {part})) GROUP BY {by}"


def _union(part: str, by: str = "page") -> str:
    return _UNION.replace("{part}", part).replace("{by}", by)


def _boxes(spark, d):
    b = F.col("box")
    number = F.row_number().over(Window.partitionBy("page").orderBy("o", b["x1"], b["y1"], b["x2"]))
    return _box_rows(spark, d).select(F.lit("d").alias("doc_id"), "page", number.alias("o"), "box")


def _pages(spark, d):
    side = F.lit(_SIDE)
    return _t(spark, d, "lineitem").select(F.lit("d").alias("doc_id"), F.col("l_orderkey").alias("page"), side.cast("double").alias("page_w"), side.cast("double").alias("page_h"), side.alias("width"), side.alias("height"), F.lit(72).alias("dpi")).distinct()


@query(_union(_BOX))
def ink_coverage(spark, d):
    """Pixels that the boxes of a page cover."""
    return ink.area(ink.filled(_boxes(spark, d))).select("page", "ink")


_SETS = f"WITH a AS ({_union(f'(SELECT * FROM {_NUMBERED} WHERE o % 2 = 1)')}), t AS ({_union(f'(SELECT * FROM {_NUMBERED} WHERE o % 2 = 0)')}), u AS ({_union(_BOX)}), s AS (SELECT page, u.ink AS u, coalesce(a.ink, 0) AS i, coalesce(t.ink, 0) AS t, coalesce(a.ink, 0) + coalesce(t.ink, 0) - u.ink AS b FROM u LEFT JOIN a USING (page) LEFT JOIN t USING (page))"


@query(_SETS + f" SELECT page, round(CASE WHEN t = 0 THEN 0.0 WHEN i / {_SIDE ** 2} > 0.02 AND t / {_SIDE ** 2} < 0.005 THEN least(0.25, v) ELSE v END + 1e-9, 6) AS visual, b AS ink_in_text FROM (SELECT *, least(1.0, 0.55 * b / greatest(1, t) + 0.45 * least(1.0, 3 * b / (i + 1e-6))) AS v FROM s)")
def text_ink_agreement(spark, d):
    """The odd boxes of a page as ink, the even ones as the text layer's boxes."""
    b, pages = _boxes(spark, d), _pages(spark, d)
    found, spans = ink.filled(b.where("o % 2 = 1")), b.where("o % 2 = 0")
    return ink.agreement(found, spans, pages).select("page", F.round(F.col("visual") + 1e-9, 6).alias("visual"), F.col("both").alias("ink_in_text"))


_PARTS = f"""WITH RECURSIVE b AS (SELECT page, o, x1, y1, x2, y2 FROM {_NUMBERED}), near AS (SELECT a.page, a.o AS a, c.o AS c FROM b a JOIN b c ON a.page = c.page AND a.x1 <= c.x2 AND c.x1 <= a.x2 AND a.y1 <= c.y2 AND c.y1 <= a.y2),
 reach AS (SELECT page, a, c FROM near UNION SELECT r.page, r.a, n.c FROM reach r JOIN near n ON r.page = n.page AND r.c = n.a), part AS (SELECT b.*, m.part FROM b JOIN (SELECT page, a AS o, min(c) AS part FROM reach GROUP BY ALL) m USING (page, o)),
 size AS ({_union('part', 'page, part')}), hull AS (SELECT page, part, max(x2) - min(x1) AS w, max(y2) - min(y1) AS h FROM part GROUP BY ALL)
 SELECT page, count(*) AS parts, max(ink) AS most, max(w * h)::BIGINT AS widest FROM size JOIN hull USING (page, part) GROUP BY page"""


@query(_PARTS)
def ink_components(spark, d):
    """Connected parts of a page's boxes: how many, the most ink of one, the largest box around one."""
    c = ink.components(ink.filled(_boxes(spark, d)))
    return c.groupBy("page").agg(F.count("*").alias("parts"), F.max("ink").alias("most"), F.max(B.area(F.col("box"))).cast("long").alias("widest"))


_MOVED = 20


@query(f"""SELECT page, o, ink, round(ink / size, 6) AS share FROM (SELECT page, o, any_value(size) AS size, sum(greatest(0, z - greatest(a, before)))::BIGINT AS ink FROM
 (SELECT *, coalesce(max(z) OVER (PARTITION BY page, o, y ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a) AS before FROM (SELECT q.page, q.o, (q.x2 - q.x1) * (q.y2 - q.y1) AS size, greatest(q.x1 + {_MOVED}, p.x1) AS a, least(q.x2 + {_MOVED}, p.x2) AS z,
 unnest(range(greatest(q.y1, p.y1)::BIGINT, least(q.y2, p.y2)::BIGINT)) AS y FROM {_NUMBERED} q JOIN {_NUMBERED} p ON q.page = p.page AND greatest(q.x1 + {_MOVED}, p.x1) < least(q.x2 + {_MOVED}, p.x2))) GROUP BY page, o)""")
def ink_in_boxes(spark, d):
    """Share of ink in each box moved to the right, where it meets any of its page's boxes."""
    b, box = _boxes(spark, d), F.col("box")
    asked = b.select("doc_id", "page", F.col("o").alias("box_id"), B.box(box["x1"] + _MOVED, box["y1"], box["x2"] + _MOVED, box["y2"]).alias("box"))
    out = ink.inside(ink.filled(b), asked).where("ink > 0")
    return out.select("page", F.col("box_id").alias("o"), "ink", F.round("share", 6).alias("share"))


_RULED = "(SELECT o_orderkey AS page, o_orderkey % 5 + 1 AS n_h, o_custkey % 7 + 1 AS n_v FROM orders)"


@query(f"SELECT page, n_h::BIGINT AS n_h, n_v::BIGINT AS n_v, 100 AS x1, 50 AS y1, (100 + (n_v - 1) * 40 + 1)::INT AS x2, (50 + (n_h - 1) * 30 + 1)::INT AS y2 FROM {_RULED} WHERE n_h >= 3 AND n_v >= 4")
def ruled_grids(spark, d):
    """Pages with rules 30 and 40 pixels apart: those with three lines each way and a fifth of the page's width are tables."""
    o = _t(spark, d, "orders").select(F.lit("d").alias("doc_id"), F.col("o_orderkey").alias("page"), (F.col("o_orderkey") % 5).alias("h"), (F.col("o_custkey") % 7).alias("v"))
    across = o.select("doc_id", "page", "v", F.explode(F.sequence(F.lit(0).cast("long"), "h")).alias("i")).select("doc_id", "page", B.box(F.lit(100), 50 + 30 * F.col("i"), 100 + 40 * F.col("v") + 1, 51 + 30 * F.col("i")).alias("box"))
    down = o.select("doc_id", "page", "h", F.explode(F.sequence(F.lit(0).cast("long"), "v")).alias("i")).select("doc_id", "page", B.box(100 + 40 * F.col("i"), F.lit(50), 101 + 40 * F.col("i"), 50 + 30 * F.col("h") + 1).alias("box"))
    lines = across.union(down)
    pages = o.select("doc_id", "page", F.lit(600.0).alias("page_w"), F.lit(700.0).alias("page_h"), F.lit(600).alias("width"), F.lit(700).alias("height"), F.lit(72).alias("dpi"))
    g = ink.grids(ink.filled(lines), ink.filled(lines, turned=True), pages)
    return g.select("page", "n_h", "n_v", *(F.col("box")[k].cast("int").alias(k) for k in ("x1", "y1", "x2", "y2")))


_LATEX = {
    "formula": r"'\frac { ' || l_linenumber || ' x } { ' || l_partkey || ' y } = z _ { ' || l_suppkey || ' }'", "cut": r"'\frac { ' || l_linenumber || ' a } { ' || l_partkey", "value": "'$ m = 0,0' || l_linenumber || ' $'",
    "numbers": "l_partkey || ' , ' || l_linenumber", "open": "'x + ' || l_partkey || ' ='", "words": r"'\mathrm { ' || l_returnflag || CASE WHEN l_linenumber % 2 = 0 THEN 'TITLE' ELSE '' END || ' } a'", "spaces": r"'a \, \, \, \, \, = b ^ { ' || l_linenumber || ' } }'",
}
_KIND = "CASE (l_orderkey + l_linenumber) % 7 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(_LATEX)) + " END"


@query(f"""SELECT kind, reason, count(*) AS n, sum(valid::INT)::BIGINT AS valid, sum(size)::BIGINT AS chars FROM (SELECT kind, CASE kind WHEN 'value' THEN 'numeric_value' WHEN 'numbers' THEN 'pure_numbers' WHEN 'open' THEN 'truncated' WHEN 'words' THEN CASE WHEN l_linenumber % 2 = 0 THEN 'caption_or_header' ELSE 'no_math_markers' END ELSE '' END AS reason,
 NOT (kind = 'words' AND l_linenumber % 2 = 0) AS valid, length(CASE kind WHEN 'value' THEN trim(replace(s, '$', '')) WHEN 'cut' THEN s || ' }}' WHEN 'spaces' THEN 'a \\, = b ^ {{ ' || l_linenumber || ' }}' ELSE s END) AS size
 FROM (SELECT *, CASE kind {" ".join(f"WHEN '{k}' THEN {v}" for k, v in _LATEX.items())} END AS s FROM (SELECT *, {_KIND} AS kind FROM lineitem))) GROUP BY ALL""")
def latex_verdicts(spark, d):
    """Order lines written as recognised LaTeX: whole, cut short, values, numbers, words, with a run of spaces and a stray brace."""
    c, text = F.col, lambda *parts: F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))
    line, part, supp = c("l_linenumber"), c("l_partkey"), c("l_suppkey")
    made = {
        "formula": text(r"\frac { ", line, " x } { ", part, " y } = z _ { ", supp, " }"), "cut": text(r"\frac { ", line, " a } { ", part), "value": text("$ m = 0,0", line, " $"), "numbers": text(part, " , ", line),
        "open": text("x + ", part, " ="), "words": text(r"\mathrm { ", c("l_returnflag"), F.when(line % 2 == 0, "TITLE").otherwise(""), " } a"), "spaces": text(r"a \, \, \, \, \, = b ^ { ", line, " } }"),
    }
    kind = F.get(F.array(*map(F.lit, made)), ((c("l_orderkey") + line) % 7).cast("int"))
    rows = _t(spark, d, "lineitem").withColumn("kind", kind)
    latex = F.coalesce(*(F.when(c("kind") == k, v) for k, v in made.items()))
    # a small table is one file; reading LaTeX takes far longer than moving it
    judged = X.verdicts(rows.select("kind", latex.alias("latex")).repartition(spark.sparkContext.defaultParallelism))
    return judged.groupBy("kind", "reason").agg(F.count("*").alias("n"), F.count_if("valid").alias("valid"), F.sum(F.length("latex_fixed")).cast("long").alias("chars"))
