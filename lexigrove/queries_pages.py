"""Queries of symbols, geometry, routing and summaries over made-up pages from the driver's tables; conventions as in ``queries``."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexigrove.functions import boxes, quality, symbols
from lexigrove.functions import formulas as M
from lexigrove.functions import text as T
from lexigrove.operators import audits, evaluate, regions
from lexigrove.plans import routing
from lexigrove.queries import _TEXTS, _docs, _lines, _t, _texts, query
from lexigrove.queries_more import _A, _BOX, _INTER, _LINE, _box_rows, _line_rows

_GREEK = "[Ͱ-Ͽἀ-῿]"
_RUN = f"coalesce(list_max(list_transform(regexp_extract_all(line, '{_GREEK}+'), lambda x: length(x))), 0)"
_MIXED = f"len(list_filter(regexp_extract_all(line, '[\\p{{L}}\\p{{M}}]+'), lambda x: length(x) >= 4 AND regexp_matches(x, '{_GREEK}') AND regexp_matches(x, '[a-zа-яё]{{3}}'))) > 0"
_CORE = "regexp_matches(line, '[=^_∞±≤≥≠≈∑∫∏√∂∇·×÷/\\\\]')"


@query(f"""SELECT doc_id, line_no, {_RUN} AS run, regexp_matches(line, '[{symbols.DISTINCTIVE}]') AS distinctive, {_MIXED} AS mixed, regexp_matches(line, '{_GREEK}') AND ({_RUN} > 2 OR {_MIXED} OR NOT regexp_matches(line, '[{symbols.DISTINCTIVE}]')) AS garbled,
 {_CORE} OR (regexp_matches(line, '{_GREEK}') AND length(line) <= 48) OR (length(line) <= 24 AND regexp_matches(line, '\\p{{Nd}}') AND regexp_matches(line, '\\p{{L}}') AND regexp_matches(line, '[=^_/+–—−-]')) AS formula FROM {_LINE} WHERE doc_id < 0""")
def symbol_predicates(spark, d):
    c = F.col("line")
    return _line_rows(spark, d).where("doc_id < 0").select("doc_id", "line_no", symbols.max_greek_run(c).alias("run"), symbols.has_distinctive_greek(c).alias("distinctive"), symbols.has_mixed_word(c).alias("mixed"), symbols.is_garbled_greek(c).alias("garbled"), symbols.looks_like_formula(c).alias("formula"))


_SKELETON = f"lower(translate(text, '{symbols.SHAPES[0]}', '{symbols.SHAPES[1]}'))"
for _a, _b in symbols.DIGRAPHS:
    _SKELETON = f"replace({_SKELETON}, '{_a}', '{_b}')"


@query(f"SELECT doc_id, sha256(regexp_replace({_SKELETON}, '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS h FROM {_TEXTS}")
def shape_skeletons(spark, d):
    return _texts(spark, d).select("doc_id", F.sha2(symbols.skeleton(F.col("text")), 256).alias("h"))


@query(f"""SELECT doc_id, n > 0 AND ((title AND k >= 2) OR k >= greatest(2, n // 3) OR (e >= greatest(3, floor(0.45 * n)) AND k >= 1)) AS contents FROM (SELECT doc_id, len(l) AS n, len(list_filter(l, lambda x: regexp_matches(x, '\\.{{2,}}|…|\\. \\. \\.'))) AS k,
 len(list_filter(l, lambda x: regexp_matches(x, '[0-9]{{1,3}}$') AND (regexp_matches(x, '\\.{{2,}}|…|\\. \\. \\.') OR length(x) >= 24))) AS e, len(list_filter(l[1:12], lambda x: regexp_matches(x, '(?i)содержани[ея]|оглавлени[ея]|contents') AND length(x) <= 48)) > 0 AS title FROM (SELECT doc_id, {_lines('text')} AS l FROM {_TEXTS}))""")
def contents_like_pages(spark, d):
    return _texts(spark, d).select("doc_id", M.is_contents(T.lines(F.col("text"))).alias("contents"))


_VALID = "x2 > x1 AND y2 > y1 AND x1 >= -1 AND y1 >= -1 AND x2 <= 91 AND y2 <= 91"


@query(f"""WITH b AS (SELECT *, {_VALID} AS ok, (y1 + y2) / 2 AS cy FROM {_BOX}), v AS (SELECT page, count(*) AS nv, count(*) FILTER (cy + 2 < before) AS back FROM (SELECT page, cy, lag(cy) OVER (PARTITION BY page ORDER BY o, cy) AS before FROM b WHERE ok) GROUP BY 1),
 g AS (SELECT page, count(*) AS n, count(*) FILTER (ok) AS nok, coalesce(sum((x2 - x1) * (y2 - y1)) FILTER (ok), 0) / 8100 AS cover, count(DISTINCT (x1, y1, x2, y2)) AS dis FROM b GROUP BY 1)
 SELECT page, round(least(1.0, 0.45 * nok / n + 0.30 * CASE WHEN coalesce(nv, 0) >= 3 THEN 1 - back / (nv - 1) ELSE 1 END + 0.25 * CASE WHEN cover > 3 THEN 0.2 WHEN cover > 1.5 THEN 0.5 WHEN cover < 0.001 AND n > 5 THEN 0.4 ELSE 1 END * CASE WHEN n >= 8 THEN dis / n ELSE 1 END), 6) AS geometry FROM g LEFT JOIN v USING (page)""")
def geometry_scores(spark, d):
    """Lines of an order as the spans of a page of 90 by 90 points."""
    s = _box_rows(spark, d).select(F.lit("d").alias("doc_id"), "page", F.col("o").alias("span_ord"), "box", F.lit(90.0).alias("page_w"), F.lit(90.0).alias("page_h"))
    return quality.geometry_scores(s).select("page", F.round("geometry", 6).alias("geometry"))


@query(f"""SELECT a.page, a.o AS a, b.o AS b, round(CASE WHEN least(a.x2, b.x2) <= greatest(a.x1, b.x1) THEN 0 ELSE (least(a.x2, b.x2) - greatest(a.x1, b.x1)) / greatest(1, least(a.x2 - a.x1, b.x2 - b.x1)) END, 6) AS across, least(a.y2, b.y2) + 3 > greatest(a.y1, b.y1) AS beside,
 greatest(0, a.y1 - b.y2, b.y1 - a.y2) AS gap, {_INTER} / greatest(1e-9, {_A}) >= 0.3 OR (greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) >= 0.3 * greatest(1e-6, a.x2 - a.x1) AND a.y1 BETWEEN b.y2 - 2 AND b.y2 + 15) AS near,
 least(a.x2, b.x2) >= greatest(a.x1, b.x1) AND (a.y1 BETWEEN b.y2 - 5 AND b.y2 + 80 OR (a.y2 <= b.y1 + 5 AND b.y1 - a.y2 <= 80)) AS caption FROM {_BOX} a JOIN {_BOX} b ON a.page = b.page AND a.o <> b.o""")
def box_neighbours(spark, d):
    a, b = _box_rows(spark, d).alias("a"), _box_rows(spark, d).alias("b")
    x, y = F.col("a.box"), F.col("b.box")
    j = a.join(b, (F.col("a.page") == F.col("b.page")) & (F.col("a.o") != F.col("b.o")))
    return j.select(F.col("a.page").alias("page"), F.col("a.o").alias("a"), F.col("b.o").alias("b"), F.round(boxes.x_overlap_ratio(x, y), 6).alias("across"), boxes.y_overlap(x, y, 3.0).alias("beside"), boxes.caption_gap(x, y).alias("gap"), boxes.near_figure(x, y).alias("near"), boxes.caption_near(x, y).alias("caption"))


@query("""SELECT l_orderkey AS region_id, CASE WHEN ok IS NOT NULL THEN 'ok' WHEN best IS NOT NULL THEN 'suspicious' ELSE 'failed' END AS status, coalesce(ok, best) AS method FROM (SELECT l_orderkey, arg_min(m, r) FILTER (c >= 0.45) AS ok, arg_min(m, (-c, r)) FILTER (c >= 0.28) AS best
 FROM (SELECT l_orderkey, CASE l_linenumber WHEN 1 THEN 'span_cells' WHEN 2 THEN 'cell_ocr' WHEN 3 THEN 'docling' WHEN 4 THEN 'ppstructure' END AS m, l_linenumber AS r, l_quantity / 100 AS c FROM lineitem WHERE l_linenumber <= 4) GROUP BY 1)""")
def table_attempts(spark, d):
    """Lines of an order as attempts to read one table, their quantity as confidence."""
    order = ["span_cells", "cell_ocr", "docling", "ppstructure"]
    n = F.col("l_linenumber")
    a = _t(spark, d, "lineitem").where("l_linenumber <= 4").select(F.col("l_orderkey").alias("region_id"), F.get(F.array(*map(F.lit, order)), n - 1).alias("method"), F.lit("| a |").alias("markdown"), (F.col("l_quantity") / 100).alias("confidence"))
    return regions.accepted_attempt(a, order).select("region_id", "status", "method")


_ROUTED = """(SELECT doc_id, ['A', 'B', 'C'][doc_id % 3 + 1] AS cls, text AS layer, CASE WHEN doc_id % 5 < 3 THEN CASE WHEN doc_id % 2 = 0 THEN text ELSE substr(text, 1, length(text) // 2) || ' other words that differ' END END AS ocr, doc_id % 13 AS lines, (doc_id % 10) / 10 AS sure,
 CASE WHEN doc_id % 7 = 0 THEN 'UNREADABLE' WHEN doc_id % 7 < 4 THEN substr(text, 1, 60) END AS seen, doc_id % 11 <> 0 AS image FROM documents)"""
_J = "CASE WHEN cls = 'B' AND ocr IS NOT NULL THEN CASE WHEN len(list_distinct(x || y)) = 0 THEN 1.0 ELSE len(list_intersect(x, y)) / len(list_distinct(x || y)) END END"


@query(f"""SELECT page_class, status, text_source, count(*) AS n, sum(length(out))::BIGINT AS chars FROM (SELECT *, CASE WHEN kept THEN cls2 WHEN unread THEN 'D' WHEN asked THEN 'C' WHEN NOT image OR bad THEN 'D' ELSE 'C' END AS page_class,
 CASE WHEN kept AND doubt THEN 'suspicious' WHEN kept THEN 'ok' WHEN unread THEN 'failed' WHEN asked THEN 'ok' WHEN NOT image OR bad THEN 'failed' ELSE 'suspicious' END AS status, CASE WHEN kept AND switch THEN 'layer+ocr' WHEN kept AND doubt THEN 'layer' WHEN kept AND j IS NOT NULL THEN 'layer+ocr_check' WHEN kept THEN 'layer' WHEN asked THEN 'vlm' WHEN NOT image THEN '' ELSE 'ocr_fallback' END AS text_source,
 CASE WHEN kept AND switch THEN coalesce(ocr, '') WHEN kept THEN layer WHEN unread THEN '' WHEN asked THEN trim(seen, chr(32) || chr(10)) WHEN NOT image THEN '' ELSE coalesce(ocr, '') END AS out FROM (SELECT *, cls2 IN ('A', 'B') AS kept, coalesce(j < 0.45, false) AS doubt, coalesce(j < 0.45, false) AND length(coalesce(ocr, '')) > 0.6 * length(layer) AS switch,
 seen IS NOT NULL AND image AS asked, seen IS NOT NULL AND image AND (upper(seen) LIKE 'UNREADABLE%' OR length(trim(seen, chr(32) || chr(10))) < 40) AS unread, lines < 3 OR sure < 0.55 AS bad FROM (SELECT *, CASE WHEN j < 0.5 AND lines >= 8 THEN 'C' ELSE cls END AS cls2
 FROM (SELECT *, {_J} AS j FROM (SELECT *, list_distinct(regexp_extract_all(lower(layer), '[a-zа-яё0-9]{{3,}}')) AS x, list_distinct(regexp_extract_all(lower(coalesce(ocr, '')), '[a-zа-яё0-9]{{3,}}')) AS y FROM {_ROUTED}))))) GROUP BY ALL""")
def page_routing(spark, d):
    """The routing list over made-up outputs of recognisers."""
    i, t = F.col("doc_id"), F.col("text")
    half = F.expr("left(text, int(length(text) div 2))")
    p = _docs(spark, d).select(
        "doc_id", F.get(F.array(F.lit("A"), F.lit("B"), F.lit("C")), (i % 3).cast("int")).alias("page_class"), t, F.lit(0.9).alias("quality"), F.lit(False).alias("vetoed"),
        F.when(i % 5 < 3, F.when(i % 2 == 0, t).otherwise(F.concat(half, F.lit(" other words that differ")))).alias("ocr_text"), (i % 13).cast("int").alias("ocr_lines"), (i % 10 / 10).alias("ocr_confidence"),
        F.when(i % 7 == 0, "UNREADABLE").when(i % 7 < 4, F.substring(t, 1, 60)).alias("vision_text"), (i % 11 != 0).alias("has_image"),
    )
    return routing.extracted(p).groupBy("page_class", "status", "text_source").agg(F.count("*").alias("n"), F.sum(F.length("text_out")).cast("long").alias("chars"))


@query(f"SELECT doc_id, round((0.30 * 1.0 + 0.20 * 0.95 + 0.20 * g + 0.15 * CASE WHEN length(text) = 0 THEN 0.0 WHEN d < 0.3 THEN 0.25 WHEN d < 2 THEN 0.55 WHEN d <= 40 THEN 1.0 WHEN d <= 80 THEN 0.55 ELSE 0.15 END) / 0.85, 6) AS tlq FROM (SELECT doc_id, text, (doc_id % 10) / 10 AS g, length(text) / 500.0 AS d FROM documents WHERE regexp_full_match(text, '[A-Za-z .,|\\n]+') AND len(regexp_extract_all(text, '[A-Za-z]{{2,}}')) >= 20)")
def text_layer_scores(spark, d):
    """The weighted score of plain English texts, whose printable share is 1 and language score 0.95."""
    c = F.col("text")
    p = _docs(spark, d).where(c.rlike("^[A-Za-z .,|\n]+$") & (F.regexp_count(c, F.lit("[A-Za-z]{2,}")) >= 20) & ~c.endswith("\n\n"))
    return p.select("doc_id", F.round(quality.text_layer_score(c, F.col("doc_id") % 10 / 10, F.lit(1000.0), F.lit(500.0), F.lit(None).cast("double")), 6).alias("tlq"))


@query("SELECT o_orderkey, round(s, 6) AS score, CASE WHEN s >= 0.72 THEN 'good' WHEN s >= 0.45 THEN 'medium' ELSE 'bad' END AS level FROM (SELECT o_orderkey, least(1.0, 0.20 * (o_custkey % 10) / 10 + 0.25 * (o_orderkey % 10) / 10 + 0.15 * 0.5 + 0.20 * (o_custkey % 7) / 7 + 0.10 * 1.0 + 0.10 * (o_orderkey % 3) / 3) AS s FROM orders)")
def image_levels(spark, d):
    a, b = F.col("o_custkey"), F.col("o_orderkey")
    s = quality.image_score({"resolution": a % 10 / 10, "blur": b % 10 / 10, "noise": F.lit(0.5), "contrast": a % 7 / 7, "skew": F.lit(1.0), "compression": b % 3 / 3})
    return _t(spark, d, "orders").select("o_orderkey", F.round(s, 6).alias("score"), quality.image_level(s).alias("level"))


_FOUND = "(SELECT l_orderkey % 20 AS doc, l_linenumber <= 3 AND l_quantity > 20 AS hit, l_quantity / 50 AS i FROM lineitem WHERE l_linenumber <= 3)"


@query(f"SELECT doc::VARCHAR AS doc_id, count(*) FILTER (hit) AS tp, count(*) FILTER (NOT hit) AS fn, round(count(*) FILTER (hit) / count(*), 6) AS recall, round(avg(i), 6) AS mean_iou FROM {_FOUND} GROUP BY ROLLUP (doc)")
def box_recall(spark, d):
    """Recall and mean overlap by document and over all, from made-up matches."""
    m = _t(spark, d, "lineitem").where("l_linenumber <= 3").select((F.col("l_orderkey") % 20).cast("string").alias("doc_id"), (F.col("l_quantity") > 20).alias("hit"), (F.col("l_quantity") / 50).alias("best_iou"))
    return evaluate.box_scores(m, m.where("hit")).select("doc_id", "tp", "fn", "recall", "mean_iou")


@query("SELECT source AS doc_id, array_to_string(list_sort(list(doc_id) FILTER (doc_id % 5 = 0)), ',') AS veto, count(*) FILTER (doc_id % 5 <> 0) AS suspects FROM documents WHERE n_chars >= 40 AND (doc_id % 5 = 0 OR (doc_id % 100) / 100 < 0.85) GROUP BY 1")
def garbage_report(spark, d):
    p = _docs(spark, d).select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page"), (F.col("doc_id") % 5 == 0).alias("vetoed"), (F.col("doc_id") % 100 / 100).alias("lexical_quality"), F.col("n_chars").alias("char_count"))
    g = audits.garbage_counts(audits.garbage_candidates(p))
    return g.select("doc_id", F.when(F.size("veto_list") > 0, F.array_join(F.col("veto_list").cast("array<string>"), ",")).alias("veto"), F.col("suspect_pages").alias("suspects"))


@query("SELECT regexp_replace(source, '[0-9]+$', '') AS value, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, value LIMIT 25")
def note_counts(spark, d):
    """Sources without their numbers as notes; the 25 most frequent are what the report is."""
    return audits.status_counts(_docs(spark, d).select(F.regexp_replace("source", "[0-9]+$", "").alias("note")), "note", 25)


