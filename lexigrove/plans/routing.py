"""Where a page's text comes from: the decision list over recorded outputs of recognisers, as columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrove.functions.quality import page_class, route, text_layer_score
from lexigrove.functions.text import strip, word_jaccard


@dataclass(frozen=True)
class Routing:
    """Agreement of layer and recognition below which a B page is read anew, or doubted; least confidence of recognition."""

    layer_threshold: float = 0.65
    escalate: float = 0.50
    escalate_lines: int = 8
    agree: float = 0.45
    long_enough: float = 0.6
    ocr_lines: int = 3
    ocr_confidence: float = 0.55
    least_chars: int = 40
    vision_confidence: float = 0.7


R = Routing()


def analysed(pages: DataFrame, threshold: float = R.layer_threshold) -> DataFrame:
    """``pages`` with tlq_score, route and page_class.

    Needs text, geometry, page_w, page_h, visual (nullable), n_spans, quality, dict_hit, oov_hard, vetoed.
    """
    text = F.coalesce("text", F.lit(""))
    layer = (strip(text) != "") | (F.coalesce("n_spans", F.lit(0)) > 0)
    veto = layer & F.coalesce("vetoed", F.lit(False))
    p = pages.withColumn("tlq_score", F.when(layer, text_layer_score(text, F.coalesce("geometry", F.lit(0.0)), F.col("page_w"), F.col("page_h"), F.col("visual"))).otherwise(0.0))
    p = p.withColumn("route", route(layer, F.col("tlq_score"), veto, threshold))
    return p.withColumn("page_class", page_class(layer, F.length(text), F.col("tlq_score"), F.col("quality"), F.col("dict_hit"), F.col("oov_hard"), veto, threshold))


def extracted(pages: DataFrame, rules: Routing = R, vision: bool = True, fallback: bool = True) -> DataFrame:
    """``pages`` with page_class, status, text_source, text_out, confidence, needs_vlm, vlm_attempted, vlm_used, vlm_quality, ocr_fallback_used, low_confidence.

    Inputs, all nullable: page_class, text (of the layer, in reading order), quality, vetoed, ocr_text, ocr_lines, ocr_confidence,
    vision_text, has_image. A pages keep their layer, B pages are compared with recognition, C pages take the vision model's
    reading, else recognition, which stays suspicious; what is unreadable becomes D.
    """
    layer, ocr = F.coalesce("text", F.lit("")), F.coalesce("ocr_text", F.lit(""))
    lines, sure = F.coalesce("ocr_lines", F.lit(0)), F.coalesce("ocr_confidence", F.lit(0.0))
    agreement = word_jaccard(layer, ocr)
    checked = (F.col("page_class") == "B") & F.col("ocr_text").isNotNull()
    p = pages.withColumn("agreement", F.when(checked, agreement)).withColumn("was", F.col("page_class"))
    p = p.withColumn("page_class", F.when((F.col("agreement") < rules.escalate) & (lines >= rules.escalate_lines), "C").otherwise(F.col("page_class")))
    kept, doubt = F.col("page_class").isin("A", "B"), F.col("agreement") < rules.agree
    switch = doubt & (F.length(ocr) > rules.long_enough * F.length(layer))
    seen = strip(F.coalesce("vision_text", F.lit("")))
    asked = F.lit(vision) & F.coalesce("has_image", F.lit(True)) & F.col("vision_text").isNotNull()
    unread = asked & (F.upper(seen).startswith("UNREADABLE") | (F.length(seen) < rules.least_chars))
    pending = F.lit(not vision and not fallback)
    image, bad = F.coalesce("has_image", F.lit(True)), (lines < rules.ocr_lines) | (sure < rules.ocr_confidence)
    case = lambda *pairs: _case(pairs)
    cls = case((kept, F.col("page_class")), (unread, F.lit("D")), (asked, F.lit("C")), (pending, F.lit("C")), (~image | bad, F.lit("D")), (F.lit(True), F.lit("C")))
    status = case((kept & doubt, F.lit("suspicious")), (kept, F.lit("ok")), (unread, F.lit("failed")), (asked, F.lit("ok")), (pending, F.lit("needs_vlm")), (~image | bad, F.lit("failed")), (F.lit(True), F.lit("suspicious")))
    source = case((kept & switch, F.lit("layer+ocr")), (kept & doubt, F.lit("layer")), (kept & F.col("agreement").isNotNull(), F.lit("layer+ocr_check")), (kept, F.lit("layer")), (asked, F.lit("vlm")), (pending | ~image, F.lit("")), (F.lit(True), F.lit("ocr_fallback")))
    text = case((kept & switch, ocr), (kept, layer), (unread, F.lit("")), (asked, seen), (pending | ~image, F.lit("")), (F.lit(True), ocr))
    confidence = case((kept, F.col("quality")), (unread, F.lit(0.0)), (asked, F.lit(rules.vision_confidence)), (pending | ~image, F.lit(None)), (F.lit(True), sure))
    grade = case((kept, F.lit(None)), (unread, F.lit("failed")), (asked, F.lit("suspicious")), (F.lit(True), F.lit("unavailable")))
    return p.select(
        *(c for c in pages.columns if c != "page_class"), "agreement", cls.alias("page_class"), status.alias("status"), source.alias("text_source"), text.alias("text_out"), confidence.cast("double").alias("confidence"), (~kept).alias("needs_vlm"),
        (~kept & asked).alias("vlm_attempted"), (~kept & asked & ~unread).alias("vlm_used"), grade.alias("vlm_quality"), (~kept & ~asked & ~pending & image).alias("ocr_fallback_used"), (~kept | F.coalesce("vetoed", F.lit(False))).alias("low_confidence"),
    )


def _case(pairs) -> Column:
    out = None
    for on, value in pairs:
        on = F.coalesce(on, F.lit(False))
        out = F.when(on, value) if out is None else out.when(on, value)
    return out


def layout_reply(c: Column) -> Column:
    """A vision model's answer on layout: columns (1 to 4), table, unusual, missing."""
    up = F.upper(c)
    n = F.nullif(F.regexp_extract(up, r"COLUMNS:[^\n]*?([0-9]+)", 1), F.lit("")).cast("int")
    yes = lambda word: up.rlike(rf"{word}:\s*Y")
    return F.struct(F.greatest(F.lit(1), F.least(F.lit(4), F.coalesce(n, F.lit(1)))).alias("n_columns"), yes("TABLE").alias("likely_table"), yes("UNUSUAL").alias("unusual_layout"), yes("MISSING").alias("missing_regions"), F.substring(F.trim(c), 1, 1200).alias("vlm_notes"))
