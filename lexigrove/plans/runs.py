"""Whole runs over page files: texts with their classes, and regions. Every step is a frame; results are written by document.

``read`` pages (sources.reader.ROW) go through the library's own chain: reading order, geometry, agreement of text and ink,
lexical quality, routing; and detectors from spans, ink, captions, rules and embedded images, settled page by page.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrove.functions import quality
from lexigrove.operators import ink, layout, regions
from lexigrove.plans import routing
from lexigrove.sources import pages as P
from lexigrove.sources import reader as R
from lexigrove.sources.tables import exists, stored

KEY = ["doc_id", "page"]
DPI = 72


def spans_of(read: DataFrame) -> DataFrame:
    """(doc_id, page, span_ord, text, box, page_w, page_h) of read pages."""
    s = read.where(F.col("error").isNull()).select(*KEY, "page_w", "page_h", F.posexplode("spans").alias("span_ord", "s"))
    s_ = F.col("s")
    box = F.struct(*(s_[k].alias(k) for k in ("x1", "y1", "x2", "y2")))
    return s.select(*KEY, "span_ord", s_["text"].alias("text"), box.alias("box"), "page_w", "page_h")


def image_pages(read: DataFrame) -> DataFrame:
    """Pages that have a raster, as ink wants them."""
    return read.where(F.col("gray").isNotNull()).select("doc_id", F.col("page").cast("long").alias("page"), "page_w", "page_h", "width", "height", F.coalesce("dpi", F.lit(DPI)).alias("dpi"))


def classified(read: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Read pages with text in reading order, geometry, visual agreement, lexical quality, tlq_score, route and page_class.

    ``known`` (lang, word, zipf), a word list; without one the pages' own words are it.
    """
    text = F.col("text")
    ordered = layout.read_pages(layout.page_rows(spans_of(read))).select(*KEY, F.col("text").alias("ordered"), "n_columns", "likely_table", "notes")
    p = read.join(ordered, KEY, "left").withColumn("text", F.coalesce(F.nullif("ordered", F.lit("")), text, F.lit(""))).drop("ordered")
    p = p.join(quality.geometry_scores(spans_of(read)), KEY, "left")
    found = ink.strokes(read.where("gray IS NOT NULL"), ink.below_median(12))
    spans = spans_of(read).select("doc_id", F.col("page").cast("long").alias("page"), "box")
    seen = ink.agreement(found, spans, image_pages(read)).select("doc_id", F.col("page").cast("int").alias("page"), "visual")
    p = stored(p.join(seen, KEY, "left").withColumn("page_id", F.concat_ws("|", "doc_id", F.col("page").cast("string"))))
    if known is None:
        known = quality.lexicon(p.select("text", F.lit("und").alias("lang")))
    words = quality.lexical_quality(p.select("page_id", "text"), known).select("page_id", "quality", "dict_hit", "oov_hard", "vetoed")
    p = p.join(words, "page_id", "left").withColumn("n_spans", F.coalesce(F.size("spans"), F.lit(0)))
    return routing.analysed(p)


def extracted(read: DataFrame, known: DataFrame | None = None, recognised: DataFrame | None = None, vision: bool = False, fallback: bool = True) -> DataFrame:
    """``classified`` pages with the text that counts and where it comes from.

    ``recognised``: (doc_id, page, and any of ocr_text, ocr_lines, ocr_confidence, vision_text) of recognisers; without it C and D
    pages have what the layer holds.
    """
    p = classified(read, known)
    nothing = {"ocr_text": "string", "ocr_lines": "int", "ocr_confidence": "double", "vision_text": "string"}
    if recognised is not None:
        p = p.join(recognised.select(*KEY, *(c for c in nothing if c in recognised.columns)), KEY, "left")
    for c, kind in nothing.items():
        p = p if c in p.columns else p.withColumn(c, F.lit(None).cast(kind))
    return routing.extracted(p.withColumn("has_image", F.col("gray").isNotNull()), vision=vision, fallback=fallback)


def page_documents(pages: DataFrame) -> DataFrame:
    """One row a document, as sources.pages.DOCUMENT: its pages in order (a document's texts meet in one row, as in its file)."""
    structure = F.struct(F.col("n_columns"), F.coalesce("likely_table", F.lit(False)).alias("likely_table"), F.lit(False).alias("unusual_layout"), F.coalesce("notes", F.array().cast("array<string>")).alias("notes"), F.lit(None).cast("string").alias("vlm_notes"))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).cast("string")
    provenance = F.create_map(F.lit("low_confidence"), flag("low_confidence"), F.lit("garbage_veto"), flag("vetoed"))
    one = F.struct(
        "doc_id", "page", "page_class", "status", F.col("text_out").alias("text"), "text_source", structure.alias("layout"), "tlq_score", F.col("quality").alias("lexical_quality"), F.lit(None).cast("string").alias("iqs_level"), "confidence", F.lit(None).cast("string").alias("preview_path"),
        F.when(F.col("error").isNotNull(), F.array("error")).otherwise(F.array().cast("array<string>")).alias("notes"), provenance.alias("provenance"), "needs_vlm", "vlm_attempted", "vlm_used", "vlm_quality", "ocr_fallback_used", F.lit(None).cast("int").alias("elapsed_ms"),
    )
    counts = F.create_map(*(x for k in "ABCD" for x in (F.lit(k), F.count_if(F.col("page_class") == k).cast("string"))))
    return pages.groupBy("doc_id").agg(F.max("path").alias("source_path"), F.max("page_count").alias("page_count"), F.array_sort(F.collect_list(F.struct(F.col("page").alias("at"), one.alias("p"))), lambda a, b: a["at"] - b["at"]).alias("pages"), counts.alias("summary")).withColumn("pages", F.col("pages.p"))


def write_documents(pages: DataFrame, out: str) -> None:
    """Page documents as JSON and page texts below ``out``; documents that are written again replace their old ones."""
    docs = page_documents(pages)
    # the file's reader takes a document from the column of that name, its folder only keeps documents apart
    docs.withColumn("of", F.col("doc_id")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("of").json(f"{out}/documents")
    texts = pages.select("doc_id", "page", F.col("text_out").alias("text"))
    texts.select("doc_id", "page", F.coalesce("text", F.lit("")).alias("text")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("doc_id", "page").text(f"{out}/texts")


def done_documents(spark: SparkSession, out: str) -> DataFrame | None:
    return spark.read.json(f"{out}/documents", schema="doc_id string").distinct() if exists(spark, f"{out}/documents") else None


def run_extract(spark: SparkSession, path: str, out: str, make: Callable, pages: str | None = None, resume: bool = False, pattern: str = "*.{pdf,PDF}", known: DataFrame | None = None, recognise: Callable[[DataFrame], DataFrame] | None = None, vision: bool = False, fallback: bool = True, step: int = R.STEP) -> DataFrame:
    """Texts of all files below ``path`` to ``out``; returns (doc_id, page, page_class, status, text_source, chars) of what was done.

    ``resume`` leaves out documents that ``out`` has. ``recognise``: read pages to (doc_id, page, ocr_text...), through ports.
    """
    found = R.counted(R.listed(spark, path, pattern), make)
    before = done_documents(spark, out) if resume else None
    if before is not None:
        found = found.join(before, "doc_id", "left_anti")
    read = stored(R.read(R.planned(stored(found), pages, step), make))
    got = stored(extracted(read, known, recognise(read) if recognise else None, vision, fallback))
    write_documents(got, out)
    return got.select(*KEY, "page_class", "status", "text_source", F.length("text_out").alias("chars"))


def detected(read: DataFrame) -> DataFrame:
    """(doc_id, page, page_w, page_h, regions): formulas, tables and figures of read pages, by all detectors, settled."""
    spans = spans_of(read)
    sizes = read.where("error IS NULL").select(*KEY, F.col("page_w"), F.col("page_h"))
    own = layout.detect(layout.page_rows(spans)).select(*KEY, "regions")
    pages, raster = image_pages(read), read.where("gray IS NOT NULL")
    long = lambda df: df.withColumn("page", F.col("page").cast("long"))
    paper, dark = stored(ink.strokes(raster, ink.below_paper())), ink.strokes(raster, ink.below_median(15))
    around = ink.below_around()
    table = ink.grids(ink.strokes(raster, around), ink.strokes(raster, around, True), pages).join(long(pages.select(*KEY, "dpi")), KEY)
    b, scale = F.col("box"), 72.0 / F.col("dpi")
    table = table.select(*KEY, F.struct(*((b[k] * scale).alias(k) for k in ("x1", "y1", "x2", "y2"))).alias("box"), "score", F.lit("cv_line_grid").alias("method"))
    s = F.col("i")
    inside = read.where("error IS NULL").select("doc_id", F.col("page").cast("long").alias("page"), F.posexplode("images").alias("box_id", "i")).select(*KEY, "box_id", F.struct(*(s[k].alias(k) for k in ("x1", "y1", "x2", "y2"))).alias("box"))
    more = {
        "ink": ink.as_regions(ink.ink_figures(dark, long(spans), pages)), "captioned": ink.as_regions(ink.caption_figures(paper, long(spans), pages)),
        "embedded": ink.as_regions(ink.embedded_figures(inside, paper, pages)), "ruled": ink.as_regions(table, "table"),
    }
    out = sizes.join(own, KEY, "left").withColumn("regions", F.coalesce("regions", F.array().cast(f"array<{layout.REGION}>")))
    for name, df in more.items():
        out = out.join(df.select("doc_id", F.col("page").cast("int").alias("page"), F.col("found").alias(name)), KEY, "left")
    return regions.with_detections(out, *more)


def blocks_of(spark: SparkSession, out: str) -> DataFrame:
    """The blocks that runs have written to ``out``."""
    return spark.read.parquet(f"{out}/blocks").where("region_id IS NOT NULL")


def run_regions(spark: SparkSession, path: str, out: str, make: Callable, pages: str | None = None, mode: str = "new", skip_unchanged: bool = False, pattern: str = "*.{pdf,PDF}", step: int = R.STEP) -> DataFrame:
    """Regions of all files below ``path`` to ``out``/blocks (see ``blocks_of``); returns (doc_id, page, formulas, tables, figures) of what was done.

    Modes: new (a document's old pages go), resume (documents whose wanted pages are all there are left out, others are done
    anew), merge (missing pages are added), reprocess (wanted pages are made anew, others stay). ``skip_unchanged`` leaves out
    files whose time and size ``out``/manifest has, and keeps it.
    """
    files = R.listed(spark, path, pattern)
    manifest = f"{out}/manifest"
    if skip_unchanged and exists(spark, manifest):
        files = P.changed(files, spark.read.parquet(manifest))
    found = stored(R.counted(files, make))
    plan = R.planned(found, pages, step)
    have = f"{out}/pages"
    if mode in ("resume", "merge") and exists(spark, have):
        wanted = plan.select("doc_id", F.explode("pages").alias("page"))
        todo = P.pages_to_do(wanted, spark.read.parquet(have).select(F.col("doc_id").cast("string"), "page"), "merge" if mode == "merge" else "resume")
        left = todo.groupBy("doc_id").agg(F.sort_array(F.collect_set("page")).alias("all"))  # a document's page numbers
        # pages left to do are cut into ranges anew
        plan = found.join(left, "doc_id").select("path", "doc_id", "page_count", F.explode(F.transform(F.sequence(F.lit(0), F.size("all") - 1, F.lit(step)), lambda i: F.slice("all", i + 1, step))).alias("pages"))
    read = stored(R.read(plan, make))
    got = stored(detected(read))
    made = regions.blocks(got)
    # new pages and blocks beside those of the touched documents that stay
    fresh = {"pages": got.select(*KEY), "blocks": made}
    for name, df in fresh.items():
        at = f"{out}/{name}"
        if mode in ("merge", "reprocess") and exists(spark, at):
            old = spark.read.schema(df.schema).parquet(at)
            kept = old.join(got.select("doc_id").distinct(), "doc_id", "left_semi").join(got.select(*KEY), KEY, "left_anti")
            df = df.unionByName(stored(kept.where("page IS NOT NULL")))
        # a document that has no rows any more keeps one of nulls, so that its old rows go
        P.write_regions(got.select("doc_id").distinct().join(df, "doc_id", "left").select(*df.columns), at)
    if skip_unchanged:
        seen = R.listed(spark, path, pattern).select("path", "mtime_ns", "size").join(found.select("path"), "path", "left_semi")
        old = spark.read.parquet(manifest) if exists(spark, manifest) else seen.limit(0)
        stored(stored(old.join(seen.select("path"), "path", "left_anti").unionByName(seen)), manifest, "overwrite")
    n = lambda kind: F.size(F.filter("regions", lambda r: r["type"] == kind)).alias(f"{kind}s")
    return got.select(*KEY, n("formula"), n("table"), n("figure"))


