"""Summaries and audits over pages, regions and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_FLAGS = ("xml", "greek", "control", "broken")


def _count(on: Column) -> Column:
    return F.count_if(F.coalesce(on, F.lit(False)))


def page_summary(pages: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts by class, status and route of pages, over all or by columns."""
    is_ = lambda c, v: _count(F.col(c) == v)
    return pages.groupBy(*(by or [])).agg(
        F.count("*").alias("pages"), *(is_("page_class", k).alias(f"class_{k}") for k in "ABCD"), *(is_("status", k).alias(k) for k in ("ok", "suspicious", "failed")),
        _count(F.col("needs_vlm")).alias("needs_vlm"), _count(F.col("needs_vlm") & ~F.coalesce("vlm_used", F.lit(False))).alias("needs_vlm_pending"), _count(F.col("needs_vlm")).alias("vlm_candidates"),
        *(_count(F.col(k)).alias(k) for k in ("vlm_attempted", "vlm_used", "ocr_fallback_used")),
    )


def page_table(pages: DataFrame) -> DataFrame:
    """By document, and with a null document over all: pages by class, ok, suspicious, from recognition, from vision."""
    src = F.col("text_source")
    return pages.rollup("doc_id").agg(F.count("*").alias("pages"), *(_count(F.col("page_class") == k).alias(k) for k in "ABCD"), _count(F.col("status") == "ok").alias("ok"), _count(F.col("status") == "suspicious").alias("suspicious"), _count(src.contains("ocr")).alias("ocr"), _count(src == "vlm").alias("vlm"))


def source_summary(pages: DataFrame) -> DataFrame:
    """Routes, vetoes, mean and least text-layer score, mean lexical quality of the pages that have one."""
    return pages.agg(F.count("*").alias("pages_analyzed"), _count(F.col("route") == "text_layer").alias("route_text_layer"), _count(F.col("route") == "ocr").alias("route_ocr"), _count(F.col("vetoed")).alias("garbage_veto_pages"), F.round(F.coalesce(F.avg("tlq_score"), F.lit(0.0)), 4).alias("mean_tlq"), F.round(F.coalesce(F.min("tlq_score"), F.lit(0.0)), 4).alias("min_tlq"), F.round(F.avg("quality"), 4).alias("mean_lexical"))


def region_summary(regions: DataFrame) -> DataFrame:
    """(doc_id, page): numbers of regions by type, and of those with status ok."""
    return regions.groupBy("doc_id", "page").agg(F.count("*").alias("regions"), *(_count(F.col("type") == t).alias(f"{t}s") for t in ("formula", "table", "figure")), _count(F.col("status") == "ok").alias("ok"), _count(F.col("status").startswith("suspicious")).alias("suspicious"), _count(F.col("status") == "failed").alias("failed"))


def garbage_candidates(pages: DataFrame, suspect: float = 0.85, least: int = 40) -> DataFrame:
    """``pages`` with a vetoed or doubtful text layer and their ``priority``; vetoed ones first, then the lowest lexical quality."""
    priority = F.when(F.col("vetoed"), "veto").when(F.col("lexical_quality") < suspect, "suspect")
    found = pages.where(F.col("char_count") >= least).withColumn("priority", priority).where(F.col("priority").isNotNull())
    return found.orderBy(F.when(F.col("priority") == "veto", 0).otherwise(1), F.coalesce("lexical_quality", F.lit(1.0)), "doc_id", "page")


def garbage_counts(candidates: DataFrame) -> DataFrame:
    """By document: vetoed and suspected pages, as counts and lists (at most one document's pages in a row)."""
    pages = lambda p: F.sort_array(F.collect_list(F.when(F.col("priority") == p, F.col("page"))))
    return candidates.groupBy("doc_id").agg(_count(F.col("priority") == "veto").alias("veto_pages"), _count(F.col("priority") == "suspect").alias("suspect_pages"), pages("veto").alias("veto_list"), pages("suspect").alias("suspect_list"))


def layer_audit(pages: DataFrame) -> DataFrame:
    """By document: pages, admitted pages, and how many of both have each problem flag (columns xml, greek, control, broken)."""
    return pages.groupBy("doc_id").agg(F.count("*").alias("pages"), _count(F.col("admitted")).alias("admitted_pages"), *(_count(F.col(k)).alias(k) for k in _FLAGS), *(_count(F.col(k) & F.col("admitted")).alias(f"adm_{k}") for k in _FLAGS))


def percent(part: Column, whole: Column) -> Column:
    """A whole percentage; a dash for none of nothing."""
    return F.when(whole == 0, "—").otherwise(F.concat(F.format_string("%.0f", F.bround(100.0 * part / whole, 0)), F.lit("%")))


def audit_priority(audit: DataFrame, xml: float = 0.05, broken: float = 0.50) -> DataFrame:
    """Documents to look at first: markup on 5 in a hundred admitted pages, or broken words on half; the worst first."""
    share = lambda k: F.col(f"adm_{k}") / F.col("admitted_pages")
    bad = audit.where("admitted_pages > 0").withColumn("share", F.greatest(share("xml"), share("broken"))).where((share("xml") >= xml) | (share("broken") >= broken))
    return bad.orderBy(F.desc("share"), F.desc("doc_id"))


def status_counts(pages: DataFrame, column: str, most: int | None = None) -> DataFrame:
    """(value, n) of a column, the most frequent first; of ``most`` values only where that is asked for."""
    out = pages.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")
    return out if most is None else out.limit(most)


def note_counts(pages: DataFrame, most: int = 25) -> DataFrame:
    """The most frequent notes, without what they measured."""
    return status_counts(pages.select(F.explode("notes").alias("note")).select(F.regexp_replace("note", "[=:].*$", "").alias("note")), "note", most)


def formula_pages(regions: DataFrame, most: int = 8) -> DataFrame:
    """(doc_id, page, n, statuses, rank): per document the pages with most formulas, then most kinds of status."""
    g = regions.where(F.col("type") == "formula").groupBy("doc_id", "page").agg(F.count("*").alias("n"), F.countDistinct("status").alias("statuses"))
    order = Window.partitionBy("doc_id").orderBy(F.desc("n"), F.desc("statuses"), "page")
    return g.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def quality_report(pairs: DataFrame) -> DataFrame:
    """By document of (doc_id, cer): pages, median, mean, least and largest error."""
    return pairs.groupBy("doc_id").agg(F.count("*").alias("pages"), F.round(F.median("cer"), 6).alias("median_cer"), F.round(F.avg("cer"), 6).alias("mean_cer"), F.round(F.min("cer"), 6).alias("least"), F.round(F.max("cer"), 6).alias("most"))


def engine_means(runs: DataFrame) -> DataFrame:
    """(engine): mean accuracy, error rates and seconds."""
    return runs.groupBy("engine").agg(F.count("*").alias("pages"), *(F.round(F.avg(c), 6).alias(f"mean_{c}") for c in ("accuracy", "cer", "wer", "seconds")))


def expected_present(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, present, ab, cd): expected documents, whether they were extracted, and their pages of classes A or B, C or D."""
    g = found.groupBy("doc_id").agg(_count(F.col("page_class").isin("A", "B")).alias("ab"), _count(F.col("page_class").isin("C", "D")).alias("cd"))
    return expected.join(g, "doc_id", "left").select("doc_id", F.col("ab").isNotNull().alias("present"), F.coalesce("ab", F.lit(0)).alias("ab"), F.coalesce("cd", F.lit(0)).alias("cd"))


def empty_documents(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """Documents without a page."""
    return docs.select("doc_id").distinct().join(pages.select("doc_id").distinct(), "doc_id", "left_anti")


def layer_density(pages: DataFrame, sample: int = 5, scanned: float = 50.0, full: float = 500.0) -> DataFrame:
    """(doc_id, mean_chars, layer): mean text length of evenly spread sample pages, as none, partial or full text layer."""
    from lexigrove.sources.pages import sampled_pages

    picked = pages.groupBy("doc_id").agg(F.max("page").cast("int").alias("n")).select("doc_id", F.explode(sampled_pages(F.col("n"), sample)).alias("page"))
    g = pages.join(picked, ["doc_id", "page"]).groupBy("doc_id").agg(F.round(F.avg(F.length("text")), 4).alias("mean_chars"))
    return g.withColumn("layer", F.when(F.col("mean_chars") < scanned, "none").when(F.col("mean_chars") < full, "partial").otherwise("full"))
