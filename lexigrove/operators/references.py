"""Proofread pages against a collection: what they hold, which page they are of, how far the text layer is from them.

``proofread``: name, page, draft, text, formulas (sources.pages.proofread). ``pages``: doc_id, page, text, and tlq_score, quality,
vetoed, route where they are known. ``candidates``: doc_id, page, priority of the report on garbage text layers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrove.functions import text as T
from lexigrove.functions.tally import char_counts
from lexigrove.operators.evaluate import char_errors
from lexigrove.sources.pages import best_named

# Fixed value: characters below which a proofread page is short.
SHORT = 200


def described(proofread: DataFrame) -> DataFrame:
    """``proofread`` with chars, lines, n_formulas and lang: ru or en by the letters that prevail, else mixed."""
    c = F.coalesce("text", F.lit(""))
    both = char_counts(c, cyr="А-Яа-яЁё", lat="A-Za-z")
    lang = T.once(both, lambda n: F.when(n.cyr > n.lat, "ru").when(n.lat > n.cyr, "en").otherwise("mixed"))
    return proofread.withColumn("chars", F.length(c)).withColumn("lines", F.size(T.lines(c))).withColumn("n_formulas", F.coalesce(F.size("formulas"), F.lit(0))).withColumn("lang", lang)


def report(proofread: DataFrame, pages: DataFrame, candidates: DataFrame | None = None, compared: int | None = None) -> DataFrame:
    """One row a proofread page: name, page, draft, lang, chars, lines, n_formulas, doc_id, cer, tlq_score, quality, vetoed, route, priority.

    Documents are found by name. A page that the collection lacks has no ``cer``; one whose layer is empty has 1. Whole pages are compared,
    or their first ``compared`` characters.
    """
    known = {"tlq_score": "double", "quality": "double", "vetoed": "boolean", "route": "string"}
    for name, kind in known.items():
        pages = pages if name in pages.columns else pages.withColumn(name, F.lit(None).cast(kind))
    found = described(proofread).join(best_named(proofread, pages.select("doc_id")), "name", "left")
    layer = pages.select("doc_id", F.col("page").cast("int").alias("page"), F.coalesce("text", F.lit("")).alias("layer"), *known)
    j = found.join(layer, ["doc_id", "page"], "left")
    j = char_errors(j.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("empty", T.strip(F.col("layer")) == ""), "text", "layer", compared)
    j = j.withColumn("cer", F.when(F.col("empty"), 1.0).otherwise(F.col("cer")))
    if candidates is not None:
        j = j.join(candidates.select("doc_id", F.col("page").cast("int").alias("page"), "priority"), ["doc_id", "page"], "left")
    else:
        j = j.withColumn("priority", F.lit(None).cast("string"))
    return j.select("name", "page", "draft", "lang", "chars", "lines", "n_formulas", "doc_id", "cer", *known, "priority")


def summary(reported: DataFrame) -> DataFrame:
    """One row: references, matched (to a page), candidates, drafts, short, with_formulas, ru, en, mixed, mean_cer."""
    n = lambda c: F.count_if(c)
    return reported.agg(
        F.count("*").alias("references"), n(F.col("cer").isNotNull()).alias("matched"), n(F.col("priority").isNotNull()).alias("candidates"), n(F.col("draft")).alias("drafts"), n(F.col("chars") < SHORT).alias("short"),
        n(F.col("n_formulas") > 0).alias("with_formulas"), *(n(F.col("lang") == k).alias(k) for k in ("ru", "en", "mixed")), F.round(F.avg("cer"), 6).alias("mean_cer"),
    )


def unread(candidates: DataFrame, reported: DataFrame) -> DataFrame:
    """Candidates of which no page was proofread."""
    return candidates.join(reported.where("doc_id IS NOT NULL").select("doc_id", "page").distinct(), ["doc_id", "page"], "left_anti")
