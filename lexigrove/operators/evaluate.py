"""Evaluation: retrieval metrics, self-recall probes, error rates of recognised text, and box metrics."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexigrove.functions import text as T
from lexigrove.sources.tables import stored


def gold_match(hit: str, gold: str) -> Column:
    """Whether a hit is what a gold row asks for: document, clause and page, where the gold row names them."""
    h, g = lambda c: F.col(f"{hit}.{c}"), lambda c: F.col(f"{gold}.{c}")
    page = g("page").between(h("page_start"), h("page_end"))
    return (g("doc_id").isNull() | (g("doc_id") == h("doc_id"))) & (g("clause_id").isNull() | g("clause_id").eqNullSafe(h("clause_id"))) & (g("page").isNull() | page)


def relevant_hits(hits: DataFrame, gold: DataFrame) -> DataFrame:
    """(query_id, rank) of the hits that match a gold row of their query.

    ``hits``: query_id, rank, doc_id, clause_id, page_start, page_end; ``gold``: query_id, doc_id, clause_id, page (null: any).
    """
    j = hits.alias("h").join(gold.alias("g"), F.col("h.query_id") == F.col("g.query_id")).where(gold_match("h", "g"))
    return j.select("h.query_id", "h.rank").distinct()


def metrics(queries: DataFrame, hits: DataFrame, relevant: DataFrame, absent: DataFrame, top_k: int = 5) -> DataFrame:
    """One row: questions, recall_1, recall_3, recall_5, mrr, precision_5, ndcg_5, junk_5, each averaged over the questions.

    ``relevant``: (query_id, rank) of relevant hits; ``absent``: (query_id) of questions without an answer, which are right when nothing is
    found. Precision, nDCG and junk look at the first min(5, top_k) hits.
    """
    window = max(1, min(5, top_k))
    first = relevant.groupBy("query_id").agg(F.min("rank").alias("r"))
    shown = hits.groupBy("query_id").agg(F.count_if(F.col("rank") <= window).alias("shown"), F.count("*").alias("any"))
    q = queries.select("query_id").join(absent.select("query_id").distinct().withColumn("absent", F.lit(True)), "query_id", "left").join(first, "query_id", "left").join(shown, "query_id", "left")
    q = q.na.fill(0, ["shown", "any"]).na.fill(False, ["absent"])
    empty, within = (F.col("any") == 0).cast("double"), F.coalesce(F.col("r") <= window, F.lit(False))
    mean = lambda c: F.round(F.avg(F.when(F.col("absent"), empty).otherwise(F.coalesce(c, F.lit(0.0)))), 6)
    junk = F.when(F.col("absent"), F.col("shown")).otherwise(F.col("shown") - within.cast("int"))
    return q.agg(
        F.count("*").alias("questions"), *(mean((F.col("r") <= k).cast("double")).alias(f"recall_{k}") for k in (1, 3, 5)), mean(1 / F.col("r")).alias("mrr"),
        mean(within.cast("double") / window).alias("precision_5"), mean(F.when(within, 1 / F.log2(F.col("r") + 1.0))).alias("ndcg_5"), F.round(F.avg(junk), 6).alias("junk_5"),
    )


def probes(chunks: DataFrame, limit: int = 100, least: int = 6) -> DataFrame:
    """(query_id, chunk_ord, query): the first sentence of six tokens of every step-th chunk that has six tokens.

    The step spreads ``limit`` probes over all such chunks; chunks without such a sentence give none.
    """
    able = chunks.where(F.size(T.tokens(F.col("text"))) >= least).select("chunk_ord", "text")
    n = able.count()
    step = max(1, n // max(1, limit))
    # numbers without one window over all rows: counts of the ranges in front, then numbers within a range
    parts = stored(able.repartitionByRange("chunk_ord").sortWithinPartitions("chunk_ord").withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()))
    own = F.row_number().over(Window.partitionBy("part").orderBy("at"))
    before, total = {}, 0
    for p, c in sorted(parts.groupBy("part").count().collect()):  # one row a partition
        before[p], total = total, total + c
    offset = F.element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), F.col("part")) if before else F.lit(0)
    sentence = F.filter(F.split("text", r"(?<=[.!?])\s+"), lambda s: F.size(T.tokens(s)) >= least)
    picked = parts.withColumn("n", own - 1 + offset).where(F.col("n") % step == 0).select("n", "chunk_ord", F.get(sentence, F.lit(0)).alias("query")).where(F.col("query").isNotNull())
    return picked.orderBy("n").limit(limit).select(F.col("chunk_ord").cast("long").alias("query_id"), "chunk_ord", "query")


def probe_recall(hits: DataFrame, asked: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: checked, recall_at_5: probes for which a hit is of their own document and clause with overlapping pages."""
    where = chunks.select("chunk_ord", "doc_id", "clause_id", "page_start", "page_end")
    own = asked.join(where, "chunk_ord").drop("chunk_ord", "query").alias("o")
    got = hits.select("query_id", "chunk_ord").join(where, "chunk_ord").alias("h")
    same = (F.col("o.doc_id") == F.col("h.doc_id")) & F.col("o.clause_id").eqNullSafe(F.col("h.clause_id")) & (F.col("h.page_start") <= F.col("o.page_end")) & (F.col("o.page_start") <= F.col("h.page_end"))
    right = own.join(got, "query_id").where(same).select("query_id").distinct().withColumn("hit", F.lit(1.0))
    return asked.select("query_id").join(right, "query_id", "left").agg(F.count("*").alias("checked"), F.round(F.avg(F.coalesce("hit", F.lit(0.0))), 4).alias("recall_at_5"))


def cer(reference: Column, hypothesis: Column, cut: int | None = 10_000, lower: bool = False, empty_is_wrong: bool = True) -> Column:
    """Edit distance of characters over the reference's length.

    ``cut``: collapse white space and compare so many characters; None compares texts as they are. An empty reference gives 0 for an empty
    hypothesis, else 1, or always 0 without ``empty_is_wrong``.
    """

    def tidy(c: Column) -> Column:
        c = F.coalesce(c, F.lit(""))
        c = F.lower(c) if lower else c
        return c if cut is None else F.substring(T.strip(F.regexp_replace(c, r"(?U)\s+", " ")), 1, cut)

    a, b = tidy(reference), tidy(hypothesis)
    bare = F.when(b == "", 0.0).otherwise(1.0) if empty_is_wrong else F.lit(0.0)
    return F.when(a == "", bare).otherwise(F.levenshtein(a, b) / F.length(a))


def word_accuracy(reference: Column, hypothesis: Column) -> Column:
    """Share of the reference's distinct words that the hypothesis has."""
    a, b = (F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"(?U)\s+"), lambda w: w != "")) for c in (reference, hypothesis))
    return F.when(F.size(a) == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def edits(a: list, b: list) -> int:
    """Edit distance of two lists, one row of the table at a time."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        corner, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            corner, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, corner + (x != y))
    return row[-1]


def replaced(a: str, b: str) -> int | None:
    """Edit distance of texts of one length whose differing characters never stand for one another, else None.

    One edit makes the bags of characters differ by one less at most, and here they differ in every place where the texts do.
    """
    if len(a) != len(b):
        return None
    x, y = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in (a, b))
    at = np.flatnonzero(x != y)
    return None if np.intersect1d(x[at], y[at]).size else len(at)


def distance(a: str, b: str) -> int:
    """Edit distance of two texts. One row of the table is the bits of an integer, so a step takes the time of a few long sums."""
    if not a or not b:
        return len(a) + len(b)
    plain = replaced(a, b)
    if plain is not None:
        return plain
    at: dict[str, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    every, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, out = every, 0, len(a)  # where the table rises and falls from one row to the next
    for x in b:
        m = at.get(x, 0) | down
        same = (((m & up) + up) ^ up) | m
        rises, falls = (down | ~(up | same)) & every, up & same
        out += bool(rises & top) - bool(falls & top)
        rises = (rises << 1 | 1) & every
        down = rises & same
        up = (falls << 1 | ~(rises | same)) & every
    return out


def char_errors(pairs: DataFrame, reference: str, hypothesis: str, cut: int | None = None) -> DataFrame:
    """``pairs`` without the two texts and with ``cer``, white space collapsed, of whole texts or their first ``cut`` characters; null where either text is null."""
    names = [c for c in pairs.columns if c not in (reference, hypothesis)]
    pairs = pairs.select(*names, reference, hypothesis)

    def one(x: str | None, y: str | None) -> float | None:
        if x is None or y is None:
            return None
        a, b = (" ".join(t.split())[:cut] for t in (x, y))
        return distance(a, b) / len(a) if a else float(bool(b))

    def run(batches):
        for b in batches:
            *rest, x, y = b.columns
            out = [one(*xy) for xy in zip(x.to_pylist(), y.to_pylist())]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(out, pa.float64())], names=[*names, "cer"])

    return pairs.mapInArrow(run, StructType(pairs.schema.fields[:-2]).add("cer", "double"))


def wer(pairs: DataFrame, reference: str = "reference", hypothesis: str = "hypothesis") -> DataFrame:
    """``pairs`` with ``wer``: edit distance of lower-cased words over the reference's words; 0 for an empty reference."""

    names = pairs.columns
    at = [names.index(c) for c in (reference, hypothesis)]

    def run(batches):
        for b in batches:
            out = []
            for x, y in zip(*(b.column(i).to_pylist() for i in at)):
                a, c = (x or "").lower().split(), (y or "").lower().split()
                out.append(edits(a, c) / len(a) if a else 0.0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.float64())], names=[*names, "wer"])

    return pairs.mapInArrow(run, StructType(list(pairs.schema.fields)).add("wer", "double"))


def matched_boxes(gold: DataFrame, found: DataFrame, least: float = 0.5) -> DataFrame:
    """(doc_id, page, gold_ord, best_iou, hit): each gold box in its order takes the unused found box that overlaps it most.

    ``gold``: doc_id, page, gold_ord, box; ``found``: doc_id, page, box (structs x1, y1, x2, y2). One page at a time is in a task.
    """
    tag = lambda df, order, is_gold: df.select("doc_id", "page", F.lit(is_gold).alias("gold"), order.alias("o"), *(F.col("box")[k].alias(k) for k in ("x1", "y1", "x2", "y2")))
    both = tag(gold, F.col("gold_ord").cast("long"), True).union(tag(found, F.lit(0).cast("long"), False))

    def match(page):
        import pandas as pd

        want, have = page[page.gold].sort_values("o"), page[~page.gold]
        left = [tuple(x) for x in have[["x1", "y1", "x2", "y2"]].to_numpy()]
        out = []
        for o, *a in want[["o", "x1", "y1", "x2", "y2"]].itertuples(index=False):
            best, at = max(((overlap(a, b), -i) for i, b in enumerate(left) if b), default=(0.0, 0))
            if best >= least:
                left[-at] = None
            out.append((o, best, best >= least))
        key = page.iloc[0]
        return pd.DataFrame([(key.doc_id, key.page, *r) for r in out], columns=["doc_id", "page", "gold_ord", "best_iou", "hit"])

    kind = gold.schema["doc_id"].dataType.simpleString()
    return both.groupBy("doc_id", "page").applyInPandas(match, f"doc_id {kind}, page long, gold_ord long, best_iou double, hit boolean")


def overlap(a, b) -> float:
    """Intersection over union of two boxes (x1, y1, x2, y2)."""
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    inter = max(0.0, w) * max(0.0, h)
    return inter / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter + 1e-9)


def box_scores(matched: DataFrame, found: DataFrame, over_hits: bool = False) -> DataFrame:
    """(doc_id, tp, fp, fn, precision, recall, mean_iou) by document, and over all with a null doc_id.

    ``mean_iou`` is over all gold boxes, or over the hits alone.
    """
    gold = matched.rollup("doc_id").agg(F.count_if("hit").alias("tp"), F.count_if(~F.col("hit")).alias("fn"), F.avg(F.when(F.col("hit") if over_hits else F.lit(True), F.col("best_iou"))).alias("mean_iou"))
    n = found.rollup("doc_id").agg(F.count("*").alias("n_found"))
    j = gold.alias("g").join(n.alias("n"), F.col("g.doc_id").eqNullSafe(F.col("n.doc_id")), "full_outer")
    tp, fn, all_ = (F.coalesce(c, F.lit(0)) for c in ("tp", "fn", "n_found"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return j.select(F.coalesce("g.doc_id", "n.doc_id").alias("doc_id"), tp.alias("tp"), (all_ - tp).alias("fp"), fn.alias("fn"), F.round(ratio(tp, all_), 6).alias("precision"), F.round(ratio(tp, tp + fn), 6).alias("recall"), F.round(F.coalesce("mean_iou", F.lit(0.0)), 6).alias("mean_iou"))


_PAGE = re.compile(r"_p\d+$")


def reference_stem(name: str) -> str:
    """Name of a proofread page's document: without extension and page suffix."""
    return _PAGE.sub("", name.rsplit("/", 1)[-1].rsplit(".", 1)[0])
