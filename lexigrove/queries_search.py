"""Queries of the index, search and its evaluation over the driver's tables; conventions as in ``queries``."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexigrove.operators import contain, evaluate, index, search
from lexigrove.queries import _FOLD, _docs, _mush, _t, _tok, query
from lexigrove.sources.tables import place, version

_CHUNKS = f"SELECT doc_id AS chunk_ord, text, {_tok('text')} AS t FROM documents"


def _chunks(spark, d):
    return _docs(spark, d).select(F.col("doc_id").alias("chunk_ord"), "text")


_built: dict[tuple, str] = {}


def _index(spark, d, vectors=None):
    """The stored index of the documents, written once a session for each state of their files."""
    key = (spark.sparkContext.applicationId, *version(spark, f"{d}/documents.parquet"))
    if key not in _built:
        path = place(spark)
        index.put(_chunks(spark, d), path)
        _built[key] = path
    return index.opened(spark, _built[key], vectors)


def _asked(spark, d):
    return _t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


@query(f"WITH c AS ({_CHUNKS}), p AS (SELECT DISTINCT chunk_ord, unnest(t) AS term FROM c) SELECT term, count(*) AS df, round(ln(1 + ((SELECT count(*) FROM c) - count(*) + 0.5) / (count(*) + 0.5)), 6) AS idf FROM p GROUP BY term")
def term_df_idf(spark, d):
    c = _chunks(spark, d)
    return index.term_stats(index.postings(c), index.corpus_stats(index.doc_lengths(c))).withColumn("idf", F.round("idf", 6))


@query(f"WITH c AS ({_CHUNKS}) SELECT chunk_ord, len(t) AS dl FROM c")
def doc_lengths(spark, d):
    return index.doc_lengths(_chunks(spark, d))


# r: hits behind the strict gate in their order; rs: those behind the soft one
_LEX = f"""WITH c AS ({_CHUNKS}), s AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM c), p AS (SELECT chunk_ord, dl, term, count(*) AS tf FROM (SELECT chunk_ord, len(t) AS dl, unnest(t) AS term FROM c) GROUP BY ALL),
 df AS (SELECT term, count(*) AS df FROM p GROUP BY 1), q AS (SELECT item_id AS query_id, text, {_tok('text')} AS t FROM benchmark), qt AS (SELECT query_id, n_terms, term, count(*) AS qtf FROM (SELECT query_id, len(list_distinct(t)) AS n_terms, unnest(t) AS term FROM q) GROUP BY ALL),
 h AS (SELECT query_id, chunk_ord, n_terms, count(*) AS m, bool_or(regexp_matches(term, '\\p{{L}}') AND regexp_matches(term, '[0-9]')) AS code, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM qt JOIN p USING (term) JOIN df USING (term), s GROUP BY ALL),
 g AS (SELECT query_id, chunk_ord, code, CASE WHEN {_mush('c.text')} THEN score / 2 ELSE score END AS score, {_FOLD.replace('{c}', 'c.text')} AS f, CASE WHEN n_terms = 1 THEN m = 1 ELSE m >= 2 AND m / n_terms >= 0.5 END AS strict,
  CASE WHEN len(q.t) >= 3 AND length({_FOLD.replace('{c}', 'q.text')}) >= 20 THEN {_FOLD.replace('{c}', 'q.text')} END AS ph FROM h JOIN c USING (chunk_ord) JOIN q USING (query_id) WHERE code OR CASE WHEN n_terms = 1 THEN m = 1 ELSE m >= 2 AND m / n_terms >= 1 / 3 END),
 o AS (SELECT *, coalesce(contains(f, ph), false) AS has FROM g WHERE score > 0),
 rs AS (SELECT query_id, chunk_ord, score, code, strict, row_number() OVER (PARTITION BY query_id ORDER BY has DESC, CASE WHEN has THEN length(f) ELSE 0 END, round(score, 9) DESC, chunk_ord) AS rank FROM o),
 r AS (SELECT query_id, chunk_ord, score, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM rs WHERE strict)"""


@query(_LEX + " SELECT query_id, chunk_ord, round(score, 6) AS score, rank FROM r WHERE rank <= 3")
def lexical_topk(spark, d):
    hits = search.search(_index(spark, d), _asked(spark, d))
    return hits.select("query_id", "chunk_ord", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(_LEX + " SELECT query_id, count(*) AS soft, count(*) FILTER (strict) AS strict, bool_or(code) AS code FROM rs GROUP BY 1")
def cover_gates(spark, d):
    hits = search.scored_hits(_index(spark, d), _asked(spark, d))
    return hits.groupBy("query_id").agg(F.count("*").alias("soft"), F.count_if("strict").alias("strict"), F.max("code").alias("code"))


@query(_LEX + " SELECT query_id, chunk_ord, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM r WHERE score >= 20 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 3")
def min_score_gate(spark, d):
    hits = search.search(_index(spark, d), _asked(spark, d), min_score=20.0)
    return hits.select("query_id", "chunk_ord", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


_DENSE = """dn AS (SELECT query_id, chunk_ord, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_ord) AS rank FROM
 (SELECT a.vec_id AS query_id, b.vec_id AS chunk_ord, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score FROM embeddings a, embeddings b WHERE {w}))"""


@query("WITH " + _DENSE.replace("{w}", "a.vec_id % 50 = 0") + " SELECT query_id, chunk_ord, round(score, 6) AS score, rank FROM dn WHERE rank <= 3")
def dense_topk(spark, d):
    e = _t(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_ord"), F.col("embedding").alias("vector"))
    q = e.where("chunk_ord % 50 = 0").select(F.col("chunk_ord").alias("query_id"), "vector")
    return search.dense(e, q).select("query_id", "chunk_ord", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def _vectors(spark, d):
    e = _t(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_ord"), F.col("embedding").alias("vector"))
    return e, _asked(spark, d).join(e.withColumnRenamed("chunk_ord", "query_id"), "query_id", "left")


_DN = ", " + _DENSE.replace("{w}", "a.vec_id IN (SELECT item_id FROM benchmark)")
_FUSED = """, j AS (SELECT query_id, chunk_ord, coalesce({b} / (10 + a.rank), 0) + coalesce({v} / (10 + b.rank), 0) AS score, a.rank AS lr, b.rank AS dr
 FROM (FROM rs WHERE rank <= 50) a FULL JOIN (FROM dn WHERE rank <= 50) b USING (query_id, chunk_ord)), fu AS (SELECT query_id, chunk_ord, score, CASE WHEN lr IS NULL THEN 'dense' WHEN dr IS NULL THEN 'lexical' ELSE 'hybrid' END AS method,
 row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, lr NULLS LAST, chunk_ord) AS rank FROM j)"""
_HYBRID = _LEX + _DN + _FUSED


def _rounded(hits):
    return hits.select("query_id", "chunk_ord", F.round("score", 6).alias("score"), "method", F.col("rank").cast("long").alias("rank"))


@query(_HYBRID.replace("{b}", "1").replace("{v}", "1") + " SELECT query_id, chunk_ord, round(score, 6) AS score, method, rank FROM fu WHERE rank <= 3")
def rrf_fusion(spark, d):
    e, q = _vectors(spark, d)
    lex = search.lexical(_index(spark, d), _asked(spark, d), strict=False)
    return _rounded(search.fuse(lex, search.dense(e, q.select("query_id", "vector"), 50)))


def _heavy(spark, d, mode):
    e, q = _vectors(spark, d)
    return _rounded(search.search(_index(spark, d, e), q, mode))


@query(_HYBRID.replace("{b}", "3").replace("{v}", "1") + " SELECT query_id, chunk_ord, round(score, 6) AS score, method, rank FROM fu WHERE rank <= 3")
def hybrid_bm25_heavy(spark, d):
    return _heavy(spark, d, "hybrid_bm25_heavy")


@query(_HYBRID.replace("{b}", "1").replace("{v}", "3") + " SELECT query_id, chunk_ord, round(score, 6) AS score, method, rank FROM fu WHERE rank <= 3")
def hybrid_dense_heavy(spark, d):
    return _heavy(spark, d, "hybrid_dense_heavy")


@query(_HYBRID.replace("{b}", "1").replace("{v}", "1") + """, x AS (SELECT q.query_id, coalesce((SELECT max(score) FROM r WHERE r.query_id = q.query_id AND rank = 1), 0) AS top, coalesce((SELECT max(score) FROM rs WHERE rs.query_id = q.query_id AND rank = 1), 0) AS soft_top,
 coalesce((SELECT bool_or(code) FROM rs WHERE rs.query_id = q.query_id), false) AS code FROM q), y AS (SELECT query_id, CASE WHEN top >= 10 THEN 'lexical' WHEN greatest(top, soft_top) < 5 AND NOT code THEN 'dense' ELSE 'hybrid' END AS branch FROM x)
 SELECT query_id, chunk_ord, round(score, 6) AS score, 'lexical' AS method, rank FROM r JOIN y USING (query_id) WHERE branch = 'lexical' AND rank <= 3 UNION ALL SELECT query_id, chunk_ord, round(score, 6), 'dense', rank FROM dn JOIN y USING (query_id) WHERE branch = 'dense' AND rank <= 3
 UNION ALL SELECT query_id, chunk_ord, round(score, 6), method, rank FROM fu JOIN y USING (query_id) WHERE branch = 'hybrid' AND rank <= 3""")
def hybrid_adaptive(spark, d):
    return _heavy(spark, d, "hybrid")


@query("SELECT item_id AS query_id, doc_id AS chunk_ord FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def passages_contained(spark, d):
    return contain.containing(_chunks(spark, d), _asked(spark, d))


@query(_LEX + """, gold AS (SELECT item_id AS query_id, doc_id AS chunk_ord FROM benchmark b JOIN documents d ON contains(d.text, b.text)), f AS (SELECT query_id, min(rank) AS r FROM r JOIN gold USING (query_id, chunk_ord) WHERE rank <= 5 GROUP BY 1),
 x AS (SELECT q.query_id, r, (SELECT count(*) FROM r WHERE r.query_id = q.query_id AND rank <= 5) AS shown, q.query_id NOT IN (SELECT query_id FROM gold) AS absent FROM q LEFT JOIN f USING (query_id))
 SELECT count(*) AS questions, round(avg(CASE WHEN absent THEN (shown = 0)::INT ELSE coalesce((r <= 1)::INT, 0) END), 6) AS recall_1, round(avg(CASE WHEN absent THEN (shown = 0)::INT ELSE coalesce((r <= 3)::INT, 0) END), 6) AS recall_3,
 round(avg(CASE WHEN absent THEN (shown = 0)::INT ELSE coalesce((r <= 5)::INT, 0) END), 6) AS recall_5, round(avg(CASE WHEN absent THEN (shown = 0)::INT ELSE coalesce(1 / r, 0) END), 6) AS mrr,
 round(avg(CASE WHEN absent THEN (shown = 0)::INT ELSE coalesce((r <= 5)::INT / 5, 0) END), 6) AS precision_5, round(avg(CASE WHEN absent THEN (shown = 0)::INT ELSE coalesce(1 / log2(r + 1), 0) END), 6) AS ndcg_5,
 round(avg(CASE WHEN absent THEN shown ELSE shown - coalesce((r <= 5)::INT, 0) END), 6) AS junk_5 FROM x""")
def recall_mrr_ndcg(spark, d):
    q = _asked(spark, d)
    hits = search.search(_index(spark, d), q, top_k=5)
    gold = contain.containing(_chunks(spark, d), q)
    absent = q.select("query_id").join(gold.select("query_id"), "query_id", "left_anti")
    return evaluate.metrics(q, hits, hits.join(gold, ["query_id", "chunk_ord"]).select("query_id", "rank"), absent)


@query()
def probe_recall(spark, d):
    """Each probe sentence looks for its own document: lines of documents as chunks, by the library's self-recall probe."""
    c = _chunks(spark, d).withColumn("doc_id", F.col("chunk_ord")).withColumn("clause_id", F.lit(None).cast("string")).withColumn("page_start", F.lit(1)).withColumn("page_end", F.lit(1))
    asked = evaluate.probes(c, limit=50)
    hits = search.search(_index(spark, d), asked.select("query_id", "query"), top_k=5)
    return evaluate.probe_recall(hits, asked, c)
