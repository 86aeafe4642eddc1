"""Queries over the driver's tables, each with its SQL where SQL can express it.

Conventions of these queries, not of the library: a document is a page and a chunk (doc_id is its number), its source is
the collection; class A for English and B otherwise; status ok unless its label says quality 0; benchmark passages are
search queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexigrove import samples
from lexigrove.config import STOP_WORDS, TOKEN
from lexigrove.functions import text as T

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _docs(spark, d):
    return _t(spark, d, "documents")


def _texts(spark, d):
    """Documents, and our own small texts with what they lack."""
    own = spark.createDataFrame(samples.TEXTS, "doc_id long, text string")
    return _docs(spark, d).select("doc_id", "text").union(own)


_quoted = lambda t: "'" + t.replace("'", "''") + "'"
_TEXTS = "(SELECT doc_id, text FROM documents UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, {_quoted(t)})" for i, t in samples.TEXTS) + ") v(doc_id, text))"
_STOP = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"
_FOLD = "trim(regexp_replace(replace(lower({c}), 'ё', 'е'), '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))"
_TOK = f"list_filter(regexp_extract_all({_FOLD}, '{TOKEN}'), lambda t: NOT list_contains({_STOP}, t))"
_LINES = "list_filter(list_transform(regexp_split_to_array({c}, '\\n'), lambda x: trim(x, chr(32) || chr(9) || chr(10) || chr(13))), lambda x: x <> '')"
_tok = lambda c: _TOK.replace("{c}", c)
_lines = lambda c: _LINES.replace("{c}", c)


@query(f"SELECT doc_id, sha256(trim(regexp_replace(text, '[ \\t]+', ' ', 'g'), chr(32) || chr(9) || chr(10) || chr(13))) AS h FROM (SELECT doc_id, regexp_replace(replace(text, chr(160), ' '), '[ \\t]+\\n', chr(10), 'g') AS text FROM {_TEXTS})")
def normalize_whitespace(spark, d):
    return _texts(spark, d).select("doc_id", F.sha2(T.normalize_whitespace(F.col("text")), 256).alias("h"))


@query(f"SELECT doc_id, sha256({_FOLD.replace('{c}', 'text')}) AS h FROM {_TEXTS}")
def folded_text(spark, d):
    return _texts(spark, d).select("doc_id", F.sha2(T.folded(F.col("text")), 256).alias("h"))


@query(f"SELECT doc_id, sha256(regexp_replace(replace(text, chr(173), ''), '([A-Za-zА-Яа-яЁё])[ \\t]*-[ \\t]*\\n[ \\t]*([A-Za-zА-Яа-яЁё])', '\\1\\2', 'g')) AS h FROM {_TEXTS}")
def join_hyphens(spark, d):
    return _texts(spark, d).select("doc_id", F.sha2(T.join_hyphens(F.col("text")), 256).alias("h"))


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def sha_of_text(spark, d):
    return _docs(spark, d).select("doc_id", F.sha2("text", 256).alias("sha256"))


@query(f"SELECT doc_id, array_to_string({_tok('text')}, ' ') AS terms FROM documents")
def tokenize_terms(spark, d):
    return _docs(spark, d).select("doc_id", F.array_join(T.tokens(F.col("text")), " ").alias("terms"))


@query("SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+(?:\\.[0-9]+)+')) AS clause_id FROM documents")
def clause_ids_in_text(spark, d):
    return _docs(spark, d).select("doc_id", F.explode(T.clause_ids(F.col("text"))).alias("clause_id"))


@query(f"SELECT doc_id, len(l) AS n_lines, len(l) >= 6 AND len(list_filter(l, lambda x: regexp_matches(x, '\\.{{4,}}|…{{2,}}'))) >= greatest(4, 0.4 * len(l)) AS toc FROM (SELECT doc_id, {_lines('text')} AS l FROM {_TEXTS})")
def toc_pages(spark, d):
    return _texts(spark, d).select("doc_id", F.size(T.lines(F.col("text"))).cast("long").alias("n_lines"), T.is_toc(F.col("text")).alias("toc"))


_MUSH = """(len({l}) >= 4 AND (len(list_filter({l}, lambda x: length(x) < 20)) / len({l}) > 0.5 OR len(list_filter({l}, lambda x: length(x) < 5)) / len({l}) > 0.3
 OR (length({c}) >= 200 AND len(regexp_extract_all({c}, '[.,;]')) * 1000 / length({c}) < 2)))"""
_mush = lambda c: _MUSH.replace("{l}", _lines(c)).replace("{c}", c)


@query(f"SELECT doc_id, {_mush('text')} AS mush FROM {_TEXTS}")
def mush_flags(spark, d):
    return _texts(spark, d).select("doc_id", T.is_mush(F.col("text")).alias("mush"))


_HTML = f"(SELECT page_id AS doc_id, html AS text FROM pages UNION ALL FROM {_TEXTS})"


def _markup(spark, d):
    return _t(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text")).union(_texts(spark, d))


_XML = "(len(list_filter(regexp_extract_all(text, '</?([A-Za-z][A-Za-z0-9]*)[^>]*>', 1), lambda x: length(x) >= 4)) > 0 AND len(regexp_extract_all(text, '[А-Яа-яЁё]{5,}')) < 4)"


@query(f"SELECT doc_id, {_XML} AS xml, count(*) AS n FROM {_HTML} GROUP BY ALL")
def xml_fragments(spark, d):
    return _markup(spark, d).groupBy("doc_id", T.is_xml_fragment(F.col("text")).alias("xml")).agg(F.count("*").alias("n"))


_EQ = f"""list_filter({_lines('text')}, lambda x: NOT regexp_matches(regexp_replace(x, 'https?://[^ \\t\\n\\r]+', ' ', 'g'), '[А-Яа-яЁё]{{5,}}|[A-Za-z]{{12,}}')
 AND regexp_matches(regexp_replace(x, 'https?://[^ \\t\\n\\r]+', ' ', 'g'), '[=∫∑∏√∂≤≥≠≈]') AND length(regexp_replace(regexp_replace(x, 'https?://[^ \\t\\n\\r]+', ' ', 'g'), '[ \\t]+', '', 'g')) >= 10
 AND len(regexp_extract_all(regexp_replace(regexp_replace(x, 'https?://[^ \\t\\n\\r]+', ' ', 'g'), '[ \\t]+', '', 'g'), '[0-9=∫∑∏√∂≤≥≠≈+*/^\\[\\](){{}}-]')) / length(regexp_replace(regexp_replace(x, 'https?://[^ \\t\\n\\r]+', ' ', 'g'), '[ \\t]+', '', 'g')) >= 0.35)"""


@query(f"SELECT doc_id, len({_EQ}) AS n FROM {_TEXTS}")
def equation_lines(spark, d):
    return _texts(spark, d).select("doc_id", F.size(T.equation_lines(F.col("text"))).cast("long").alias("n"))


_FORMULA = f"(len({_EQ}) > 0 AND list_sum(list_transform({_EQ}, lambda x: length(x))) >= 0.6 * length(text))"


@query(f"SELECT doc_id, coalesce({_FORMULA}, false) AS formula FROM {_TEXTS}")
def formula_chunks(spark, d):
    return _texts(spark, d).select("doc_id", T.is_formula_chunk(F.col("text")).alias("formula"))


@query(f"""SELECT doc_id, {_XML} OR coalesce({_FORMULA}, false)
 OR (n >= 20 AND (letters = 0 OR (n - letters - digits) / n > 0.5 OR tags >= 2 OR (regexp_matches(text, 'https?://[^ \\t\\n\\r]+') AND len(regexp_extract_all(regexp_replace(text, 'https?://[^ \\t\\n\\r]+', ' ', 'g'), '\\p{{L}}')) < 40))) AS garbage, count(*) AS times
 FROM (SELECT doc_id, text, length(c) AS n, len(regexp_extract_all(c, '\\p{{L}}')) AS letters, len(regexp_extract_all(c, '[0-9]')) AS digits, len(regexp_extract_all(text, '</?[A-Za-z][A-Za-z0-9_:.-]*[^>]*>')) AS tags
  FROM (SELECT doc_id, text, regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', '', 'g') AS c FROM {_HTML})) GROUP BY ALL""")
def garbage_flags(spark, d):
    return _markup(spark, d).groupBy("doc_id", T.is_garbage(F.col("text")).alias("garbage")).agg(F.count("*").alias("times"))


@query(f"SELECT t AS term, count(*) AS n FROM (SELECT unnest({_tok('text')}) AS t FROM documents) WHERE regexp_matches(t, '\\p{{L}}') AND regexp_matches(t, '[0-9]') GROUP BY t")
def code_tokens(spark, d):
    t = _docs(spark, d).select(F.explode(T.tokens(F.col("text"))).alias("term"))
    return t.where(T.is_code_token(F.col("term"))).groupBy("term").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest({_lines('text')}) AS x FROM {_TEXTS}) WHERE regexp_matches(lower(x), '^(?:[0-9]{{1,4}}|страница[ \\t]+[0-9]+[ \\t]+из[ \\t]+[0-9]+|стр\\.?[ \\t]*[ivxlcdm0-9]+|[0-9]+[ \\t]*[-–—][ \\t]*[0-9]+)$') GROUP BY doc_id")
def furniture_lines(spark, d):
    t = _texts(spark, d).select("doc_id", F.explode(T.lines(F.col("text"))).alias("x"))
    return t.where(T.is_furniture(F.col("x"))).groupBy("doc_id").agg(F.count("*").alias("n"))


@query(f"SELECT own, hint, count(*) AS n FROM (SELECT doc_id < 0 AS own, CASE WHEN c + l = 0 THEN 'unknown' WHEN c / (c + l) >= 0.6 THEN 'ru' WHEN c / (c + l) <= 0.2 THEN 'en' ELSE 'mixed' END AS hint FROM (SELECT doc_id, len(regexp_extract_all(text, '[Ѐ-ӿ]')) AS c, len(regexp_extract_all(text, '[A-Za-z]')) AS l FROM {_TEXTS})) GROUP BY ALL")
def lang_hint_summary(spark, d):
    return _texts(spark, d).groupBy((F.col("doc_id") < 0).alias("own"), T.lang_hint(F.col("text")).alias("hint")).agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, round(len(regexp_extract_all(text, '[Ѐ-ӿ]')) / n, 6) AS cyr, round(len(regexp_extract_all(text, '[A-Za-z]')) / n, 6) AS lat, round(len(regexp_extract_all(text, '[Ͱ-Ͽ]')) / n, 6) AS greek FROM (SELECT doc_id, text, greatest(len(regexp_extract_all(text, '\\p{{L}}')), 1) AS n FROM {_TEXTS})")
def script_shares(spark, d):
    s = T.script_shares(F.col("text"))
    return _texts(spark, d).select("doc_id", *(F.round(s[k], 6).alias(k) for k in ("cyr", "lat", "greek")))


def _pages(spark, d):
    lab = _t(spark, d, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    p = _docs(spark, d).join(lab, "doc_id", "left")
    reason = T.reject_reason(F.when(F.col("lang") == "en", "A").otherwise("B"), F.when(F.col("quality") == 0, "suspicious").otherwise("ok"), F.lit(False), F.col("text"))
    return p.withColumn("reason", reason)


_REASON = f"""SELECT d.doc_id, d.source, d.lang, d.text, CASE WHEN q = 0 THEN 'status' WHEN length(trim(text, chr(32) || chr(9) || chr(10) || chr(13))) < 40 THEN 'short'
 WHEN len({_lines('text')}) >= 6 AND len(list_filter({_lines('text')}, lambda x: regexp_matches(x, '\\.{{4,}}|…{{2,}}'))) >= greatest(4, 0.4 * len({_lines('text')})) THEN 'toc' END AS reason
 FROM documents d LEFT JOIN (SELECT doc_id, min(quality) AS q FROM labels GROUP BY 1) l USING (doc_id)"""


@query(f"SELECT coalesce(reason, 'admitted') AS reason, count(*) AS n FROM ({_REASON}) GROUP BY 1")
def admission_reasons(spark, d):
    return _pages(spark, d).groupBy(F.coalesce("reason", F.lit("admitted")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"SELECT count(*) AS pages_seen, count(*) FILTER (reason = 'status') AS skipped_status, count(*) FILTER (reason = 'short') AS skipped_empty, count(*) FILTER (reason IS NULL) AS admitted, count(DISTINCT source) FILTER (reason IS NULL) AS documents FROM ({_REASON})")
def build_report(spark, d):
    n = lambda c: F.count_if(c)
    r = F.col("reason")
    return _pages(spark, d).agg(F.count("*").alias("pages_seen"), n(r == "status").alias("skipped_status"), n(r == "short").alias("skipped_empty"), n(r.isNull()).alias("admitted"), F.countDistinct(F.when(r.isNull(), F.col("source"))).alias("documents"))


@query(f"SELECT d.doc_id FROM documents d WHERE d.doc_id NOT IN (SELECT doc_id FROM ({_REASON}) WHERE reason IS NULL)")
def seen_minus_admitted(spark, d):
    return _docs(spark, d).select("doc_id").join(_pages(spark, d).where(F.col("reason").isNull()).select("doc_id"), "doc_id", "left_anti")


@query("SELECT source, lang, count(*) AS n, sum(length(text))::BIGINT AS chars FROM documents GROUP BY ROLLUP (source, lang)")
def class_summary_rollup(spark, d):
    return _docs(spark, d).rollup("source", "lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("SELECT source, median(length(text)) AS median_chars, round(avg(length(text)), 4) AS mean_chars, min(length(text)) AS least, max(length(text)) AS most FROM documents GROUP BY source")
def median_chars_by_source(spark, d):
    n = F.length("text")
    return _docs(spark, d).groupBy("source").agg(F.median(n).alias("median_chars"), F.round(F.avg(n), 4).alias("mean_chars"), F.min(n).cast("long").alias("least"), F.max(n).cast("long").alias("most"))


@query("SELECT source, count(*) AS n, count(*) FILTER (regexp_matches(text, '</?[A-Za-z][A-Za-z0-9_:.-]*[^>]*>')) AS xml, count(*) FILTER (regexp_matches(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]')) AS control FROM documents GROUP BY source")
def audit_by_source(spark, d):
    c = F.col("text")
    return _docs(spark, d).groupBy("source").agg(F.count("*").alias("n"), F.count_if(c.rlike("</?[A-Za-z][A-Za-z0-9_:.-]*[^>]*>")).alias("xml"), F.count_if(c.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]")).alias("control"))


@query("SELECT quality, lang, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY ALL")
def labels_join(spark, d):
    return _docs(spark, d).select("doc_id", "lang").join(_t(spark, d, "labels"), "doc_id").groupBy("quality", "lang").agg(F.count("*").alias("n"))


@query("SELECT sha256(text) AS sha256, min(doc_id) AS doc_id FROM documents GROUP BY 1 HAVING sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0)")
def cache_missing_anti(spark, d):
    h = _docs(spark, d).select(F.sha2("text", 256).alias("sha256"), "doc_id")
    return h.groupBy("sha256").agg(F.min("doc_id").alias("doc_id")).join(h.where("doc_id % 3 = 0").select("sha256"), "sha256", "left_anti")


@query("SELECT source, doc_id, rn FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rn FROM documents) WHERE rn <= 8")
def top8_per_source(spark, d):
    w = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    return _docs(spark, d).select("source", "doc_id", F.row_number().over(w).cast("long").alias("rn")).where("rn <= 8")


@query("SELECT o_orderkey, unnest(range(lo, lo + 3)) AS page FROM (SELECT o_orderkey, o_orderkey % 7 + 1 AS lo FROM orders)")
def page_range_explode(spark, d):
    lo = F.col("o_orderkey") % 7 + 1
    return _t(spark, d, "orders").select("o_orderkey", F.explode(F.sequence(lo, lo + 2)).alias("page"))


from lexigrove import queries_ink, queries_more, queries_pages, queries_search  # noqa: E402, F401 - they add their queries
