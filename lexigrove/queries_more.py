"""Queries of clauses, formulas, text quality, audits and sources over the driver's tables and our own small texts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexigrove.functions import boxes
from lexigrove.functions import formulas as M
from lexigrove.functions import quality
from lexigrove.functions import text as T
from lexigrove.functions.tally import word_counts
from lexigrove.operators import audits, chunks, evaluate, references
from lexigrove.queries import _TEXTS, _docs, _lines, _t, _texts, query
from lexigrove.sources import pages as sources
from lexigrove.sources.tables import place
from lexigrove.streaming import clauses

_LINE = f"(SELECT doc_id, i AS line_no, l[i] AS line, l[i + 1] AS following FROM (SELECT doc_id, {_lines('text')} AS l FROM {_TEXTS}), LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i))"


def _line_rows(spark, d):
    t = _texts(spark, d).select("doc_id", T.lines(F.col("text")).alias("l"))
    t = t.select("doc_id", "l", F.posexplode("l").alias("i", "line"))
    return t.select("doc_id", (F.col("i") + 1).cast("long").alias("line_no"), "line", F.get("l", F.col("i") + 1).alias("following"))


_H = "'^(?:(глава|раздел|подраздел|пункт|статья|section|chapter|п)\\.?[ \\t]+)?([0-9]+(?:\\.[0-9]+)*)(\\.)?[ \\t]*(.*)$'"
_HEAD = f"""SELECT *, CASE WHEN regexp_matches(line, '^[0-9]{{1,3}}\\.$') THEN CASE WHEN len(regexp_extract_all(coalesce(following, ''), '[A-Za-zА-Яа-яЁё]')) >= 4 THEN replace(line, '.', '') END
 WHEN num <> '' AND NOT regexp_matches(line, '\\.{{4,}}|…{{2,}}') AND NOT regexp_matches(title, '^[0-9]{{2,4}}$') AND num[1] <> '0'
  AND (contains(num, '.') OR prefix <> '' OR (len(regexp_extract_all(title, '[A-Za-zА-Яа-яЁё]')) >= 4 AND regexp_matches(title, '^\\p{{Lu}}') AND length(num) <= 3 AND try_cast(num AS INT) <= 400))
  AND NOT (contains(num, '.') AND prefix = '' AND title = '' AND len(list_filter(string_split(num, '.'), lambda x: length(x) > 4)) > 0) THEN num END AS heading
 FROM (SELECT *, regexp_extract(line, {_H}, 1, 'i') AS prefix, regexp_extract(line, {_H}, 2, 'i') AS num, trim(regexp_extract(line, {_H}, 4, 'i'), chr(32) || chr(9)) AS title FROM {_LINE})"""


@query(f"SELECT doc_id, line_no, heading FROM ({_HEAD}) WHERE heading IS NOT NULL")
def heading_numbers(spark, d):
    rows = _line_rows(spark, d)
    return rows.select("doc_id", "line_no", chunks.heading_number(F.col("line"), F.col("following")).alias("heading")).where("heading IS NOT NULL")


_PAGES = f"(SELECT CASE WHEN doc_id < 0 THEN 'own' ELSE 'd' || (doc_id // 4) END AS doc, CASE WHEN doc_id < 0 THEN -doc_id ELSE doc_id % 4 END AS page, text FROM {_TEXTS})"
_KEPT = f"""(SELECT doc, page, i AS line_no, l[i] AS line FROM (SELECT doc, page, list_filter(list_transform(string_split(regexp_replace(replace(text, chr(173), ''), '([A-Za-zА-Яа-яЁё])[ \\t]*-[ \\t]*\\n[ \\t]*([A-Za-zА-Яа-яЁё])', '\\1\\2', 'g'), chr(10)),
 lambda x: trim(regexp_replace(x, '[ \\t]+', ' ', 'g'))), lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(?:[0-9]{{1,4}}|страница[ \\t]+[0-9]+[ \\t]+из[ \\t]+[0-9]+|стр\\.?[ \\t]*[ivxlcdm0-9]+|[0-9]+[ \\t]*[-–—][ \\t]*[0-9]+)$')) AS l FROM {_PAGES}), LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i))"""
_SESSIONS = f"""SELECT doc, page, line_no, sum((heading IS NOT NULL OR gap)::INT) OVER (PARTITION BY doc ORDER BY page, line_no)::BIGINT AS group_no, heading, length(line) AS size FROM (SELECT doc, page, line_no, line, coalesce(page > before + 1, true) AS gap, heading FROM ({
    _HEAD.replace(_LINE, "(SELECT *, doc AS doc_id, lead(line) OVER (PARTITION BY doc ORDER BY page, line_no) AS following, lag(page) OVER (PARTITION BY doc ORDER BY page, line_no) AS before FROM " + _KEPT + ")")
}))"""


def _page_rows(spark, d):
    """Four documents with ids in a row are the pages of one document; our own texts are those of another."""
    i = F.col("doc_id")
    return _texts(spark, d).select(F.when(i < 0, "own").otherwise(F.concat(F.lit("d"), F.floor(i / 4).cast("string"))).alias("doc_id"), F.when(i < 0, -i).otherwise(i % 4).alias("page"), F.lit("A").alias("page_class"), "text")


@query(f"SELECT doc AS doc_id, group_no, max(heading) AS clause_id, count(*) AS lines, min(page) AS first_page, max(page) AS last_page, sum(size)::BIGINT AS chars FROM ({_SESSIONS}) GROUP BY ALL")
def clause_sessions(spark, d):
    s = chunks.sessions(chunks.page_lines(_page_rows(spark, d)))
    return s.groupBy("doc_id", F.col("group_no").cast("long").alias("group_no")).agg(F.max("clause_id").alias("clause_id"), F.count("*").alias("lines"), F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.sum(F.length("line")).cast("long").alias("chars"))


@query("""SELECT count(*) AS "references", count(*) AS matched, count(*) FILTER (quality = 0) AS candidates, count(*) FILTER (doc_id % 3 = 0) AS drafts, count(*) FILTER (length(text) < 200) AS short, count(*) FILTER (contains(text, '=')) AS with_formulas, count(*) FILTER (c > l) AS ru, count(*) FILTER (l > c) AS en, count(*) FILTER (l = c) AS mixed,
 round(avg(CASE WHEN trim(text) = '' THEN 1.0 ELSE len(regexp_extract_all(t, 'e')) / length(t) END), 6) AS mean_cer FROM (SELECT *, len(regexp_extract_all(text, '[A-Za-z]')) AS l, len(regexp_extract_all(text, '[А-Яа-яЁё]')) AS c, substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 12000) AS t FROM documents LEFT JOIN labels USING (doc_id))""")
def reference_summary(spark, d):
    """Every document as a proofread page of its source, and as a text layer that reads each e as c; labels of poor quality as candidates. Compares as much as its SQL does."""
    docs = _docs(spark, d).join(_t(spark, d, "labels"), "doc_id", "left")
    source = F.concat(F.lit("collection "), F.col("source"))
    page = F.col("doc_id").cast("int")
    read = docs.select(source.alias("name"), page.alias("page"), (page % 3 == 0).alias("draft"), "text", F.when(F.contains("text", F.lit("=")), F.array(F.lit("="))).alias("formulas"))
    pages = docs.select(source.alias("doc_id"), page.alias("page"), F.replace("text", F.lit("e"), F.lit("c")).alias("text"))
    return references.summary(references.report(read, pages, docs.where("quality = 0").select(source.alias("doc_id"), page.alias("page"), F.lit("high").alias("priority")), compared=12_000))


@query(f"SELECT doc AS doc_id, group_no, max(heading) AS clause_id, count(*) AS lines, min(page)::INT AS first_page, max(page)::INT AS last_page, sum(size)::BIGINT AS chars FROM ({_SESSIONS}) WHERE doc <> 'own' GROUP BY ALL")
def clause_session_stream(spark, d):
    """The same groups found by the stateful operator, from a stream that brings each document's pages in two batches."""
    home, pages = place(spark), _page_rows(spark, d).where("doc_id <> 'own'")
    pages = pages.select("doc_id", F.col("page").cast("int").alias("page"), "page_class", "text")
    documents = pages.select("doc_id").distinct()
    for batch, part in enumerate(("page < 2", "page >= 2")):
        pages.where(part).write.mode("append").parquet(f"{home}/in")
        documents.where(F.lit(batch == 1)).write.mode("append").parquet(f"{home}/whole")
        stream = clauses.session_stream(spark.readStream.schema(pages.schema).parquet(f"{home}/in"), spark.readStream.schema(documents.schema).parquet(f"{home}/whole"))
        run = stream.writeStream.format("parquet").option("path", f"{home}/out").option("checkpointLocation", f"{home}/state").trigger(availableNow=True).start()
        clauses.finished(spark, run, f"{home}/state", batch)
    s = spark.read.schema(clauses.OUT).parquet(f"{home}/out")
    return s.groupBy("doc_id", "group_no").agg(F.max("clause_id").alias("clause_id"), F.count("*").alias("lines"), F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.sum(F.length("line")).cast("long").alias("chars"))


@query(f"""WITH RECURSIVE s AS (SELECT doc, group_no, row_number() OVER (PARTITION BY doc, group_no ORDER BY page, line_no) AS k, size FROM ({_SESSIONS})),
 w AS (SELECT doc, group_no, k, size AS filled, 1 AS part FROM s WHERE k = 1 UNION ALL SELECT s.doc, s.group_no, s.k, CASE WHEN filled + 1 + size > 1800 THEN size ELSE filled + 1 + size END, CASE WHEN filled + 1 + size > 1800 THEN part + 1 ELSE part END
  FROM w JOIN s ON s.doc = w.doc AND s.group_no = w.group_no AND s.k = w.k + 1)
 SELECT doc AS doc_id, group_no, max(part) AS parts FROM w GROUP BY ALL""")
def clause_parts(spark, d):
    """Parts that a clause is packed into, before short ones are dropped: greedy filling up to 1,800 characters."""
    s = chunks.sessions(chunks.page_lines(_page_rows(spark, d)))
    order = F.array_sort(F.collect_list(F.struct("page", "line_no", F.length("line").alias("size"))))
    step = F.expr("aggregate(o, named_struct('filled', -1, 'part', 1), (a, x) -> if(a.filled + 1 + x.size > 1800 and a.filled >= 0, named_struct('filled', x.size, 'part', a.part + 1), named_struct('filled', a.filled + 1 + x.size, 'part', a.part)))")
    g = s.groupBy("doc_id", F.col("group_no").cast("long").alias("group_no")).agg(order.alias("o"))  # sizes of one clause's lines
    return g.select("doc_id", "group_no", step["part"].cast("int").alias("parts"))


@query()
def clause_chunks(spark, d):
    """Chunks of all pages, by digest; tests hold them against a plain loop."""
    return chunks.chunk_documents(_page_rows(spark, d)).select("chunk_id", "doc_id", "page_start", "page_end", "clause_id", "part", "parts", F.sha2("text", 256).alias("sha256"))


_MARKS = "[=+−×÷\\^_√∫∑∏∂∇∞±≤≥≠≈-]"
_SLASHES = "len(list_filter(range(2, length({c})), lambda i: substr({c}, i, 1) = '/' AND regexp_matches(substr({c}, i - 1, 1), '[\\p{{L}}\\p{{N}}_)]') AND regexp_matches(substr({c}, i + 1, 1), '[\\p{{L}}\\p{{N}}_(]')))".replace("{c}", "line").replace("{{", "{").replace("}}", "}")
_MARKERS = f"len(regexp_extract_all(line, '{_MARKS}')) + len(regexp_extract_all(line, '=')) + len(regexp_extract_all(line, '[Ͱ-Ͽἀ-῿℀-⅏]')) + len(regexp_extract_all(line, '\\\\[a-zA-Z]+')) + {_SLASHES}"


@query(f"SELECT doc_id, line_no, n FROM (SELECT doc_id, line_no, {_MARKERS} AS n FROM {_LINE}) WHERE n > 0")
def formula_marker_count(spark, d):
    return _line_rows(spark, d).select("doc_id", "line_no", M.marker_count(F.col("line")).cast("long").alias("n")).where("n > 0")


_SIGNS = "[=+×÷·±≠≈≤≥<>∑∫∏√∞∂∇αβγδθλμπσφω\\^_{}\\\\/|()\\[\\]0-9-]"
_STRONG = "=|\\\\frac|\\\\sum|\\\\int|\\\\sqrt|[Σ∑∫√∞±≤≥≠≈]|[A-Za-zА-Яа-яЁё][ \\t]*[\\^_][ \\t]*[A-Za-zА-Яа-яЁё0-9]"


@query(f"""SELECT doc_id, line_no, round(score, 6) AS score FROM (SELECT doc_id, line_no, CASE WHEN length(line) < 2 OR length(line) > 240 OR l + s = 0 OR (NOT strong AND (w >= 3 OR length(line) > 40)) THEN 0.0
 WHEN strong AND s / (l + s) >= 0.20 THEN least(1.0, 0.55 + 0.45 * s / (l + s)) WHEN regexp_matches(line, '\\\\(?:frac|sum|int|sqrt|left|right|mathrm|text)|[Σ∑∫√∞±≤≥≠≈=^_]') AND s / (l + s) >= 0.55 AND w <= 3 THEN least(1.0, s / (l + s)) ELSE 0.0 END AS score
 FROM (SELECT *, len(regexp_extract_all(line, '\\p{{L}}')) AS l, len(regexp_extract_all(line, '{_SIGNS}')) AS s, len(regexp_extract_all(line, '[A-Za-zА-Яа-яЁё]{{2,}}')) AS w, regexp_matches(line, '{_STRONG}') AS strong FROM {_LINE})) WHERE score > 0""")
def math_line_score(spark, d):
    return _line_rows(spark, d).select("doc_id", "line_no", F.round(M.line_math_score(F.col("line")), 6).alias("score")).where("score > 0")


@query(f"""SELECT doc_id, line_no, regexp_matches(regexp_replace(line, '[ \\t]+', '', 'g'), '^[_=.·—−-]+$') AS rule, regexp_matches(line, '^\\([0-9]{{1,2}}\\.[0-9]{{1,3}}\\)$') AS eqno, regexp_matches(line, '^[^ \\t=]{{1,4}}[ \\t]*=$') AS cut,
 contains(line, '=') AND NOT regexp_matches(line, '^[^ \\t=]{{1,4}}[ \\t]*=$') AS display, regexp_matches(line, '[=+−×÷/^_∫∑√Ͱ-Ͽἀ-῿-]') AS signal FROM {_LINE} WHERE doc_id < 0""")
def line_kinds(spark, d):
    c = F.col("line")
    return _line_rows(spark, d).where("doc_id < 0").select("doc_id", "line_no", M.is_rule_line(c).alias("rule"), M.is_equation_number(c).alias("eqno"), M.is_left_side(c).alias("cut"), M.is_display_equation(c).alias("display"), M.has_formula_signal(c).alias("signal"))


_WORDS = "regexp_extract_all(text, '[A-Za-zА-Яа-яЁё][A-Za-zА-Яа-яЁё0-9/-]+')"
_V = "len(regexp_extract_all(lower(t), '[aeiouy]'))"
_N = "len(regexp_extract_all(t, '\\p{L}'))"
_REPEAT = "len(list_filter(range(1, length(t) - 2), lambda i: substr(t, i, 1) = substr(t, i + 1, 1) AND substr(t, i, 1) = substr(t, i + 2, 1) AND substr(t, i, 1) = substr(t, i + 3, 1))) > 0"


@query(f"""SELECT t AS token, n FROM (SELECT t, count(*) AS n FROM (SELECT unnest({_WORDS}) AS t FROM {_TEXTS}) GROUP BY 1) WHERE regexp_matches(t, '[A-Za-z]{{2,}}[0-9]{{2,}}[A-Za-z]+|[~^*=_]') OR {_REPEAT} OR ({_N} >= 5 AND ((regexp_matches(t, '[A-Za-z]')
 AND NOT regexp_matches(t, '[Ѐ-ӿ]') AND ({_V} = 0 OR ({_V} / {_N} < 0.12 AND {_N} >= 7))) OR (regexp_matches(t, '[Ѐ-ӿ]') AND len(regexp_extract_all(lower(t), '[аеёиоуыэюяaeiouy]')) = 0)))""")
def typo_shapes(spark, d):
    t = word_counts(_texts(spark, d), "text", quality.WORD).withColumnRenamed("word", "token")
    return t.where(quality.is_typo_shaped(F.col("token")))


@query(f"""SELECT t AS token, n FROM (SELECT t, count(*) AS n FROM (SELECT unnest({_WORDS}) AS t FROM {_TEXTS}) GROUP BY 1) WHERE regexp_matches(t, '{quality.TECHNICAL.replace("'", "''")}') OR regexp_matches(t, '{quality.IDENTIFIER}')
 OR regexp_matches(trim(t, '<>/'), '{quality.TECHNICAL.replace("'", "''")}') OR regexp_matches(trim(t, '<>/'), '{quality.IDENTIFIER}')""")
def technical_tokens(spark, d):
    t = word_counts(_texts(spark, d), "text", quality.WORD).withColumnRenamed("word", "token")
    return t.where(quality.is_technical(F.col("token")))


@query(f"""SELECT doc_id, round(CASE WHEN length(text) = 0 THEN 0.0 ELSE len(regexp_extract_all(text, '[\\x09-\\x0D\\x20-\\x7E\\x{{85}}\\x{{A0}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{3000}}«»—–−°±×÷№§…ёЁА-Яа-я]')) / length(text) END, 6) AS printable,
 round(CASE WHEN trim(text, chr(32) || chr(9) || chr(10) || chr(13)) = '' THEN 0.0 WHEN l = 0 THEN 0.35 WHEN c + a = 0 THEN 0.2 WHEN c / (c + a) >= 0.45 THEN 0.65 + 0.35 * c / (c + a) WHEN a / (c + a) >= 0.75 THEN CASE WHEN w >= 3 THEN 0.75 + 0.2 * least(1.0, w / 20) ELSE 0.45 END
 WHEN c / (c + a) >= 0.2 THEN 0.55 ELSE 0.3 END, 6) AS language, CASE WHEN length(text) = 0 THEN 0.0 WHEN dens < 0.3 THEN 0.25 WHEN dens < 2 THEN 0.55 WHEN dens <= 40 THEN 1.0 WHEN dens <= 80 THEN 0.55 ELSE 0.15 END AS density
 FROM (SELECT *, len(regexp_extract_all(text, '\\p{{L}}')) AS l, len(regexp_extract_all(text, '[Ѐ-ӿ]')) AS c, len(regexp_extract_all(text, '[A-Za-z]')) AS a, len(regexp_extract_all(text, '[A-Za-z]{{2,}}')) AS w, length(text) / 500.0 AS dens FROM {_TEXTS})""")
def printable_language_density(spark, d):
    c = F.col("text")
    return _texts(spark, d).select("doc_id", F.round(quality.printable_ratio(c), 6).alias("printable"), F.round(quality.language_score(c), 6).alias("language"), T.density_score(F.length(c), F.lit(500_000.0)).alias("density"))


_LEXICON = """(SELECT word, max(log10(n * 1e9 / total)) AS zipf FROM (SELECT *, sum(n) OVER (PARTITION BY lang) AS total FROM (SELECT lang, w AS word, count(*) AS n FROM (SELECT lang, unnest(regexp_extract_all(lower(text), '[A-Za-zА-Яа-яЁё][A-Za-zА-Яа-яЁё0-9/-]+')) AS w FROM documents) GROUP BY ALL)) GROUP BY 1)"""


@query(f"""WITH t AS (SELECT doc_id, unnest({_WORDS}) AS t FROM {_TEXTS}), k AS (SELECT *, {_N} AS a FROM (SELECT doc_id, t, count(*) AS n FROM t GROUP BY ALL) WHERE {_N} >= 2),
 z AS (SELECT doc_id, n, a, (regexp_matches(t, '{quality.TECHNICAL.replace("'", "''")}') OR regexp_matches(t, '{quality.IDENTIFIER}') OR regexp_matches(trim(t, '<>/'), '{quality.TECHNICAL.replace("'", "''")}') OR regexp_matches(trim(t, '<>/'), '{quality.IDENTIFIER}')) AS tech, coalesce(zipf, 0) AS zipf
  FROM k LEFT JOIN {_LEXICON} ON word = lower(CASE WHEN length(t) > 3 AND t[-1] = '-' THEN t[:-2] ELSE t END)),
 g AS (SELECT doc_id, sum(n) FILTER (a >= 5) AS n5, sum(n) AS n2, sum(n) FILTER (a >= 5 AND (tech OR zipf >= 3)) AS h5, sum(n) FILTER (tech OR zipf >= 3) AS h2, sum(n) FILTER (a >= 5 AND NOT tech AND zipf < 1.5) AS o5, sum(n) FILTER (NOT tech AND zipf < 1.5) AS o2 FROM z GROUP BY 1)
 SELECT d.doc_id, coalesce(CASE WHEN n5 > 0 THEN n5 ELSE n2 END, 0)::BIGINT AS n_tokens, round(coalesce(CASE WHEN n5 > 0 THEN coalesce(h5, 0) / n5 ELSE coalesce(h2, 0) / n2 END, 0), 4) AS dict_hit, round(coalesce(CASE WHEN n5 > 0 THEN coalesce(o5, 0) / n5 ELSE coalesce(o2, 0) / n2 END, 0), 4) AS oov_hard FROM {_TEXTS} d LEFT JOIN g USING (doc_id)""")
def lexical_quality_rates(spark, d):
    known = quality.lexicon(_docs(spark, d))
    got = quality.lexical_quality(_texts(spark, d).withColumnRenamed("doc_id", "page_id"), known)
    return got.select(F.col("page_id").alias("doc_id"), F.col("n_tokens").cast("long").alias("n_tokens"), "dict_hit", "oov_hard")


@query(f"""SELECT doc_id, regexp_matches(text, '</?[A-Za-z][A-Za-z0-9_:.-]*[^>]*>') AS xml, regexp_matches(text, '[Ͱ-Ͽἀ-῿]') AS greek, regexp_matches(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x9F]') AS control,
 contains(text, chr(65533)) OR regexp_matches(text, '[A-Za-zА-Яа-яЁё]-\\n[A-Za-zА-Яа-яЁё]') AS broken FROM {_TEXTS}""")
def problem_flags(spark, d):
    return _texts(spark, d).select("doc_id", quality.problem_flags(F.col("text")).alias("f")).select("doc_id", "f.*")


@query("""SELECT source AS doc_id, count(*) AS pages, count(*) FILTER (regexp_matches(text, '</?[A-Za-z][A-Za-z0-9_:.-]*[^>]*>')) AS xml, count(*) FILTER (lang = 'en') AS admitted_pages, count(*) FILTER (lang = 'en' AND (contains(text, chr(65533)) OR regexp_matches(text, '[A-Za-zА-Яа-яЁё]-\\n[A-Za-zА-Яа-яЁё]'))) AS adm_broken FROM documents GROUP BY 1""")
def layer_audit(spark, d):
    p = _docs(spark, d).select(F.col("source").alias("doc_id"), (F.col("lang") == "en").alias("admitted"), quality.problem_flags(F.col("text")).alias("f")).select("doc_id", "admitted", "f.*")
    return audits.layer_audit(p).select("doc_id", "pages", "xml", "admitted_pages", "adm_broken")


@query(f"SELECT doc_id, regexp_matches(j, '(?i)(?:^|[^\\p{{L}}\\p{{N}}_])(?:литература|библиограф|references|список\\s+использованных)(?:$|[^\\p{{L}}\\p{{N}}_])') AS bibliography FROM (SELECT doc_id, array_to_string({_lines('text')}, ' ') AS j, len({_lines('text')}) AS n FROM {_TEXTS} WHERE doc_id < 0) WHERE n < 20")
def bibliography_like(spark, d):
    t = _texts(spark, d).where("doc_id < 0").select("doc_id", T.lines(F.col("text")).alias("l")).where(F.size("l") < 20)
    return t.select("doc_id", M.is_bibliography(F.col("l")).alias("bibliography"))


_CLASS = "CASE WHEN length(text) < 40 THEN 'C' WHEN s < 0.65 AND (q IS NULL OR q < 0.55) THEN 'C' WHEN NOT v AND s >= 0.65 AND q >= 0.85 THEN 'A' WHEN length(text) >= 200 AND ((coalesce(q >= 0.62, false) AND h >= 0.58 AND o <= 0.32 AND (s >= 0.55 OR v)) OR (NOT v AND s >= 0.65)) THEN 'B' WHEN v OR coalesce(q < 0.62, false) THEN 'C' WHEN s < 0.65 THEN 'C' ELSE 'B' END"


@query(f"SELECT page_class, count(*) AS n FROM (SELECT {_CLASS} AS page_class FROM (SELECT text, (doc_id * 37 % 100) / 100 AS s, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE (doc_id * 53 % 100) / 100 END AS q, (doc_id * 71 % 100) / 100 AS h, (doc_id * 29 % 60) / 100 AS o, doc_id % 5 = 0 AS v FROM documents)) GROUP BY 1")
def page_classes(spark, d):
    """The routing decision list over made-up scores from the ids, so that every branch occurs."""
    i = F.col("doc_id")
    p = _docs(spark, d).select("text", (i * 37 % 100 / 100).alias("s"), F.when(i % 11 != 0, i * 53 % 100 / 100).alias("q"), (i * 71 % 100 / 100).alias("h"), (i * 29 % 60 / 100).alias("o"), (i % 5 == 0).alias("v"))
    c = quality.page_class(F.lit(True), F.length("text"), F.col("s"), F.col("q"), F.col("h"), F.col("o"), F.col("v"))
    return p.groupBy(c.alias("page_class")).agg(F.count("*").alias("n"))


@query("SELECT a.doc_id, CASE WHEN x = '' THEN CASE WHEN y = '' THEN 0.0 ELSE 1.0 END ELSE round(levenshtein(x, y) / length(x), 6) END AS cer FROM (SELECT doc_id, trim(regexp_replace(substr(regexp_replace(text, '[^\\x20-\\x7E]', '', 'g'), 1, 300), '\\s+', ' ', 'g')) AS x FROM documents) a JOIN (SELECT doc_id, trim(regexp_replace(substr(upper(regexp_replace(text, '[^\\x20-\\x7E]', '', 'g')), 1, 290), '\\s+', ' ', 'g')) AS y FROM documents) b USING (doc_id)")
def cer_pairs(spark, d):
    """The beginning of each text, ASCII only (SQL counts bytes), against its capitals, cut ten letters shorter."""
    plain = F.regexp_replace("text", r"[^\x20-\x7E]", "")
    return _docs(spark, d).select("doc_id", F.round(evaluate.cer(F.substring(plain, 1, 300), F.substring(F.upper(plain), 1, 290)), 6).alias("cer"))


@query("SELECT a.doc_id, round(CASE WHEN len(list_distinct(x || y)) = 0 THEN 1.0 ELSE len(list_intersect(x, y)) / len(list_distinct(x || y)) END, 6) AS jaccard FROM (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-zа-яё0-9]{3,}')) AS x FROM documents) a JOIN (SELECT doc_id - 1 AS doc_id, list_distinct(regexp_extract_all(lower(text), '[a-zа-яё0-9]{3,}')) AS y FROM documents) b USING (doc_id)")
def word_jaccard_pairs(spark, d):
    a, b = _docs(spark, d).select("doc_id", F.col("text").alias("a")), _docs(spark, d).select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("b"))
    return a.join(b, "doc_id").select("doc_id", F.round(T.word_jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"))


_BOX = "(SELECT l_orderkey AS page, l_linenumber AS o, (l_partkey % 50)::DOUBLE AS x1, (l_suppkey % 40)::DOUBLE AS y1, (l_partkey % 50 + 10 + l_quantity)::DOUBLE AS x2, (l_suppkey % 40 + 10 + l_quantity)::DOUBLE AS y2 FROM lineitem)"


def _box_rows(spark, d):
    p, s, q = F.col("l_partkey") % 50, F.col("l_suppkey") % 40, F.col("l_quantity")
    b = F.struct(*(c.cast("double").alias(k) for k, c in (("x1", p), ("y1", s), ("x2", p + 10 + q), ("y2", s + 10 + q))))
    return _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("o"), b.alias("box"))


_INTER = "(greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)))"
_AREA = "(({t}.x2 - {t}.x1) * ({t}.y2 - {t}.y1))"
_A, _B = _AREA.replace("{t}", "a"), _AREA.replace("{t}", "b")


@query(f"SELECT a.page, a.o AS a, b.o AS b, round({_INTER} / ({_A} + {_B} - {_INTER} + 1e-9), 6) AS iou, round({_INTER} / greatest(1e-9, {_A}), 6) AS inside, {_INTER} > 0 AND {_INTER} >= 0.2 * least({_A}, {_B}) AS overlaps FROM {_BOX} a JOIN {_BOX} b ON a.page = b.page AND a.o < b.o")
def box_overlaps(spark, d):
    """Pairs of an order's lines as boxes on a page; orders have seven lines at most."""
    a, b = _box_rows(spark, d).alias("a"), _box_rows(spark, d).alias("b")
    x, y = F.col("a.box"), F.col("b.box")
    j = a.join(b, (F.col("a.page") == F.col("b.page")) & (F.col("a.o") < F.col("b.o")))
    return j.select(F.col("a.page").alias("page"), F.col("a.o").alias("a"), F.col("b.o").alias("b"), F.round(T.iou(x, y), 6).alias("iou"), F.round(boxes.share_inside(x, y), 6).alias("inside"), boxes.overlaps(x, y).alias("overlaps"))


@query(f"SELECT page, o, (x1 * 200 / 72.0)::INT - CASE WHEN (x1 * 200 / 72.0)::INT > x1 * 200 / 72.0 THEN 1 ELSE 0 END AS px, CASE WHEN greatest(x2 - x1, 0) * greatest(y2 - y1, 0) > 0.6 * 10000 THEN 'too_large' WHEN x2 - x1 > 90 AND y2 - y1 > 90 THEN 'full_page' WHEN x2 - x1 < 50 OR y2 - y1 < 50 THEN 'too_small' WHEN (x2 - x1) / greatest(y2 - y1, 1) < 0.15 OR (x2 - x1) / greatest(y2 - y1, 1) > 7 THEN 'bad_aspect' END AS fault FROM {_BOX}")
def box_faults(spark, d):
    b = F.col("box")
    return _box_rows(spark, d).select("page", "o", boxes.points_to_pixels(b, F.lit(200)).x1.alias("px"), boxes.figure_fault(b, F.lit(100.0), F.lit(100.0)).alias("fault"))


@query("SELECT o_orderkey, unnest(CASE WHEN n <= 4 THEN range(1, n + 1) ELSE list_sort(list_distinct([1, n, 1 + round_even((n - 1) / 3, 0)::INT, 1 + round_even(2 * (n - 1) / 3, 0)::INT])) END) AS page FROM (SELECT o_orderkey, (o_custkey % 13)::INT AS n FROM orders)")
def sample_pages(spark, d):
    n = (F.col("o_custkey") % 13).cast("int")
    return _t(spark, d, "orders").select("o_orderkey", F.explode(sources.sampled_pages(n, 4).cast("array<long>")).alias("page"))


@query("SELECT o_orderkey, unnest(list_sort(list_distinct(range(k, k + 3) || [k + 6]))) AS page FROM (SELECT o_orderkey, o_orderkey % 7 + 1 AS k FROM orders)")
def page_range_lists(spark, d):
    k = F.col("o_orderkey") % 7 + 1
    spec = F.concat_ws(", ", F.concat_ws("-", k.cast("string"), (k + 2).cast("string")), F.lit(""), (k + 6).cast("string"))
    return _t(spark, d, "orders").select("o_orderkey", F.explode(sources.page_ranges(spec).cast("array<long>")).alias("page"))


@query("SELECT o_orderkey AS doc_id, page, CASE WHEN o_orderkey % 3 = 0 AND page > 1 THEN 'new' ELSE 'old' END AS text FROM (SELECT o_orderkey, unnest(range(1, 4)) AS page FROM orders)")
def merge_pages_upsert(spark, d):
    base = _t(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.explode(F.expr("sequence(1L, 3L)")).alias("page"))
    return sources.upserted(base.withColumn("text", F.lit("old")), base.where("doc_id % 3 = 0 AND page > 1").withColumn("text", F.lit("new")), ["doc_id", "page"])


@query("SELECT o_orderkey AS doc_id, unnest(range(1, 4)) AS page FROM orders WHERE o_orderkey % 4 = 1 UNION ALL SELECT o_orderkey, unnest(range(1, 4)) FROM orders WHERE o_orderkey % 4 = 2")
def pages_to_do(spark, d):
    """Of every fourth order all pages are done, of every fourth the first; resume does documents with a page left whole."""
    wanted = _t(spark, d, "orders").where("o_orderkey % 4 IN (0, 1, 2)").select(F.col("o_orderkey").alias("doc_id"), F.explode(F.expr("sequence(1L, 3L)")).alias("page"))
    return sources.pages_to_do(wanted, wanted.where("doc_id % 4 = 0 OR (doc_id % 4 = 1 AND page = 1)"), "resume")


@query("SELECT source AS doc_id, page, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, statuses DESC, page) AS rank FROM (SELECT source, lang AS page, count(*) AS n, count(DISTINCT doc_id % 3) AS statuses FROM documents GROUP BY ALL)) WHERE rank <= 8")
def formula_pages(spark, d):
    r = _docs(spark, d).select(F.col("source").alias("doc_id"), F.col("lang").alias("page"), F.lit("formula").alias("type"), (F.col("doc_id") % 3).alias("status"))
    return audits.formula_pages(r).select("doc_id", "page", "n", F.col("rank").cast("long").alias("rank"))


@query("SELECT source AS doc_id, count(*) AS pages, count(*) FILTER (lang = 'en') AS A, count(*) FILTER (lang = 'fr') AS B, 0::BIGINT AS C, count(*) FILTER (doc_id % 3 = 0) AS ok FROM documents GROUP BY ROLLUP (source)")
def page_table(spark, d):
    p = _docs(spark, d).select(F.col("source").alias("doc_id"), F.when(F.col("lang") == "en", "A").when(F.col("lang") == "fr", "B").alias("page_class"), F.when(F.col("doc_id") % 3 == 0, "ok").otherwise("failed").alias("status"), F.lit("layer").alias("text_source"))
    return audits.page_table(p).select("doc_id", "pages", "A", "B", "C", "ok")


@query("SELECT o_orderkey, h, unnest(b) AS top FROM (SELECT o_orderkey, h, CASE WHEN h <= 0 THEN [] ELSE list_filter(range(0, greatest(h - 1, 0) + 1, 1408), lambda t: t = 0 OR t - 1408 + 1600 < h) END AS b FROM (SELECT o_orderkey, (o_custkey * 7 % 9000)::INT AS h FROM orders))")
def image_bands(spark, d):
    h = (F.col("o_custkey") * 7 % 9000).cast("int")
    t = _t(spark, d, "orders").select("o_orderkey", h.alias("h"))
    return t.select("o_orderkey", "h", F.explode(quality.horizontal_bands(F.col("h"))).alias("b")).select("o_orderkey", "h", F.col("b.top").cast("long").alias("top"))


@query("SELECT doc_id, rn // 5 AS nth FROM (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS rn, source FROM documents) WHERE rn % 5 = 0")
def every_nth(spark, d):
    rn = F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1
    return _docs(spark, d).select("doc_id", rn.alias("rn")).where("rn % 5 = 0").select("doc_id", F.floor(F.col("rn") / 5).alias("nth"))
