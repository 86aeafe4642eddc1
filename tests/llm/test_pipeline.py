import re
from collections import Counter

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from lexigrove.llm import op2_quality, op4_langid, op6_pieces
from lexigrove.llm.common import table

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TOKEN = re.compile(r"[a-z0-9\u0080-\U0010ffff]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def recognised(spark, docs):
    """By the verdicts of the operator's own query, joined in Python."""
    got = {r.doc_id: r for r in op4_langid.language_id(docs).collect()}
    return [r for r in docs.collect() if (g := got[r.doc_id]).lang_pred != "und" and (g.score >= 0.5 or len(WORD.findall(r.text or "")) < 20)]


def good(spark, docs):
    got = {r.doc_id: r.score for r in op2_quality.quality_scores(docs.select("doc_id", "text"), table(spark, SF, "labels")).collect()}
    return [r for r in docs.collect() if got[r.doc_id] >= 0.5]


def fingerprint(text):
    ws = WORD.findall((text or "").translate(UPPER))
    g = [" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] if len(ws) >= 3 else [" ".join(ws)] if ws else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in g]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def distinct(spark, docs):
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    prints, group = [fingerprint(r.text) for r in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3 and group[i] != group[j]:
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    return [r for i, r in enumerate(rows) if group[i] == i]


def clean(spark, docs):
    def shingles(text, k):
        ws = TOKEN.findall((text or "").translate(UPPER))
        return {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)}

    def holds(text, item):
        k = min(5, len(TOKEN.findall((item or "").translate(UPPER))))
        want = shingles(item, k) if k else set()
        return bool(want) and len(want & shingles(text, k)) >= 0.8 * len(want)

    items = [r.text for r in table(spark, SF, "benchmark").collect()]
    return [r for r in docs.collect() if not any(holds(r.text, i) for i in items)]


def test_run_and_every_stage_against_brute_force(spark):
    docs = table(spark, SF, "documents")
    for (name, stage), brute in zip(corpus_pipeline.STAGES, (recognised, good, distinct, clean)):
        want = brute(spark, docs)
        assert Counter(stage(spark, docs, SF).collect()) == Counter(want), name
        assert 0 < len(want) <= docs.count()
        docs = spark.createDataFrame(want, docs.schema)
    c = op6_pieces.Codec(op6_pieces.read())
    value = {i: w for w, i in c.score.values()}
    texts, out = {r.doc_id: r.text for r in docs.collect()}, corpus_pipeline.run(spark, SF).collect()
    assert Counter(r.doc_id for r in out) == Counter(list(texts))
    for r in out:
        assert r.round_trip and c.decode(np.array(r.ids, np.int32)) == (texts[r.doc_id] or "")
        assert r.scores[0] == pytest.approx(sum(value.get(i, 0) for i in r.ids))


def folder(spark, tmp_path, rows):
    """A small collection: the given documents, and labels and passages of the smallest tables."""
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, count long, h string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        table(spark, SF, name).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_every_stage_takes_odd_rows(spark, tmp_path):
    texts = [None, "", " \n", "a", "x" * 20_000, "The cat sat on the mat and the dog ran over the hill to the river. " * 9, "12 34 !!"]
    rows = [(i, t, "en" if i % 2 else None, None, None, i, "h") for i, t in enumerate(texts * 2)] + [(5, texts[5], "en", "s", 1, 5, "h"), (None, texts[5], "en", "s", 1, 5, None)]
    at = folder(spark, tmp_path, rows)
    docs = table(spark, at, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, at)
        assert kept.columns == docs.columns and kept.count() <= docs.count(), name
        docs = kept
    out = corpus_pipeline.run(spark, at).collect()
    assert all(r.round_trip for r in out) and Counter(r.doc_id for r in out) == Counter(r.doc_id for r in docs.collect())


def test_no_documents_give_no_rows(spark, tmp_path):
    at = folder(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, at).collect() == []
