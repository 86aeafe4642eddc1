import json
import random

import pytest
from pyspark.sql import functions as F

from lexigrove.operators import audits, chunks, evaluate, references
from lexigrove.plans import ports, routing
from lexigrove.sources import pages as P
from lexigrove.streaming import incremental

TEXT = "A page with enough words to be admitted to the index, it has letters."


def write(folder, name, pages, **more):
    (folder / name).write_text(json.dumps({"doc_id": name.removesuffix("_pages.json"), "source_path": f"/in/{name}.pdf", "pages": pages} | more))


def page(n, text=TEXT, **more):
    return {"page": n, "page_class": "A", "status": "ok", "text": text, "notes": [], "provenance": {}} | more


def test_admission_of_page_documents(spark, tmp_path):
    toc = "\n".join(f"Part {i} ........ {i}" for i in range(8))
    write(tmp_path, "a_pages.json", [page(1), page(2, page_class="C"), page(3, status="failed"), page(4, "short"), page(5, toc), page(6, notes=["low_confidence"]), page(7, provenance={"garbage_veto": "true"}), page(8, "x1 " * 30)])
    write(tmp_path, "b_pages.json", [])
    (tmp_path / "c_pages.json").write_text("{ not json")
    docs = P.documents(spark, str(tmp_path)).cache()
    judged = P.admission(P.pages_of(docs)).cache()
    assert {r.page: r.reason for r in judged.collect()} == {1: None, 2: "class", 3: "status", 4: "short", 5: "toc", 6: "low_confidence", 7: "low_confidence", 8: None}
    raw = chunks.chunk_documents(judged.where("reason IS NULL").select("doc_id", "page", "page_class", "text", "source_file"))
    r = P.build_report(docs, judged, raw, raw).first()
    assert (r.files, r.bad_json, r.empty_json, r.pages_seen, r.skipped_low_confidence, r.admitted, r.skipped_short, r.skipped_garbage, r.chunks, r.docs) == (3, 1, 1, 8, 2, 2, 1, 0, 1, 1)


def test_page_lists(spark):
    df = spark.createDataFrame([("1-3, 7,2",), ("",), (None,), ("5,,6",)], "c string")
    assert [r[0] for r in df.select(P.page_ranges(F.col("c"))).collect()] == [[1, 2, 3, 7], None, None, [5, 6]]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        df.select(P.page_ranges(F.col("c"), skip_blanks=False)).collect()
    n = spark.createDataFrame([(0,), (3,), (10,), (11,)], "n int")
    pick = lambda k: [r[0] for r in n.select(P.sampled_pages(F.col("n"), k)).collect()]
    assert pick(4) == [[], [1, 2, 3], [1, 4, 7, 10], [1, 4, 8, 11]] and pick(1) == [[], [1], [1], [1]] and pick(0)[1] == [1, 2, 3]


def test_manifests_and_runs(spark):
    old = spark.createDataFrame([("a", 1, 10), ("b", 1, 10)], "path string, mtime_ns long, size long")
    new = spark.createDataFrame([("a", 1, 10), ("b", 2, 10), ("c", 1, 1)], "path string, mtime_ns long, size long")
    assert {r.path for r in P.changed(new, old).collect()} == {"b", "c"}
    wanted = spark.createDataFrame([("d", 1), ("d", 2), ("e", 1)], "doc_id string, page int")
    done = spark.createDataFrame([("d", 1), ("e", 1)], "doc_id string, page int")
    assert [sorted(map(tuple, P.pages_to_do(wanted, done, m).collect())) for m in ("merge", "resume", "reprocess")] == [[("d", 2)], [("d", 1), ("d", 2)], [("d", 1), ("d", 2), ("e", 1)]]
    up = P.upserted(wanted.withColumn("t", F.lit("old")), spark.createDataFrame([("d", 2, "new"), ("f", 1, "new")], "doc_id string, page int, t string"), ["doc_id", "page"])
    assert [tuple(r) for r in up.collect()] == [("d", 1, "old"), ("d", 2, "new"), ("e", 1, "old"), ("f", 1, "new")]


def test_files_and_sinks(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    for n in ("a.pdf", "sub/b.PDF", "c.txt"):
        (tmp_path / "in" / n).write_bytes(b"x" * 5)
    found = P.files(spark, str(tmp_path / "in"))
    assert sorted(r.path.rsplit("/", 1)[1] for r in found.select("path").collect()) == ["a.pdf", "b.PDF"]
    assert {r["size"] for r in P.fingerprints(found).collect()} == {5}
    P.write_texts(spark.createDataFrame([("d", 1, "t\nu"), ("d", 2, None)], "doc_id string, page int, text string"), str(tmp_path / "texts"))
    assert spark.read.text(str(tmp_path / "texts/doc_id=d/page=1"), wholetext=True).first()[0] == "t\nu\n"
    r = spark.createDataFrame([("d", 1), ("e", 1)], "doc_id string, n int")
    P.write_regions(r, str(tmp_path / "regions"))
    P.write_regions(r.where("doc_id = 'd'").withColumn("n", F.lit(9)), str(tmp_path / "regions"))
    assert {tuple(x) for x in spark.read.parquet(str(tmp_path / "regions")).select("doc_id", "n").collect()} == {("d", 9), ("e", 1)}


def test_proofread_and_gold(spark, tmp_path):
    (tmp_path / "Flight Manual_p12.txt").write_text("# draft\nLine one\n~ a = b\nLine two\n")
    r = P.proofread(spark, str(tmp_path)).first()
    assert (r.name, r.page, r.draft, r.text, r.formulas) == ("Flight Manual", 12, True, "Line one\nLine two", ["a = b"])
    docs = spark.createDataFrame([("flight_manual_2020",), ("manual of ships",), ("other",)], "doc_id string")
    assert P.best_named(spark.createDataFrame([("Flight Manual",)], "name string"), docs).first().doc_id == "flight_manual_2020"
    g = spark.createDataFrame([("150,300,450,600|Fig. 1|plot", "1,2,3,4|a=b")], "f string, x string").select(P.gold_figures(F.col("f")).alias("f"), P.gold_formulas(F.col("x")).alias("x")).first()
    assert (g.f.bbox.x1, g.f.bbox.y2, g.f.caption, g.f.kind) == (72.0, 288.0, "Fig. 1", "plot") and (g.x.bbox.y2, g.x.latex, g.x.status) == (4.0, "a=b", "ok")


def test_stream_upserts_pages(spark, tmp_path):
    src, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    src.mkdir()
    write(src, "a_pages.json", [page(1, "one"), page(2, "two")])
    keep = lambda df: df.select("doc_id", "page", "text")
    spark.sparkContext.setCheckpointDir(str(tmp_path / "cp"))
    incremental.ingest(incremental.page_stream(spark, str(src)), out, state, keep).awaitTermination()
    write(src, "b_pages.json", [page(1, "three")])
    write(src, "a2_pages.json", [page(2, "new", doc_id="a")])
    incremental.ingest(incremental.page_stream(spark, str(src)), out, state, keep).awaitTermination()
    assert {(r.doc_id, r.page): r.text for r in spark.read.parquet(out).collect()} == {("a", 1): "one", ("a", 2): "new", ("b", 1): "three"}


def test_stream_makes_vectors_once(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    texts = spark.createDataFrame([("h1", "a"), ("h2", "b"), ("h1", "a")], "sha256 string, text string")
    texts.write.parquet(src)
    made = lambda df: df.withColumn("vector", F.array(F.lit(1.0)))
    for state in ("s1", "s2"):  # a run from the beginning makes nothing anew
        incremental.embed_stream(spark.readStream.schema("sha256 string, text string").parquet(src), made, out, str(tmp_path / state)).awaitTermination()
    assert sorted(r.sha256 for r in spark.read.parquet(out).collect()) == ["h1", "h2"]


def test_routing(spark):
    rows = [
        ("keeps", "A", "text of the layer", 0.9, False, None, None, None, None, True), ("checked", "B", "one two three four", 0.7, False, "one two three four", 9, 0.9, None, True),
        ("escalated", "B", "xxx yyy zzz", 0.7, False, "quite another text here", 9, 0.9, None, True), ("doubted", "B", "xxx yyy zzz", 0.7, True, "quite another text", 5, 0.9, None, True),
        ("seen", "C", "", None, False, None, None, None, "What the vision model has read from the image of the page.", True), ("unread", "C", "", None, False, None, None, None, "UNREADABLE", True),
        ("fallback", "C", "", None, False, "recognised", 5, 0.8, None, True), ("bad", "C", "", None, False, "rec", 1, 0.8, None, True), ("no image", "C", "", None, False, None, None, None, None, False),
    ]
    p = spark.createDataFrame(rows, "name string, page_class string, text string, quality double, vetoed boolean, ocr_text string, ocr_lines int, ocr_confidence double, vision_text string, has_image boolean")
    got = {r.name: (r.page_class, r.status, r.text_source) for r in routing.extracted(p).collect()}
    assert got == {
        "keeps": ("A", "ok", "layer"), "checked": ("B", "ok", "layer+ocr_check"), "escalated": ("C", "suspicious", "ocr_fallback"), "doubted": ("B", "suspicious", "layer+ocr"), "seen": ("C", "ok", "vlm"),
        "unread": ("D", "failed", "vlm"), "fallback": ("C", "suspicious", "ocr_fallback"), "bad": ("D", "failed", "ocr_fallback"), "no image": ("D", "failed", ""),
    }
    assert {r.name: r.status for r in routing.extracted(p, vision=False, fallback=False).collect()}["seen"] == "needs_vlm"
    reply = spark.createDataFrame([("COLUMNS: 2\nTABLE: yes\nMISSING: no",), ("nothing",)], "c string").select(routing.layout_reply(F.col("c")).alias("r")).collect()
    assert (reply[0].r.n_columns, reply[0].r.likely_table, reply[0].r.missing_regions, reply[1].r.n_columns) == (2, True, False, 1)


def test_ports(spark):
    class Engine:  # defined here, so that workers need not import this file
        def recognise(self, image, dpi):
            if image == b"bad":
                raise ValueError("no image")
            return [{"text": image.decode(), "x1": 0.0, "y1": 1.0, "x2": 2.0, "y2": 3.0, "confidence": 0.5, "engine": "test"}]

    class Letters:
        def encode(self, texts):
            return [[float(len(t))] for t in texts]

    images = spark.createDataFrame([(bytearray(b"ab"), 72, 10.0), (bytearray(b"bad"), 72, 0.0)], "image binary, dpi int, y_offset double")
    got = ports.recognised(images, Engine).collect()
    assert got[0].lines[0].y1 == 11.0 and got[0].lines[0].text == "ab" and got[1].lines is None
    assert ports.recognised(images, lambda: None).collect()[0].lines is None
    texts = spark.createDataFrame([("h", "abc")], "sha256 string, text string")
    assert ports.encoded(texts, Letters, "e5-small").first().vector == [12.0] and ports.encoded(texts, lambda: None).first().vector is None
    assert isinstance(Engine(), ports.Recogniser) and isinstance(Letters(), ports.Encoder)


def test_child_process():
    import sys

    code = "import sys, json\nprint('loading'); print(json.dumps({'ready': True}), flush=True)\nfor x in sys.stdin:\n    print('noise'); print(json.dumps({'got': json.loads(x)['q']}), flush=True)"
    p = ports.ChildProcess([sys.executable, "-c", code])
    assert p.available and p.ask({"q": 5}) == {"got": 5}
    p.close()
    assert not p.available and p.ask({"q": 1}) is None


def test_summaries(spark):
    pages = spark.createDataFrame(
        [("d", 1, "A", "ok", "layer", False, False, False, False, "text_layer", False, 0.9, 0.8, ["x=1", "y"]), ("d", 2, "C", "suspicious", "ocr_fallback", True, True, False, True, "ocr", True, 0.1, None, ["x=2"])],
        "doc_id string, page int, page_class string, status string, text_source string, needs_vlm boolean, vlm_attempted boolean, vlm_used boolean, ocr_fallback_used boolean, route string, vetoed boolean, tlq_score double, quality double, notes array<string>",
    )
    s = audits.page_summary(pages).first()
    assert (s.pages, s.class_A, s.class_C, s.ok, s.suspicious, s.needs_vlm_pending, s.ocr_fallback_used) == (2, 1, 1, 1, 1, 1, 1)
    assert audits.source_summary(pages).first().mean_lexical == 0.8 and audits.note_counts(pages).first().asDict() == {"value": "x", "n": 2}
    a = spark.createDataFrame([("d", True, True, False, False, True), ("d", False, True, False, False, True), ("e", True, False, False, False, False)], "doc_id string, admitted boolean, xml boolean, greek boolean, control boolean, broken boolean")
    audit = audits.layer_audit(a)
    assert [r.doc_id for r in audits.audit_priority(audit).collect()] == ["d"]
    g = spark.createDataFrame([("d", 1, True, 0.2, 100), ("d", 2, False, 0.5, 100), ("d", 3, False, None, 100), ("d", 4, True, 0.1, 10)], "doc_id string, page int, vetoed boolean, lexical_quality double, char_count int")
    c = audits.garbage_candidates(g)
    assert [(r.page, r.priority) for r in c.collect()] == [(1, "veto"), (2, "suspect")] and audits.garbage_counts(c).first().veto_list == [1]
    assert [r[0] for r in spark.createDataFrame([(1, 3), (0, 0)], "a int, b int").select(audits.percent(F.col("a"), F.col("b"))).collect()] == ["33%", "—"]


def test_report_on_proofread_pages(spark):
    proofread = spark.createDataFrame([("Gear manual", 1, False, "landing gear", ["a=b"]), ("Gear manual", 9, True, "шасси самолета", None), ("unknown", 1, False, None, None), ("Fuel", 2, False, "fuel tanks", [])], "name string, page int, draft boolean, text string, formulas array<string>")
    pages = spark.createDataFrame([("gear manual", 1, "landing geer"), ("gear manual", 2, "x"), ("Fuel", 2, " ")], "doc_id string, page int, text string")
    candidates = spark.createDataFrame([("Fuel", 2, "high"), ("gear manual", 2, "low")], "doc_id string, page int, priority string")
    got = references.report(proofread, pages, candidates).cache()
    assert {(r.name, r.page): (r.lang, r.doc_id, r.cer, r.priority) for r in got.collect()} == {("Gear manual", 1): ("en", "gear manual", 1 / 12, None), ("Gear manual", 9): ("ru", "gear manual", None, None), ("unknown", 1): ("mixed", None, None, None), ("Fuel", 2): ("en", "Fuel", 1.0, "high")}
    r = references.summary(got).first()
    assert (r.references, r.matched, r.candidates, r.drafts, r.short, r.with_formulas, r.ru, r.en, r.mixed) == (4, 2, 1, 1, 4, 1, 1, 2, 1)
    assert [r.doc_id for r in references.unread(candidates, got).collect()] == ["gear manual"]


def test_pages_are_compared_to_their_end(spark):
    text = "seen here " * 3_000
    proofread = spark.createDataFrame([("Gear", 1, False, text, None)], "name string, page int, draft boolean, text string, formulas array<string>")
    layer = text[:20_000] + text[20_000:].replace("e", "c")
    pages = spark.createDataFrame([("Gear", 1, layer)], "doc_id string, page int, text string")
    assert references.report(proofread, pages).first().cer == 4_000 / 29_999
    assert references.report(proofread, pages, compared=12_000).first().cer == 0
    pair = spark.createDataFrame([("a" * 13_000 + "b", "a" * 13_000)], "x string, y string")
    assert evaluate.char_errors(pair, "x", "y").first().cer == 1 / 13_001


def test_distance_is_that_of_the_table():
    rng = random.Random(3)
    for _ in range(300):
        a, b = ("".join(rng.choices("abcж ", k=rng.randrange(0, 30))) for _ in range(2))
        assert evaluate.distance(a, b) == evaluate.edits(list(a), list(b))


def test_replaced_letters_need_no_table():
    rng = random.Random(4)
    assert evaluate.replaced("ab", "ba") is None and evaluate.replaced("abc", "ab") is None and evaluate.replaced("", "") == 0
    found = 0
    for _ in range(500):
        a = "".join(rng.choices("abcж😀 ", k=rng.randrange(0, 20)))
        b = "".join(rng.choice("xcз" if rng.random() < 0.1 else x) for x in a)
        got = evaluate.replaced(a, b)
        assert got is None or got == evaluate.edits(list(a), list(b))
        found += got is not None and got > 0
    assert found > 100
    long = "seen here " * 100_000  # the table would have 10^12 places
    assert evaluate.distance(long, long.replace("e", "c")) == 400_000
