import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql.streaming import StreamingQuery

from lexigrove.operators import chunks
from lexigrove.queries import QUERIES
from lexigrove.streaming import clauses

PAGES = "doc_id string, page int, page_class string, text string"


def streamed(spark, home, batches):
    """Lines of all batches, each a file of its own, read one by one; state goes on between runs."""
    out = []
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, PAGES).coalesce(1).write.mode("append").parquet(f"{home}/in")
        stream = spark.readStream.schema(PAGES).parquet(f"{home}/in")
        run = clauses.session_stream(stream).writeStream.format("parquet").option("path", f"{home}/out").option("checkpointLocation", f"{home}/state").trigger(availableNow=True).start()
        run.awaitTermination()
    return sorted((r.doc_id, r.page, r.line_no, r.line, r.group_no, r.clause_id, r.late) for r in spark.read.parquet(f"{home}/out").collect())


def batch(spark, rows):
    s = chunks.sessions(chunks.page_lines(spark.createDataFrame(rows, PAGES)))
    return sorted((r.doc_id, r.page, r.line_no, r.line, r.group_no, r.clause_id, False) for r in s.collect())


def test_sessions_of_a_stream_are_those_of_windows(spark, tmp_path):
    rows = [
        ("a", 1, "A", "Preface of the book\n4.1 Landing gear\nloads of it"), ("a", 2, "A", "go on here\n12."), ("a", 3, "A", "Классификация изделий\nand more"), ("a", 5, "A", "behind a gap\n7."), ("a", 6, "A", "1 2 3\n4.2 Doors"),
        ("b", 1, "A", None), ("b", 2, "A", "3.\nTitle of three\n5."), ("c", 9, "A", "only one line"),
    ]
    got = streamed(spark, tmp_path, [[r for r in rows if r[1] in pages] for pages in ((1, 2), (3,), (5,), (6, 9))])
    want = batch(spark, rows)
    held = [r for r in want if r[:2] == ("b", 2) and r[3] == "5."]  # nothing has come behind it yet
    assert len(held) == 1 and got == [r for r in want if r not in held]


def test_pages_that_come_late(spark, tmp_path):
    got = streamed(spark, tmp_path, [[("a", 4, "A", "4.1 Gear\nof it")], [("a", 2, "A", "a late line\n3.1 Wing\nof it")], [("a", 5, "A", "goes on")]])
    assert [(r[1], r[4], r[5], r[6]) for r in got] == [(2, -1, None, True), (2, -2, "3.1", True), (2, -2, "3.1", True), (4, 1, "4.1", False), (4, 1, "4.1", False), (5, 1, "4.1", False)]


def test_a_held_line_comes_out_when_nothing_follows():
    document = clauses.Document(None)
    assert list(document.add(1, 0, "7.", None, "7", False)) == []
    again = clauses.Document(document.state())
    assert list(again.release(False)) == [(1, 0, "7.", 1, None, False)] and list(again.release(True)) == []
    assert list(document.add(2, 0, "Title", None, None, True)) == [(1, 0, "7.", 1, "7", False), (2, 0, "Title", 1, "7", False)]


def documents(spark, path, texts):
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return str(path)


def sessions_of(name, spark, path):
    return sorted(tuple(r) for r in QUERIES[name](spark, path).where("doc_id <> 'own'").collect())


def test_a_number_at_the_end_of_a_whole_document_comes_out(spark, tmp_path):
    path = documents(spark, tmp_path, [(4, "4.1 Gear\nof it"), (5, "7."), (8, "1.1 Wing\n3."), (10, "Title of three\n9."), (12, "5."), (14, None)])
    got = sessions_of("clause_session_stream", spark, path)
    assert got == sessions_of("clause_sessions", spark, path) and sum(r[3] for r in got) == 8


def test_a_stream_that_takes_long_is_waited_for(spark, tmp_path, monkeypatch):
    path = documents(spark, tmp_path, [(i, f"{i}.1 Gear\nof it") for i in range(4, 12)])
    wait = StreamingQuery.awaitTermination
    monkeypatch.setattr(StreamingQuery, "awaitTermination", lambda run, timeout=None: wait(run, timeout and timeout / 6000))
    got = sessions_of("clause_session_stream", spark, path)
    assert got == sessions_of("clause_sessions", spark, path) and len(got) == 8


def test_a_stream_that_is_stopped_is_no_result(spark, tmp_path, monkeypatch):
    path = documents(spark, tmp_path, [(i, f"{i}.1 Gear\nof it") for i in range(4, 12)])
    wait, ended = StreamingQuery.awaitTermination, []

    def stopped(run, timeout=None):
        if ended:  # the second run, which brings the later pages
            run.stop()
        ended.append(wait(run, timeout))

    monkeypatch.setattr(StreamingQuery, "awaitTermination", stopped)
    with pytest.raises(RuntimeError, match="batch 1"):
        sessions_of("clause_session_stream", spark, path)


def test_a_stream_that_fails_raises(spark, tmp_path, monkeypatch):
    path = documents(spark, tmp_path, [(4, "4.1 Gear\nof it")])
    fails = clauses.session_stream
    monkeypatch.setattr(clauses, "session_stream", lambda *a: fails(*a).where("raise_error('broken') IS NULL"))
    with pytest.raises(StreamingQueryException):
        sessions_of("clause_session_stream", spark, path)
