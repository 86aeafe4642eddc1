import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexigrove.functions.lookalikes import repair
from lexigrove.operators import chunks


def heading(spark, pairs):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, line string, following string")
    return [r.h for r in df.select("i", chunks.heading_number(F.col("line"), F.col("following")).alias("h")).orderBy("i").collect()]


def test_heading_numbers(spark):
    cases = {
        ("7.", "Loads of the frame"): "7", ("7.", "12"): None, ("7.", None): None, ("1.2 General", None): "1.2", ("3 Scope of work", None): "3", ("3 scope of work", None): None,
        ("8 Four", None): "8", ("8 Fou", None): None, ("401 Too large here", None): None, ("400 Just small enough", None): "400", ("05 Leading zero", None): None, ("0.5 mm", None): None, ("6.2", None): "6.2",
        ("1.23456", None): None, ("п. 9", None): "9", ("Раздел 3 нагрузки", None): "3", ("chapter 4", None): "4", ("3 Terms .... 8", None): None, ("10 2020", None): None, ("1.1 12", None): None, ("12", None): None, ("Plain text", None): None, (None, None): None,
    }
    assert heading(spark, list(cases)) == list(cases.values())


def pages(spark, rows):
    return spark.createDataFrame(rows, "doc_id string, page int, page_class string, text string")


def test_clause_over_two_pages_and_gap(spark):
    long = "Текст требования к раме шасси без номера пункта. "
    got = chunks.chunk_documents(pages(spark, [
        ("d", 2, "B", "продолжение пункта на второй странице"), ("d", 1, "A", "1.1 Общие положения\nШасси прове-\nряют до полёта"), ("d", 5, "A", long), ("d", 6, "A", None), ("e", 1, "A", "1.1 Short"), ("e", 1 + 1, "A", "few"),
    ])).orderBy("doc_id", "page_start").collect()
    assert [(r.chunk_id, r.page_class, r.part, r.parts) for r in got] == [("d|1-2|1.1|1", "AB", 1, 1), ("d|5-5|preamble|1", "A", 1, 1), ("e|1-2|1.1|1", "A", 1, 1)]
    assert got[0].text == "1.1 Общие положения\nШасси проверяют до полёта\nпродолжение пункта на второй странице"


def test_parts_repeat_the_heading_and_ids_are_told_apart(spark):
    line = "слово " * 40
    body = "2.1 Требования\n" + "\n".join(line for _ in range(12))
    got = chunks.chunk_documents(pages(spark, [("d", 1, "A", body + "\n" + "2.1 Требования\nповтор того же номера")])).orderBy("group_no", "part").collect()
    assert [r.chunk_id for r in got] == ["d|1-1|2.1|1", "d|1-1|2.1|2", "d|1-1|2.1|1#2"]
    assert got[1].text.startswith("2.1 Требования\nслово") and [r.parts for r in got] == [2, 2, 1]
    assert all(len(r.text) <= 1800 + len("2.1 Требования\n") for r in got)


def plain_chunks(rows, limit=1800):
    """The same by a plain loop over one document's pages, headings left out."""
    out, run, size, last = [], [], 0, None

    def end():
        if sum(c.isalpha() for c in "\n".join(run)) >= 40:
            out.append("\n".join(run))

    for page, text in rows:
        for x in map(str.strip, text.split("\n")):
            if not x:
                continue
            if run and (page > last + 1 or size + 1 + len(x) > limit):
                end()
                run, size = [], 0
            size += len(x) + bool(run)
            run.append(x)
            last = page
    end()
    return out


def test_against_plain_loop(spark):
    rows = [(p, "\n".join("some words without any number " * (1 + (p * 7 + i) % 9) for i in range(5))) for p in (1, 2, 3, 7, 8, 20)]
    got = chunks.chunk_documents(pages(spark, [("d", p, "A", t) for p, t in reversed(rows)])).orderBy("group_no", "part")
    want = plain_chunks([(p, "\n".join(" ".join(x.split()) for x in t.split("\n"))) for p, t in rows])
    assert Counter(r.text for r in got.collect()) == Counter(want)
    few = got.sparkSession.conf.get("spark.sql.shuffle.partitions")
    got.sparkSession.conf.set("spark.sql.shuffle.partitions", "1")
    again = chunks.chunk_documents(pages(spark, [("d", p, "A", t) for p, t in rows]))
    assert Counter(r.text for r in again.collect()) == Counter(want)
    got.sparkSession.conf.set("spark.sql.shuffle.partitions", few)


@pytest.mark.parametrize(
    "given, wanted",
    [
        ("β соответствии с правилами", "в соответствии с правилами"), ("(Δ) Внешнее", "(Д) Внешнее"), ("§ 29.305 η 29.307", "§ 29.305 и 29.307"), ("ARP4754Α", "ARP4754A"), ("τ.δ.", "т.д."), ("ε.γ.", "e.g."),
        ("σ = μ + λ", "σ = μ + λ"), ("§ 29.501(α)", "§ 29.501(а)"), ("α", "α"), ("(ι) ОЦЕНКА", "(i) ОЦЕНКА"), ("Σ1000Δ-Α", "S1000D-A"), ("the Αir data", "the Air data"), ("по ρаботе", "по работе"), ("λ is real", "λ is real"), ("plain", "plain"), ("", ""), (None, None),
    ],
)
def test_lookalikes(given, wanted):
    assert repair(given) == wanted


def test_letters_are_looked_for_up_to_the_last_that_counts(spark):
    t = ["", "abc", "a1b2c3d", "....\n\nаб ё\tz", "é é é é", "1234", None, "x" * 50]
    df = spark.createDataFrame([(x,) for x in t], "t string")
    for r in df.select("t", chunks.has_letters(F.col("t"), 4).alias("has")).collect():
        assert r.has == (None if r.t is None else len(re.findall("[A-Za-zА-Яа-яЁё]", r.t)) >= 4)
    plan = chunks.sessions(chunks.page_lines(spark.createDataFrame([("a", 1, "A", "x")], "doc_id string, page int, page_class string, text string")))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan
