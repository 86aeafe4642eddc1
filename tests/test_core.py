import duckdb
import pytest
from pyspark.sql import functions as F

from lexigrove import queries as core
from lexigrove.functions import text as T
from lexigrove.operators import index, search

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    import os

    c = duckdb.connect()
    for t in os.listdir(SF):
        c.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{t}')")
    return c


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted(map(repr, df[cols].astype(object).where(df[cols].notna(), None).values.tolist()))


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_matches_sql(spark, duck, name):
    assert rows(core.QUERIES[name](spark, SF).toPandas()) == rows(duck.execute(core.SQL[name]).df())


def value(spark, text, f):
    return spark.createDataFrame([(text,)], "c string").select(f(F.col("c"))).first()[0]


@pytest.mark.parametrize(
    "text, mush",
    [("a\nb\nc\nd", True), ("one\ntwo", False), ("A full line of text here, yes.\n" * 5, False), ("word " * 80 + "\n" + ("longer line without marks " * 2 + "\n") * 4, True), (None, None)],
)
def test_mush(spark, text, mush):
    assert value(spark, text, T.is_mush) == mush


def test_predicates(spark):
    assert value(spark, "tion-\nal re-\n  do", T.join_hyphens) == "tional redo"
    assert value(spark, "The Cat 12 and 3.4.5 x1", T.tokens) == ["cat", "12", "3.4.5", "x1"]
    assert value(spark, "1.2 Scope ........ 4\n" * 6, T.is_toc) is True
    assert value(spark, "x = 12 + 3*4 - 5\nplain words stay here", T.equation_lines) == ["x = 12 + 3*4 - 5"]
    assert value(spark, "<section>a</section>", T.is_xml_fragment) is True
    assert value(spark, "12345 67890 12345 67890 1", T.is_garbage) is True


def test_search_ties_and_refusal(spark):
    c = spark.createDataFrame([(1, "alpha beta gamma"), (2, "alpha beta gamma"), (3, "delta")], "chunk_ord long, text string")
    q = spark.createDataFrame([(1, "alpha beta"), (2, "the of"), (3, "omega psi")], "query_id long, query string")
    assert [(r.query_id, r.chunk_ord, r["rank"]) for r in search.lexical(index.build(c), q).orderBy("query_id", "rank").collect()] == [(1, 1, 1), (1, 2, 2)]


def test_dense_empty_and_ties(spark):
    v = spark.createDataFrame([(i, [1.0, 0.0]) for i in (3, 1, 2)], "chunk_ord long, vector array<float>")
    q = spark.createDataFrame([(7, [1.0, 0.0])], "query_id long, vector array<float>")
    assert [r.chunk_ord for r in search.dense(v, q, 2).orderBy("rank").collect()] == [1, 2]
    assert search.dense(v, q.limit(0)).count() == 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
