import random
import re
import unicodedata
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lexigrove.functions import tally


def texts(n):
    rng = random.Random(1)
    return ["".join(rng.choices("abЖё 1²Ⅷ😀é=/-\n", k=rng.randrange(0, 12))) for _ in range(n)] + [""]


def test_characters_of_classes(spark):
    t = [*texts(400), None]
    df = spark.createDataFrame(list(enumerate(t)), "i int, t string").repartition(3)
    c = tally.char_counts(F.col("t"), words="A-Za-z", letters=tally.LETTERS, lat="A-Za-z", cyr="Ѐ-ӿ")
    for r in df.select("t", c.alias("n")).collect():
        if r.t is None:
            assert r.n is None
            continue
        assert (r.n.lat, r.n.cyr, r.n.words) == tuple(len(re.findall(p, r.t)) for p in ("[A-Za-z]", "[Ѐ-ӿ]", "[A-Za-z]{2,}"))
        assert r.n.letters == sum(unicodedata.category(x)[0] == "L" for x in r.t)


def test_texts_are_looked_at_in_parts(monkeypatch):
    raw = [x.encode() for x in texts(50)]
    at = np.cumsum([0, *map(len, raw)])
    got = tally._counted(np.frombuffer(b"".join(raw), np.uint8), at, {"lat": "A-Za-z"}, "A-Za-z")
    assert got["lat"].tolist() == [len(re.findall(b"[A-Za-z]", x)) for x in raw]


def test_a_class_is_counted_without_a_match_each(spark):
    plan = spark.createDataFrame([("a",)], "t string").select(tally.char_counts(F.col("t"), lat="A-Za-z", cyr="Ѐ-ӿ").alias("n"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "regexp" not in plan


def test_words_are_counted_before_the_shuffle(spark, monkeypatch):
    t = texts(300)
    df = spark.createDataFrame([(i, "x" if i % 2 else None, x) for i, x in enumerate(t)], "i int, k string, t string").repartition(3)
    for held in (500_000, 2):
        monkeypatch.setattr(tally, "HELD", held)
        want = Counter((("x" if i % 2 else None), w) for i, x in enumerate(t) for w in re.findall("[abЖё]+", x))
        assert {(r.k, r.word): r.n for r in tally.word_counts(df, "t", "[abЖё]+", "k").collect()} == want
        assert {r.word: r.n for r in tally.word_counts(df, "t", "[abЖё]+").collect()} == Counter(w for x in t for w in re.findall("[abЖё]+", x))
    got = sorted((r.i, r["at"], r.word, r.n) for r in tally.words_by_text(df, "i", "t", "[abЖё]+").collect())
    assert got == [(i, at, w, n) for i, x in enumerate(t) for at, (w, n) in enumerate(Counter(re.findall("[abЖё]+", x)).items())]


def test_tokens_are_judged_once_and_not_by_occurrence(spark):
    from lexigrove.functions import quality

    pages = spark.createDataFrame([(1, "Valve valve vlvtrkq zz and and"), (2, "and 12 ---"), (3, None)], "page_id int, text string")
    known = spark.createDataFrame([("en", "and", 7.0), ("en", "valve", 4.0)], "lang string, word string, zipf double")
    got = quality.lexical_quality(pages, known, letters=3)
    assert {r.page_id: (r.n_tokens, r.dict_hit, r.oov_hard, list(r.bad_tokens)) for r in got.collect()} == {1: (5, 0.8, 0.2, ["vlvtrkq"]), 2: (1, 1.0, 0.0, []), 3: (0, 0.0, 0.0, [])}
    plan = got._jdf.queryExecution().executedPlan().toString().lower()
    assert "rlike" not in plan and "mil(" not in plan and "explode" not in plan
