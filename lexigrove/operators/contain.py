"""Exact containment: which texts hold which of a set of passages."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from lexigrove.sources.tables import stored

#: Bytes of passages in one automaton.
BLOCK = 8 << 20


def _finder(passages: list[tuple[int, str]]):
    """A function from a text to the ids of the passages it holds, in one pass over the text."""
    import ahocorasick

    ids: dict[str, list[int]] = {}
    for i, p in passages:
        ids.setdefault(p, []).append(i)
    automaton = ahocorasick.Automaton()
    for p, i in ids.items():
        automaton.add_word(p, i)
    automaton.make_automaton()
    return lambda text: {i for _, found in automaton.iter(text) for i in found}


def containing(texts: DataFrame, passages: DataFrame, block: int = BLOCK) -> DataFrame:
    """(query_id, chunk_ord) for every text (chunk_ord, text) that holds a passage (query_id, query) letter by letter.

    Passages are shipped in blocks of bounded size, each in one scan of the texts; the driver holds one block at a time and the
    results of several are written. Null and empty passages are in no text.
    """
    spark, schema = texts.sparkSession, "query_id long, chunk_ord long"
    out, held, size = spark.createDataFrame([], schema), [], 0

    def search(passages: list[tuple[int, str]]) -> DataFrame:
        shipped = spark.sparkContext.broadcast(passages)

        def run(batches):
            find = _finder(shipped.value)
            for b in batches:
                pairs = [(q, c) for c, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if t for q in find(t)]
                yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], names=["query_id", "chunk_ord"])

        return texts.select("chunk_ord", "text").mapInArrow(run, schema)

    parts = []
    for r in passages.where("query <> ''").select("query_id", "query").toLocalIterator():
        if held and size + len(r.query) > block:
            parts.append(stored(search(held)))
            held, size = [], 0
        held.append((r.query_id, r.query))
        size += len(r.query)
    for one in [*parts, search(held)] if held else parts:
        out = out.union(one)
    return out.distinct()
