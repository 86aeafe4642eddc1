"""Clause sessions over a stream of pages.

What ``chunks.sessions`` finds with windows over whole documents, found page by page as they arrive: the state of a document is
its last page, the group that is open, and a lone number at the foot of the last page, of which only the next line tells whether
it is a heading. Lines come out once, with their group; a held line comes out with the document's next page, or when the document
is known to be whole.

Pages of a document must arrive in order, those of one batch may stand in any. A page that comes after a later one is ``late``: it
opens groups of its own, numbered -1, -2..., and leaves the others as they are. Null texts have no lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lexigrove.functions import text as T
from lexigrove.operators.chunks import has_letters, heading_number, page_lines
from lexigrove.sources.tables import exists

OUT = "doc_id string, page int, line_no int, line string, group_no long, clause_id string, late boolean"
STATE = "page int, group_no long, clause_id string, late long, held_page int, held_no int, held_line string, held_num string"
_READ = ["page", "line_no", "line", "num", "lone", "words"]
_KINDS = {"page": np.int32, "line_no": np.int32, "line": object, "group_no": np.int64, "clause_id": object, "late": bool}


def marked_lines(pages: DataFrame) -> DataFrame:
    """Lines of pages with what each tells by itself: ``num`` of a heading, ``lone`` number that the next line decides, ``words``: four letters or more."""
    lines = page_lines(pages).select(F.col("doc_id").cast("string").alias("doc_id"), F.col("page").cast("int").alias("page"), F.col("line_no").cast("int").alias("line_no"), "line")
    line = F.col("line")
    lone = F.when(T.strip(line).rlike(r"^[0-9]{1,3}\.$"), heading_number(line, F.lit("abcd")))
    return lines.select("doc_id", "page", "line_no", "line", F.when(lone.isNull(), heading_number(line, F.lit(""))).alias("num"), lone.alias("lone"), has_letters(line, 4).alias("words"))


class Document:
    """The open group of a document and the line that waits."""

    def __init__(self, state: tuple | None):
        self.page, self.group, self.clause, self.late, *held = state or (None, 0, None, 0, None, None, None, None)
        self.held = held if held[0] is not None else None

    def state(self) -> tuple:
        return self.page, self.group, self.clause, self.late, *(self.held or (None,) * 4)

    def put(self, page: int, number: int, line: str, num: str | None) -> tuple:
        gap = self.page is None or page > self.page + 1
        if num is not None or gap:
            self.group += 1
            self.clause = num
        self.page = page
        return page, number, line, self.group, self.clause, False

    def release(self, words: bool) -> Iterator[tuple]:
        if self.held:
            page, number, line, num = self.held
            self.held = None
            yield self.put(page, number, line, num if words else None)

    def add(self, page: int, number: int, line: str, num: str | None, lone: str | None, words: bool) -> Iterator[tuple]:
        yield from self.release(words)
        if lone is not None:
            self.held = [page, number, line, lone]
        else:
            yield self.put(page, number, line, num)


def _none(x):
    return None if x is None or x != x else x


def _sessions(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    document = Document(tuple(map(_none, state.get)) if state.exists else None)
    out: list[tuple] = []
    # a document's batch is small, so plain lists take a part of the time of frames
    rows = [row for b in batches for row in zip(*(b[c].tolist() for c in _READ))]
    lines = sorted((row for row in rows if isinstance(row[2], str)), key=lambda row: row[:2])
    reached, late = document.held[0] if document.held else document.page, None
    for page, number, line, num, lone, words in lines:
        if reached is None or page >= reached:
            out += document.add(int(page), int(number), line, _none(num), _none(lone), bool(words))
            continue
        if page != late or _none(num) is not None:
            document.late += 1
            late, clause = page, _none(num)
        out.append((int(page), int(number), line, -document.late, clause, True))
    if len(lines) < len(rows):  # a row without a line: the document is whole
        out += document.release(False)
    state.update(document.state())
    columns = list(zip(*out)) or [()] * len(_KINDS)
    yield pd.DataFrame({"doc_id": np.full(len(out), key[0], object)} | {k: np.array(c, t) for (k, t), c in zip(_KINDS.items(), columns)})


def session_stream(pages: DataFrame, whole: DataFrame | None = None) -> DataFrame:
    """``pages`` (doc_id, page, page_class, text), a stream, as lines with group_no, clause_id and late.

    ``whole``: a stream of doc_id of documents behind whose pages, those of the same batch too, nothing comes.
    """
    lines = marked_lines(pages)
    if whole is not None:
        none = F.lit(None).cast("string")
        lines = lines.union(whole.select(F.col("doc_id").cast("string"), F.lit(0), F.lit(0), none, none, none, F.lit(False)))
    return lines.groupBy("doc_id").applyInPandasWithState(_sessions, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def finished(spark: SparkSession, run: StreamingQuery, state: str, batch: int) -> None:
    """Waits for a run over what there is, however long it takes; raises if it failed or ended before ``batch`` was committed to its checkpoint ``state``."""
    try:
        run.awaitTermination()
    finally:
        run.stop()
    if not exists(spark, f"{state}/commits/{batch}"):
        raise RuntimeError(f"the stream was stopped before batch {batch} was done")
