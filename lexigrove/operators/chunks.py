"""Clauses of admitted pages as chunks with their page ranges.

Pages: (doc_id, page, page_class, text), optionally source_file. Lines are cleaned and tested for headings as column
expressions; a window over the lines of a document finds where clauses begin; packing reads each document's lines in
order, holds one clause at a time and never splits a line.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrove.config import LEADER, Settings
from lexigrove.functions import text as T
from lexigrove.functions.lookalikes import repair

S = Settings()
# Words before a clause number, and letters that count.
PREFIX = "глава|раздел|подраздел|пункт|статья|section|chapter|п"
LETTERS = "[A-Za-zА-Яа-яЁё]"
HEADING = rf"(?iu)^(?:({PREFIX})\.?[ \t]+)?([0-9]+(?:\.[0-9]+)*)(\.)?[ \t]*(.*)$"
#: Letters that a numbered and an unnumbered chunk need at least; the largest number of a heading without dots or prefix.
NUMBERED, UNNUMBERED, LARGEST = 8, 40, 400


def has_letters(c: Column, least: int) -> Column:
    """Whether ``c`` has so many letters; looks no further than to the last of them."""
    return c.rlike(rf"^(?:[^{LETTERS[1:-1]}]*+{LETTERS}){{{least}}}")


def heading_number(line: Column, following: Column) -> Column:
    """Clause number when ``line`` opens a clause, else null. A lone ``n.`` needs a line with four letters behind it."""
    line = T.strip(line)
    part = lambda i: F.regexp_extract(line, HEADING, i)

    def numbered(x: Column) -> Column:
        prefix, num, title = x.prefix != "", x.num, x.title
        dotted = F.contains(num, F.lit("."))
        bad = x.line.rlike(LEADER) | title.rlike("^[0-9]{2,4}$") | num.startswith("0")
        plain = ~dotted & ~prefix
        titled = has_letters(title, 4) & F.substring(title, 1, 1).rlike(r"^\p{Lu}") & (F.length(num) <= 3) & (num.cast("int") <= LARGEST)
        # a number with dots alone must not be a long decimal
        long = dotted & ~prefix & (title == "") & F.exists(F.split(num, r"\."), lambda x: F.length(x) > 4)
        return F.when((num != "") & ~bad & ~(plain & ~F.coalesce(titled, F.lit(False))) & ~long, num)

    lone = line.rlike(r"^[0-9]{1,3}\.$")
    parts = F.struct(part(1).alias("prefix"), part(2).alias("num"), T.strip(part(4)).alias("title"), line.alias("line"))
    # most lines hold no number where a heading has it
    found = F.when(line.rlike(HEADING), T.once(parts, numbered))
    return F.when(lone, F.when(has_letters(F.coalesce(following, F.lit("")), 4), F.regexp_replace(line, r"\.$", ""))).otherwise(found)


def page_lines(pages: DataFrame) -> DataFrame:
    """(doc_id, source_file, page, page_class, line_no, line): joined at hyphens, tidied, without page furniture."""
    source = F.coalesce(F.col("source_file"), F.col("doc_id").cast("string")) if "source_file" in pages.columns else F.col("doc_id").cast("string")
    found = F.filter(F.transform(F.split(T.join_hyphens(F.col("text")), T.BREAK), lambda x: T.strip(F.regexp_replace(x, "[ \t]{2,}|\t", " "))), lambda x: (x != "") & ~T.is_furniture(x))
    return pages.select("doc_id", source.alias("source_file"), "page", "page_class", F.posexplode(found).alias("line_no", "line"))


def sessions(lines: DataFrame) -> DataFrame:
    """``lines`` with ``clause_id`` of the heading that opens a line's group (else null) and the group's number in its document.

    A heading opens a group, and so does a line more than one page behind the one before.
    """
    order = Window.partitionBy("doc_id").orderBy("page", "line_no")
    num = heading_number(F.col("line"), F.lead("line").over(order))
    gap = F.coalesce(F.col("page") > F.lag("page").over(order) + 1, F.lit(True))
    marked = lines.withColumn("num", num).withColumn("opens", (F.col("num").isNotNull() | gap).cast("int"))
    # a window's sums are running ones, so a group never has to be held whole
    marked = marked.withColumn("group_no", F.sum("opens").over(order))
    return marked.withColumn("clause_id", F.first("num").over(Window.partitionBy("doc_id", "group_no").orderBy("page", "line_no"))).drop("num", "opens")


def pack(lines: list[tuple[int, str, str]], limit: int) -> Iterator[list[tuple[int, str, str]]]:
    """Runs of (page, class, line) of up to ``limit`` characters with one newline between lines; a longer line is a run by itself."""
    run, size = [], 0
    for row in lines:
        if run and size + 1 + len(row[2]) > limit:
            yield run
            run, size = [], 0
        size += len(row[2]) + bool(run)
        run.append(row)
    if run:
        yield run


def parts_of(clause: str | None, lines: list[tuple[int, str, str]], limit: int) -> list[tuple[int, int, str, str]]:
    """(first page, last page, class, text) of the chunks of one clause. Later ones repeat the heading."""
    out: list[tuple[int, int, str, str]] = []
    head, least = lines[0][2], NUMBERED if clause else UNNUMBERED
    for run in pack(lines, limit):
        body = "\n".join(x for *_, x in run)
        if clause and out and not body.startswith(head):
            body = f"{head}\n{body}"
        body = repair(body)
        if sum(c in _LETTER for c in body) >= least:
            classes = {c for _, c, _ in run}
            out.append((run[0][0], run[-1][0], classes.pop() if len(classes) == 1 else "AB", body))
    return out


_LETTER = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0x410, 0x450))) + "Ёё")
_FIELDS = "source_file string, page_start int, page_end int, page_class string, clause_id string, part int, parts int, text string, group_no long"


def chunk_documents(pages: DataFrame, limit: int = S.max_chunk) -> DataFrame:
    """(chunk_id, doc_id, source_file, page_start, page_end, page_class, clause_id, part, parts, text, group_no) of all pages.

    Ids are ``doc|first-last|clause or preamble|part``; the second of the same id ends in ``#2`` and so on. Null texts have
    no lines; a document's pages may come in any order, but a page number must not repeat.
    """
    kind = pages.schema["doc_id"].dataType.simpleString()
    lines = sessions(page_lines(pages)).select("doc_id", F.col("group_no").cast("long").alias("group_no"), "clause_id", "source_file", F.col("page").cast("int").alias("page"), "page_class", "line_no", "line")
    ordered = lines.repartition("doc_id").sortWithinPartitions("doc_id", "group_no", "page", "line_no")
    schema = f"doc_id {kind}, {_FIELDS}"
    names = [x.split()[0] for x in schema.split(", ")]
    types = None

    def run(batches):
        nonlocal types
        key, held, out = None, [], []

        def done():
            if held:
                parts = parts_of(key[2], held, limit)
                out.extend((key[0], key[3], a, b, c, key[2], i, len(parts), text, key[1]) for i, (a, b, c, text) in enumerate(parts, 1))

        def batch(doc_type):
            cols = list(zip(*out)) or [()] * len(names)
            kinds = [doc_type, pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

        doc_type = None
        for b in batches:
            doc_type = b.schema.field(0).type
            doc, group, clause, source, page, cls, _, line = (c.to_pylist() for c in b.columns)
            for i in range(b.num_rows):
                if key is None or (doc[i], group[i]) != key[:2]:
                    done()
                    key, held = (doc[i], group[i], clause[i], source[i]), []
                held.append((page[i], cls[i], line[i]))
            yield batch(doc_type)
            out.clear()
        done()
        if out:
            yield batch(doc_type)

    made = ordered.mapInArrow(run, schema)
    base = F.concat_ws("|", F.col("doc_id").cast("string"), F.concat_ws("-", "page_start", "page_end"), F.coalesce("clause_id", F.lit("preamble")), F.col("part").cast("string"))
    made = made.withColumn("base", base)
    again = F.row_number().over(Window.partitionBy("doc_id", "base").orderBy("group_no"))
    made = made.withColumn("again", again)
    return made.select(F.when(F.col("again") == 1, F.col("base")).otherwise(F.concat_ws("#", "base", F.col("again").cast("string"))).alias("chunk_id"), *names)
