"""Reading page files in parallel over ranges of their pages: as frames, and as a data source of Spark.

A paged file is opened by a port: ``count(path)`` and ``read(path, pages)`` with the pages' numbers, from one. Files are listed by
Spark without their contents; each range of pages is a row, ranges are dealt to all tasks, and each is read where it lands. So a
file of many thousand pages is read by many tasks, and a task holds one page at a time.

As a data source: ``spark.dataSource.register(PageSource)``, then ``spark.read.format("lexigrove_pages").option("reader",
"module:factory").option("pages", "1-3,7").load(path)``.
"""

from __future__ import annotations

import glob
import importlib
import os
from collections.abc import Callable, Iterable, Iterator
from typing import Any, Protocol, runtime_checkable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from lexigrove.sources.pages import page_ranges

SPAN = "struct<text:string,x1:double,y1:double,x2:double,y2:double>"
IMAGE = "struct<x1:double,y1:double,x2:double,y2:double>"
PAGE = f"page int, page_w double, page_h double, text string, spans array<{SPAN}>, images array<{IMAGE}>, width int, height int, dpi int, gray binary"
ROW = f"path string, doc_id string, page_count int, {PAGE}, error string"
#: Pages that one task reads before the next range.
STEP = 16


@runtime_checkable
class PagedFile(Protocol):
    def count(self, path: str) -> int:
        """How many pages the file has."""

    def read(self, path: str, pages: list[int]) -> Iterable[dict]:
        """page, page_w, page_h (points), text, spans, images (boxes of embedded ones), and a grey raster (width, height, dpi, gray); all but page may be missing."""


def listed(spark: SparkSession, path: str, pattern: str = "*.{pdf,PDF}") -> DataFrame:
    """(path, doc_id, mtime_ns, size) of one file or of all below a folder; contents are not read. Files of one name are told apart by nothing but their paths."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", "modificationTime", "length").dropDuplicates(["path"])
    name = F.regexp_replace(F.url_decode(F.replace(F.element_at(F.split("path", "/"), -1), F.lit("+"), F.lit("%2B"))), r"\.[^.]*$", "")
    return found.select("path", F.regexp_replace(F.trim(name), r"\.+$", "").alias("doc_id"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), F.col("length").alias("size"))


def local(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:")


def counted(files: DataFrame, make: Callable[[], PagedFile | None]) -> DataFrame:
    """``files`` with page_count (0 for one that cannot be opened) and error."""
    def run(batches):
        port = make()
        for b in batches:
            counts, errors = [], []
            for path in b.column(b.schema.get_field_index("path")).to_pylist():
                try:
                    counts.append(port.count(local(path)) if port is not None else 0)
                    errors.append(None if port is not None else "no reader")
                except Exception as e:  # noqa: BLE001 - a file that cannot be opened must not end the job
                    counts.append(0)
                    errors.append(f"{type(e).__name__}: {e}"[:200])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(counts, pa.int32()), pa.array(errors, pa.string())], names=[*b.schema.names, "page_count", "error"])

    schema = StructType(list(files.schema.fields)).add("page_count", "integer").add("error", "string")
    return files.repartition("path").mapInArrow(run, schema)


def planned(files: DataFrame, asked: str | None = None, step: int = STEP) -> DataFrame:
    """``files`` (path, doc_id, page_count) as one row for each ``step`` pages: path, doc_id, page_count, pages.

    ``asked``: ``1-3,7`` or null for all; numbers beyond a file's last page are left out.
    """
    wanted = F.coalesce(page_ranges(F.lit(asked)), F.sequence(F.lit(1), F.col("page_count"))) if asked else F.sequence(F.lit(1), F.col("page_count"))
    some = F.filter(wanted, lambda p: (p >= 1) & (p <= F.col("page_count")))
    own = files.where("page_count > 0").withColumn("_all", some)
    parts = F.transform(F.sequence(F.lit(0), F.size("_all") - 1, F.lit(step)), lambda i: F.slice("_all", i + 1, step))
    return own.where(F.size("_all") > 0).select("path", "doc_id", "page_count", F.explode(parts).alias("pages"))


def read(plan: DataFrame, make: Callable[[], PagedFile | None]) -> DataFrame:
    """Pages of a plan, one row each; a range that cannot be read gives a row for each of its pages with ``error``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    fields = to_arrow_schema(plan.sparkSession.createDataFrame([], ROW).schema)

    def run(batches):
        port = make()
        for b in batches:
            for path, doc, count, pages in zip(*(c.to_pylist() for c in b.columns)):
                for row in _rows(port, path, doc, count, pages):
                    yield pa.RecordBatch.from_pylist([row], fields)

    return plan.select("path", "doc_id", "page_count", "pages").repartition("path", "pages").mapInArrow(run, ROW)


_NAMES = [f.split()[0] for f in ("page", "page_w", "page_h", "text", "spans", "images", "width", "height", "dpi", "gray")]


def _rows(port: PagedFile | None, path: str, doc: str, count: int, pages: list[int]) -> Iterator[dict]:
    left = list(pages)
    try:
        if port is None:
            raise OSError("no reader")
        for p in port.read(local(path), pages):
            left = [n for n in left if n != p["page"]]
            yield {"path": path, "doc_id": doc, "page_count": count, "error": None} | {n: p.get(n) for n in _NAMES}
        if left:
            raise OSError("page not delivered")
    except Exception as e:  # noqa: BLE001 - pages that cannot be read must not end the job
        for n in left:
            yield {"path": path, "doc_id": doc, "page_count": count, "error": f"{type(e).__name__}: {e}"[:200]} | dict.fromkeys(_NAMES) | {"page": n}


def factory(name: str) -> Callable[[], Any]:
    """What ``module:attribute`` names."""
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


class Range(InputPartition):
    def __init__(self, path: str, doc_id: str, count: int, pages: list[int]):
        self.path, self.doc_id, self.count, self.pages = path, doc_id, count, pages


class PageSource(DataSource):
    """Options: path (a file or folder that driver and executors share), reader (``module:factory`` of a PagedFile), pages, step, pattern (one or more, by commas)."""

    @classmethod
    def name(cls) -> str:
        return "lexigrove_pages"

    def schema(self) -> str:
        return ROW

    def reader(self, schema: StructType) -> DataSourceReader:
        return PageSourceReader(self.options)


class PageSourceReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)
        if "reader" not in self.options or "path" not in self.options:
            raise ValueError("options path and reader are needed")

    def partitions(self) -> list[Range]:
        path, step = local(self.options["path"]), int(self.options.get("step", STEP))
        patterns = self.options.get("pattern", "*.pdf,*.PDF").split(",")
        files = [path] if os.path.isfile(path) else sorted({f for p in patterns for f in glob.glob(os.path.join(glob.escape(path), "**", p.strip()), recursive=True)})
        port, asked, out = factory(self.options["reader"])(), pages_asked(self.options.get("pages")), []
        for f in files:
            count = port.count(f)
            wanted = [p for p in asked or range(1, count + 1) if 1 <= p <= count]
            doc = os.path.splitext(os.path.basename(f))[0].strip().rstrip(".")
            out += [Range(f, doc, count, wanted[i : i + step]) for i in range(0, len(wanted), step)]
        return out

    def read(self, partition: Range) -> Iterator[tuple]:
        port = factory(self.options["reader"])()
        for row in _rows(port, partition.path, partition.doc_id, partition.count, partition.pages):
            spans = [tuple(s.get(k) for k in ("text", "x1", "y1", "x2", "y2")) for s in row["spans"] or []] if row["spans"] is not None else None
            images = [tuple(s.get(k) for k in ("x1", "y1", "x2", "y2")) for s in row["images"] or []] if row["images"] is not None else None
            yield tuple({**row, "spans": spans, "images": images}[n] for n in ["path", "doc_id", "page_count", *_NAMES, "error"])


def pages_asked(spec: str | None) -> list[int] | None:
    """``1-3,7`` as sorted distinct numbers, None for all."""
    ends = [p.strip().split("-", 1) for p in (spec or "").split(",") if p.strip()]
    return sorted({n for e in ends for n in range(int(e[0]), int(e[-1]) + 1)}) or None
