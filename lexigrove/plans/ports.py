"""Ports: what recognisers, layout and vision models, encoders and stores must offer, and how frames pass through them.

No model is part of this library. A port is a factory, called once in each task, of an object with the method named in the
protocol; rows go through it in Arrow batches. An object that is not available leaves its outputs null.
"""

from __future__ import annotations

import json
import subprocess
from collections.abc import Callable, Iterable
from typing import Any, Protocol, runtime_checkable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

LINE = "struct<text:string,x1:double,y1:double,x2:double,y2:double,confidence:double,engine:string>"


@runtime_checkable
class Recogniser(Protocol):
    def recognise(self, image: bytes, dpi: int) -> list[dict]:
        """Lines with text, x1, y1, x2, y2 (pixels), confidence, engine."""


@runtime_checkable
class Vision(Protocol):
    def read(self, image: bytes, prompt: str) -> str: ...


@runtime_checkable
class FormulaRecogniser(Protocol):
    def latex(self, image: bytes) -> tuple[str, float]: ...


@runtime_checkable
class LayoutModel(Protocol):
    def boxes(self, image: bytes) -> list[dict]:
        """label (picture, caption, table...), x1, y1, x2, y2, score, text."""


@runtime_checkable
class TableReader(Protocol):
    def markdown(self, image: bytes) -> tuple[str, float]: ...


@runtime_checkable
class Encoder(Protocol):
    def encode(self, texts: list[str]) -> list[list[float]]: ...


@runtime_checkable
class PageReader(Protocol):
    def pages(self, content: bytes) -> Iterable[dict]:
        """page, width, height, text, spans (text, x1, y1, x2, y2) and optionally image of each page."""


@runtime_checkable
class Reranker(Protocol):
    def scores(self, query: str, texts: list[str]) -> list[float]: ...


@runtime_checkable
class VectorStore(Protocol):
    def put(self, ids: list[str], vectors: list[list[float]]) -> None: ...

    def nearest(self, vector: list[float], k: int) -> list[tuple[str, float]]: ...


@runtime_checkable
class GraphStore(Protocol):
    def put(self, edges: list[tuple[str, str, str]]) -> None: ...

    def neighbours(self, node: str) -> list[tuple[str, str]]: ...


@runtime_checkable
class LanguageModel(Protocol):
    def answer(self, question: str, passages: list[str]) -> str: ...


def through(df: DataFrame, make: Callable[[], Any], call: Callable[[Any, dict], Any], name: str, kind: str, rows: int = 32) -> DataFrame:
    """``df`` with a column ``name`` of SQL type ``kind``: ``call(port, row)`` of every row, ``rows`` at a time.

    ``make`` may return None where the port is not available; then, and where a call fails, the value is null.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = StructType(list(df.schema.fields))
    for f in df.sparkSession.createDataFrame([], f"{name} {kind}").schema.fields:
        schema = schema.add(f)
    arrow = to_arrow_schema(schema)

    def run(batches):
        port = make()

        def value(row: dict):
            try:
                return call(port, row) if port is not None else None
            except Exception:  # noqa: BLE001 - one page that a model cannot read must not end the job
                return None

        for b in batches:
            for i in range(0, b.num_rows, rows):
                part = b.slice(i, rows)
                yield pa.RecordBatch.from_arrays([*(c.cast(t) for c, t in zip(part.columns, arrow.types)), pa.array([value(r) for r in part.to_pylist()], arrow.types[-1])], names=arrow.names)

    return df.mapInArrow(run, schema)


def recognised(images: DataFrame, make: Callable[[], Recogniser | None]) -> DataFrame:
    """``images`` (image, dpi, ...) with ``lines``, places moved down by the row's ``y_offset`` where it is one band of a page."""

    def call(port: Recogniser, r: dict) -> list[dict]:
        dy = r.get("y_offset") or 0.0
        return [x | {"y1": x["y1"] + dy, "y2": x["y2"] + dy} for x in port.recognise(r["image"], r["dpi"])]

    return through(images, make, call, "lines", f"array<{LINE}>")


def read_by_vision(images: DataFrame, make: Callable[[], Vision | None], prompt: str) -> DataFrame:
    return through(images, make, lambda port, r: port.read(r["image"], prompt), "vision_text", "string")


def with_latex(crops: DataFrame, make: Callable[[], FormulaRecogniser | None]) -> DataFrame:
    """``latex`` and its confidence as a struct ``formula``."""
    return through(crops, make, lambda port, r: dict(zip(("latex", "confidence"), port.latex(r["image"]))), "formula", "struct<latex:string,confidence:double>")


def latex_by_vision(port: Vision, image: bytes, prompt: str) -> tuple[str, float]:
    """A vision model as a formula recogniser: what it calls unreadable is empty."""
    text = (port.read(image, prompt) or "").strip()
    return ("", 0.0) if text.upper().startswith("UNREADABLE") else (text, 0.55)


def read_documents(found: DataFrame, make: Callable[[], PageReader | None], kind: str = "array<struct<page:int,width:double,height:double,text:string,spans:array<struct<text:string,x1:double,y1:double,x2:double,y2:double>>>>") -> DataFrame:
    """Files (path, content) with ``pages`` as a page reader gives them."""
    return through(found, make, lambda port, r: list(port.pages(r["content"])), "pages", kind, rows=1)


# What a model of the e5 family wants before its texts.
E5 = {"query": "query: ", "passage": "passage: "}


def prefixed(text: str, model: str, role: str) -> str:
    return (E5[role] if "e5" in model.lower() else "") + text


def encoded(texts: DataFrame, make: Callable[[], Encoder | None], model: str = "", role: str = "passage", batch: int = 32) -> DataFrame:
    """(sha256, text) with ``vector``, ``batch`` texts a call."""

    def run(batches):
        port = make()
        for b in batches:
            for i in range(0, b.num_rows, batch):
                part = b.slice(i, batch)
                found = [prefixed(t or "", model, role) for t in part.column(1).to_pylist()]
                vectors = port.encode(found) if port is not None else [None] * len(found)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(vectors, pa.list_(pa.float32()))], names=["sha256", "text", "vector"])

    return texts.select("sha256", "text").mapInArrow(run, "sha256 string, text string, vector array<float>")


class ChildProcess:
    """A recogniser in a process of its own that answers JSON lines: it says ``ready`` once, then one answer for each request."""

    def __init__(self, command: list[str], skipped: int = 200):
        self.process = subprocess.Popen(command, stdin=subprocess.PIPE, stdout=subprocess.PIPE, text=True, bufsize=1)
        self.ready = any(self._answer() == {"ready": True} for _ in range(skipped))

    def _answer(self) -> dict | None:
        line = self.process.stdout.readline()
        try:
            return json.loads(line)
        except ValueError:
            return None

    @property
    def available(self) -> bool:
        return self.ready and self.process.poll() is None

    def ask(self, request: dict, skipped: int = 200) -> dict | None:
        """The next answer in JSON; other lines are passed over."""
        if not self.available:
            return None
        self.process.stdin.write(json.dumps(request) + "\n")
        self.process.stdin.flush()
        return next((x for x in (self._answer() for _ in range(skipped)) if x is not None), None)

    def close(self) -> None:
        if self.process.poll() is None:
            self.process.stdin.close()
            self.process.terminate()
        self.process.wait(timeout=10)
