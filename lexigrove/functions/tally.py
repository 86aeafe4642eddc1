"""Counts over whole texts that Spark's patterns make a value a match for: characters of classes by numpy, words by tasks."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of texts that a task looks at together; different words that it holds before it passes their counts on.
LOOKED, HELD = 4 << 20, 500_000
LETTERS = r"\p{L}"


@lru_cache(64)
def _table(chars: str) -> np.ndarray:
    """Whether a code point is of the class ``chars`` (as inside brackets, or LETTERS)."""
    every = map(chr, range(sys.maxunicode + 1))
    if chars == LETTERS:
        return np.fromiter((unicodedata.category(x)[0] == "L" for x in every), bool, sys.maxunicode + 1)
    found = np.zeros(sys.maxunicode + 1, bool)
    found[[ord(x) for x in re.findall(f"[{chars}]", "".join(every))]] = True
    return found


def _sums(mask: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many places of ``mask`` hold between neighbours of ``at``."""
    return np.diff(np.searchsorted(np.flatnonzero(mask), at))


def _counted(data: np.ndarray, at: np.ndarray, classes: dict[str, str], words: str | None) -> dict[str, np.ndarray]:
    """Counts of texts whose UTF-8 bytes lie in ``data`` between neighbours of ``at``."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    heads = np.flatnonzero((data & 0xC0) != 0x80)
    row = np.searchsorted(heads, at)
    out = {k: _sums(_table(v)[points], row) for k, v in classes.items()}
    if words is not None:
        m = _table(words)[points]
        first = np.zeros(len(m) + 1, bool)
        first[row] = True
        new = m.copy()
        new[1:] &= ~m[:-1] | first[1:-1]
        two = np.zeros(len(m), bool)
        two[:-1] = m[1:] & ~first[1:-1]
        out["words"] = _sums(new & two, row)
    return out


def char_counts(c: Column, words: str | None = None, **classes: str) -> Column:
    """Struct with the number of characters of each class in ``classes`` (as inside brackets), null for null.

    ``words``: also the number of runs of two or more characters of this class.
    """
    names = [*classes, *(["words"] if words is not None else [])]

    def count(texts: pa.Array) -> pa.Array:
        whole = texts.fill_null("").cast(pa.large_string())
        offsets = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1] if len(whole) else np.zeros(1, np.int64)
        held = whole.buffers()[2] if len(whole) else None
        data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
        got: dict[str, list] = {k: [np.zeros(0, np.int64)] for k in names}
        cuts = [0, *(np.flatnonzero(np.diff(offsets[1:] // LOOKED)) + 1), len(whole)]
        for a, b in zip(cuts, cuts[1:]):
            for k, v in _counted(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], classes, words).items():
                got[k].append(v)
        return pa.StructArray.from_arrays([pa.array(np.concatenate(got[k]), pa.int64()) for k in names], names, mask=texts.is_null())

    return F.arrow_udf(count, ", ".join(f"{k} long" for k in names))(c)


def word_counts(texts: DataFrame, text: str, pattern: str, *by: str) -> DataFrame:
    """(*by, word, n): how often the words that ``pattern`` finds occur; tasks count before the shuffle. Few different ``by`` are meant."""
    texts = texts.select(*by, text)
    fields = [*texts.schema.fields[:-1]]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "word string", "n long"])

    def run(batches):
        find = re.compile(pattern).findall
        held: dict[tuple, Counter] = {}

        def passed():
            keys = [(k, len(v)) for k, v in held.items()]
            columns = [pa.array([k[i] for k, n in keys for _ in range(n)], kinds[i]) for i in range(len(fields))]
            counts = [pa.array([w for v in held.values() for w in v], pa.string()), pa.array([n for v in held.values() for n in v.values()], pa.int64())]
            held.clear()
            return pa.RecordBatch.from_arrays([*columns, *counts], [*(f.name for f in fields), "word", "n"])

        kinds = None
        for b in batches:
            kinds = [c.type for c in b.columns[:-1]]
            keys = zip(*(c.to_pylist() for c in b.columns[:-1])) if fields else iter([()] * b.num_rows)
            for key, t in zip(keys, b.column(len(fields))):
                held.setdefault(key, Counter()).update(find(t.as_py() or ""))
                if len(held[key]) > HELD // (len(held) or 1):
                    yield passed()
        if held:
            yield passed()

    return texts.mapInArrow(run, schema).groupBy(*by, "word").agg(F.sum("n").alias("n"))


def words_by_text(texts: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """(key, at, word, n): the different words of each row's text, where each stands first among them, and how often; no shuffle."""
    texts = texts.select(key, text)
    kind = texts.schema[key].dataType.simpleString()

    def run(batches):
        find = re.compile(pattern).findall
        for b in batches:
            keys, words, at, n = [], [], [], []
            for row, t in enumerate(b.column(1)):
                found = Counter(find(t.as_py() or ""))
                keys += [row] * len(found)
                at += range(len(found))
                words += found
                n += found.values()
                if len(keys) > HELD:
                    yield batch(b, keys, words, at, n)
                    keys, words, at, n = [], [], [], []
            yield batch(b, keys, words, at, n)

    def batch(b, keys, words, at, n):
        return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keys, pa.int32())), pa.array(at, pa.int32()), pa.array(words, pa.string()), pa.array(n, pa.int64())], [key, "at", "word", "n"])

    return texts.mapInArrow(run, f"`{key}` {kind}, at int, word string, n long")
