"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are short and documents long, so the Jaccard similarity of the two says little; what counts is the
share of an item's five-word shingles that a document holds (containment). The items are partitioned by their number
of shingles (powers of two). In a partition with at most u shingles an item is sketched by the
``u - ceil(t * u) + 1`` smallest of its shingle hashes (a bottom-k MinHash sketch; t the threshold): a document
that holds a share t of the item misses at most n - ceil(t * n) shingles and so holds at least one of the
sketch, whatever its own length. The search thus loses nothing. Hits are verified by comparing the shingles as
bytes.

Words are runs of ASCII letters, digits and non-ASCII bytes, A-Z lower-cased; an item of fewer than five words is
one shingle of all its words; an item without words matches nothing. Null texts have no words.
Items are taken in blocks of ``BLOCK`` bytes, each broadcast as arrays of about six times that size, so a larger test set costs more
passes and never more memory. Items without an id are left out of pairs and of ``clean``; no items or no documents give no pairs. Repeated
items or documents with the same ids give one row, that with most shingles found; extra columns are ignored by ``contained`` and kept by ``clean``.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrove.llm import kernel as K
from lexigrove.llm.common import keep, rows

THRESHOLD = 0.8
SHINGLE = 5
BLOCK = 16 << 20
_BITS = 22


class Sketches:
    """Sketches and shingles of a block of items, as arrays: about six bytes for each byte of their texts.

    Shingle j of item i: ``hashes[first[i] + j]`` and the bytes ``begin:end`` of ``data``, where words stand one blank apart.
    """

    def __init__(self, items: list[tuple[int, str]], threshold: float = THRESHOLD):
        data, off = K.as_arrays(pa.array([t for _, t in items], pa.string()))
        w = K.Tokens(data, off)
        size = w.ends - w.starts
        ends = np.cumsum(size + 1) - 1
        self.data = np.full(int(ends[-1]) if len(ends) else 0, 32, np.uint8)
        inside = np.ones(len(self.data), bool)
        inside[ends[:-1]] = False
        self.data[inside] = w.data[w.inside]
        self.data = self.data.tobytes()
        begins, h = ends - size, w.hashes()
        k_of = np.minimum(w.counts, SHINGLE)
        parts = []
        for k in range(1, SHINGLE + 1):
            g, at = K.shingles(h, w.bounds, k)
            item = np.searchsorted(w.bounds, at, "right") - 1
            mine = k_of[item] == k
            parts.append((item[mine], g[mine], begins[at[mine]], ends[at[mine] + k - 1]))
        item, g, begin, end = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((g, item))
        item, g, begin, end = item[order], g[order], begin[order], end[order]
        keep = np.ones(len(g), bool)
        known: set[bytes] = set()
        for i in np.flatnonzero((item[1:] == item[:-1]) & (g[1:] == g[:-1])).tolist():
            # a shingle that repeats in its item counts once; one that only shares a hash is another
            if not i or not (item[i - 1] == item[i] and g[i - 1] == g[i]):
                known = {self.data[begin[i] : end[i]]}
            text = self.data[begin[i + 1] : end[i + 1]]
            keep[i + 1] = text not in known
            known.add(text)
        item, self.hashes, self.begin, self.end = item[keep], g[keep], begin[keep], end[keep]
        self.ids = np.array([i for i, _ in items], np.int64)
        self.first = np.searchsorted(item, np.arange(len(items) + 1))
        n = np.diff(self.first)
        self.need = np.ceil(threshold * n - 1e-9).astype(np.int64)
        # the partition of an item holds upper/2 < n <= upper
        upper = np.array([1 << (int(x) - 1).bit_length() if x else 1 for x in n], np.int64)
        sketch = np.minimum(n, upper - np.ceil(threshold * upper - 1e-9).astype(np.int64) + 1)
        low = np.arange(len(item)) - self.first[item] < sketch[item]
        self.by_length = {}
        for k in np.unique(k_of[item]).tolist():
            one = low & (k_of[item] == k)
            order = np.argsort(self.hashes[one], kind="stable")
            keys, start = np.unique(self.hashes[one][order], return_index=True)
            self.by_length[k] = keys, np.append(start, int(one.sum())), item[one][order], self.bits(keys)

    @staticmethod
    def bits(keys: np.ndarray) -> np.ndarray:
        table = np.zeros(1 << _BITS, bool)
        table[keys >> np.uint64(64 - _BITS)] = True
        return table

    def search(self, col: pa.Array) -> list[tuple[int, int, int, int]]:
        """(row, item, shingles of the item, shingles found) for every pair at or above the threshold."""
        out = []
        for a, _, data, off in K.slices(col):
            w = K.Tokens(data, off)
            h = w.hashes()
            for k, (keys, start, owners, table) in self.by_length.items():
                g, at = K.shingles(h, w.bounds, k)
                hit = np.flatnonzero(table[g >> np.uint64(64 - _BITS)])
                place = np.minimum(np.searchsorted(keys, g[hit]), len(keys) - 1)
                same = keys[place] == g[hit]
                hit, place = hit[same], place[same]
                if not len(hit):
                    continue
                doc = np.searchsorted(w.bounds, at[hit], "right") - 1
                pairs = np.unique(doc * len(keys) + place)
                by_doc: dict[int, set[int]] = {}
                for d, p in zip((pairs // len(keys)).tolist(), (pairs % len(keys)).tolist()):
                    by_doc.setdefault(d, set()).update(owners[start[p] : start[p + 1]].tolist())
                for d, items in by_doc.items():
                    lo, hi = np.searchsorted(at, [w.bounds[d], w.bounds[d + 1]])
                    order = np.argsort(g[lo:hi], kind="stable")
                    mine, where = g[lo:hi][order], at[lo:hi][order]
                    for i in sorted(items):
                        s, e = self.first[i], self.first[i + 1]
                        want = self.hashes[s:e]
                        left, right = np.searchsorted(mine, want), np.searchsorted(mine, want, "right")
                        need = int(self.need[i])
                        if (right > left).sum() < need:
                            continue
                        found = 0
                        for j in np.flatnonzero(right > left).tolist():
                            text = self.data[self.begin[s + j] : self.end[s + j]]
                            # all places with this hash are looked at, should another shingle share it; the first is nearly always it
                            found += any(w.shingle(x, k) == text for x in where[left[j] : right[j]].tolist())
                        if found >= need:
                            out.append((a + d, i, int(e - s), found))
        return out


def blocks(items: DataFrame, limit: int = BLOCK):
    """The items with an id as lists whose texts together stay within ``limit`` bytes (a longer item is a block by itself).

    Only one block at a time is in the driver.
    """
    block, size = [], 0
    for r in items.select("item_id", "text").where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).distinct().toLocalIterator():
        n = len(r.text.encode())
        if block and size + n > limit:
            yield block
            block, size = [], 0
        block.append((r.item_id, r.text))
        size += n
    if block:
        yield block


SCHEMA = "item_id long, doc_id long, n_shingles long, n_found long"


def contained(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, limit: int = BLOCK) -> DataFrame:
    """item_id, doc_id, n_shingles, n_found, containment for every pair at or above the threshold."""
    spark, out = docs.sparkSession, None
    for block in blocks(items, limit):
        shipped = spark.sparkContext.broadcast(Sketches(block, threshold))

        def run(batches, shipped=shipped):
            s = shipped.value
            for b in batches:
                hits, ids = s.search(b.column(1)), b.column(0)
                yield pa.RecordBatch.from_arrays([pa.array([int(s.ids[i]) for _, i, _, _ in hits], pa.int64()), ids.take(pa.array([r for r, *_ in hits], pa.int64())).cast(pa.int64()), pa.array([n for *_, n, _ in hits], pa.int64()), pa.array([f for *_, f in hits], pa.int64())], names=["item_id", "doc_id", "n_shingles", "n_found"])

        part = rows(docs.select("doc_id", "text"), run, SCHEMA)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], SCHEMA + ", containment double")
    out = out.groupBy("item_id", "doc_id", "n_shingles").agg(F.max("n_found").alias("n_found"))
    return out.withColumn("containment", F.col("n_found") / F.col("n_shingles"))


def clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, limit: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` that hold no item."""
    for block in blocks(items, limit):
        shipped = docs.sparkSession.sparkContext.broadcast(Sketches(block, threshold))

        def mask(col, shipped=shipped):
            free = np.ones(len(col), bool)
            free[[r for r, *_ in shipped.value.search(col)]] = False
            return free

        docs = keep(docs, lambda mask=mask: mask)
    return docs


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')"
ORACLE_SQL = f"""
WITH w AS (
  SELECT item_id AS id, 1 AS kind, {_WORDS} AS ws FROM benchmark
  UNION ALL
  SELECT doc_id, 2, {_WORDS} FROM documents
), i AS (
  SELECT id, ws, least(5, len(ws)) AS k FROM w WHERE kind = 1 AND len(ws) > 0
), s AS (
  SELECT 1 AS kind, id, k, list_aggregate(ws[i:i + k - 1], 'string_agg', ' ') AS g FROM (SELECT id, k, ws, unnest(range(1, len(ws) - k + 2)) AS i FROM i)
  UNION
  SELECT 2, id, k, list_aggregate(ws[i:i + k - 1], 'string_agg', ' ') FROM (SELECT id, k, ws, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (SELECT DISTINCT k FROM i) WHERE kind = 2 AND len(ws) >= k)
), n AS (SELECT id AS item_id, count(*) AS n_shingles FROM s WHERE kind = 1 GROUP BY 1)
SELECT a.id AS item_id, b.id AS doc_id, n_shingles, count(*) AS n_found, count(*) / n_shingles AS containment
FROM s a JOIN s b ON a.kind = 1 AND b.kind = 2 AND a.g = b.g AND a.k = b.k JOIN n ON n.item_id = a.id
GROUP BY a.id, b.id, n_shingles HAVING count(*) >= 0.8 * n_shingles
"""
