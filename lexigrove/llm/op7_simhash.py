"""SimHash near-duplicates: BK-trees over shards of fingerprints.

1. Fingerprint: majority bits of the XXH64 (seed 42) of 3-word shingles, words lower-cased (A-Z).
2. Distinct fingerprints only go on, so copies cost nothing more.
3. Shards: the 64 bits fall into six blocks; two fingerprints with at most three differing bits agree on at least
   three whole blocks, so each fingerprint goes to the 20 shards "these three blocks have these values" and every
   linked pair meets in one. About 32 bits are fixed in a shard, so unlike fingerprints seldom meet, at any scale.
   Shards above ``HEAVY`` fingerprints are dealt out again as cells of two salts each, which keeps every pair.
4. In a shard a BK-tree (children keyed by their integer Hamming distance to the parent) finds, following only
   edges within the radius, the earlier fingerprints within three bits; only links that join two parts of the shard
   are emitted (a spanning forest), never all pairs.
5. Components: alternating large-star and small-star rounds on the links as DataFrame joins and minima, each
   round written to the shared folder.

Null or empty texts have fingerprint zero and link like any other. Null ids stay in the result and never become a
component's id unless the component has no other. Repeated rows stay (``one_of_each`` keeps one of rows that repeat wholly); extra columns
of any name are ignored (or kept as they are); no rows give no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrove.llm import kernel as K
from lexigrove.llm.common import forget, rows, saved

RADIUS = 3
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
#: Fingerprints of a shard, or of half a cell of a heavy shard, that one tree holds at most.
HEAVY = 4096


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


MASKS = [_signed(sum(((1 << w) - 1) << s for s, w in c)) for c in combinations(BLOCKS, 3)]


def fingerprints(col: pa.Array, k: int = 3) -> np.ndarray:
    """uint64 fingerprint of each text."""
    out = np.zeros(len(col), np.uint64)
    digest = xxhash.xxh64_intdigest
    for a, b, data, off in K.slices(col):
        w = K.Words(data, off, lower=True)
        low = w.data.copy()
        low[~w.inside] = 32
        low, bounds = low.tobytes(), w.bounds
        starts, ends = w.starts, w.ends
        single = (starts[1:] - ends[:-1] == 1) if len(starts) else np.zeros(0, bool)
        for i in range(b - a):
            p, q = bounds[i], bounds[i + 1]
            n = q - p
            if not n:
                continue
            if single[p : q - 1].all():  # words already stand one blank apart
                text, s, e = low, starts[p:q], ends[p:q]
            else:
                text = b" ".join(low[off[i] : off[i + 1]].split())
                size = ends[p:q] - starts[p:q]
                e = np.cumsum(size + 1) - 1
                s = e - size
            s, e = (s[:1], e[-1:]) if n < k else (s[: n - k + 1], e[k - 1 :])
            h = np.fromiter((digest(text[x:y], 42) for x, y in zip(s.tolist(), e.tolist())), np.uint64, len(s))
            ones = np.zeros(64, np.int64)
            for j in range(0, len(h), 4096):
                ones += np.unpackbits(h[j : j + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            out[a + i] = np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0]
    return out


class BKTree:
    """A node is (fingerprint, {distance to it: child})."""

    def __init__(self):
        self.root = None

    def add(self, x: int) -> None:
        if self.root is None:
            self.root = (x, {})
            return
        node = self.root
        while True:
            d = (node[0] ^ x).bit_count()
            child = node[1].get(d)
            if child is None:
                if d:
                    node[1][d] = (x, {})
                return
            node = child

    def near(self, x: int, radius: int = RADIUS) -> list[int]:
        """Every member within the radius; only edges whose distance can lead there are followed."""
        found, todo = [], [self.root] if self.root else []
        while todo:
            y, children = todo.pop()
            d = (y ^ x).bit_count()
            if d <= radius:
                found.append(y)
            if len(children) <= 2 * radius + 1:
                todo += [c for e, c in children.items() if d - radius <= e <= d + radius]
            else:
                todo += [c for e in range(d - radius, d + radius + 1) if (c := children.get(e))]
        return found


def spanning_links(members: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links of a forest that connects what is linked among ``members`` (order and repeats do not matter)."""
    members = sorted(set(members))
    if len(members) == 2:
        a, b = members
        return [(a, b)] if (a ^ b).bit_count() <= radius else []
    parent = {x: x for x in members}

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    tree, out = BKTree(), []
    for x in members:
        for y in tree.near(x, radius):
            a, b = top(x), top(y)
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((y, x))
        tree.add(x)
    return out


def links(prints: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """(a, b): spanning links of every shard, from distinct fingerprints ``fp`` (long)."""
    dealt = prints.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("v")) for i, m in enumerate(MASKS)])).alias("s")).select("fp", F.col("s.t").alias("t"), F.col("s.v").alias("v"))
    sizes = dealt.groupBy("t", "v").count().where(F.col("count") > 1)
    shards = dealt.join(sizes, ["t", "v"])  # what is alone in its shard goes no further
    parts = F.ceil(F.col("count") / heavy).cast("int")
    salt = F.pmod(F.xxhash64("fp"), F.greatest(parts, F.lit(1))).cast("int")
    cells = shards.select("fp", "t", "v", salt.alias("i"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("j"))
    cells = cells.select("fp", F.xxhash64("t", "v", F.least("i", "j"), F.greatest("i", "j")).alias("cell"))
    # two cells with one hash only share a tree, which finds the same links

    def run(batches):
        cell, members = None, []
        for b in batches:
            keys, fps = b.column(0).to_numpy(), b.column(1).to_numpy()
            cuts = np.flatnonzero(np.diff(keys)) + 1
            a, c = [], []
            for s, e in zip(np.concatenate([[0], cuts]).tolist(), [*cuts.tolist(), len(keys)]):
                if e == s:
                    continue
                if keys[s] != cell:
                    if len(members) > 1:
                        for x, y in spanning_links(members):
                            a.append(x), c.append(y)
                    cell, members = keys[s], []
                members += fps[s:e].view(np.uint64).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(np.array(v, np.uint64).view(np.int64)) for v in (a, c)], names=["a", "b"])
        if len(members) > 1:
            x = spanning_links(members)
            yield pa.RecordBatch.from_arrays([pa.array(np.array([v[i] for v in x], np.uint64).view(np.int64)) for i in (0, 1)], names=["a", "b"])

    ordered = cells.repartition("cell").sortWithinPartitions("cell").select("cell", "fp")
    return rows(ordered, run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node with an edge other than to itself.

    Alternating stars (Kiveris and others 2014): the large star links a node's larger neighbours to its smallest
    one, the small star its smaller neighbours. Minima are partial aggregates and the joins are plain equi-joins,
    so AQE can split a hub's rows.
    """
    e = saved(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:  # every round but the last shortens the paths, so it ends
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        mins = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(mins, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(mins.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        new = saved(small)
        now = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        forget(e)
        e = new
        if now == before:
            out = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
            out._lexigrove_path = e._lexigrove_path
            return out
        before = now


def groups(printed: DataFrame) -> DataFrame:
    """From rows with ``fp``: (fp, root), one row for each fingerprint, as a saved table."""
    distinct = saved(printed.select("fp").distinct())
    found = components(links(distinct))
    out = saved(distinct.join(found.select("node", "root"), distinct.fp == found.node, "left").select("fp", F.coalesce("root", "fp").alias("root")))
    forget(distinct)
    forget(found)
    return out


def printed(docs: DataFrame, *also: str) -> DataFrame:
    """``doc_id``, the columns ``also`` and ``fp`` (long) of every row."""
    names = ["doc_id", *also]

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(names))), pa.array(fingerprints(b.column(len(names))).view(np.int64))], names=[*names, "fp"])

    part = docs.select(*names, "text")
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in part.schema.fields[:-1]), "fp long"])
    return rows(part, run, schema)


def simhash_groups(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id for every row; extra columns are ignored, repeated rows stay."""
    prints = saved(printed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")))
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    linked = groups(prints)
    roots = linked.join(least, "fp")
    ids = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    found = saved(roots.join(ids, "root").select("fp", "component_id"))
    forget(linked)
    return prints.join(found, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(spark, docs: DataFrame) -> DataFrame:
    """The columns and rows of ``docs`` with one row of each group: that with the smallest doc_id (nulls last).

    A row is known by its id and a hash of its text, so rows without ids and ids used twice are told apart;
    rows that repeat wholly are one.
    """
    # the row goes along as one column, so that no name of its own can clash
    known = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"))
    prints = saved(printed(docs.select("doc_id", F.xxhash64("text").alias("h"), "text"), "h"))
    roots = groups(prints)
    firsts = prints.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("doc_id"), F.col("h").alias("h"))).alias("s"))
    kept = firsts.join(roots, "fp").groupBy("root").agg(F.min("s").alias("s")).select(F.col("s.doc_id").alias("kept_id"), F.col("s.h").alias("kept_h"))
    count = prints.groupBy("doc_id", "h").count()
    kept = saved(kept.join(count, kept.kept_id.eqNullSafe(count.doc_id) & (kept.kept_h == count.h)).select("kept_id", "kept_h", "count"))
    forget(roots)
    forget(prints)
    joined = known.join(kept, known.id.eqNullSafe(kept.kept_id) & (known.h == kept.kept_h))
    if not kept.where("count > 1").limit(1).count():
        return joined.select("row.*")
    once = joined.where("count = 1").select("row.*")
    again = joined.where("count > 1").dropDuplicates(["id", "h"]).select("row.*")
    return once.unionByName(again)
