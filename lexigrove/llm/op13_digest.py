"""Document fingerprints: an improbable-feature digest in chained Bloom filters.

Every window of ``WINDOW`` bytes of a text has an entropy level, in thousandths of the highest possible. How often each level
occurs in all documents is counted first; the rarer a level, the better its rank. In every run of ``NEAR`` neighbouring windows
the leftmost one of best rank gets a vote, and windows with ``VOTES`` votes or more are the text's improbable features.
A text in which no window has as many gives its best one; one shorter than a window is a feature itself.

Features are hashed, each distinct one once, in order, into Bloom filters of 1,024 bits, five bits a feature; a filter that holds
``FULL`` features is followed by the next of the chain. Two filters are as alike as their common bits, less those that chance
explains, by the most that could be common. Each filter of the text with fewer features is compared with all of the other and
the best counts; a text's likeness is the mean over its features. Equal texts have likeness 1, an empty and another text 0.

``edited`` makes a version of each document whose last half comes from the next one by ascending doc_id. Texts are
range-partitioned by (doc_id, hash of the text, row number), so neither long runs of one id nor copies meet in one task; they are
moved compressed. Each partition is read in order; its first and last text are kept with the results, and the partitions are
then linked by these.

Null texts are empty; a null doc_id comes first. Repeated rows are documents of their own, equal ids in the order of their
texts' hashes. A single document is its own next one. Texts are walked in blocks, so windows of a very long text take bounded
memory beside the text; comparing two very long texts takes time by the product of their filters. Extra columns are ignored;
no rows give no rows.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrove.llm import kernel as K
from lexigrove.llm.common import rows, saved

WINDOW, NEAR, VOTES = 16, 16, 4
BITS, FULL, HASHES = 1024, 80, 5
LEVELS = 1001
BLOCK = 1 << 20
#: Characters of texts that are fingerprinted at once while a partition is read.
AT_ONCE = 1 << 18
_ONE = 1 << 20  # n log2 n in integers, so that sums of a rolling window never drift


def _steps(window: int) -> tuple[np.ndarray, int]:
    n = np.arange(1, window + 1)
    f = np.concatenate([[0], np.rint(n * np.log2(n) * _ONE).astype(np.int64)])
    return np.diff(f), int(f[-1])


def levels(data: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Entropy level of the window that begins at each byte; as many as there are windows.

    A byte that leaves or enters changes the sum of n log2 n over byte values by a step that depends on how many equal bytes
    stand within the window after or before it; these are counted by comparing the text with itself, moved by each distance.
    """
    if len(data) < window:
        return np.zeros(0, np.int64)
    step, most = _steps(window)
    after, before = np.zeros(len(data), np.uint8), np.zeros(len(data), np.uint8)
    for d in range(1, window):
        same = (data[d:] == data[:-d]).view(np.uint8)
        after[:-d] += same
        before[d:] += same
    sums = np.empty(len(data) - window + 1, np.int64)
    n = np.bincount(data[:window])
    sums[0] = step[: window][np.concatenate([np.arange(k) for k in n[n > 0].tolist()])].sum()
    sums[1:] = step[before[window:]] - step[after[: -window]]
    np.cumsum(sums, out=sums)
    return (1000 * (most - sums) + most // 2) // most


def blocks(data: np.ndarray, extra: int):
    """(begin, block) over a buffer; blocks reach ``extra`` bytes into the next one."""
    for at in range(0, max(len(data) - extra, 0), BLOCK):
        yield at, data[at : at + BLOCK + extra]


def level_counts(docs: DataFrame) -> np.ndarray:
    """How many windows of all texts have each level; the driver gets at most ``LEVELS`` rows."""
    def run(batches):
        total = np.zeros(LEVELS, np.int64)
        for b in batches:
            for _, _, data, off in K.slices(b.column(0)):
                inside = windows(off, len(data))
                for at, block in blocks(data, WINDOW - 1):
                    found = levels(block)
                    total += np.bincount(found[inside[at : at + len(found)]], minlength=LEVELS)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total)), pa.array(total[total > 0])], ["level", "n"])

    total = np.zeros(LEVELS, np.int64)
    for r in rows(docs.select("text"), run, "level long, n long").groupBy("level").agg(F.sum("n").alias("n")).collect():
        total[r.level] = r.n
    return total


def windows(off: np.ndarray, n: int) -> np.ndarray:
    """True where a window begins that lies within one text."""
    inside = np.ones(n, bool)
    for k in range(1, WINDOW):
        at = off[1:] - k
        inside[at[at >= off[:-1]]] = False
    return inside


def ranks(counts: np.ndarray) -> np.ndarray:
    """The rarest level first; windows of one repeated byte come last, however rare."""
    order = np.argsort(np.where(np.arange(LEVELS) == 0, np.iinfo(np.int64).max, counts), kind="stable")
    out = np.empty(LEVELS, np.int64)
    out[order] = np.arange(LEVELS)
    return out


def selected(data: np.ndarray, off: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Where the improbable windows of texts begin; texts without a whole window have none."""
    inside, votes, size = windows(off, len(data)), np.zeros(len(data), np.uint8), np.diff(off)
    # a run of neighbours counts where all its windows lie within one text
    edge, many = np.zeros(len(data) + 1, np.int32), size >= WINDOW + NEAR - 1
    np.add.at(edge, off[:-1][many], 1)
    np.subtract.at(edge, off[1:][many] - (WINDOW + NEAR - 2), 1)
    whole = np.cumsum(edge[:-1]).astype(bool)
    for at, block in blocks(data, WINDOW + NEAR - 2):
        best = np.where(inside[at : at + len(block) - WINDOW + 1], rank[levels(block)], LEVELS) << 32 | np.arange(len(block) - WINDOW + 1)
        n, width = len(best), 1
        while width < NEAR:  # NEAR is a power of two: runs of twice the width from two runs
            best = np.minimum(best[:-width], best[width:])
            width *= 2
        votes[at : at + n] += np.bincount(best[whole[at : at + len(best)]] & 0xFFFFFFFF, minlength=n).astype(np.uint8)
    found = np.flatnonzero(votes >= VOTES)
    without = np.flatnonzero((size >= WINDOW) & (np.diff(np.searchsorted(found, off)) == 0))
    return np.sort(np.concatenate([found, np.array([best_window(data, off[i], off[i + 1], rank) for i in without.tolist()], np.int64)]))


def best_window(data: np.ndarray, begin: int, end: int, rank: np.ndarray) -> int:
    """Where the window of best rank begins, the leftmost of equal ones."""
    least, where = LEVELS + 1, begin
    for at, block in blocks(data[begin:end], WINDOW - 1):
        found = rank[levels(block)]
        k = int(found.argmin())
        if found[k] < least:
            least, where = int(found[k]), begin + at + k
    return where


class Prints:
    """Fingerprints of many texts: the number of distinct features and the filters of each."""

    def __init__(self, texts: list[bytes], rank: np.ndarray):
        data = np.frombuffer(b"".join(texts), np.uint8)
        off = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
        at = selected(data, off, rank) if len(data) >= WINDOW else np.zeros(0, np.int64)
        view, seen = memoryview(data), xxhash.xxh3_64_intdigest
        doc = np.searchsorted(off, at, "right") - 1
        short = np.flatnonzero((np.diff(off) > 0) & (np.diff(off) < WINDOW))
        h = [seen(view[i : i + WINDOW]) for i in at.tolist()] + [seen(texts[i]) for i in short.tolist()]
        doc, at, h = np.concatenate([doc, short]), np.concatenate([at, off[short]]), np.array(h, np.uint64)
        order = np.lexsort((at, h, doc))
        doc, at, h = doc[order], at[order], h[order]
        first = np.ones(len(h), bool)
        first[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
        doc, at, h = doc[first], at[first], h[first]
        order = np.lexsort((at, doc))
        doc, h = doc[order], h[order]
        self.n = np.bincount(doc, minlength=len(texts))
        chain = -(-self.n // FULL)
        self.begin = np.concatenate([[0], np.cumsum(chain)])
        place = np.arange(len(doc)) - np.repeat(np.cumsum(self.n) - self.n, self.n)
        bits = np.zeros((int(self.begin[-1]), BITS), bool)
        for k in range(HASHES):
            bits[self.begin[doc] + place // FULL, ((h >> np.uint64(12 * k)) & np.uint64(BITS - 1)).astype(np.int64)] = True
        self.filters = np.packbits(bits, axis=1).view(np.uint64) if len(bits) else np.zeros((0, BITS // 64), np.uint64)

    def of(self, i: int) -> tuple[int, np.ndarray]:
        return int(self.n[i]), self.filters[self.begin[i] : self.begin[i + 1]]

    def text(self, i: int) -> str:
        """Number of features, a colon, the filters in base 64."""
        n, filters = self.of(i)
        return f"{n}:{base64.b64encode(filters.tobytes()).decode()}"

    def packed(self, i: int) -> bytes:
        """Number of features in 8 bytes, the filters."""
        n, filters = self.of(i)
        return n.to_bytes(8, "big") + filters.tobytes()


def shown(packed: str) -> F.Column:
    """What ``Prints.text`` gives, of a column of what ``Prints.packed`` gives."""
    number = F.conv(F.hex(F.substring(F.col(packed), 1, 8)), 16, 10)
    filters = F.expr(f"substring({packed}, 9)")
    return F.concat(number, F.lit(":"), F.translate(F.base64(filters), "\r\n", "")).alias(packed)  # one line


def read(fingerprint: str) -> tuple[int, np.ndarray]:
    n, filters = fingerprint.split(":")
    return int(n), np.frombuffer(base64.b64decode(filters), np.uint64).reshape(-1, BITS // 64)


def likeness(x: tuple[int, np.ndarray], y: tuple[int, np.ndarray]) -> float:
    """Normalised bit overlap of two fingerprints, 0 to 1."""
    if not x[0] or not y[0]:
        return float(x[0] == y[0])
    if x[0] > y[0]:
        x, y = y, x
    forth = toward(x, y)
    return max(forth, toward(y, x)) if x[0] == y[0] else forth


def toward(x: tuple[int, np.ndarray], y: tuple[int, np.ndarray]) -> float:
    n, a = x
    b = y[1]
    size_a, size_b = np.bitwise_count(a).sum(1, dtype=np.int64), np.bitwise_count(b).sum(1, dtype=np.int64)
    held = np.minimum(FULL, n - FULL * np.arange(len(a)))
    at_once = max(1, (1 << 16) // len(b))
    total = 0.0
    for i in range(0, len(a), at_once):
        s, best = size_a[i : i + at_once, None], np.zeros(len(a[i : i + at_once]))
        for j in range(0, len(b), 1 << 16):
            t = size_b[None, j : j + (1 << 16)]
            common = np.bitwise_count(a[i : i + at_once, None] & b[None, j : j + (1 << 16)]).sum(2, dtype=np.int64)
            chance = s * t / BITS
            extra = common - chance
            score = np.where(extra > 3 * np.sqrt(chance), extra / (np.minimum(s, t) - chance), 0.0)
            best = np.maximum(best, score.max(1))
        total += float((best * held[i : i + at_once]).sum())
    return min(1.0, total / n)


def changed(text: str, after: str) -> str:
    """The text with its last floor(n / 2) characters replaced by the first as many of ``after``, or all it has."""
    k = len(text) // 2
    return text[: len(text) - k] + after[:k]


_FIELDS = "part int, head string, tail string, doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
_NAMES = [f.split()[0] for f in _FIELDS.split(", ")]
_TYPES = [{"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64()}[f.split()[1]] for f in _FIELDS.split(", ")]


def batch(found: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*found)) if found else [[]] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], _NAMES)


def results(pairs: list[tuple[int, str, str]], rank: np.ndarray) -> list[tuple]:
    """Result rows of (doc_id, text, next text), with no part, head or tail."""
    same = len(pairs) > 1 and all(a[2] is b[1] for a, b in zip(pairs, pairs[1:]))  # each next text is the row after it
    edits = [changed(t, after).encode() for _, t, after in pairs]
    own = [t.encode() for _, t, _ in pairs]
    nexts = [pairs[-1][2].encode()] if same else [t.encode() for _, _, t in pairs]
    n, made = len(pairs), Prints(own + edits + nexts, rank)
    out = []
    for i, (doc, t, _) in enumerate(pairs):
        after = min(i + 1, n) if same else n + i
        after = after if same and after < n else (2 * n if same else 2 * n + i)
        me, ed = made.of(i), made.of(n + i)
        out.append((None, None, None, doc, len(t), hashlib.sha256(edits[i]).hexdigest(), made.packed(i), made.packed(n + i), likeness(me, ed), likeness(me, made.of(after))))
    return out


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rank = ranks(level_counts(own))

    def pack(batches):
        small = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([small(t.as_py().encode()) for t in b.column(3)], pa.binary())], ["doc_id", "h", "row", "text"])

    def walk(batches):
        part, wait, held, first, whole = TaskContext.get().partitionId(), [], 0, True, zstandard.ZstdDecompressor().decompress
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                text = whole(text.as_py()).decode()
                if first:
                    yield batch([(part, text, None, *[None] * 7)])
                    first = False
                wait.append((doc, text))
                held += len(text)
                if held > AT_ONCE and len(wait) > 1:
                    yield batch(results([(d, t, after) for (d, t), (_, after) in zip(wait, wait[1:])], rank))
                    wait, held = wait[-1:], len(text)
        if len(wait) > 1:
            yield batch(results([(d, t, after) for (d, t), (_, after) in zip(wait, wait[1:])], rank))
        if wait:
            yield batch([(part, None, wait[-1][1], wait[-1][0], *[None] * 6)])

    order = [F.col("doc_id").asc_nulls_first(), F.col("h"), F.col("row")]
    put = own.select("doc_id", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("row"), "text")
    put = rows(put, pack, "doc_id long, h long, row long, text binary").repartitionByRange(*order).sortWithinPartitions(*order)
    done = saved(rows(put.select("doc_id", "text"), walk, _FIELDS))
    # one first and one last text a partition; only the partitions' numbers come to the driver
    heads = done.where(F.col("head").isNotNull()).select(F.col("part").alias("after"), "head")
    parts = sorted(r.after for r in heads.select("after").collect())
    follow = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, after int")
    tails = done.where(F.col("tail").isNotNull()).select("part", "doc_id", "tail").join(F.broadcast(follow), "part").join(heads, "after")

    def link(batches):
        for b in batches:
            for doc, text, after in zip(*(b.column(i).to_pylist() for i in range(3))):
                yield batch(results([(doc, text, after)], rank))

    out = ["doc_id", "n_chars", "edited_sha256", shown("fingerprint"), shown("edited_fingerprint"), "near_edited", "near_next"]
    return done.where("head IS NULL AND tail IS NULL").select(*out).unionByName(rows(tails.select("doc_id", "tail", "head"), link, _FIELDS).select(*out))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of every row; no shuffle but that of level counts. ``likeness`` compares two after ``read``."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rank = ranks(level_counts(own))

    def run(batches):
        for b in batches:
            for p, q, data, off in K.slices(b.column(1)):
                made = Prints([data[i:j].tobytes() for i, j in zip(off.tolist(), off[1:].tolist())], rank)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(p, q - p), pa.array([made.text(i) for i in range(q - p)], pa.string())], ["doc_id", "fingerprint"])

    return rows(own, run, "doc_id long, fingerprint string")
