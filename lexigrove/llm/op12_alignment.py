"""Cross-tokenizer alignment: which tokens of one vocabulary stand for which tokens of another.

A is a byte-level BPE, B a SentencePiece BPE with byte fallback. A text is encoded with a blank before it. Tokens of A and B
that share bytes are joined in a bipartite graph; union-find gives its components, which are exactly the minimal groups of
tokens between two places where tokens of both end. Every A-B pair of occurrences in a group is a link. How many documents
hold an id pair linked is counted over the whole corpus, and each document's links are then valued by those counts.

Chunks: no token of A or B goes over a blank that follows something other than white space, so a text falls apart there;
inside chunks of more than ``LONG`` bytes it also falls apart between two pre-tokens of A whose neighbouring characters stand
beside each other in no piece of B. Each distinct chunk is encoded and grouped once a task, within a memo of bounded size.

Counting: tasks add up their pairs before the shuffle. The commonest pairs, at most ``SHIPPED`` of them by a threshold on
their counts, go to every task with their counts (8 bytes a pair). A pair beyond them stands in few documents, so the join by
which it gets its count has no hot key. The best count of each A id has one row an id of A at most.

Null and empty texts, and texts whose tokens do not give back their bytes (they hold U+2581), have no tokens: zeros and an
empty digest. Texts of any length are encoded whole. Repeated rows are documents of their own. Pairs of equal count are all
best. Extra columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import hashlib
import os
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrove.llm import bpe
from lexigrove.llm import kernel as K
from lexigrove.llm.common import TOKENIZERS, forget, rows, saved

#: Pairs whose counts are shipped to every task; the others are joined.
SHIPPED = 1 << 20
#: Bytes of chunks and results a task remembers, and of a chunk that is cut further.
MEMO, LONG = 64 << 20, 256
#: Links of one group beyond which they are counted by distinct ids at once.
MANY = 4096
_B = 1 << 15  # ids of B stay below this, those of A below 2^16, so a pair is an integer of 32 bits


def read(path: str = TOKENIZERS) -> tuple[bytes, bytes]:
    """The two vocabulary files' bytes (4 MB), read by the driver and shipped."""
    with open(f"{path}/byte_bpe_50k.json", "rb") as a, open(f"{path}/piece_bpe_32k.model", "rb") as b:
        return a.read(), b.read()


def overlaps(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges of the graph: (token of A, token of B) that share bytes, from the places where tokens end."""
    ends = np.union1d(a_ends, b_ends)  # between two such places there is one token of each side
    return np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends)


def components(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Union-find over arrays: for each of ``n`` nodes the smallest node that edges (x, y) connect it with.

    Each round hangs the larger root of every edge under the smaller one and then shortens all paths to their roots; chains
    of tokens halve with each round.
    """
    root = np.arange(n)
    while True:
        p, q = root[x], root[y]
        apart = p != q
        if not apart.any():
            return root
        x, y, p, q = x[apart], y[apart], p[apart], q[apart]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The ranges begin:begin+size one after another."""
    total = np.cumsum(size)
    return np.repeat(begin - (total - size), size) + np.arange(total[-1] if len(total) else 0)


class Aligner:
    """Both tokenizers, and a memo of the tokens, groups and links of chunks."""

    def __init__(self, files: tuple[bytes, bytes]):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_buffer(files[0])
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=files[1])
        n, m = self.a.get_vocab_size(), self.b.get_piece_size()
        # a token of A is written in characters that stand for bytes: printable ones for themselves, the rest from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        a_bytes = [bytes(byte[c] for c in self.a.id_to_token(i)) for i in range(n)]
        pieces = [self.b.id_to_piece(i) for i in range(m)]
        b_bytes = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_bytes, self.b_bytes = pa.array(a_bytes, pa.large_binary()), pa.array(b_bytes, pa.large_binary())
        self.a_size, self.b_size = (np.array([len(x) for x in v], np.int64) for v in (a_bytes, b_bytes))
        self.beside = {two for i, p in enumerate(pieces) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i)) for two in zip(p.replace("▁", " "), p.replace("▁", " ")[1:])}
        #: An id and what follows it in a digest: ids of A before a comma and before a bar, then those of B before a comma and before a semicolon.
        self.written = pa.array([f"{i}{c}".encode() for k, c in ((n, ","), (n, "|"), (m, ","), (m, ";")) for i in range(k)], pa.large_binary())
        self.first = np.array([0, n, 2 * n, 2 * n + m])
        self.words, self.blank = regex.compile(bpe.PATTERN), regex.compile(r"\s")
        self.fresh()

    def fresh(self) -> None:
        self.known: dict[bytes, int] = {}
        self.strings = pa.array([], pa.large_binary())
        self.numbers, self.begin, self.held = np.zeros((0, 5), np.int64), np.zeros(1, np.int64), 0
        self.pairs, self.times = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def within(self, chunk: bytes) -> list[int]:
        """Places (in bytes) where a long chunk may be cut: between pre-tokens of A, not behind white space, where no piece of B lies across."""
        s, out, at, size = chunk.decode(), [], 0, 0
        for m in self.words.finditer(s):
            i = m.start()
            if i and (s[i - 1], s[i]) not in self.beside and not self.blank.match(s[i - 1]):
                size += len(s[at:i].encode())
                at = i
                out.append(size)
        return out

    def tokens(self, chunks: list[bytes]) -> list[np.ndarray]:
        """Ids and how many a chunk, of A and of B. A line break is in no piece, so one before a chunk keeps it from getting a blank of B's own."""
        texts = [c.decode() for c in chunks]
        a = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        b = [ids[2:] for ids in self.b.encode(["\n" + t for t in texts], num_threads=1)]
        out = []
        for lists in (a, b):
            size = np.fromiter(map(len, lists), np.int64, len(lists))
            out += [np.fromiter(chain.from_iterable(lists), np.int64, int(size.sum())), size]
        return out

    def learn(self, chunks: list[bytes]) -> None:
        """Adds chunks to the memo: n_a, n_b, n_groups, n_links, whether bytes differ, the digest's part, links and how often each."""
        a, a_n, b, b_n = self.tokens(chunks)
        bad = np.zeros(len(chunks), bool)
        whole = b"".join(chunks)
        if not (joined(self.a_bytes, a) == whole == joined(self.b_bytes, b)):
            at, bt = np.cumsum(a_n) - a_n, np.cumsum(b_n) - b_n
            for i, c in enumerate(chunks):
                bad[i] = not (joined(self.a_bytes, a[at[i] : at[i] + a_n[i]]) == c == joined(self.b_bytes, b[bt[i] : bt[i] + b_n[i]]))
            a, b = a[~np.repeat(bad, a_n)], b[~np.repeat(bad, b_n)]
            a_n, b_n = np.where(bad, 0, a_n), np.where(bad, 0, b_n)
        x, y = overlaps(np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b]))
        root = components(len(a) + len(b), x, y + len(a))
        # roots are tokens of A, in order; members of a group are consecutive on both sides
        _, group = np.unique(root, return_inverse=True)
        n = int(group.max()) + 1 if len(group) else 0
        g_a, g_b = np.bincount(group[: len(a)], minlength=n), np.bincount(group[len(a) :], minlength=n)
        chunk_a = np.concatenate([[0], np.cumsum(a_n)])
        bounds = np.searchsorted(np.cumsum(g_a) - g_a, chunk_a)  # groups of each chunk
        n_links = K.sums(g_a * g_b, bounds)
        self.add_links(a, b, g_a, g_b, bounds)
        # the digest in order: each group's tokens of A, then those of B, each with what follows it
        last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last_a[np.cumsum(g_a) - 1] = last_b[np.cumsum(g_b) - 1] = 1
        codes = np.concatenate([a + self.first[last_a], b + self.first[2 + last_b]])
        order = np.argsort(group * 2 + (np.arange(len(group)) >= len(a)), kind="stable")
        parts = self.written.take(pa.array(codes[order]))
        ends = np.concatenate([[0], np.cumsum(a_n + b_n)])
        places = np.frombuffer(parts.buffers()[1], np.int64)[parts.offset :][: len(parts) + 1][ends] if len(parts) else np.zeros(len(ends), np.int64)
        strings = pa.Array.from_buffers(pa.large_binary(), len(chunks), [None, pa.py_buffer(np.ascontiguousarray(places)), parts.buffers()[2]]) if len(parts) else pa.array([b""] * len(chunks), pa.large_binary())
        self.strings = pa.concat_arrays([self.strings, strings])
        self.known.update(zip(chunks, range(len(self.known), len(self.known) + len(chunks))))
        self.numbers = np.concatenate([self.numbers, np.stack([a_n, b_n, np.diff(bounds), n_links, bad], axis=1).astype(np.int64)])
        self.held += len(whole) + int(places[-1]) + 200 * len(chunks)

    def add_links(self, a: np.ndarray, b: np.ndarray, g_a: np.ndarray, g_b: np.ndarray, bounds: np.ndarray) -> None:
        """Links of every chunk; a group of many tokens is first counted by distinct ids."""
        begin_a, begin_b = np.cumsum(g_a) - g_a, np.cumsum(g_b) - g_b
        wide = np.flatnonzero(g_a * g_b > MANY)
        size = np.where(g_a * g_b > MANY, 0, g_a * g_b)
        k = spread(np.zeros(len(size), np.int64), size)
        of = np.repeat(np.arange(len(size)), size)
        pairs, times = a[begin_a[of] + k // g_b[of]] * _B + b[begin_b[of] + k % g_b[of]], np.ones(len(of), np.int64)
        for g in wide.tolist():
            i, m = np.unique(a[begin_a[g] : begin_a[g] + g_a[g]], return_counts=True)
            j, n = np.unique(b[begin_b[g] : begin_b[g] + g_b[g]], return_counts=True)
            pairs, times, of = np.concatenate([pairs, np.add.outer(i * _B, j).ravel()]), np.concatenate([times, np.outer(m, n).ravel()]), np.concatenate([of, np.full(len(i) * len(j), g)])
        if len(wide):
            order = np.argsort(of, kind="stable")
            pairs, times, of = pairs[order], times[order], of[order]
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.searchsorted(of, bounds[1:])])
        self.pairs = np.concatenate([self.pairs, (pairs - (1 << 31)).astype(np.int32)])
        self.times = np.concatenate([self.times, times])
        self.held += 12 * len(pairs)

    def cuts(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        cut = np.zeros(len(data) + 1, bool)
        # behind control signs and Unicode blanks nothing is cut, so white space of every kind stays together
        if len(data):
            cut[1:-1] = ((data[1:] == 32) & (data[:-1] > 32) & ~bpe.odd_blanks(data)[:-1])
        cut[off] = True
        places = np.flatnonzero(cut)
        for i in np.flatnonzero(np.diff(places) > LONG).tolist():
            cut[places[i] + np.array(self.within(data[places[i] : places[i + 1]].tobytes()), np.int64)] = True
        return np.flatnonzero(cut)

    def __call__(self, data: np.ndarray, off: np.ndarray):
        """(numbers, digests, bounds of links, links, how often each) of the texts of a slice."""
        full = np.diff(off) > 0
        data = np.insert(data, off[:-1][full], 32)
        off = off + np.concatenate([[0], np.cumsum(full)])
        cuts = self.cuts(data, off)
        starts, ends = cuts[:-1], cuts[1:]
        bounds = np.searchsorted(starts, off)
        codes, found = K.distinct(data, starts, ends)
        found = found.to_pylist()
        if self.held > MEMO:
            self.fresh()
        new = [c for c in found if c not in self.known]
        if new:
            self.learn(new)
        at = np.fromiter((self.known[c] for c in found), np.int64, len(found))[codes]
        numbers = K.sums(self.numbers[at], bounds)
        numbers[numbers[:, 4] > 0] = 0
        some = numbers[:, 0] > 0
        parts = self.strings.take(pa.array(at))
        places = np.frombuffer(parts.buffers()[1], np.int64)[parts.offset :][: len(at) + 1][bounds].tolist() if len(at) else [0] * len(off)
        text = memoryview(parts.buffers()[2] or b"") if len(at) else b""
        digests = [hashlib.sha256(text[p : q - 1]).hexdigest() if ok else "" for ok, p, q in zip(some.tolist(), places, places[1:])]
        at = at[np.repeat(some, np.diff(bounds))]
        size = self.begin[at + 1] - self.begin[at]
        where = spread(self.begin[at], size)
        doc = np.repeat(np.repeat(np.arange(len(off) - 1), np.where(some, np.diff(bounds), 0)), size)
        key = doc * (1 << 32) + (self.pairs[where].astype(np.int64) + (1 << 31))
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        times = np.add.reduceat(self.times[where][order], first) if len(first) else np.zeros(0, np.int64)
        links = ((key[first] & 0xFFFFFFFF) - (1 << 31)).astype(np.int32)
        return numbers, digests, np.searchsorted(key[first] >> 32, np.arange(len(off))), links, times


def joined(spelled: pa.Array, ids: np.ndarray) -> bytes:
    """The bytes of tokens, joined."""
    got = spelled.take(pa.array(ids))
    if not len(got):
        return b""
    ends = np.frombuffer(got.buffers()[1], np.int64)[got.offset :]
    return bytes(memoryview(got.buffers()[2] or b"")[ends[0] : ends[len(got)]])


_made: dict[int, Aligner] = {}


def aligner(files: tuple[bytes, bytes]) -> Aligner:
    """One for a worker, as reading the files takes a second; what it remembers is dropped at a task's end."""
    key = hash(files)
    if key not in _made:
        _made[key] = Aligner(files)
    return _made[key]


_ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<int>, times array<long>"


def aligned(docs: DataFrame, files: tuple[bytes, bytes]) -> DataFrame:
    """Counts, digest and distinct links of every row of ``docs`` (row, doc_id, text); a link is a * 2^15 + b - 2^31."""
    def run(batches):
        made = aligner(files)
        for b in batches:
            for p, q, data, off in K.slices(b.column(2)):
                numbers, digests, bounds, links, times = made(data, off)
                bounds = pa.array(bounds.astype(np.int32))
                columns = [b.column(0).slice(p, q - p), b.column(1).slice(p, q - p), *(pa.array(numbers[:, i]) for i in range(4)), pa.array(digests, pa.string())]
                columns += [pa.ListArray.from_arrays(bounds, pa.array(links)), pa.ListArray.from_arrays(bounds, pa.array(times))]
                yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])
        made.fresh()

    return rows(docs, run, _ALIGNED)


def pair_counts(links: DataFrame) -> DataFrame:
    """pair, count: in how many rows of ``links`` (column pairs, distinct within a row) a pair stands."""
    def add(batches):
        pairs, counts = np.zeros(0, np.int32), np.zeros(0, np.int64)
        wait, waiting = [], 0
        for b in batches:
            wait.append(b.column(0).flatten().to_numpy())
            waiting += len(wait[-1])
            if waiting > max(len(pairs), 1 << 21):  # so that each merge at most doubles what is held
                pairs, counts = merged(pairs, counts, wait)
                wait, waiting = [], 0
                if len(pairs) > 1 << 22:  # a task holds 50 MB of pairs at most
                    yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(counts)], ["pair", "count"])
                    pairs, counts = pairs[:0], counts[:0]
        pairs, counts = merged(pairs, counts, wait)
        yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(counts)], ["pair", "count"])

    return rows(links.select("pairs"), add, "pair int, count long").groupBy("pair").agg(F.sum("count").alias("count"))


def merged(pairs: np.ndarray, counts: np.ndarray, more: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    new, n = np.unique(np.concatenate([pairs[:0], *more]), return_counts=True)
    every = np.concatenate([pairs, new])
    out, at = np.unique(every, return_inverse=True)
    total = np.zeros(len(out), np.int64)
    np.add.at(total, at, np.concatenate([counts, n]))
    return out, total


def commonest(counts: DataFrame, most: int) -> int:
    """The least count c such that at most ``most`` pairs have a count of c or more; found from sizes by powers of 2^(1/8)."""
    step = F.floor(8 * F.log2("count"))
    seen = 0
    for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.min("count").alias("least")).orderBy(F.desc("step")).collect():
        seen += r.n
        if seen > most:
            return least
        least = r.least
    return 0


def valued(links: DataFrame, counts: DataFrame, shipped: int) -> DataFrame:
    """``links`` with n_best and count_sum: sums over a row's links of (the count is the best of its A id) and of the count."""
    vocabulary = counts.groupBy(F.shiftright(F.col("pair").cast("long") + (1 << 31), 15).alias("a")).agg(F.max("count").alias("best")).toArrow()
    best = np.zeros(1 << 16, np.int64)
    best[vocabulary.column("a").to_numpy()] = vocabulary.column("best").to_numpy()
    floor = commonest(counts, shipped)
    common = counts.where(F.col("count") >= floor).toArrow()
    order = np.argsort(common.column("pair").to_numpy())
    told = counts.sparkSession.sparkContext.broadcast((common.column("pair").to_numpy()[order], common.column("count").to_numpy()[order], best))

    def look(batches):
        pairs, count, best = told.value
        good = np.concatenate([count == best[(pairs.astype(np.int64) + (1 << 31)) >> 15], [False]])
        count, pairs = np.concatenate([count, [0]]), np.concatenate([pairs, [np.iinfo(np.int32).max]])
        for b in batches:
            links, times = b.column(7), b.column(8)
            ends = links.offsets.to_numpy() - links.offsets[0].as_py()
            key, n = links.flatten().to_numpy(), times.flatten().to_numpy()
            at = np.searchsorted(pairs[:-1], key)
            hit = pairs[at] == key
            at = np.where(hit, at, len(pairs) - 1)
            rare = np.concatenate([[0], np.cumsum(~hit)]).astype(np.int32)[ends]
            sums = [pa.array(np.diff(np.concatenate([[0], np.cumsum(v)])[ends])) for v in (n * good[at], n * count[at])]
            lists = [pa.ListArray.from_arrays(pa.array(rare), pa.array(v[~hit])) for v in (key, n)]
            yield pa.RecordBatch.from_arrays([*b.columns[:7], *sums, *lists], [*b.schema.names[:7], "n_best", "count_sum", "pairs", "times"])

    one = rows(links, look, links.drop("pairs", "times").schema.simpleString()[7:-1] + ",n_best:bigint,count_sum:bigint,pairs:array<int>,times:array<bigint>")
    if floor == 0:
        return one.drop("pairs", "times")
    one = saved(one)
    rest = one.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("l")).select("row", F.col("l.pairs").alias("pair"), F.col("l.times").alias("times"))
    tops = counts.sparkSession.createDataFrame(vocabulary)  # one row an id of A, so its size is bounded
    rare = counts.where(F.col("count") < floor).withColumn("a", F.shiftright(F.col("pair").cast("long") + (1 << 31), 15)).join(F.broadcast(tops), "a")
    sums = rest.join(rare, "pair").groupBy("row").agg(F.sum(F.when(F.col("count") == F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("count")).alias("more_sum"))
    out = one.drop("pairs", "times").join(sums, "row", "left")
    return out.withColumn("n_best", F.col("n_best") + F.coalesce("more_best", F.lit(0))).withColumn("count_sum", F.col("count_sum") + F.coalesce("more_sum", F.lit(0)))


def alignment(docs: DataFrame, path: str = TOKENIZERS, shipped: int = SHIPPED) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of ``docs`` (doc_id, text)."""
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    links = saved(aligned(numbered, read(path)))
    counts = saved(pair_counts(links))
    return valued(links, counts, shipped).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def translation(docs: DataFrame, path: str = TOKENIZERS) -> DataFrame:
    """a, b, count of every id pair linked in ``docs``, and best: whether no pair of the same A id has a higher count."""
    numbered = docs.select(F.lit(0).cast("long").alias("row"), F.lit(0).cast("long").alias("doc_id"), "text")
    key = F.col("pair").cast("long") + (1 << 31)
    counts = saved(pair_counts(aligned(numbered, read(path)))).select(F.shiftright(key, 15).alias("a"), (key % _B).alias("b"), "count")
    return counts.join(counts.groupBy("a").agg(F.max("count").alias("most")), "a").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))
