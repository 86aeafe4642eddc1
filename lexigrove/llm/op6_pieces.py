"""SentencePiece encoding and decoding with N-best segmentation.

The lattice of a text has an edge for every piece of a public model that matches at a place, with the piece's score; a
character in no piece is spelled in byte pieces. A forward Viterbi pass gives the best score from the start to
every place. An A* search runs backward from the end with those scores as heuristic; they are exact, so complete
segmentations leave the agenda in the order of their scores: the best, the second best, and so on.

No edge spans a place between two characters that stand beside each other in no piece, so the lattice falls into
chunks there: N-best lists of distinct chunks are computed once, and the lists of a text are combined exactly.

As the model prescribes: one blank is put before a text and taken away when decoding; nothing else is normalised, so
decoding gives back the text exactly (U+2581 in a text is spelled in bytes). Null and empty texts have no pieces.
Texts of any length are encoded whole; repeated rows get equal results. Equal scores: the longer last piece first.
Extra columns are ignored; no rows give no rows.
"""

from __future__ import annotations

from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrove.llm import kernel as K
from lexigrove.llm.common import TOKENIZERS, rows

NBEST = 3
BLANK = "▁"
STRAY = "\ud800"
INF = float("inf")


def read(path: str = TOKENIZERS) -> bytes:
    """The model file's bytes (0.5 MB), read by the driver and shipped."""
    with open(f"{path}/piece_bpe_32k.model", "rb") as f:
        return f.read()


class Codec:
    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.byte = {}
        self.score: dict[str, tuple[float, int]] = {}
        text: list[bytes] = []
        for i, p in enumerate(self.pieces):
            if sp.is_byte(i):
                self.byte[int(p[3:-1], 16)] = i
                text.append(bytes([int(p[3:-1], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i):
                text.append(b"")
            else:
                self.score[p] = (sp.get_score(i), i)
                text.append(p.replace(BLANK, " ").encode())
        self.longest = max(map(len, self.score))
        #: A cut between two ASCII characters is safe where no piece holds the one behind the other.
        self.cut = np.zeros((256, 256), bool)
        self.cut[:128, :128] = True
        for p in self.score:
            t = p.replace(BLANK, " ")
            for x, y in zip(t, t[1:]):
                if x < "\x80" and y < "\x80":
                    self.cut[ord(x), ord(y)] = False
        self.size = np.array([len(t) for t in text], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(text), np.uint8)
        self.tables()
        self.memo = Memo(self)

    def search(self, s: str, n: int) -> list[tuple[float, list[int]]]:
        """The ``n`` best segmentations of a prepared chunk, best first."""
        size, get, longest = len(s), self.score.get, self.longest
        best = [0.0]
        edges: list = [None]  # by end: (start, score, ids)
        for j in range(1, size + 1):
            here, top = [], -INF
            for i in range(j - longest if j > longest else 0, j):
                if e := get(s[i:j]):
                    here.append((i, e[0], e[1]))
                    if (v := best[i] + e[0]) > top:
                        top = v
            if s[j - 1] not in self.score:
                c = BLANK if s[j - 1] == STRAY else s[j - 1]
                here.append((j - 1, 0.0, tuple(self.byte[x] for x in c.encode("utf-8", "replace"))))
                top = max(top, best[j - 1])
            edges.append(here)
            best.append(top)
        # A*: what is pushed has the exact score of one segmentation, so nothing below the n best known is pushed; of equal
        # scores the one nearest to the start goes on first, so that ties don't fan out
        out, agenda, tie = [], [(-best[size], size, 0, 0.0, None)], 0
        known = [best[size]] + [-INF] * (n - 1)
        while agenda and len(out) < n:
            f, at, _, tail, path = heappop(agenda)
            if not at:
                ids: list[int] = []
                while path:
                    ids += path[0] if isinstance(path[0], tuple) else (path[0],)
                    path = path[1]
                out.append((tail, ids))
                continue
            same = True
            for i, sc, e in edges[at]:
                v = tail + sc + best[i]
                if v == -INF:
                    continue
                if same and v >= -f - 1e-6:
                    same = False  # goes on with the segmentation that was popped
                elif v > known[-1]:
                    known[-1] = v
                    known.sort(reverse=True)
                elif v < known[-1]:
                    continue
                tie += 1
                heappush(agenda, (-v, i, tie, tail + sc, (e, path)))
        return out

    def tables(self) -> None:
        """Pieces by the hash of their code points, in two direct-mapped tables (a piece is in one of them)."""
        words = list(self.score)
        codes, at = _codes(words)
        h = K.Hasher(codes)(at[:-1], at[1:])
        self.key = np.append(h, np.uint64(0))
        #: Code points of each piece, by which every piece found by its hash is checked.
        self.spelled = np.zeros((len(words) + 1, self.longest), np.uint32)
        self.length = np.append(np.diff(at), 0)
        for k in range(self.longest):
            has = np.flatnonzero(self.length > k)
            self.spelled[has, k] = codes[at[has] + k]
        self.value = np.array([self.score[w][0] for w in words] + [-INF])
        self.ident = np.array([self.score[w][1] for w in words] + [-1], np.int32)
        self.first = np.full(1 << 19, len(words), np.int32)
        self.second = np.full(1 << 19, len(words), np.int32)
        slot = (h >> np.uint64(45)).astype(np.int64)
        self.first[slot] = np.arange(len(words), dtype=np.int32)
        rest = np.flatnonzero(self.first[slot] != np.arange(len(words)))
        for shift in range(44):  # the bits that keep the rest apart
            slot = ((h[rest] >> np.uint64(shift)) & np.uint64((1 << 19) - 1)).astype(np.int64)
            if len(np.unique(slot)) == len(rest):
                break
        else:
            raise ValueError("pieces collide; use larger tables")
        self.shift = np.uint64(shift)
        self.second[slot] = rest

    def find(self, h: np.ndarray) -> np.ndarray:
        """Index of the piece with each hash, or the last index for none."""
        none = len(self.key) - 1
        a = self.first[(h >> np.uint64(45)).astype(np.int64)]
        miss = np.flatnonzero(self.key[a] != h)
        b = self.second[((h[miss] >> self.shift) & np.uint64((1 << 19) - 1)).astype(np.int64)]
        a[miss] = np.where(self.key[b] == h[miss], b, none)
        return a

    def forward(self, strings: list[str]) -> tuple[list[list[int]], np.ndarray, np.ndarray]:
        """Best ids, best score and what the second best costs against it, of many prepared chunks at once.

        Alpha is the forward Viterbi score of every place, beta that of the rest of the chunk; the second best
        segmentation is the best through an edge that the best one does not use.
        """
        n = len(strings)
        codes, at = _codes(strings)
        hasher, size = K.Hasher(codes), np.diff(at)
        longest, high = self.longest, int(size.max())
        score = np.full((longest + 1, len(codes)), -INF)
        ident = np.full((longest + 1, len(codes)), -1, np.int32)
        end = np.repeat(at[1:], size)
        for k in range(1, min(longest, high) + 1):
            i = np.flatnonzero(np.arange(len(codes)) + k <= end)
            p = self.find(hasher(i, i + k))
            hit = np.flatnonzero(self.length[p] > 0)
            same = (self.length[p[hit]] == k) & (codes[i[hit, None] + np.arange(k)] == self.spelled[p[hit], :k]).all(1)
            p[hit[~same]] = len(self.key) - 1
            score[k, i], ident[k, i] = self.value[p], self.ident[p]
        order = np.argsort(-size, kind="stable")
        begin, length = at[:-1][order], size[order]
        alpha = np.full((high + 1, n), -INF)
        beta = np.full((high + 1, n), -INF)
        back = np.zeros((high + 1, n), np.int8)
        alpha[0] = 0
        live = [int(np.searchsorted(-length, -j, "right")) for j in range(high + 1)]  # chunks of at least j
        for j in range(1, high + 1):
            m = live[j]
            for k in range(min(longest, j), 0, -1):
                v = alpha[j - k, :m] + score[k, begin[:m] + j - k]
                better = v > alpha[j, :m]
                alpha[j, :m][better] = v[better]
                back[j, :m][better] = k
        beta[length, np.arange(n)] = 0
        for i in range(high - 1, -1, -1):
            for k in range(1, min(longest, high - i) + 1):
                w = live[i + k]
                np.maximum(beta[i, :w], score[k, begin[:w] + i] + beta[i + k, :w], out=beta[i, :w])
        best = alpha[length, np.arange(n)]
        used = np.zeros((longest + 1, len(codes)), bool)
        place, out = length.copy(), [[] for _ in range(n)]
        while True:
            go = np.flatnonzero(place > 0)
            if not len(go):
                break
            k = back[place[go], go].astype(np.int64)
            place[go] -= k
            where = begin[go] + place[go]
            used[k, where] = True
            for x, i in zip(go.tolist(), ident[k, where].tolist()):
                out[x].append(i)
        other = np.full(n, -INF)
        for i in range(high):
            for k in range(1, min(longest, high - i) + 1):
                w = live[i + k]
                spot = begin[:w] + i
                v = alpha[i, :w] + score[k, spot] + beta[i + k, :w]
                np.maximum(other[:w], np.where(used[k, spot], -INF, v), out=other[:w])
        ids: list = [None] * n
        top, loss = np.zeros(n), np.zeros(n)
        for x, i in enumerate(order.tolist()):
            ids[i] = out[x][::-1]
        top[order], loss[order] = best, best - other
        return ids, top, loss

    @staticmethod
    def prepared(text: str) -> str:
        """BLANK stands for a blank, STRAY (which no text holds) for U+2581 in the text."""
        return text.replace(BLANK, STRAY).replace(" ", BLANK) if BLANK in text else text.replace(" ", BLANK)

    def nbest(self, text: str, n: int = NBEST) -> list[tuple[float, list[int]]]:
        """N-best over the lattice of a whole text, without chunks."""
        return self.search(self.prepared(" " + text), n) if text else []

    def decode(self, ids) -> str:
        ids = np.asarray(ids, np.int64)
        return self.flat(ids).tobytes().decode("utf-8", "replace")[1:]

    def flat(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of the pieces, one after another."""
        size = self.size[ids]
        end = np.cumsum(size)
        return self.bytes[np.repeat(self.begin[ids] - (end - size), size) + np.arange(end[-1] if len(end) else 0)]

    def chunks(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(stream with a blank before every text that is not empty, its offsets, starts and ends of chunks)."""
        size = np.diff(off)
        grown = size + (size > 0)
        new = np.concatenate([[0], np.cumsum(grown)])
        stream = np.full(int(new[-1]), 32, np.uint8)
        stream[np.arange(len(data)) + np.repeat(new[:-1] + (size > 0) - off[:-1], size)] = data
        cut = np.zeros(len(stream) + 1, bool)
        cut[new] = True
        cut[1:-1] |= self.cut[stream[:-1], stream[1:]]
        cuts = np.flatnonzero(cut)
        return stream, new, cuts[:-1], cuts[1:]

    def encode(self, col: pa.Array):
        """(first row, row after the last, ids, bounds of ids by text, scores, stream, its offsets, others) by slice.

        ``scores`` has the N-best scores of each text, best first; NaN where there are fewer segmentations. ``others`` has
        the ids of the second, third... segmentation of each text, as many as there are.
        """
        for a, b, data, off in K.slices(col):
            stream, new, starts, ends = self.chunks(data, off)
            scores = np.full((b - a, NBEST), np.nan)
            if not len(starts):
                yield a, b, np.zeros(0, np.int32), np.zeros(b - a + 1, np.int64), scores, stream, new, [[] for _ in range(b - a)]
                continue
            at, rows_ = self.memo(stream, starts, ends)
            ids, size = self.memo.expand(at, rows_)
            bounds = np.searchsorted(starts, new)
            bounds[-1] = len(starts)
            row = rows_[at, 2]
            begin, others = np.concatenate([[0], np.cumsum(size)]), [[] for _ in range(b - a)]
            total, loss = K.sums(self.memo.best[row], bounds), self.memo.loss[row]
            for i in range(b - a):
                p, q = bounds[i], bounds[i + 1]
                if p < q:
                    # only the chunks whose second segmentation costs least can differ among the best of the text
                    k = min(NBEST - 1, q - p)
                    near = np.sort(p + np.argpartition(loss[p:q], k - 1)[:k]).tolist()
                    lists = [self.memo.others(int(row[x]), stream, starts[x], ends[x], ids[begin[x] : begin[x + 1]]) for x in near]
                    scores[i], picks = combined(total[i], [[cost for cost, _ in way] for way in lists])
                    for pick in picks[1:]:
                        parts, done = [], begin[p]
                        for x, way, entry in zip(near, lists, pick):
                            if entry:
                                parts += [ids[done : begin[x]], way[entry - 1][1]]
                                done = begin[x + 1]
                        others[i].append(np.concatenate([*parts, ids[done : begin[q]]]))
            yield a, b, ids, begin[bounds], scores, stream, new, others


def combined(best: float, losses: list[list[float]], n: int = NBEST) -> tuple[np.ndarray, list[tuple[int, ...]]]:
    """Scores of the ``n`` best ways to take one list entry of each chunk, and the entries that each way takes.

    ``losses``: for the chunks that can differ, what their second, third... entry costs against their first.
    """
    out = np.full(n, np.nan)
    ways: list[tuple[float, tuple[int, ...]]] = [(0.0, ())]
    for row in losses:
        ways = sorted((w + x, (*pick, i)) for w, pick in ways for i, x in enumerate((0.0, *row)))[:n]
    out[: len(ways)] = best - np.array([w for w, _ in ways])
    return out, [pick for _, pick in ways]


def _codes(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all strings, and the bounds of each."""
    size = np.fromiter(map(len, strings), np.int64, len(strings))
    return np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32), np.concatenate([[0], np.cumsum(size)])


class Memo(K.Pool):
    """Best ids of each chunk; rows are (offset, length, row in ``best`` and ``loss``)."""

    def __init__(self, codec: Codec, budget: int = 96 << 20):
        self.codec = codec
        super().__init__(None, budget)

    def fresh(self) -> None:
        super().fresh()
        self.best, self.loss, self.lists_ = np.zeros(0), np.zeros(0), {}

    def others(self, row: int, stream: np.ndarray, start: int, end: int, best: np.ndarray) -> list[tuple[float, np.ndarray]]:
        """(what it costs, ids) of the chunk's second, third... segmentation, by A*; ``best`` has the ids of the first."""
        if row not in self.lists_:
            c = self.codec
            ways = c.search(c.prepared(stream[start:end].tobytes().decode("utf-8", "replace")), NBEST)
            # of ways with equal scores, A* may find another one first
            first = best.tolist()
            self.lists_[row] = [(ways[0][0] - w, np.array(i, np.int32)) for w, i in ways if list(i) != first][: NBEST - 1]
            self.held += 400 + 8 * len(first)
        return self.lists_[row]

    def add(self, strings: list[bytes]) -> np.ndarray:
        c, n = self.codec, len(strings)
        text = [c.prepared(s.decode("utf-8", "replace")) for s in strings]
        found: list = [None] * n
        best, loss = np.zeros(n), np.full(n, INF)
        known = c.score.keys()
        plain = []
        for i, t in enumerate(text):
            if len(t) <= 48 and known >= set(t):
                plain.append(i)
            else:
                ways = c.search(t, 2)
                found[i], best[i] = ways[0][1], ways[0][0]
                if len(ways) > 1:
                    loss[i] = ways[0][0] - ways[1][0]
        for i in range(0, len(plain), 8192):
            at = plain[i : i + 8192]
            ids, top, cost = c.forward([text[x] for x in at])
            best[at], loss[at] = top, cost
            for x, f in zip(at, ids):
                found[x] = f
        self.lists = lambda _: found
        out = np.column_stack([super().add(strings), len(self.best) + np.arange(n)])
        self.best, self.loss = np.concatenate([self.best, best]), np.concatenate([self.loss, loss])
        return out


_codecs: dict[int, Codec] = {}


def codec(model: bytes) -> Codec:
    """One codec a Python worker; each task has a memo of its own."""
    key = hash(model)
    if key not in _codecs:
        _codecs[key] = Codec(model)
    return _codecs[key]


SCHEMA = "doc_id long, ids array<int>, scores array<double>, round_trip boolean, others array<array<int>>"


def encode(docs: DataFrame, path: str = TOKENIZERS) -> DataFrame:
    """doc_id, ids of the best segmentation, N-best scores, whether decoding gave the text back, and the ids of the other
    segmentations that have scores, for every row."""
    shipped = docs.sparkSession.sparkContext.broadcast(read(path))

    def run(batches):
        c = codec(shipped.value)
        for batch in batches:
            doc_ids = batch.column(0).cast(pa.int64())
            for a, b, ids, bounds, scores, stream, new, others in c.encode(batch.column(1)):
                back = c.flat(ids)
                size = np.concatenate([[0], np.cumsum(c.size[ids])])[bounds]
                same = np.diff(size) == np.diff(new)
                if len(back) == len(stream):
                    wrong = np.concatenate([[0], np.cumsum(back != stream)])
                    same &= wrong[new[1:]] == wrong[new[:-1]]
                else:
                    same &= [(back[s:e] == stream[p:q]).all() if e - s == q - p else False for s, e, p, q in zip(size, size[1:], new, new[1:])]
                flat = pa.array(scores.ravel(), from_pandas=True)  # NaN: there are fewer ways
                ways = [x for one in others for x in one]
                inner = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ways)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *ways]), pa.int32()))
                outer = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, others)]), pa.int32()), inner)
                yield pa.RecordBatch.from_arrays([doc_ids.slice(a, b - a), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids)), pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * NBEST), flat), pa.array(same), outer], names=["doc_id", "ids", "scores", "round_trip", "others"])
        c.memo.fresh()  # the worker lives on

    return rows(docs.select("doc_id", "text"), run, SCHEMA)


def digest(encoded: DataFrame) -> DataFrame:
    """Counts, scores and hashes of the ids of each segmentation."""
    s = [F.col("scores")[i].alias(name) for i, name in enumerate(("best_score", "second_score", "third_score"))]
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), *s, "round_trip", *(F.xxhash64(F.get("others", F.lit(i))).alias(name) for i, name in enumerate(("second_hash", "third_hash"))))
