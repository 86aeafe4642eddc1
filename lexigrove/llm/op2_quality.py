"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded, and learned filters of ``WIDTH`` bytes, ``STRIDE`` apart, run over the whole document. Windows
belong to overlapping chunks (``CHUNK`` windows, half of them shared with the next chunk); each filter is max-pooled
within a chunk. The largest, smallest and mean pooled value of every filter over the chunks, and the logarithm of the length, go through one hidden
layer to one probability. The smallest value tells what a whole chunk lacks, such as variety of words.

Null texts count as empty, and an empty text has one window of padding, so every text has a score. Whole texts are
read whatever their length; repeated rows get equal scores. Fitting uses ``SAMPLE`` texts of each class at most;
without both classes every score is the share of the class there is (0.5 without labels). Extra columns are
ignored by ``quality_scores`` and kept by ``good``; no rows give no rows; of equal pooled values the first window's filter learns.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lexigrove.llm import kernel as K
from lexigrove.llm.common import fold, keep, labelled, rows

DEPTH, WIDTH, STRIDE, FILTERS, HIDDEN = 8, 16, 4, 32, 16
#: Windows of half a chunk: a chunk is two halves, and consecutive chunks share one.
HALF = 64
SAMPLE = 1000
EPOCHS = 14
#: Padding before and after a text, as a byte that UTF-8 never uses.
PAD = 255


def padded(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One stream in which each text starts at a multiple of STRIDE, with its number of windows.

    A text of n bytes stands after WIDTH - STRIDE bytes of padding and has enough padding behind it that windows
    STRIDE apart cover every byte.
    """
    n = np.diff(off)
    windows = np.maximum(1, -(-(n + WIDTH - STRIDE) // STRIDE))
    size = windows * STRIDE
    begin = np.concatenate([[0], np.cumsum(size)])
    out = np.full(int(begin[-1]) + WIDTH, PAD, np.uint8)
    if len(data):
        out[np.arange(len(data)) + np.repeat(begin[:-1] + WIDTH - STRIDE - off[:-1], n)] = data
    return out, windows


def halves(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of each half chunk in the stream of windows, and the halves of each text as bounds."""
    k = -(-windows // HALF)
    bounds = np.concatenate([[0], np.cumsum(k)])
    first = np.concatenate([[0], np.cumsum(windows)[:-1]])
    return np.repeat(first - bounds[:-1] * HALF, k) + np.arange(bounds[-1]) * HALF, bounds


class Net:
    def __init__(self, seed: int = 3):
        r = np.random.default_rng(seed)
        f = np.float32
        self.p = {
            "emb": r.normal(0, 0.5, (256, DEPTH)).astype(f),
            "conv": r.normal(0, (DEPTH * WIDTH) ** -0.5, (DEPTH * WIDTH, FILTERS)).astype(f),
            "conv_b": np.zeros(FILTERS, f),
            "w1": r.normal(0, (3 * FILTERS) ** -0.5, (3 * FILTERS + 1, HIDDEN)).astype(f),
            "b1": np.zeros(HIDDEN, f),
            "w2": r.normal(0, HIDDEN**-0.5, HIDDEN).astype(f),
            "b2": np.zeros(1, f),
        }
        self.constant: float | None = None

    def windows(self, stream: np.ndarray, a: int, b: int) -> np.ndarray:
        e = self.p["emb"][stream[a * STRIDE : (b - 1) * STRIDE + WIDTH]].reshape(-1)
        step = e.strides[0]
        return np.lib.stride_tricks.as_strided(e, (b - a, WIDTH * DEPTH), (STRIDE * DEPTH * step, step))

    def activations(self, stream: np.ndarray, total: int) -> np.ndarray:
        out = np.empty((total, FILTERS), np.float32)
        for a in range(0, total, 8192):
            b = min(total, a + 8192)
            np.dot(np.ascontiguousarray(self.windows(stream, a, b)), self.p["conv"], out=out[a:b])
        out += self.p["conv_b"]
        return out

    def pool(self, half: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Chunks from maxima of halves (a text of one half is one chunk), and their bounds by text."""
        k = np.diff(bounds)
        last = np.zeros(len(half), bool)
        last[bounds[1:] - 1] = True
        chunk = half.copy()
        np.maximum(chunk[:-1], half[1:], out=chunk[:-1], where=~last[:-1, None])
        use = ~last | np.repeat(k == 1, k)
        return chunk[use], np.concatenate([[0], np.cumsum(np.maximum(k - 1, 1))])

    def head(self, chunk: np.ndarray, cb: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, ...]:
        s = np.maximum(chunk, 0)
        n = np.diff(cb)[:, None].astype(np.float32)
        v = np.concatenate([np.maximum.reduceat(s, cb[:-1]), np.minimum.reduceat(s, cb[:-1]), np.add.reduceat(s, cb[:-1]) / n, np.log(windows)[:, None].astype(np.float32) / 4], axis=1)
        h = np.tanh(v @ self.p["w1"] + self.p["b1"])
        return s, v, h, 1 / (1 + np.exp(-np.clip(h @ self.p["w2"] + self.p["b2"], -30, 30)))

    def scores(self, col: pa.Array) -> np.ndarray:
        out = np.zeros(len(col))
        if self.constant is not None:
            return out + self.constant
        for a, b, data, off in K.slices(col, 1 << 20):
            stream, windows = padded(data, off)
            act = self.activations(stream, int(windows.sum()))
            start, bounds = halves(windows)
            out[a:b] = self.head(*self.pool(np.maximum.reduceat(act, start, axis=0), bounds), windows)[3]
        return out

    def step(self, texts: pa.Array, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the weighted log loss; only the windows that won a maximum receive any."""
        data, off = K.as_arrays(texts)
        stream, windows = padded(data, off)
        total = int(windows.sum())
        act = self.activations(stream, total)
        start, bounds = halves(windows)
        half = np.maximum.reduceat(act, start, axis=0)
        chunk, cb = self.pool(half, bounds)
        s, v, h, p = self.head(chunk, cb, windows)
        g = {}
        dz = (p - y) * weight
        g["w2"], g["b2"] = h.T @ dz, np.array([dz.sum()])
        dh = np.outer(dz, self.p["w2"]) * (1 - h * h)
        g["w1"], g["b1"] = v.T @ dh, dh.sum(0)
        dv = (dh @ self.p["w1"].T).astype(np.float32)
        n = np.diff(cb)
        k = np.repeat(np.arange(len(n)), n)
        top, low, mean = dv[:, :FILTERS], dv[:, FILTERS : 2 * FILTERS], dv[:, 2 * FILTERS : 3 * FILTERS]
        is_top, is_low = s == v[k, :FILTERS], s == v[k, FILTERS : 2 * FILTERS]
        share = lambda m: m / np.maximum(np.add.reduceat(m.astype(np.float32), cb[:-1]), 1)[k]  # noqa: E731  ties share
        ds = share(is_top) * top[k] + share(is_low) * low[k] + mean[k] / n[k, None]
        ds *= chunk > 0
        # chunk -> the half that won -> the window that won
        nh = np.diff(bounds)
        one = np.repeat(nh == 1, nh)
        last = np.zeros(len(half), bool)
        last[bounds[1:] - 1] = True
        owner = np.flatnonzero(~last | one)
        both = np.flatnonzero(~one[owner])
        dhalf = np.zeros_like(half)
        second = np.zeros(chunk.shape, bool)
        second[both] = half[owner[both] + 1] > half[owner[both]]
        dhalf[owner] += np.where(second, 0, ds)
        dhalf[owner[both] + 1] += np.where(second[both], ds[both], 0)
        size = np.diff(np.append(start, total))
        hid = np.repeat(np.arange(len(start)), size)
        r, f = np.nonzero(act == half[hid])
        keep = dhalf[hid[r], f] != 0
        r, f = r[keep], f[keep]
        _, first = np.unique(hid[r] * FILTERS + f, return_index=True)  # the first of equal windows
        r, f = r[first], f[first]
        dact = dhalf[hid[r], f]
        g["conv_b"] = np.bincount(f, dact, FILTERS)
        rows_, at = np.unique(r, return_inverse=True)
        d = np.zeros((len(rows_), FILTERS), np.float32)
        np.add.at(d, (at, f), dact)
        bytes_ = stream[rows_[:, None] * STRIDE + np.arange(WIDTH)]
        x = self.p["emb"][bytes_].reshape(len(rows_), -1)
        g["conv"] = x.T @ d
        de = (d @ self.p["conv"].T).reshape(-1, DEPTH)
        g["emb"] = np.stack([np.bincount(bytes_.ravel(), de[:, i], 256) for i in range(DEPTH)], axis=1)
        return g

    def fit(self, sample: list[tuple[str, int]], epochs: int = EPOCHS, batch: int = 32, rate: float = 4e-3, seed: int = 3) -> Net:
        y = np.array([l for _, l in sample], np.float32)
        if not len(y) or y.min() == y.max():
            self.constant = float(y[0]) if len(y) else 0.5
            return self
        texts = pa.array([t for t, _ in sample], pa.string())
        w = np.where(y > 0, 0.65 / y.mean(), 0.35 / (1 - y.mean()))  # losing a clean text counts more
        rng, m, v, t = np.random.default_rng(seed), {}, {}, 0
        steps = epochs * -(-len(y) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for i in range(0, len(y), batch):
                at = order[i : i + batch]
                g = self.step(texts.take(pa.array(at)), y[at], (w[at] / len(at)).astype(np.float32))
                t += 1
                lr = rate * min(1, t / 20) * (1 - t / (steps + 1))
                for k, x in g.items():
                    x = x.astype(np.float32)
                    m[k] = 0.9 * m.get(k, 0) + 0.1 * x
                    v[k] = 0.99 * v.get(k, 0) + 0.01 * x * x
                    self.p[k] -= (lr * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-7)).astype(np.float32)
        return self


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Net:
    return Net().fit(labelled(docs, labels, "quality", most))


SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def quality_scores(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; extra columns are ignored."""
    net = fit(docs, labels, most)

    def run(batches):
        for b in batches:
            s = net.scores(b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return rows(docs.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "text"), run, SCHEMA)


def good(docs: DataFrame, labels: DataFrame, least: float = 0.5, most: int = SAMPLE) -> DataFrame:
    """Rows of ``docs`` with a score of at least ``least``."""
    net = fit(docs, labels, most)
    return keep(docs, lambda: lambda col: net.scores(col) >= least)
