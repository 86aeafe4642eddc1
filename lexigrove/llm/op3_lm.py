"""LM scoring: a causal self-attention model in numpy on subword ids.

What is scored is the sequence of lower-cased words (A-Z) of a text and one end. Every word is spelled in subword ids of
a public byte-level BPE (with a blank before it). The model gives each word a probability from the words before it:

    P(word | words before) = P(class | words before) * P(word | class)

*The first factor is causal self-attention.* A word comes in as the sum of the embeddings of its subword ids and of its
class; two heads with learned distances attend over the words before, and a softmax over ``CLASSES`` classes follows.
All its parameters are trained by Adam: the driver begins with a sample of windows, then every task goes on with all
windows of its training texts and the parameters of the tasks are averaged (``whole``). Scoring cuts the words of a text into blocks of
``BLOCK``; the window of a block also holds the ``BEFORE`` words in front of it, so windows overlap and each word (and
the end) is scored once, with masked attention over a batch of windows.

*The second factor* does not look at the context. The ``SINGLE`` commonest words (of all counts) are classes of their own. The
other classes are topics, found by EM over the subword ids of windows: rounds on the sample, then one over all training texts
(with their counts, ``count``), whose expected counts alone are the topics used (``topics``); a word's topic is the likeliest for its ids. Within a topic a
word's share is its count in all training documents, discounted (Pitman-Yor), and what the discount sets free goes to
the topic's spelling model: transitions between subword ids over all distinct training words. A spelling that is no word
of the topic is no outcome, so the spelling model is divided by the mass of those that are, which is measured on ``DRAWN``
spellings drawn from it (and taken two standard errors larger), so that shares do not sum to more than one.

Counts of words are exact: words are told apart by their bytes. They are counted per task, summed by word and
written to the shared folder; the most frequent ones (``TOP`` at most) are shipped to every task, the rest meets the
texts in a shuffle join on the word, pre-aggregated by text. Both scores use them all.

Null and empty texts have one token, the end. Texts of any length are scored whole; repeated rows get equal results, ties
do not matter, extra columns are ignored, no rows give no rows. Without training rows counts are zero and the attention is untrained.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from copy import copy

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrove.llm import bpe
from lexigrove.llm import kernel as K
from lexigrove.llm.common import TOKENIZERS, fold, forget, place, rows, saved

VOCABULARY = 50257
#: Beside the ids: the edge of a word in its spelling.
EDGE = VOCABULARY
SYMBOLS = VOCABULARY + 1
CLASSES, SINGLE = 64, 48
TOPICS = CLASSES - SINGLE
#: Class of the end.
END = 0
HEADS, DIM, VALUE = 2, 8, 16
QKV = HEADS * (2 * DIM + VALUE)
BLOCK, BEFORE = 16, 8
WINDOW = BLOCK + BEFORE
#: Training begins with windows of ``SAMPLE`` training documents and one in ``EVERY``, one window of up to ``STRIDE`` each; all windows follow.
SAMPLE, EVERY, STRIDE = 2400, 100, 8
#: Stands before each word in a window's ids; a window with more ids than ``LONGEST`` is not trained on.
MARK, LONGEST = 0xFFFF, 4096
TOP = 1 << 18
#: Slices whose distinct words are taken together, and how many distinct words these may be.
WIDE, MANY = 4, 200_000
#: Spellings drawn for each topic.
DRAWN = 6000
DISCOUNT = 0.5


class Spelling(K.Pool):
    """Subword ids of distinct words, each with a blank before it."""

    def __init__(self, vocabulary: bytes, budget: int = 32 << 20):
        def lists(words: list[bytes]) -> list[list[int]]:
            ids, bounds = spelled(words, vocabulary)
            ids, bounds = ids.tolist(), bounds.tolist()
            return [ids[a:b] for a, b in zip(bounds, bounds[1:])]

        super().__init__(lists, budget)


def spelled(words: list[bytes] | pa.Array, vocabulary: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Subword ids of words, each with a blank before it, one after another, and their bounds."""
    found = words if isinstance(words, pa.Array) else pa.array(words, pa.large_binary())
    found = found.cast(pa.large_binary())
    data, off = stored(found)
    text = np.full(len(data) + len(found), 32, np.uint8)
    inside = np.ones(len(text), bool)
    inside[off[:-1] + np.arange(len(found))] = False
    text[inside] = data
    got = bpe.spell_joined(text.tobytes().decode("utf-8", "replace"), len(found), vocabulary)
    return got or bpe.spell([w.decode("utf-8", "replace") for w in found.to_pylist()], vocabulary)


def stored(found: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a large_binary column."""
    if not len(found):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = found.buffers()
    off = np.frombuffer(off, np.int64)[found.offset : found.offset + len(found) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8))[off[0] : off[-1]], off - off[0]


def edges(size: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(size, dtype=np.int64)])


def parts(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, K.Words, np.ndarray, pa.Array]]:
    """(first row, row after the last, bounds of its slices in rows, words, code of each word, the distinct words) of consecutive rows.

    Up to ``WIDE`` slices share their distinct words, so that what depends on the word alone is made once for them; a slice
    stands alone where they would hold more than ``MANY``.
    """
    cuts = [(a, z) for a, z, _, _ in K.slices(col)]

    def part(some: list[tuple[int, int]]):
        a, z = some[0][0], some[-1][1]
        w = K.Words(*K.as_arrays(col.slice(a, z - a)), lower=True)
        # the bytes inside words are all words one after another
        every = pa.Array.from_buffers(pa.large_binary(), len(w.starts), [None, pa.py_buffer(edges(w.ends - w.starts)), pa.py_buffer(w.data[w.inside])]).dictionary_encode()
        return a, z, np.array([a, *(y for _, y in some)]) - a, w, every.indices.to_numpy().astype(np.int64), every.dictionary

    for i in range(0, len(cuts), WIDE):
        some = cuts[i : i + WIDE]
        one = part(some)
        if len(some) == 1 or len(one[-1]) <= MANY:
            yield one
        else:
            del one
            yield from (part([x]) for x in some)


def flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Lists one after another, and their bounds."""
    size = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter((x for one in lists for x in one), np.int64, int(size.sum())), np.concatenate([[0], np.cumsum(size)])


def windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From numbers of tokens by text: (first token of each block, its text, number of the block in its text)."""
    n = -(-counts // BLOCK)
    text = np.repeat(np.arange(len(n)), n)
    number = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    return (np.cumsum(counts) - counts)[text] + number * BLOCK, text, number


class Sample:
    """Windows of words for training: ``words`` (window, WINDOW + 1) holds places in ``ids``/``bounds``, -1 outside a text."""

    def __init__(self, packed: list[bytes], lead: np.ndarray):
        """``packed``: ids of each window's words, MARK before each; ``lead``: how many words each window lacks in front."""
        self.known: dict[bytes, int] = {}
        lists = []
        self.words = np.full((len(packed), WINDOW + 1), -1, np.int32)
        for i, raw in enumerate(packed):
            ids = np.frombuffer(raw, np.uint16)
            cut = np.flatnonzero(ids == MARK)
            parts = [ids[a:b].tobytes() for a, b in zip((cut + 1).tolist(), [*cut[1:].tolist(), len(ids)])]
            for j, p in enumerate(parts, int(lead[i])):
                at = self.known.setdefault(p, len(lists))
                if at == len(lists):
                    lists.append(np.frombuffer(p, np.uint16).tolist())
                self.words[i, j] = at
        self.lists = lists
        self.ids, self.bounds = flat(lists)
        there = self.words[:, BEFORE + 1 :]
        self.count = np.bincount(there[there >= 0], minlength=len(lists))


class Lexicon:
    """Class of every word, from its subword ids: SINGLE single words, then topics."""

    def __init__(self, sample: Sample, seed: int = 5, rounds: int = 12):
        end = (bpe.END,)
        order = np.argsort(-sample.count, kind="stable")
        single = [t for i in order[: SINGLE + 1].tolist() if sample.count[i] and (t := tuple(sample.lists[i])) != end]
        single = [end] + [t for t in single if len(t) <= 3][: SINGLE - 1]
        #: Spellings of up to three ids as one integer each, sorted, and their classes.
        key = np.array([sum((x + 1) << (17 * i) for i, x in enumerate(t)) for t in single], np.int64)
        self.single_key, self.single_kind = np.sort(key), np.argsort(key).astype(np.int32)
        used = np.unique(sample.ids)
        self.row = np.full(SYMBOLS, len(used), np.int32)
        self.row[used] = np.arange(len(used), dtype=np.int32)
        r = self.row[sample.ids]
        size = np.diff(sample.bounds)
        seen = sample.words >= 0
        at = np.where(seen, sample.words, len(size))
        base = np.bincount(r, np.repeat(sample.count, size), len(used)) + 1.0
        base /= base.sum()
        rng = np.random.default_rng(seed)
        #: log share of each id in each topic; ids never seen say nothing.
        self.theta = np.zeros((len(used) + 1, TOPICS), np.float32)
        if len(at):
            # each topic begins with a window of its own
            post = np.full((len(at), TOPICS), 1 / TOPICS, np.float32)
            first = rng.permutation(len(at))[:TOPICS]
            post[first] = np.eye(TOPICS, dtype=np.float32)[: len(first)]
            weight = np.full(len(at), 1e-3, np.float32)
            weight[first] = 1
            for _ in range(rounds):
                part = np.zeros((len(size) + 1, TOPICS))
                p = post * weight[:, None]
                for t in range(TOPICS):
                    part[:, t] = np.bincount(at.ravel(), np.repeat(p[:, t], at.shape[1]), len(size) + 1)
                n = np.zeros((len(used), TOPICS))
                by_id = np.repeat(part[:-1], size, axis=0)
                for t in range(TOPICS):
                    n[:, t] = np.bincount(r, by_id[:, t], len(used))
                n += 20 * base[:, None]
                self.theta[:-1] = np.log(n / n.sum(0))
                score = np.zeros((len(size) + 1, TOPICS), np.float32)
                score[:-1] = K.sums(self.theta[r], sample.bounds)
                z = np.zeros((len(at), TOPICS), np.float32)
                for j in range(at.shape[1]):
                    z += score[at[:, j]]
                z -= z.max(1, keepdims=True)
                post = np.exp(z)
                post /= post.sum(1, keepdims=True)
                weight[:] = 1

    def learned(self, single: list[tuple[int, ...]], ids: np.ndarray, n: np.ndarray) -> Lexicon:
        """The lexicon with these commonest words and topics from ``n`` (id, topic): how often each of ``ids`` (sorted) is expected in each."""
        out = copy(self)
        single = [(bpe.END,)] + [t for t in single if len(t) <= 3][: SINGLE - 1]
        key = np.array([sum((x + 1) << (17 * i) for i, x in enumerate(t)) for t in single], np.int64)
        out.single_key, out.single_kind = np.sort(key), np.argsort(key).astype(np.int32)
        out.row = np.full(SYMBOLS, len(ids), np.int32)
        out.row[ids] = np.arange(len(ids), dtype=np.int32)
        base = n.sum(1) + 1.0
        n = n + 20 * (base / base.sum())[:, None]
        out.theta = np.zeros((len(ids) + 1, TOPICS), np.float32)
        out.theta[:-1] = np.log(n / n.sum(0))
        return out

    def kinds(self, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Class of each spelled word; of likeliest topics the first."""
        if len(bounds) < 2:
            return np.zeros(0, np.int32)
        out = SINGLE + gathered(self.theta, self.row[ids], bounds).argmax(1).astype(np.int32)
        size, ids = np.diff(bounds), ids.astype(np.int64, copy=False)
        key = np.zeros(len(size), np.int64)
        for i in range(3):
            at = np.flatnonzero(size > i)
            key[at] += (ids[bounds[at] + i] + 1) << (17 * i)
        at = np.minimum(np.searchsorted(self.single_key, key), len(self.single_key) - 1)
        return np.where((self.single_key[at] == key) & (size <= 3), self.single_kind[at], out)


def gathered(table: np.ndarray, row: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of rows of ``table`` over consecutive ranges, the first of all ranges, then the second..., some ranges of like length at a time."""
    size = np.diff(bounds)
    sums, many = np.zeros((len(size), table.shape[1]), table.dtype), int(np.count_nonzero(size))
    order = np.argsort(65535 - size.astype(np.uint16) if len(size) and size.max() < 1 << 16 else -size, kind="stable")
    step = max(512, (1 << 18) // table.shape[1])
    table = np.ascontiguousarray(table)  # np.take copies whole rows, unlike an index
    more = np.empty((min(step, many), table.shape[1]), table.dtype)
    for a in range(0, many, step):
        some = order[a : min(a + step, many)]
        begin, falling = bounds[some], -size[some]
        n, j = len(some), 0
        part = np.take(table, row[begin], axis=0, out=sums[a : a + n], mode="clip")
        while True:
            j += 1
            n = int(np.searchsorted(falling[:n], -j, "left"))  # ranges of more than j
            if not n:
                break
            if n < 64 or n < 1024 and j >= 64:  # few long ones are left
                for i in range(n):  # one after another as below, so that a sum does not depend on the other ranges
                    rest = np.take(table, row[begin[i] + j : begin[i] - falling[i]], axis=0)
                    rest[0] += part[i]
                    part[i] = rest.sum(0)
                break
            part[:n] += np.take(table, row[begin[:n] + j], axis=0, out=more[:n], mode="clip")
    back = np.empty(len(size), np.int64)
    back[order] = np.arange(len(size))
    return np.take(sums, back, axis=0)


def ordered(key: np.ndarray) -> np.ndarray:
    """Stable order of integers that are not negative, by 16 bits at a time (numpy sorts those in one pass over the data)."""
    order = np.argsort(key.astype(np.uint16), kind="stable")
    if len(key) and key.max() >> 16:
        order = order[ordered((key >> 16)[order])]
    return order


def transitions(kind: np.ndarray, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Keys (topic, symbol before, symbol) of the spellings of words in topics, edges included."""
    n = np.diff(bounds)
    seq = np.full(len(ids) + len(n) + 1, EDGE, np.int64)
    seq[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n) + 1] = ids
    topic = np.repeat(kind.astype(np.int64) - SINGLE, n + 1)
    return ((topic * SYMBOLS + seq[:-1]) * SYMBOLS + seq[1:])[topic >= 0]


class Level:
    """Discounted shares of symbols after a context; what the discount sets free goes to the level below."""

    def __init__(self, key: np.ndarray, n: np.ndarray):
        """``key``: context * SYMBOLS + symbol, sorted."""
        self.key, self.n = key, n.astype(np.float64)
        context = key // SYMBOLS
        self.context, start = np.unique(context, return_index=True)
        self.bounds = np.append(start, len(key))
        self.total = K.sums(self.n, self.bounds)
        self.free = DISCOUNT * np.diff(self.bounds) / self.total if len(key) else np.zeros(0)

    def find(self, context: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.context, context), len(self.context) - 1)
        return np.where(self.context[at] == context, at, -1)

    def share(self, context: np.ndarray, symbol: np.ndarray, below: np.ndarray) -> np.ndarray:
        if not len(self.key):
            return below
        at, k = self.find(context), context * SYMBOLS + symbol
        e = np.minimum(np.searchsorted(self.key, k), len(self.key) - 1)
        own = np.where(self.key[e] == k, self.n[e] - DISCOUNT, 0.0)
        return np.where(at < 0, below, own / self.total[at] + self.free[at] * below)

    def draw(self, context: np.ndarray, rng) -> np.ndarray:
        """A symbol after each context, or -1 where the level below must be asked."""
        if not len(self.key):
            return np.full(len(context), -1)
        at = self.find(context)
        below = (at < 0) | (rng.random(len(at)) < self.free[at])
        cum = np.concatenate([[0.0], np.cumsum(self.n - DISCOUNT)])
        a, b = cum[self.bounds[at]], cum[self.bounds[at + 1]]
        e = np.searchsorted(cum, a + (b - a) * rng.random(len(at)), "right") - 1
        return np.where(below, -1, self.key[np.clip(e, self.bounds[at], self.bounds[at + 1] - 1)] % SYMBOLS)


class Speller:
    """Probability of a spelling in each topic; ``key``: transitions of all distinct training words, sorted, with counts ``n``."""

    def __init__(self, key: np.ndarray, n: np.ndarray):
        self.topic = Level(key, n)
        pair, inverse = np.unique(key % (SYMBOLS * SYMBOLS), return_inverse=True)
        self.pair = Level(pair, np.bincount(inverse, n, len(pair)))
        kinds = np.bincount(pair % SYMBOLS, minlength=SYMBOLS) + 0.05
        self.symbol = kinds / kinds.sum()
        self.log_mass = np.zeros(TOPICS)

    def logs(self, kind: np.ndarray, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """log10 probability of each word's spelling in its topic, against all spellings that are words of the topic."""
        topic = np.maximum(kind.astype(np.int64) - SINGLE, 0)
        found = pa.array(transitions(topic + SINGLE, ids, bounds)).dictionary_encode()
        key = found.dictionary.to_numpy()
        symbol, context = key % SYMBOLS, key // SYMBOLS
        p = self.pair.share(context % SYMBOLS, symbol, self.symbol[symbol])
        p = self.topic.share(context, symbol, p)
        return K.sums(np.log10(p)[found.indices.to_numpy()], bounds + np.arange(len(bounds))) - self.log_mass[topic]

    def draw(self, topic: np.ndarray, rng, steps: int = 40) -> list[list[int]]:
        """A spelling of each topic; unfinished ones after ``steps`` ids are empty."""
        out, before = np.full((len(topic), steps), EDGE), np.full(len(topic), EDGE)
        going = np.arange(len(topic))
        cum = np.cumsum(self.symbol)
        for s in range(steps):
            context = topic[going] * SYMBOLS + before[going]
            x = self.topic.draw(context, rng)
            miss = np.flatnonzero(x < 0)
            x[miss] = self.pair.draw(context[miss] % SYMBOLS, rng)
            miss = np.flatnonzero(x < 0)
            x[miss] = np.minimum(np.searchsorted(cum, rng.random(len(miss)), "right"), SYMBOLS - 1)
            out[going, s] = before[going] = x
            going = going[x != EDGE]
        out[going] = EDGE
        return [r[: n] for r, n in zip(out.tolist(), (out != EDGE).argmin(1).tolist())]

    def measure(self, lexicon: Lexicon, vocabulary: bytes, drawn: int = DRAWN, seed: int = 5) -> None:
        """Sets the mass of the spellings that are words of their topic, two standard errors up."""
        topic = np.repeat(np.arange(TOPICS), drawn)
        lists = self.draw(topic, np.random.default_rng(seed))
        kind = lexicon.kinds(*flat(lists))
        encoding, good = bpe.encoding(vocabulary), np.zeros(len(lists))
        for i in np.flatnonzero(kind == topic + SINGLE).tolist():
            raw = encoding.decode_bytes(lists[i]) if bpe.END not in lists[i] else b""
            if len(raw) > 1 and raw[0] == 32 and not K.SPACE[np.frombuffer(raw[1:], np.uint8)].any():
                try:
                    good[i] = encoding.encode_ordinary(raw.decode()) == lists[i]
                except UnicodeDecodeError:
                    pass
        mass = good.reshape(TOPICS, drawn).mean(1)
        self.log_mass = np.log10(np.minimum(mass + 2 * np.sqrt(np.maximum(mass * (1 - mass), 1 / drawn) / drawn), 1.0))


class Shares:
    """Pitman-Yor shares of words in their topics: discounts and open mass from counts of all training words."""

    def __init__(self, tokens: np.ndarray, types: np.ndarray, once: np.ndarray, twice: np.ndarray):
        self.discount = np.clip((once + 0.5) / (once + 2 * twice + 1), 0.05, 0.95)
        self.log_open = np.log10(1 + self.discount * types)
        self.log_norm = np.log10(tokens + 1.0)

    def open(self, kind: np.ndarray, spelled: np.ndarray) -> np.ndarray:
        """log10 of what a word has without its count; zero in classes of one word."""
        t = np.maximum(kind - SINGLE, 0)
        return np.where(kind < SINGLE, 0.0, self.log_open[t] + spelled)

    def logs(self, kind: np.ndarray, count: np.ndarray, opened: np.ndarray) -> np.ndarray:
        """log10 share in the class of words with ``count`` (0: not seen)."""
        t = np.maximum(kind - SINGLE, 0)
        own = np.log10(np.where(count > 0, count - self.discount[t], 0.0) + 10.0 ** np.maximum(opened, -290))
        return np.where(kind < SINGLE, 0.0, np.where(count > 0, own, opened) - self.log_norm[t])


class Attention:
    """Two heads over words; logits of classes. Row ``lexicon rows`` of ``ids`` is for ids never seen, the last class row for a text's start."""

    def __init__(self, lexicon: Lexicon, seed: int = 5):
        r, f, n = np.random.default_rng(seed), np.float32, len(lexicon.theta)
        scale = np.repeat([0.3, 0.3, 0.1], [HEADS * DIM, HEADS * DIM, HEADS * VALUE])
        gap = np.arange(WINDOW)
        self.row = lexicon.row
        self.p = {
            "ids": np.zeros((n, QKV), f), "classes": (r.normal(0, 1, (CLASSES + 1, QKV)) * scale).astype(f),
            "out": r.normal(0, 0.1, (HEADS * VALUE, CLASSES)).astype(f), "bias": np.zeros(CLASSES, f), "near": np.stack([-0.1 * gap, -1.0 * gap]).astype(f),
        }
        i, j = np.arange(BLOCK)[:, None] + BEFORE, np.arange(WINDOW)[None]
        self.gap = np.where(j <= i, i - j, -1)
        #: Goes on training after the sample, if set.
        self.rest: Callable[[Attention], None] | None = None

    def inputs(self, kind: np.ndarray, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Queries, keys and values of words, one row each."""
        x = gathered(self.p["ids"], self.row[ids], bounds)
        x += np.take(self.p["classes"], kind, axis=0)
        return x

    @property
    def start(self) -> np.ndarray:
        return self.p["classes"][CLASSES]

    def attend(self, now: np.ndarray, every: np.ndarray, front: np.ndarray):
        """``now`` (windows, BLOCK, QKV): the words before those to predict; ``every`` (windows, WINDOW, QKV): these and the BEFORE in front; ``front``: which of those exist.

        What stands behind a text's end is seen by nothing that counts, as the mask is causal.
        """
        n = len(now)
        heads = lambda a, d, y: y[..., a : a + HEADS * d].reshape(n, -1, HEADS, d).transpose(0, 2, 1, 3)
        q, k, v = heads(0, DIM, now) * now.dtype.type(DIM**-0.5), heads(HEADS * DIM, DIM, every), heads(2 * HEADS * DIM, VALUE, every)
        s = q @ k.transpose(0, 1, 3, 2)
        s += np.where(self.gap >= 0, self.p["near"][:, np.maximum(self.gap, 0)], np.float32(-60))
        np.clip(s, -60, 30, out=s)
        np.exp(s, out=s)
        bad = np.flatnonzero(~front.all(1))
        if len(bad):
            s[bad, :, :, :BEFORE] *= front[bad, None, None]
        s /= (s.reshape(-1, WINDOW) @ np.ones(WINDOW, s.dtype)).reshape(*s.shape[:3], 1) + np.float32(1e-30)
        o = np.empty((n, BLOCK, HEADS, VALUE), s.dtype)
        np.matmul(s, v, out=o.transpose(0, 2, 1, 3))
        return q, k, v, s, o.reshape(-1, HEADS * VALUE)

    @staticmethod
    def laid(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of each token when every text fills whole blocks and BEFORE places stand in front of all, text of each block, which blocks do not begin a text)."""
        n = -(-counts // BLOCK)
        text = np.repeat(np.arange(len(n)), n)
        first = np.cumsum(n) - n
        later = np.ones(len(text), bool)
        later[first[n > 0]] = False
        return np.arange(int(counts.sum())) + np.repeat(BEFORE + first * BLOCK - (np.cumsum(counts) - counts), counts), text, later[:, None]

    @staticmethod
    def views(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``now`` and ``every`` of blocks one after another, BEFORE rows in front; nothing is copied."""
        n = (len(x) - BEFORE) // BLOCK
        return x[BEFORE:].reshape(n, BLOCK, -1), np.lib.stride_tricks.as_strided(x, (n, WINDOW, x.shape[1]), (BLOCK * x.strides[0], *x.strides))

    def logs(self, x: np.ndarray, before: np.ndarray, kind: np.ndarray, counts: np.ndarray, batch: int = 256) -> np.ndarray:
        """Sum of log10 class probabilities by text.

        ``x``: inputs of words; by token (the end last in its text) ``before``, the place of its input in ``x``, and ``kind``; ``counts`` of tokens.
        """
        place, text, later = self.laid(counts)
        size = BEFORE + len(text) * BLOCK
        at, goal, live = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size, np.float32)
        at[place], goal[place], live[place] = before, kind, np.log10(np.e)
        goal += np.arange(-BEFORE, size - BEFORE) % (batch * BLOCK) * CLASSES
        part, ones = np.zeros(len(text)), np.ones(CLASSES, np.float32)
        for a in range(0, len(text), batch):
            z_ = min(a + batch, len(text))
            new = slice(BEFORE + a * BLOCK, BEFORE + z_ * BLOCK)
            y = np.take(x, at[a * BLOCK : new.stop], axis=0).astype(np.float32, copy=False)
            z = self.attend(*self.views(y), later[a:z_])[4] @ self.p["out"]
            z += self.p["bias"]
            hit = z.reshape(-1)[goal[new]]
            np.exp(z, out=z)
            hit -= np.log(z @ ones)
            hit *= live[new]
            part[a:z_] = hit.reshape(-1, BLOCK).sum(1, dtype=np.float64)
        return np.bincount(text, part, len(counts))

    def gradients(self, sample: Sample, kind: np.ndarray, words: np.ndarray, part: int = 128) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss of a batch of windows (natural logarithm a token) and its gradients, ``part`` windows at a time."""
        p, size = self.p, np.diff(sample.bounds)
        there = words[:, 1:] >= 0  # a text's start stands where the word before does not exist, but the word itself does
        # the words of the batch, -1 (a text's start) the first if it occurs
        seen = np.zeros(len(size) + 1, bool)
        seen[words[:, :-1] + 1] = True
        used = np.flatnonzero(seen) - 1
        place = (np.cumsum(seen) - 1).astype(np.uint16 if len(used) < 1 << 16 else np.int64)
        real = int(len(used) > 0 and used[0] < 0)
        long = size[used[real:]]
        bounds = np.concatenate([[0], np.cumsum(long)])
        row = self.row[sample.ids[np.repeat(sample.bounds[:-1][used[real:]] - bounds[:-1], long) + np.arange(bounds[-1])]]
        cls = np.concatenate([np.full(real, CLASSES), kind[used[real:]]])
        x = p["classes"][cls]
        x[real:] += gathered(p["ids"], row, bounds)
        many = max(1, int(there[:, BEFORE:].sum()))
        by_word, loss = np.zeros_like(x), 0.0
        g = self.zeros()
        for a in range(0, len(words), part):
            w = place[words[a : a + part, :-1] + 1]
            y, dx = x[w], np.zeros((len(w), WINDOW, QKV), x.dtype)
            here = there[a : a + part]
            lost, *d = self.shift(y[:, BEFORE:], y, here[:, :BEFORE], here[:, BEFORE:], kind[np.maximum(words[a : a + part, BEFORE + 1 :], 0)], many, g)
            dx[:, BEFORE:, : HEADS * DIM], dx[:, :, HEADS * DIM : 2 * HEADS * DIM], dx[:, :, 2 * HEADS * DIM :] = d
            loss += lost
            by_word += added(w.reshape(-1), dx.reshape(-1, QKV), len(x))
        g["near"] = self.by_gap(g.pop("gap"))
        g["classes"] = added(cls, by_word, CLASSES + 1)
        g["ids"] = added(row, np.repeat(by_word[real:], long, axis=0), len(p["ids"]))
        return loss / many, g

    def zeros(self) -> dict[str, np.ndarray]:
        """Where ``shift`` adds; "gap" becomes "near" in the end (``by_gap``)."""
        return {name: np.zeros_like(self.p[name]) for name in ("out", "bias")} | {"gap": np.zeros((HEADS, *self.gap.shape), self.p["near"].dtype)}

    def by_gap(self, ds: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(np.maximum(self.gap, 0).ravel(), np.where(self.gap >= 0, d, 0).ravel(), WINDOW) for d in ds])

    def shift(self, now: np.ndarray, every: np.ndarray, front: np.ndarray, live: np.ndarray, goal: np.ndarray, many: int, g: dict[str, np.ndarray]):
        """Sum of the losses of windows (as in ``attend``) and its gradients by queries, keys and values; those of the other parameters are added to ``g``.

        ``live``: which tokens there are to predict; ``goal``: their classes.
        """
        p, n = self.p, len(now)
        q, k, v, s, o = self.attend(now, every, front)
        z = o @ p["out"]
        z += p["bias"]
        at, live = np.arange(n * BLOCK) * CLASSES + goal.reshape(-1), live.reshape(-1)
        if max(z.max(), -z.min()) > 60:
            z -= z.max(1, keepdims=True)
        flat_ = z.reshape(-1)
        hit = flat_[at]
        np.exp(z, out=z)
        total = z @ np.ones(CLASSES, z.dtype)
        z *= (live / (total * z.dtype.type(many))).astype(z.dtype)[:, None]
        flat_[at] -= (live / many).astype(z.dtype)
        g["out"] += o.T @ z
        g["bias"] += np.ones(len(z), z.dtype) @ z
        do = z @ p["out"].T
        own = ((do * o).reshape(-1, VALUE) @ np.ones(VALUE, z.dtype)).reshape(n, BLOCK, HEADS).transpose(0, 2, 1)[..., None]
        do = do.reshape(n, BLOCK, HEADS, VALUE).transpose(0, 2, 1, 3)
        ds = do @ v.transpose(0, 1, 3, 2)
        ds -= own
        ds *= s
        g["gap"] += (np.ones(n, ds.dtype) @ ds.reshape(n, -1)).reshape(HEADS, BLOCK, WINDOW)
        dq, dk, dv = (np.empty((n, size, HEADS, d), z.dtype) for size, d in ((BLOCK, DIM), (WINDOW, DIM), (WINDOW, VALUE)))
        np.matmul(ds, k, out=dq.transpose(0, 2, 1, 3))
        dq *= dq.dtype.type(DIM**-0.5)
        np.matmul(ds.transpose(0, 1, 3, 2), q, out=dk.transpose(0, 2, 1, 3))
        np.matmul(s.transpose(0, 1, 3, 2), do, out=dv.transpose(0, 2, 1, 3))
        return float(((np.log(total) - hit) * live).sum()), dq.reshape(n, BLOCK, -1), dk.reshape(n, WINDOW, -1), dv.reshape(n, WINDOW, -1)

    def all_gradients(self, code: np.ndarray, counts: np.ndarray, kind: np.ndarray, ids: np.ndarray, bounds: np.ndarray, part: int = 256) -> dict[str, np.ndarray]:
        """Gradients of the mean loss over every window of some texts.

        ``code``: words of the texts (places in ``kind``, ``ids`` and ``bounds``); ``counts`` of words by text.
        """
        start, tokens = len(kind), counts + 1
        x = np.concatenate([self.inputs(kind, ids, bounds), self.start[None]])
        where, text, later = self.laid(tokens)
        size = BEFORE + len(text) * BLOCK
        ends = np.cumsum(tokens) - 1
        word = np.ones(len(where), bool)
        word[ends] = False
        at, goal, live = np.full(size, start, np.int64), np.full(size, END, np.int64), np.zeros(size, bool)
        own = where[word]
        at[own + 1], goal[own], live[where] = code, kind[code], True
        at[where[ends - counts]] = start
        g = self.zeros()
        dx, a1, a2 = np.empty((size, QKV), x.dtype), HEADS * DIM, 2 * HEADS * DIM
        dx[:BEFORE] = 0
        for a in range(0, len(text), part):
            z = min(a + part, len(text))
            new = slice(BEFORE + a * BLOCK, BEFORE + z * BLOCK)
            _, dq, dk, dv = self.shift(*self.views(np.take(x, at[a * BLOCK : new.stop], axis=0)), later[a:z], live[new], goal[new], len(where), g)
            d = dx[new].reshape(z - a, BLOCK, QKV)
            d[..., :a1], d[..., a1:a2], d[..., a2:] = dq, dk[:, BEFORE:], dv[:, BEFORE:]
            d = dx[a * BLOCK : z * BLOCK].reshape(z - a, BLOCK, QKV)[:, :BEFORE]  # what stands before a block is the end of the block before
            d[..., a1:a2] += dk[:, :BEFORE]
            d[..., a2:] += dv[:, :BEFORE]
        w = at[where]
        first = np.concatenate([[0], np.cumsum(np.bincount(w, minlength=len(x)))])
        by_word = gathered(dx, where[ordered(w)], first)
        g["near"], cls = self.by_gap(g.pop("gap")), np.append(kind, CLASSES)
        g["classes"] = gathered(by_word, np.argsort(cls, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(cls, minlength=CLASSES + 1))]))
        row, n = self.row[ids], len(self.p["ids"])
        g["ids"] = gathered(by_word, np.repeat(np.arange(len(kind)), np.diff(bounds))[ordered(row)], edges(np.bincount(row, minlength=n)))
        return g

    def train(self, sample: Sample, kind: np.ndarray, steps: int = 0, batch: int = 256, rate: float = 0.02, seed: int = 5) -> Attention:
        """Begins with two draws for each window of the sample, 250 steps at least, unless ``steps`` are given; then ``rest`` goes on with all windows."""
        rest, self.rest = self.rest, None
        if not len(sample.words):
            return self
        n = np.bincount(kind, sample.count, CLASSES) + 0.5
        self.p["bias"][:] = np.log(n / n.sum())
        steps = steps or max(250, -(-2 * len(sample.words) // batch))
        rng, adam = np.random.default_rng(seed), Adam()
        with self.only(sample.ids):
            for step in range(1, steps + 1):
                _, g = self.gradients(sample, kind, sample.words[rng.integers(0, len(sample.words), batch)])
                adam.step(self.p, g, rate * min(1, step / 20) * (1 - step / (steps + 1)))
        if rest:
            rest(self)
        return self

    @contextmanager
    def only(self, ids: np.ndarray):
        """Inside, only the rows of ``ids`` are there, as no others have gradients."""
        row, whole = self.row, self.p["ids"]
        used = np.unique(row[ids])
        self.row = np.zeros(len(row), np.int32)
        self.row[ids] = np.searchsorted(used, row[ids])
        self.p["ids"] = whole[used]
        try:
            yield used
        finally:
            whole[used] = self.p["ids"]
            self.row, self.p["ids"] = row, whole


class Adam:
    """Moments of gradients; the rows of subword ids move less."""

    def __init__(self):
        self.n, self.m, self.v = 0, {}, {}

    def step(self, p: dict[str, np.ndarray], g: dict[str, np.ndarray], rate: float) -> None:
        self.n += 1
        for name, d in g.items():
            d = d.astype(np.float32)
            self.m[name] = 0.9 * self.m.get(name, 0) + 0.1 * d
            self.v[name] = 0.99 * self.v.get(name, 0) + 0.01 * d * d
            p[name] -= (rate * (0.3 if name == "ids" else 1) * (self.m[name] / (1 - 0.9**self.n)) / (np.sqrt(self.v[name] / (1 - 0.99**self.n)) + 1e-8)).astype(np.float32)


def added(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by place."""
    order = np.argsort(at, kind="stable")
    s = at[order]
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
    out = np.zeros((n, values.shape[1]), np.float32)
    if len(s):
        out[s[first]] = np.add.reduceat(values[order], first, axis=0)
    return out


class Model:
    """All that scoring needs: shipped to every task."""

    def __init__(self, lexicon: Lexicon, speller: Speller, shares: Shares, attention: Attention):
        self.lexicon, self.speller, self.shares, self.attention = lexicon, speller, shares, attention

    #: Class, count among the shipped words (-1: not among them), log10 of the share without a count, log10 share, attention's input.
    ROW = np.dtype([("kind", np.int32), ("count", np.int64), ("open", np.float64), ("share", np.float64), ("x", np.float32, (QKV,))])

    def words(self, vocabulary: bytes, counts: Counts | dict[bytes, int]):
        """Gives one ROW for each of some distinct words; the empty string stands for a text's start."""
        counts = counts if isinstance(counts, Counts) else Counts(pa.table({"word": pa.array(list(counts), pa.binary()), "n": np.array(list(counts.values()), np.int64)}))

        def make(strings: list[bytes]) -> np.ndarray:
            found = self.rows(pa.array([x or b"." for x in strings], pa.large_binary()), vocabulary, counts)
            out = np.zeros(len(strings) + 1, self.ROW)
            for name, column in found.items():
                out[name] = column
            if b"" in strings:
                out[strings.index(b"")] = out[-1]
            return out[:-1]

        return make

    def rows(self, found: pa.Array, vocabulary: bytes, counts: Counts) -> dict[str, np.ndarray]:
        """The columns of ROW for each of some distinct words and for a text's start; each column lies in one piece."""
        n, step = len(found), 1 << 14
        place = counts.find(found)
        count = np.append(counts.n, -1)[place]
        kind, opened, ids, bounds = counts.made(place, *self.opened(found.filter(pa.array(place < 0)), vocabulary)) if counts.rows else self.opened(found, vocabulary)
        out = {name: np.zeros(n + 1, self.ROW[name].base) if name != "x" else np.empty((n + 1, QKV), np.float32) for name in self.ROW.names}
        out["kind"][:n], out["count"][:n], out["open"][:n] = kind, count, opened
        out["share"][:n] = self.shares.logs(kind, np.maximum(count, 0), opened)
        for a in range(0, n, step):  # inputs are wide
            edge = bounds[a : min(a + step, n) + 1]
            out["x"][a : a + len(edge) - 1] = self.attention.inputs(kind[a : a + step], ids[edge[0] : edge[-1]], edge - edge[0])
        out["x"][n] = self.attention.start
        return out

    def opened(self, found: pa.Array, vocabulary: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(class, log10 of the share without a count) of words, and their subword ids with bounds."""
        ids, bounds = spelled(found, vocabulary)
        kind = self.lexicon.kinds(ids, bounds)
        return kind, self.shares.open(kind, self.speller.logs(kind, ids, bounds)), ids, bounds

    @staticmethod
    def look_up(memo: K.Memo, w: K.Words) -> tuple[int, np.ndarray, np.ndarray]:
        """(place of a text's start, places of the words, rows)."""
        zero = np.zeros(1, np.int64)
        at, row = memo(w.data, np.concatenate([zero, w.starts]), np.concatenate([zero, w.ends]))
        return int(at[0]), at[1:], row

    def score(self, w: K.Words, start: int, at: np.ndarray, row: np.ndarray | dict[str, np.ndarray]) -> np.ndarray:
        """log10 probability of each text, with the counts that ``row`` has."""
        n = len(w.counts)
        place = np.arange(len(at)) + w.docs()
        before, kind = np.full(len(at) + n + 1, start), np.full(len(at) + n, END, np.int32)
        before[place + 1], kind[place] = at, row["kind"][at]
        before[w.bounds[:-1] + np.arange(n)] = start
        return self.attention.logs(np.ascontiguousarray(row["x"]), before[:-1], kind, w.counts + 1) + w.sums(row["share"][at])


def batch(names: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c) for c in columns], names=names)


#: Expected numbers of words in topics are counted in units of 1 / UNIT, so that sums do not depend on their order.
UNIT = 1 << 16
#: Begins the keys of topics among those of words, which hold no blank.
BLANK = b" "


def count(train: DataFrame, lexicon, shipped) -> DataFrame:
    """(word, n): counts of all words of ``train``, by their bytes, and a round of EM over all its texts, from ``lexicon``.

    For the latter a text is cut into blocks as for scoring; the words of a block and half a block before tell its topic. How often
    (in units of 1 / UNIT) a subword id is expected in a topic is the ``n`` of a key that begins with BLANK, the topic and the id behind it.
    """
    half = BLOCK // 2

    def run(batches):
        known, n = lexicon.value, np.zeros((TOPICS, VOCABULARY), np.int64)
        for b in batches:
            for *_, w, at, found in parts(b.column(0)):
                if not len(at):
                    continue
                times = np.bincount(at, minlength=len(found))
                yield batch(["word", "n"], found.cast(pa.binary()), times)
                ids, bounds = spelled(found, shipped.value)
                row = gathered(known.theta, known.row[ids], bounds)
                halves = -(-w.counts // half)
                text = np.repeat(np.arange(len(halves)), halves)
                number = np.arange(len(text)) - np.repeat(np.cumsum(halves) - halves, halves)
                begin = w.bounds[:-1][text] + half * number
                size = np.diff(np.append(begin, len(at)))
                score = gathered(row, at, np.append(begin, len(at)))
                even = np.flatnonzero(number % 2 == 0)  # first half of each block
                block = np.cumsum(number % 2 == 0) - 1
                z = score[even]
                odd = np.flatnonzero(number % 2)
                z[block[odd]] += score[odd]
                later = np.flatnonzero(number[even] > 0)
                z[later] += score[even[later] - 1]
                z = np.exp(z - z.max(1, keepdims=True))
                z = np.rint(z * (UNIT / z.sum(1, keepdims=True)))
                weight = z[block].astype(np.float64)
                weight[even[later] - 1] += z[later]
                by_word = gathered(weight, np.repeat(np.arange(len(size), dtype=np.int32), size)[ordered(at)], edges(times))
                by_id = np.bincount(ids, minlength=VOCABULARY)
                some = np.flatnonzero(by_id)
                n[:, some] += gathered(by_word, np.repeat(np.arange(len(times)), np.diff(bounds))[ordered(ids)], edges(by_id[some])).astype(np.int64).T
        topic, ids = np.nonzero(n)
        key = np.zeros((len(ids), 4), np.uint8)
        key[:, 0], key[:, 1], key[:, 2], key[:, 3] = BLANK[0], topic, ids >> 8, ids & 255
        yield batch(["word", "n"], pa.array([k.tobytes() for k in key], pa.binary()), n[topic, ids])

    return rows(train.select("text"), run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def sampled(train: DataFrame, ends: int, shipped, sample: int = SAMPLE) -> Sample:
    """Where training begins: windows of ``sample`` training documents and one in ``EVERY``, or all, those with the smallest hashes of their ids.

    Of up to ``sample`` / 8 documents every window, of more one in two, and so on up to one in ``STRIDE``. So what comes to the driver
    grows with the training set: about 150 bytes for each of 1 / (EVERY * STRIDE) of all windows.
    """
    most, stride = sample + ends // EVERY, min(STRIDE, max(1, 8 * ends // max(1, sample)))
    share = 1 << 30 if ends <= most else int((1 << 30) * most / ends)

    def run(batches):
        spelling = Spelling(shipped.value)
        for b in batches:
            hashed = b.column(0).to_numpy()
            for i, j, data, off in K.slices(b.column(1)):
                w = K.Words(data, off, lower=True)
                at, row = spelling(w.data, w.starts, w.ends) if len(w.starts) else (np.zeros(0, np.int64), np.zeros((0, 2), np.int64))
                tokens = w.counts + 1
                begin, text, number = windows(tokens)
                low, high = (np.cumsum(tokens) - tokens), np.cumsum(tokens)
                out = []
                for k in np.flatnonzero((number + hashed[i:j][text]) % stride == 0).tolist():
                    t = text[k]
                    a, z = max(begin[k] - BEFORE - 1, low[t]), min(begin[k] + BLOCK, high[t])
                    words = row[at[a - t : z - t - (z == high[t])]]
                    if words[:, 1].sum() > LONGEST:
                        continue
                    parts = [np.append(np.int32(MARK), spelling.values[s : s + n]) for s, n in words.tolist()] + [np.array([MARK, bpe.END])] * int(z == high[t])
                    out.append((int(hashed[i + t]), int(a - begin[k] + BEFORE + 1), np.concatenate(parts).astype(np.uint16).tobytes()))
                yield batch(["at", "lead", "ids"], pa.array([x for x, *_ in out], pa.int64()), pa.array([x for _, x, _ in out], pa.int32()), pa.array([x for *_, x in out], pa.binary()))

    able = train.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & (place() < share))
    got = rows(able.select(place().alias("at"), "text"), run, "at long, lead int, ids binary").toArrow()
    # the same order whatever the tasks
    order = sorted(zip(got["at"].to_pylist(), got["ids"].to_pylist(), got["lead"].to_pylist()))
    return Sample([x for _, x, _ in order], np.array([x for *_, x in order], np.int64))


TRANSITION, TOKENS, TYPES, ONCE, TWICE = range(5)


def statistics(words: DataFrame, lexicon, shipped) -> tuple[Speller, Shares]:
    """Spelling model and shares from all training words; to the driver come the distinct transitions between ids by topic."""

    def run(batches):
        for b in batches:
            n = b.column(1).to_numpy()
            ids, bounds = spelled(b.column(0), shipped.value)
            kind = lexicon.value.kinds(ids, bounds)
            key, times = np.unique(transitions(kind, ids, bounds), return_counts=True)
            t, n = kind[kind >= SINGLE] - SINGLE, n[kind >= SINGLE]
            stats = [np.bincount(t, x, TOPICS).astype(np.int64) for x in (n, np.ones(len(n)), n == 1, n == 2)]
            yield batch(["what", "key", "n"], np.concatenate([np.full(len(key), TRANSITION), np.repeat([TOKENS, TYPES, ONCE, TWICE], TOPICS)]).astype(np.int32), np.concatenate([key, np.tile(np.arange(TOPICS), 4)]), np.concatenate([times, *stats]))

    got = rows(words.select("word", "n"), run, "what int, key long, n long").groupBy("what", "key").agg(F.sum("n").alias("n")).toArrow()
    what, key, n = (got[c].to_numpy() for c in ("what", "key", "n"))
    shares = Shares(*(np.bincount(key[what == x], n[what == x], TOPICS) for x in (TOKENS, TYPES, ONCE, TWICE)))
    key, times = key[what == TRANSITION], n[what == TRANSITION]
    order = np.argsort(key)
    return Speller(key[order], times[order]), shares


def topics(seen: DataFrame, words: DataFrame, lexicon: Lexicon, shipped) -> Lexicon:
    """The lexicon that a round of EM from ``lexicon`` gives, by what ``count`` found; the commonest words from all counts.

    To the driver come up to TOPICS rows for each subword id.
    """
    got = seen.where(F.startswith("word", F.lit(BLANK))).toArrow()
    key, n = np.frombuffer(b"".join(got["word"].to_pylist()), np.uint8).reshape(-1, 4).astype(np.int64), got["n"].to_numpy() / UNIT
    ids, place = np.unique(key[:, 2] * 256 + key[:, 3], return_inverse=True)
    by_id = np.zeros((len(ids), TOPICS))
    by_id[place, key[:, 1]] = n
    common = [bytes(r.word) for r in words.orderBy(F.desc("n"), "word").limit(SINGLE).collect()]
    spelling, bounds = spelled(common, shipped.value)
    single = [tuple(spelling[a:b].tolist()) for a, b in zip(bounds, bounds[1:])]
    return lexicon.learned(single, ids, by_id)


#: Rate at which tasks go on training; a task takes one step for each slice of its texts.
RATE = 0.003


def whole(train: DataFrame, lexicon, shipped) -> Callable[[Attention], None]:
    """Goes on training with every window of every training text.

    Each task begins with the attention's parameters and takes steps over its own texts; the parameters of all tasks are averaged, those of a
    subword id by how often tasks met it, the others by their tokens. What tasks pass on is summed by parameter row in an exchange; one row
    for each parameter row comes to the driver.
    """

    def go(attention: Attention) -> None:
        sent = train.sparkSession.sparkContext.broadcast(attention)
        few = {"classes": CLASSES + 1, "out": HEADS * VALUE, "bias": 1, "near": HEADS}
        first = dict(zip(few, np.cumsum([0, *few.values()]).tolist()))
        edge = sum(few.values())

        def packed(p: dict[str, np.ndarray]) -> np.ndarray:
            """All but the rows of ids, as rows of one width."""
            out = np.zeros((edge, QKV))
            for name, at in first.items():
                x = np.atleast_2d(p[name])
                out[at : at + len(x), : x.shape[1]] = x
            return out

        def run(batches):
            a, known, adam = copy(sent.value), lexicon.value, Adam()
            a.p = {k: v.copy() for k, v in a.p.items()}
            begin = {k: v.copy() for k, v in a.p.items()}
            met, tokens = np.zeros(len(a.p["ids"]), np.int64), 0
            for b in batches:
                for *_, cuts, w, code, found in parts(b.column(0)):
                    ids, bounds = spelled(found, shipped.value)
                    kind, size = known.kinds(ids, bounds), np.diff(bounds)
                    for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                        own = code[w.bounds[i] : w.bounds[j]]
                        times = np.bincount(own, minlength=len(size))
                        here = np.flatnonzero(times)
                        long = size[here]
                        own_bounds = edges(long)
                        some = ids[np.repeat(bounds[here] - own_bounds[:-1], long) + np.arange(own_bounds[-1])]
                        adam.step(a.p, a.all_gradients((np.cumsum(times > 0) - 1)[own], w.counts[i:j], kind[here], some, own_bounds), RATE)
                        met += np.bincount(a.row[some], np.repeat(times[here], long), len(met)).astype(np.int64)
                        tokens += len(own) + j - i
            if tokens:
                at = np.flatnonzero(met)
                moved = np.concatenate([(packed(a.p) - packed(begin)) * tokens, (a.p["ids"][at] - begin["ids"][at]) * met[at, None].astype(np.float64)]).astype(np.float32)
                place = np.concatenate([np.arange(edge), edge + at])
                weight = np.concatenate([np.full(edge, tokens), met[at]])
                yield batch(["at", "task", "weight", "moved"], place.astype(np.int32), np.full(len(place), TaskContext.get().partitionId(), np.int32), weight, pa.FixedSizeListArray.from_arrays(moved.ravel(), QKV).cast(pa.list_(pa.float32())))

        def total(batches):
            weight, moved = {}, {}
            for b in batches:  # sorted by place and task
                values = b.column(3).flatten().to_numpy().reshape(-1, QKV).astype(np.float64)
                for i, (at, n) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist())):
                    weight[at] = weight.get(at, 0) + n
                    moved[at] = moved.get(at, 0) + values[i]
            yield batch(["at", "moved"], np.array(list(moved), np.int32), pa.array([(moved[k] / weight[k]).tolist() for k in moved], pa.list_(pa.float64())))

        got = rows(train.select("text"), run, "at int, task int, weight long, moved array<float>")
        got = rows(got.repartition("at").sortWithinPartitions("at", "task"), total, "at int, moved array<double>").toArrow()
        at, moved = got["at"].to_numpy(), np.array(got["moved"].combine_chunks().flatten()).reshape(-1, QKV)
        attention.p["ids"][at[at >= edge] - edge] += moved[at >= edge].astype(np.float32)
        shared = np.zeros((edge, QKV))
        shared[at[at < edge]] = moved[at < edge]
        for name, i in first.items():
            p = attention.p[name]
            x = shared[i : i + few[name], : p.shape[-1]].astype(np.float32)
            p += x.reshape(p.shape)

    return go


def begin(train: DataFrame, ends: int, shipped, sample: int = SAMPLE) -> tuple[Sample, Lexicon, DataFrame]:
    """Where training begins: windows, the lexicon from them, and what ``count`` finds with it in every training text."""
    windows_ = sampled(train, ends, shipped, sample)
    lexicon = Lexicon(windows_)
    return windows_, lexicon, saved(count(train, train.sparkSession.sparkContext.broadcast(lexicon), shipped))


def fit(train: DataFrame, words: DataFrame, ends: int, shipped, sample: int = SAMPLE, begun: tuple[Sample, Lexicon, DataFrame] | None = None) -> Model:
    windows_, lexicon, seen = begun or begin(train, ends, shipped, sample)
    lexicon = topics(seen, words, lexicon, shipped)
    sent = train.sparkSession.sparkContext.broadcast(lexicon)
    speller, shares = statistics(words, sent, shipped)
    speller.measure(lexicon, shipped.value)
    kind = lexicon.kinds(windows_.ids, windows_.bounds)
    attention = Attention(lexicon)
    attention.rest = whole(train, sent, shipped)
    return Model(lexicon, speller, shares, attention.train(windows_, kind))


def hashes(found: pa.Array) -> np.ndarray:
    data, off = stored(found)
    return K.Hasher(data)(off[:-1], off[1:])


class Counts:
    """The shipped words with their counts, and what depends on the word alone if ``make`` was called."""

    def __init__(self, words: pa.Table):
        self.words, self.n = pa.array(words["word"].combine_chunks(), pa.large_binary()), words["n"].to_numpy()
        self.rows: tuple[np.ndarray, ...] = ()
        key = hashes(self.words)
        self.order = np.argsort(key)
        self.key = key[self.order]

    def make(self, model: Model, vocabulary: bytes, step: int = 1 << 14) -> Counts:
        """Classes, shares without counts and subword ids of all words, so that tasks need not work them out again and again."""
        parts = [model.opened(self.words.slice(a, step), vocabulary) for a in range(0, len(self.words), step)]
        if parts:
            kind, opened, ids, bounds = zip(*parts)
            self.rows = np.concatenate(kind), np.concatenate(opened), np.concatenate(ids).astype(np.uint16), edges(np.concatenate([np.diff(x) for x in bounds]))
        return self

    def find(self, found: pa.Array) -> np.ndarray:
        """Place of each word, -1 if it is not among them; found by hashes, told by bytes."""
        if not len(self.key) or not len(found):
            return np.full(len(found), -1)
        if (self.key[1:] == self.key[:-1]).any():  # two words of one hash: not to be expected
            return pc.index_in(found, self.words).fill_null(-1).to_numpy().astype(np.int64)
        at = self.order[np.minimum(np.searchsorted(self.key, hashes(found)), len(self.key) - 1)]
        return np.where(pc.equal(self.words.take(pa.array(at)), found).to_numpy(zero_copy_only=False), at, -1)

    def made(self, place: np.ndarray, kind: np.ndarray, opened: np.ndarray, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Class, share and ids with bounds by word, from the rows of the words at ``place``; the rest holds those that have none, in order."""
        at, begin = place.copy(), self.rows[3]
        at[place < 0] = np.arange(len(self.n), len(self.n) + len(kind))
        first = np.concatenate([begin[:-1], begin[-1] + bounds[:-1]])[at]
        size = np.concatenate([np.diff(begin), np.diff(bounds)])[at]
        own = edges(size)
        every = np.concatenate([self.rows[2], ids.astype(np.uint16)])
        return np.append(self.rows[0], kind)[at], np.append(self.rows[1], opened)[at], every[np.repeat(first - own[:-1], size) + np.arange(own[-1])], own


RARE = "array<struct<word:binary,times:int,open:double,less:double>>"
SCHEMA = f"doc_id long, held_out boolean, n_words long, known long, part double, score double, rare {RARE}"
_NAMES = ["doc_id", "held_out", "n_words", "known", "part", "score", "rare"]


def lm_scores(docs: DataFrame, path: str = TOKENIZERS, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row; extra columns are ignored."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", (fold("doc_id", 7) == 2).alias("held_out"), "text")
    train = docs.where(~F.col("held_out"))
    shipped = spark.sparkContext.broadcast(bpe.read(path))
    ends = train.count()
    begun = begin(train, ends, shipped, sample)
    seen = begun[-1]
    words = seen.where(~F.startswith("word", F.lit(BLANK)))
    # words by the size of their count, a few hundred rows at most
    size = F.floor(4 * F.log2("n")).cast("int")
    sizes = sorted(((r.b, r.v, r.n) for r in words.groupBy(size.alias("b")).agg(F.count("*").alias("v"), F.sum("n").alias("n")).collect()), reverse=True)
    least, room = 0, TOP
    for b, v, _ in sizes:
        if v > room:
            least = b + 1
            break
        room -= v
    distinct, total = sum(v for _, v, _ in sizes) + (1 if ends else 0), sum(n for *_, n in sizes) + ends
    model = fit(train, words, ends, shipped, sample, begun)
    # at most TOP words; the long ones (seldom frequent) stay in the join
    top = words.where((size >= least) & (F.octet_length("word") <= 64)).select("word", "n").toArrow()
    whole = top.num_rows == distinct - (1 if ends else 0)
    base = float(np.log10(total + distinct + 1.0))
    pack = spark.sparkContext.broadcast((model, Counts(top).make(model, shipped.value)))

    def run(batches):
        model, counts = pack.value
        less = model.shares.discount
        for b in batches:
            for a, z, _, w, at, found in parts(b.column(2)):
                start, row = len(found), model.rows(found, shipped.value, counts)
                n = np.maximum(row["count"], 0)
                hit = (n > 0)[at]
                known, part = w.sums(hit.astype(np.int64)), w.sums(np.log10(n + 1.0)[at])
                s = model.score(w, start, at, row)
                bounds = np.zeros(z - a + 1, np.int32)
                flat_ = pa.array([], pa.binary()), np.zeros(0, np.int32), np.zeros(0), np.zeros(0)
                if not whole and len(at):
                    miss = np.flatnonzero(~hit)
                    pair, times = np.unique(w.docs()[miss] * (start + 1) + at[miss], return_counts=True)
                    kept = pair % (start + 1)
                    bounds = np.searchsorted(pair // (start + 1), np.arange(z - a + 1)).astype(np.int32)
                    kind = row["kind"][kept]
                    flat_ = found.take(pa.array(kept)).cast(pa.binary()), times.astype(np.int32), row["open"][kept], np.where(kind < SINGLE, -1.0, less[np.maximum(kind - SINGLE, 0)])
                rare = pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in flat_], ["word", "times", "open", "less"]))
                yield batch(_NAMES, b.column(0).slice(a, z - a).cast(pa.int64()), b.column(1).slice(a, z - a), w.counts.astype(np.int64), known, part, s, rare)

    scored = rows(docs, run, SCHEMA)
    extra_known, extra_part, extra = F.lit(0).cast("long"), F.lit(0.0), F.lit(0.0)
    if not whole:
        # rows are kept apart by a number of their own, fixed once they are written
        scored = saved(scored.withColumn("at", F.monotonically_increasing_id()))
        rare = scored.select("at", F.explode("rare").alias("r")).select("at", "r.*")
        # classes of one word (less < 0) have a share of one whatever the count
        more = F.when(F.col("less") < 0, 0.0).otherwise(F.log10(F.col("n") - F.col("less") + F.pow(F.lit(10.0), F.col("open"))) - F.col("open"))
        seen = rare.join(words.select("word", "n"), "word").groupBy("at").agg(F.sum("times").cast("long").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("add"), F.sum(F.col("times") * more).alias("raise"))
        scored = scored.drop("rare").join(seen, "at", "left")
        extra_known, extra_part, extra = F.coalesce("more", F.lit(0)), F.coalesce("add", F.lit(0.0)), F.coalesce("raise", F.lit(0.0))
    else:
        forget(seen)
    n_tokens = F.col("n_words") + 1
    end = float(np.log10(ends + 1.0))
    return scored.select("doc_id", "held_out", n_tokens.alias("n_tokens"), (F.col("known") + extra_known + int(ends > 0)).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"), (F.col("part") + extra_part + F.lit(end) - n_tokens * F.lit(base)).alias("base_score"), (F.col("score") + extra).alias("score"))
