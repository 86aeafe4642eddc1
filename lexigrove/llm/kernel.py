"""Vectorised word kernel: whole Arrow string columns as one byte buffer.

Everything here works on slices of at most ``SLICE_BYTES`` of UTF-8 (one longer text makes a slice of its
own), so memory is bounded whatever the batch size, and a text is never cut.

Null texts count as empty. Words are the runs outside ``\\x20 \\x09-\\x0D``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_PINV = np.uint64(pow(int(_P), -1, 1 << 64))
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_pow = np.ones(1, np.uint64)
_inv = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        one = np.ones(max(n, SLICE_BYTES), np.uint64)
        one[1:] = _P
        _pow = np.cumprod(one)
        one[1:] = _PINV
        _inv = np.cumprod(one)
    return _pow[:n], _inv[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 (public domain), so that every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def as_arrays(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column as (bytes, offsets); nulls become empty."""
    col = col.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = col.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(col: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of consecutive rows that together stay within ``limit``."""
    data, off = as_arrays(col)
    a, n = 0, len(off) - 1
    while a < n:
        b = int(np.searchsorted(off, off[a] + limit, "right")) - 1
        b = min(n, max(b, a + 1))
        yield a, b, data[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True that do not cross a document."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.zeros(len(inside) + 1, bool)
    first[offsets] = True
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1] | first[1:-1]
    end[:-1] &= ~inside[1:] | first[1:-1]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


class Hasher:
    """64-bit hashes of any byte ranges of one buffer, from one prefix sum."""

    def __init__(self, data: np.ndarray):
        pw, self.inv = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * pw[:-1], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.inv[starts] + (ends - starts).astype(np.uint64))


class Words:
    """The words of a slice: ``starts``, ``ends`` (bytes), ``bounds`` (document i has words bounds[i]:bounds[i+1])."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.data = LOWER[data] if lower else data
        self.offsets = offsets
        self.inside = ~SPACE[data]
        self.starts, self.ends = runs(self.inside, offsets)
        self.bounds = np.searchsorted(self.starts, offsets)
        self.bounds[-1] = len(self.starts)
        self.counts = np.diff(self.bounds)
        self._hash = None

    def hasher(self) -> Hasher:
        self._hash = self._hash or Hasher(self.data)
        return self._hash

    def hashes(self) -> np.ndarray:
        return self.hasher()(self.starts, self.ends)

    def docs(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def sums(self, per_word: np.ndarray) -> np.ndarray:
        """Per document, the sum of a value (or row of values) per word."""
        return sums(per_word, self.bounds)


WORD = np.ones(256, bool)
WORD[:128] = False
WORD[48:58] = WORD[65:91] = WORD[97:123] = True


class Tokens(Words):
    """Words that are runs of ASCII letters, digits and non-ASCII bytes, A-Z lower-cased."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        super().__init__(np.where(WORD[data], LOWER[data], np.uint8(32)), offsets)

    def shingle(self, i: int, k: int) -> bytes:
        return b" ".join(self.data[s:e].tobytes() for s, e in zip(self.starts[i : i + k], self.ends[i : i + k]))


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of consecutive ranges, in double precision and within each range alone."""
    out = np.zeros((len(bounds) - 1, *values.shape[1:]), np.float64 if values.dtype.kind == "f" else np.int64)
    full = np.flatnonzero(np.diff(bounds) > 0)
    if len(full):
        out[full] = np.add.reduceat(values, bounds[full], axis=0, dtype=out.dtype)
    return out


def shingles(h: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every k consecutive values within a document, and the index of the first of each."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    g = np.zeros(n, np.uint64)
    for i in range(k):
        g = mix(g * _P + h[i : i + n])
    left = np.repeat(bounds[1:], np.diff(bounds))[:n] - np.arange(n)  # words from here to the document's end
    at = np.flatnonzero(left >= k)
    return g[at], at


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One integer for each pair of integers (none negative); different pairs get different ones."""
    width = int(b.max()) + 1
    if (int(a.max()) + 1) * width >= 1 << 63:
        a = np.unique(a, return_inverse=True)[1]
    return a * width + b


def repeated(key: np.ndarray) -> np.ndarray:
    """True where a value occurs at least twice."""
    order = np.argsort(key, kind="stable")
    s = key[order]
    same = s[1:] == s[:-1]
    flag = np.zeros(len(key), bool)
    flag[1:] |= same
    flag[:-1] |= same
    out = np.empty(len(key), bool)
    out[order] = flag
    return out


def strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The byte strings data[start:end], of ranges in order that do not overlap."""
    size = ends - starts
    off = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(size, out=off[1:])
    if len(starts) and off[-1] != ends[-1] - starts[0]:
        edge, full = np.zeros(len(data) + 1, np.int8), size > 0
        edge[starts[full]] += 1
        edge[ends[full]] -= 1
        data = data[np.cumsum(edge[:-1], dtype=np.int8).view(bool)]
    elif len(starts):
        data = data[starts[0] : ends[-1]]
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(data))])


def distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(code of each string, the distinct strings by code); strings are told apart by their bytes."""
    found = strings(data, starts, ends).dictionary_encode()
    return found.indices.to_numpy().astype(np.int64), found.dictionary


class Memo:
    """Values of distinct byte strings, found by their bytes, kept from slice to slice.

    ``make(list of bytes)`` gives an array with one row for each. When the memo holds more than ``budget`` bytes it
    starts anew, which bounds memory and changes no result.
    """

    #: What a string takes in a dict beside its own bytes.
    ENTRY = 150

    def __init__(self, make, budget: int = 32 << 20):
        self.make, self.budget = make, budget
        self.fresh()

    def fresh(self) -> None:
        self.known: dict[bytes, int] = {}
        self.rows, self.held = None, 0

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of each string's row, rows)."""
        codes, found = distinct(data, starts, ends)
        if self.held > self.budget:
            self.fresh()
        keys, get, n = found.to_pylist(), self.known.get, len(self.known)
        at = np.fromiter((get(k, -1) for k in keys), np.int64, len(keys))
        new = np.flatnonzero(at < 0)
        if len(new) or self.rows is None:
            fresh = [keys[i] for i in new.tolist()]
            rows = self.make(fresh)
            if self.rows is None:
                self.rows = rows
            else:
                if n + len(new) > len(self.rows):  # room doubles, so that rows are seldom copied
                    self.rows = np.concatenate([self.rows, np.zeros((max(len(self.rows), len(new)), *rows.shape[1:]), rows.dtype)])
                self.rows[n : n + len(new)] = rows
            self.known.update(zip(fresh, range(n, n + len(new))))
            at[new] = np.arange(n, n + len(new))
            self.held += sum(map(len, fresh)) + self.ENTRY * len(fresh) + 3 * rows.nbytes // 2
        return at[codes], self.rows


class Pool(Memo):
    """A memo of integer lists: rows are (offset, length) in one growing array."""

    def __init__(self, lists, budget: int = 64 << 20):
        self.lists = lists
        super().__init__(self.add, budget)

    def fresh(self) -> None:
        super().fresh()
        self.values, self.filled = np.zeros(0, np.int32), 0

    def add(self, strings: list[bytes]) -> np.ndarray:
        found = self.lists(strings)
        size = np.fromiter(map(len, found), np.int64, len(found))
        total = int(size.sum())
        if self.filled + total > len(self.values):
            self.values = np.concatenate([self.values[: self.filled], np.zeros(max(self.filled, total), np.int32)])
        self.values[self.filled : self.filled + total] = np.fromiter((x for f in found for x in f), np.int32, total)
        begin = self.filled + np.cumsum(size) - size
        self.filled += total
        self.held += 8 * total
        return np.stack([begin, size], axis=1)

    def expand(self, at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists one after another, and the length of each."""
        begin, size = rows[at, 0], rows[at, 1]
        total = np.cumsum(size)
        return self.values[np.repeat(begin - (total - size), size) + np.arange(total[-1] if len(total) else 0)], size
