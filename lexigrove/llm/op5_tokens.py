"""Token counts with edits: a segment tree over pre-token chunks for each document.

Leaves are chunks of pre-tokens (blanks with the word behind them) and hold token counts; inner nodes hold sums. An
edit replaces a byte range. Only the leaves it touches and one leaf of context to each side are encoded again; the
first of them takes the new count, the others zero, and the sums above them are updated. The root is the document's count.

Null and empty texts have no leaves and no tokens. Texts of any length get a tree; repeated rows get equal results.
Of edits that overlap, the one that starts first (then the longer) wins. A text with non-ASCII white space has one leaf, since
there the cuts between leaves would not be safe; its counts are exact too. Extra columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lexigrove.llm import bpe
from lexigrove.llm import kernel as K
from lexigrove.llm.common import TOKENIZERS, rows

#: Redactions: what is replaced by what, in the order of precedence at one place. Addresses come first; see ``redactions``.
EMAIL = b"<EMAIL>"
REDACTIONS = (
    (rb"\bAKIA[0-9A-Z]{16}\b", b"<KEY>"),
    (rb"\b(?:password|passwd|token|secret|api_key)\s*=\s*[^\s]+", b"<SECRET>"),
    (rb"\b[0-9]{13,19}\b", b"<CARD>"),
    (rb"\+[0-9]{1,3} ?\(?[0-9]{2,4}\)?[ 0-9-]{6,14}[0-9]", b"<PHONE>"),
)
_FIND = re.compile(b"|".join(b"(" + p + b")" for p, _ in REDACTIONS))
_LOCAL = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(rb"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_DIGIT[[ord("@"), ord("=")]] = True


def redactions(text: bytes) -> list[tuple[int, int, bytes]]:
    """(start, end, replacement) of everything to redact, the leftmost first; in time linear in the text.

    Addresses are found from their at signs backward, as a pattern would try every letter of a long run as their start.
    """
    addresses, before = [], 0
    at = text.find(b"@")
    while at >= 0:
        start = before + len(text[before:at].rstrip(_LOCAL))
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            addresses.append((start, at, m.end()))
        before, at = at + 1, text.find(b"@", at + 1)
    out, i, done = [], 0, 0
    other = _FIND.search(text)
    while True:
        while i < len(addresses) and addresses[i][1] <= done:
            i += 1
        if other and other.start() < done:
            other = _FIND.search(text, done)
        start = max(addresses[i][0], done) if i < len(addresses) else len(text) + 1
        if other and other.start() < start:
            out.append((other.start(), other.end(), REDACTIONS[other.lastindex - 1][1]))
        elif i < len(addresses):
            out.append((start, addresses[i][2], EMAIL))
        else:
            return out
        done = out[-1][1]


class Tree:
    """Sums over leaves: node i has the children 2i and 2i+1; leaf k is node ``width`` + k."""

    def __init__(self, counts: np.ndarray):
        self.width = 1 << max(0, (len(counts) - 1).bit_length())
        self.node = np.zeros(2 * self.width, np.int64)
        self.node[self.width : self.width + len(counts)] = counts
        w = self.width
        while w > 1:
            self.node[w // 2 : w] = self.node[w : 2 * w : 2] + self.node[w + 1 : 2 * w : 2]
            w //= 2

    @property
    def total(self) -> int:
        return int(self.node[1]) if self.width > 1 else int(self.node[-1])

    def put(self, leaf: int, count: int) -> None:
        i = self.width + leaf
        change = count - self.node[i]
        while i and change:
            self.node[i] += change
            i >>= 1


class Document:
    """A text with its tree. Positions of edits are byte positions in the original text."""

    def __init__(self, text: bytes, ends: np.ndarray, counts: np.ndarray, encode: Callable[[str], list[int]]):
        self.text, self.ends, self.encode = text, ends, encode
        self.starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        self.tree = Tree(counts)
        self.parts: dict[int, bytes] = {}  # leaf -> its text, where it changed
        self.reencoded = 0

    def part(self, leaf: int) -> bytes:
        return self.parts[leaf] if leaf in self.parts else self.text[self.starts[leaf] : self.ends[leaf]]

    def apply(self, edits: list[tuple[int, int, bytes]]) -> None:
        n, last = len(self.ends), -1
        chosen = []
        for s, e, new in sorted(edits, key=lambda x: (x[0], -x[1])):
            if s >= last and 0 <= s <= e <= len(self.text):
                chosen.append((s, e, new))
                last = e
        if not n:
            if new := b"".join(x[2] for x in chosen):
                self.text, self.ends, self.starts = new, np.array([len(new)]), np.array([0])
                self.tree = Tree(np.array([len(self.encode(new.decode("utf-8", "replace")))]))
                self.reencoded = 1
            return
        # edits whose regions meet are encoded together
        i = 0
        while i < len(chosen):
            lo = self.region(chosen[i])[0]
            hi, j = self.region(chosen[i])[1], i + 1
            while j < len(chosen) and self.region(chosen[j])[0] <= hi:
                hi = max(hi, self.region(chosen[j])[1])
                j += 1
            at, out = int(self.starts[lo]), []
            for s, e, new in chosen[i:j]:
                out += [self.text[at:s], new]
                at = e
            out.append(self.text[at : self.ends[hi]])
            self.parts[lo] = b"".join(out)
            self.tree.put(lo, len(self.encode(self.parts[lo].decode("utf-8", "replace"))))
            for k in range(lo + 1, hi + 1):
                self.parts[k] = b""
                self.tree.put(k, 0)
            self.reencoded += hi - lo + 1
            i = j

    def region(self, edit: tuple[int, int, bytes]) -> tuple[int, int]:
        """First and last leaf to encode again: those touched, and one more to each side."""
        s, e, _ = edit
        lo = int(np.searchsorted(self.ends, s, "right"))
        hi = int(np.searchsorted(self.ends, max(e - 1, s), "right"))
        n = len(self.ends)
        return max(0, min(lo, n - 1) - 1), min(n - 1, hi + 1)

    def edited(self) -> bytes:
        return b"".join(self.part(k) for k in range(len(self.ends)))


def suspects(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Documents that may need a redaction: they hold a digit, an at sign or an equals sign, or a key's first letters."""
    if not len(data):
        return np.zeros(len(off) - 1, bool)
    may = K.sums(_DIGIT[data].astype(np.int64), off) > 0
    raw = data.tobytes()
    at = np.array([m.start() for m in re.finditer(b"AKIA", raw)], np.int64)
    may[np.searchsorted(off, at, "right") - 1] = True
    return may


class Counter:
    def __init__(self, vocabulary: bytes):
        self.encode = bpe.encoding(vocabulary).encode_ordinary
        self.memo = K.Memo(self.counts)

    def counts(self, strings: list[bytes]) -> np.ndarray:
        encode = self.encode
        return np.fromiter((len(encode(s.decode("utf-8", "replace"))) for s in strings), np.int32, len(strings))

    def documents(self, col: pa.Array, find=redactions, maybe=suspects):
        """(row, Document before any edit, its edits) for each text of the column."""
        for a, b, data, off in K.slices(col):
            c = bpe.Chunks(data, off)
            at, values = self.memo(data, c.starts, c.ends) if len(c.starts) else (np.zeros(0, np.int64), np.zeros(0, np.int32))
            n, raw, may = values[at], data.tobytes(), maybe(data, off)
            for i in range(b - a):
                p, q = c.bounds[i], c.bounds[i + 1]
                text = raw[off[i] : off[i + 1]]
                yield a + i, Document(text, c.ends[p:q] - off[i], n[p:q], self.encode), find(text) if may[i] else []


SCHEMA = "doc_id long, n_leaves long, n_tokens long, n_edits long, n_reencoded long, n_tokens_edited long"


def token_counts(docs: DataFrame, path: str = TOKENIZERS, find=redactions, maybe=suspects) -> DataFrame:
    """Counts of every row before and after the edits that ``find`` gives; extra columns are ignored."""
    shipped = docs.sparkSession.sparkContext.broadcast(bpe.read(path))

    def run(batches):
        counter = Counter(shipped.value)
        for b in batches:
            out = np.zeros((b.num_rows, 5), np.int64)
            for i, d, edits in counter.documents(b.column(1), find, maybe):
                out[i, :3] = len(d.ends), d.tree.total, len(edits)
                if edits:
                    d.apply(edits)
                out[i, 3:] = d.reencoded, d.tree.total
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *(pa.array(out[:, i]) for i in range(5))], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return rows(docs.select("doc_id", "text"), run, SCHEMA)
