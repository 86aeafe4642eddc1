"""Byte-level BPE from a public vocabulary file; nothing is trained.

The pre-token pattern never joins a blank run to what stands before it, so a text may be cut before any run of
ASCII blanks that follows something that is not white space. ``Chunks`` cuts slices there, so each distinct chunk is encoded once.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import tiktoken

from lexigrove.llm import kernel as K
from lexigrove.llm.common import TOKENIZERS

#: Fixed value: the pre-token pattern that goes with the vocabulary file.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END = 50256
#: The same where the only white space is one blank in front of a word: without a look-ahead it is matched about twice as fast.
PLAIN = PATTERN.removesuffix(r"|\s+(?!\S)|\s+")


def read(path: str = TOKENIZERS) -> bytes:
    """The vocabulary file's bytes (0.8 MB), read by the driver and shipped."""
    with open(f"{path}/byte_bpe_50k.tiktoken", "rb") as f:
        return f.read()


_made: dict[tuple[int, str], tiktoken.Encoding] = {}


def encoding(vocabulary: bytes, pattern: str = PATTERN) -> tiktoken.Encoding:
    key = hash(vocabulary), pattern
    if key not in _made:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        # encode_to_numpy is slow without any special token; a line break is none of PLAIN's white space
        special = {"\n": END} if pattern == PLAIN else {}
        _made[key] = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    return _made[key]


_BEGINS: dict[int, np.ndarray] = {}
_OTHER_BLANK = re.compile(r"[^\S ]")


def spell(words: list[str], vocabulary: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Ids of words, each with a blank before it, one after another, and their bounds.

    Words without white space are encoded in one go: a token that begins with a blank begins a word.
    """
    got = spell_joined(" " + " ".join(words) if words else "", len(words), vocabulary)
    if got:
        return got
    # words that hold white space of other kinds are encoded one by one
    odd = [bool(_OTHER_BLANK.search(w)) for w in words]
    plain = [w for w, o in zip(words, odd) if not o]
    got = spell_joined(" " + " ".join(plain), len(plain), vocabulary) if len(plain) < len(words) else None
    if got:
        ids, bounds = (x.tolist() for x in got)
        rest = iter([ids[a:b] for a, b in zip(bounds, bounds[1:])])
    e = encoding(vocabulary)
    lists = [e.encode_ordinary(" " + w) if o or not got else next(rest) for w, o in zip(words, odd)]
    size = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter((x for one in lists for x in one), np.int64, int(size.sum())), np.concatenate([[0], np.cumsum(size)])


def spell_joined(text: str, n: int, vocabulary: bytes) -> tuple[np.ndarray, np.ndarray] | None:
    """``spell`` for a text that is ``n`` words with a blank before each; None if its tokens do not show where words begin."""
    e, key = encoding(vocabulary, PLAIN), hash(vocabulary)
    if key not in _BEGINS:
        _BEGINS[key] = np.array([x[:1] == b" " for x in map(e.decode_single_token_bytes, range(END))])
    if _OTHER_BLANK.search(text):
        return None
    ids = e.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
    begins = np.flatnonzero(_BEGINS[key][ids])
    return (ids, np.append(begins, len(ids))) if len(begins) == n else None


def odd_blanks(data: np.ndarray) -> np.ndarray:
    """True at the last byte of every non-ASCII white-space character (and of a few that merely look like one)."""
    out = np.zeros(len(data), bool)
    if len(data) > 1:
        out[1:] |= (data[:-1] == 0xC2) & ((data[1:] == 0x85) | (data[1:] == 0xA0))
    if len(data) > 2:
        a, b = data[:-2], data[1:-1]
        out[2:] |= ((a == 0xE1) & (b == 0x9A)) | ((a == 0xE2) & ((b == 0x80) | (b == 0x81))) | ((a == 0xE3) & (b == 0x80))
    return out


class Chunks:
    """Chunks of a slice: blanks with the word behind them. A text with non-ASCII white space is one chunk."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.data, self.off = data, off
        inside = ~K.SPACE[data]
        if len(data):
            odd = np.flatnonzero(K.sums(odd_blanks(data).astype(np.int64), off) > 0)
        else:
            odd = np.zeros(0, np.int64)
        _, ends = K.runs(inside, off)
        # a chunk ends with a word; blanks at a text's end are one more
        cut = np.zeros(len(data) + 1, bool)
        cut[ends] = True
        for d in odd.tolist():
            cut[off[d] : off[d + 1]] = False
        cut[off] = True
        cuts = np.flatnonzero(cut)
        self.starts, self.ends = cuts[:-1], cuts[1:]
        self.bounds = np.searchsorted(self.starts, off)
