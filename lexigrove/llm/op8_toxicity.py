"""Toxicity: Levenshtein automata intersected with a lexicon trie.

The lexicon is learned from labelled rows: whole words, and stems (prefixes that several words share), that toxic
texts hold far more often than others. It forms one trie. For each distinct word the Levenshtein automaton of the
word (its NFA, one bit vector of states for each number of errors) walks down the trie; a branch is left as soon as no
state is alive. So misspelled terms are caught with one edit, without listing spellings.

Every hit is weighed by a window of ``WINDOW`` words to each side: between quotation marks or beside a verb of saying
it is likely a quotation and counts little; beside further hits it counts more. A logistic model fitted on the labelled
rows turns the sums of exact terms, misspelled terms, misspelled stems and different words with a stem into a probability.

Null and empty texts have no hits and get the model's base score. Whole texts count, whatever their length; repeated
rows get equal scores. At most ``SAMPLE`` labelled texts of each class are used; without both classes nothing is toxic.
Terms of equal frequency are taken in alphabetical order; extra columns are ignored; no rows give no rows.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lexigrove.llm import kernel as K
from lexigrove.llm.common import fold, labelled, rows

SAMPLE = 3000
WINDOW = 8
#: Shortest term, and shortest stem, that may be misspelled.
FUZZY_TERM, FUZZY_STEM = 5, 5
QUOTES = "\"“”„«»‹›"
#: Verbs of saying in the languages at hand.
SAYING = ["said", "says", "wrote", "writes", "quoted", "quote", "called", "cited", "dit", "écrit", "cite", "sagte", "schrieb", "zitiert", "dijo", "escribió", "citó"]
#: What a word is: a term, a misspelled term, a misspelled stem, a verb of saying, a word with a stem.
EXACT, TERM, STEM, SAYS, ROOT = 1, 2, 3, 4, 5
#: Different words of one text that must share a stem when stems are learned.
TOGETHER = 2
#: Words of a text over which words that only have a stem begin to count less.
SPREAD = 500


class Trie:
    """Node: [children by character, term ends here, stem ends here]."""

    def __init__(self, terms: list[str], stems: list[str]):
        self.terms, self.stems = set(terms), set(stems)
        self.stem_sizes = sorted({len(s) for s in stems})
        self.root: list = [{}, False, False]
        self.heads: dict[int, dict[str, set[int]]] = {}
        self.tails: dict[int, dict[str, set[int]]] = {}
        self.inner: dict[int, dict[str, set[int]]] = {}
        for kind, words, least in ((1, self.terms, FUZZY_TERM), (2, self.stems, FUZZY_STEM)):
            for t in words:
                if len(t) < least:
                    continue
                node = self.root
                for c in t:
                    node = node[0].setdefault(c, [{}, False, False])
                node[kind] = True
                # one edit leaves the first or the second half whole: a word with neither cannot match
                h = len(t) // 2
                sizes = {len(t) - 1, len(t), len(t) + 1} if kind == 1 else {-1}
                self.heads.setdefault(h, {}).setdefault(t[:h], set()).update(sizes)
                if kind == 1:
                    self.tails.setdefault(len(t) - h, {}).setdefault(t[h:], set()).update(sizes)
                else:
                    self.inner.setdefault(len(t) - h, {}).setdefault(t[h:], set()).update({h - 1, h, h + 1})

    def possible(self, w: str) -> bool:
        n = len(w)
        for k, d in self.heads.items():
            if (s := d.get(w[:k])) and (-1 in s or n in s):
                return True
        for k, d in self.tails.items():
            if (s := d.get(w[-k:])) and n in s:
                return True
        for k, d in self.inner.items():
            for i in range(1, 6):
                if (s := d.get(w[i : i + k])) and i in s:
                    return True
        return False

    def walk(self, w: str) -> int:
        """TERM, STEM or 0: the automaton of ``w`` with one error, run over the trie."""
        n = len(w)
        goal, full = 1 << n, (2 << n) - 1
        masks: dict[str, int] = {}
        for i, c in enumerate(w):
            masks[c] = masks.get(c, 0) | 1 << i
        # bit i of r0, r1: i characters of w are read with 0, at most 1 errors
        todo, stem = [(self.root, 1, 3 & full)], 0
        while todo:
            (children, _, _), r0, r1 = todo.pop()
            for c, child in children.items():
                m = masks.get(c, 0)
                s0 = (r0 & m) << 1
                s1 = (((r1 & m) << 1) | r0 | (r0 << 1) | (s0 << 1)) & full  # match, insertion, substitution, deletion
                if not s1:
                    continue
                if child[1] and s1 & goal:
                    return TERM
                if child[2]:
                    stem = STEM
                todo.append((child, s0, s1))
        return stem

    def kind(self, w: str) -> int:
        if w in self.terms:
            return EXACT
        for k in self.stem_sizes:
            if w[:k] in self.stems:
                return ROOT
        if len(w) >= FUZZY_TERM - 1 and self.possible(w):
            return self.walk(w)
        return SAYS if w in SAYING else 0


def learn(sample: list[tuple[str, int]], ratio: float = 30.0, stem_ratio: float = 10.0, level: float = 0.01) -> Trie:
    """Terms with at least ``ratio`` times the document frequency in toxic texts, and stems with ``stem_ratio``, and not by chance.

    Not by chance: the Chernoff bound of the chance that so many of the texts with the candidate are toxic, times
    the number of candidates seen often enough, is at most ``level``. Texts that repeat count once. A text counts for a stem if ``TOGETHER``
    different words of it begin with it, as single such words occur anywhere. Of stems that begin with each other the longest that
    keeps (nearly) all toxic texts of the shorter is taken.
    """
    df: tuple[Counter, Counter] = (Counter(), Counter())
    prefixes: tuple[Counter, Counter] = (Counter(), Counter())
    n, seen, toxic = [0, 0], set(), []
    for text, y in sample:
        if text in seen:
            continue
        seen.add(text)
        n[y] += 1
        data, off = K.as_arrays(pa.array([text], pa.string()))
        w = K.Tokens(data, off)
        raw = w.data.tobytes()
        words = {raw[s:e].decode("utf-8", "replace").lower() for s, e in zip(w.starts.tolist(), w.ends.tolist())}
        df[y].update(words)
        forms = Counter(w[:k] for w in words for k in range(3, min(9, len(w))))
        prefixes[y].update(t for t, c in forms.items() if c >= TOGETHER)
        if y:
            toxic.append(words)
    if not n[0] or not n[1]:
        return Trie([], [])
    share = n[1] / (n[0] + n[1])

    def strong(p: int, q: int, candidates: int, ratio: float = ratio, level: float = level) -> bool:
        a = p / (p + q)
        if p < 3 or p / n[1] < ratio * (q + 0.5) / n[0] or a <= share:
            return False
        kl = a * np.log(a / share) + ((1 - a) * np.log((1 - a) / (1 - share)) if a < 1 else 0)
        return np.log(candidates) - (p + q) * kl <= np.log(level)

    often = sum(p >= 3 for p in prefixes[1].values())
    able = {t for t, p in prefixes[1].items() if strong(p, prefixes[0][t], often, stem_ratio)}
    longer: dict[str, str] = {}  # prefix -> the one longer by a letter that keeps nearly all its toxic texts
    for t in sorted(able):
        if prefixes[1][t] >= 0.95 * prefixes[1][t[:-1]]:
            longer[t[:-1]] = t
    stems: list[str] = []
    for t in sorted(able, key=lambda t: (len(t), t)):
        while t in longer:
            t = longer[t]
        if not any(t.startswith(known) for known in stems):
            stems.append(t)
    terms = sorted((w for w, p in df[1].items() if len(w) >= 3 and strong(p, df[0][w], len(df[1]))), key=lambda w: (-df[1][w], w))
    sure = {w for w in terms if strong(df[1][w], df[0][w], len(df[1]), level=level**20)}
    terms = own_weight(terms, stems, toxic, sure)
    return Trie(terms, stems)


def own_weight(terms: list[str], stems: list[str], toxic: list[set[str]], sure: set[str]) -> list[str]:
    """``terms``, the most frequent first, without those that merely accompany stems and terms before them.

    A term goes if it has a stem, or if it is in a dozen toxic texts or more, each of them has a term or stem
    accepted before, and it is not among the ``sure`` ones.
    """
    sizes, chosen = {len(s) for s in stems}, set(stems)
    stemmed = lambda w: any(w[:k] in chosen for k in sizes)
    covered = [any(stemmed(w) for w in words) for words in toxic]
    holding: dict[str, list[int]] = {w: [] for w in terms}
    for i, words in enumerate(toxic):
        for w in words & holding.keys():
            holding[w].append(i)
    out = []
    for w in terms:
        mine = holding[w]
        if stemmed(w) or (w not in sure and len(mine) >= 12 and all(covered[i] for i in mine)):
            continue
        out.append(w)
        for i in mine:
            covered[i] = True
    return out


class Model:
    def __init__(self, sample: list[tuple[str, int]]):
        self.trie = learn(sample)
        self.w = np.array([-6.0, 0, 0, 0, 0])
        y = np.array([l for _, l in sample], float)
        if len(y) and y.min() < y.max():
            x = self.features(pa.array([t for t, _ in sample], pa.string()), K.Memo(self.kinds))
            self.w = logistic(x, y)

    def kinds(self, strings: list[bytes]) -> np.ndarray:
        kind = self.trie.kind
        return np.fromiter((kind(s.decode("utf-8", "replace").lower()) for s in strings), np.int8, len(strings))

    def features(self, col: pa.Array, memo: K.Memo) -> np.ndarray:
        x = np.zeros((len(col), 5))
        x[:, 0] = 1
        for a, _, data, off in K.slices(col):
            w = K.Tokens(data, off)
            if not len(w.starts):
                continue
            at, values = memo(w.data, w.starts, w.ends)
            kinds = values[at]
            marked = np.flatnonzero(kinds)
            doc = np.searchsorted(w.bounds, marked, "right") - 1
            says = kinds[marked] == SAYS
            for d in np.unique(doc[~says]).tolist():
                mine = doc == d
                hits, said = marked[mine & ~says], marked[mine & says]
                x[a + d, 1:] = self.evidence(data, w, d, hits, kinds[hits], said, at[hits])
        x[:, 1:] = np.log1p(x[:, 1:])
        return x

    @staticmethod
    def evidence(data: np.ndarray, w: K.Tokens, d: int, hits: np.ndarray, kinds: np.ndarray, said: np.ndarray, words: np.ndarray) -> np.ndarray:
        lo, hi = w.bounds[d], w.bounds[d + 1] - 1
        left, right = np.maximum(lo, hits - WINDOW), np.minimum(hi, hits + WINDOW)
        beside = np.searchsorted(hits, right, "right") - np.searchsorted(hits, left) - 1
        saying = np.searchsorted(said, right, "right") > np.searchsorted(said, left)
        quoted = np.zeros(len(hits), bool)
        begin, end = int(w.offsets[d]), int(w.offsets[d + 1])
        text = data[begin:end].tobytes().decode("utf-8", "replace")
        if any(q in text for q in QUOTES):
            for i, h in enumerate(hits):
                before = data[w.starts[left[i]] if left[i] > lo else begin : w.starts[h]].tobytes().decode("utf-8", "replace")
                after = data[w.ends[h] : w.ends[right[i]] if right[i] < hi else end].tobytes().decode("utf-8", "replace")
                quoted[i] = any(q in before for q in QUOTES) and any(q in after for q in QUOTES)
        weight = np.where(quoted, np.where(saying, 0.05, 0.25), np.where(saying, 0.7, 1.0)) * (1 + 0.25 * np.minimum(beside, 4) * ~quoted)
        # a word that only has a stem counts once a text, however often it is repeated
        root = np.flatnonzero(kinds == ROOT)
        once = root[np.unique(words[root], return_index=True)[1]]
        # and in a long text some such words occur anyway
        spread = np.sqrt(1 + (hi + 1 - lo) / SPREAD)
        return np.array([*(weight[kinds == k].sum() for k in (EXACT, TERM, STEM)), weight[once].sum() / spread])

    def scores(self, col: pa.Array, memo: K.Memo) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(col, memo) @ self.w, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 40) -> np.ndarray:
    """Ridge logistic regression by Newton steps; evidence never counts against toxicity."""
    use = np.ones(x.shape[1], bool)
    while True:
        w = np.zeros(x.shape[1])
        z = x[:, use]
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ w[use], -30, 30)))
            h = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(z.shape[1])
            step = np.linalg.solve(h, z.T @ (p - y) + ridge * w[use])
            w[use] -= step * min(1, 4 / max(np.abs(step).max(), 1e-9))
        bad = use & (w < 0)
        bad[0] = False
        if not bad.any():
            return w
        use &= ~bad


SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def toxicity(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, least: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; extra columns are ignored."""
    model = Model(labelled(docs, labels, "toxic", most))

    def run(batches):
        memo = K.Memo(model.kinds)
        for b in batches:
            s = model.scores(b.column(2), memo)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1), pa.array(s), pa.array((s >= least).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return rows(docs.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "text"), run, SCHEMA)
