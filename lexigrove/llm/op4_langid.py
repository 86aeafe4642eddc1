"""Language ID by hierarchical discrimination.

First a linear classifier picks the language family, then one-versus-one linear support vector machines tell apart
the languages of that family. Features are hashed byte 1-, 2- and 3-grams inside lower-cased words (with word ends),
as shares of the text, so every model is a sum over words and each distinct word is scored once.

Null texts and texts without a letter get ``und`` and score 0. Whole texts of any length count; repeated rows get
equal results. Fitting uses a bounded sample (``SAMPLE`` documents a language, and see ``sampled_texts``).
Of equal votes the language later in the alphabet wins; extra columns are ignored (``known_language`` keeps them); no rows give no rows, and
without rows to learn from every text is ``und``.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexigrove.llm import kernel as K
from lexigrove.llm.common import ROOM, fold, keep, place, rows, sampled_texts, share

DIM = 4096
SAMPLE = 500
UND = "und"
#: ISO 639-1 codes by family (public knowledge); a code not listed is a family of its own.
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "fy", "is", "lb", "nl", "no", "nb", "nn", "sv"],
    "romance": ["ca", "es", "fr", "gl", "it", "oc", "pt", "ro"],
    "slavic": ["be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "indic": ["bn", "gu", "hi", "mr", "ne", "pa", "ur"],
    "uralic": ["et", "fi", "hu"],
    "turkic": ["az", "kk", "tr", "uz"],
    "semitic": ["ar", "he"],
}
FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes}
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True


def grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of words (with a blank at both ends), and how many each word has."""
    size = ends - starts
    padded = np.full(int((size + 2).sum()), 32, np.uint32)
    begin = np.concatenate([[0], np.cumsum(size + 2)[:-1]])
    inner = np.repeat(begin + 1 - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum()))
    padded[inner] = data[np.repeat(starts - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum()))]
    left = np.repeat(begin + size + 2, size + 2) - np.arange(len(padded))
    out = np.zeros((len(padded), 3), np.int64)
    code = np.zeros(len(padded), np.uint32)
    for n in range(3):
        shifted = np.zeros(len(padded), np.uint32)
        shifted[: len(padded) - n] = padded[n:]
        code = code * np.uint32(257) + shifted + np.uint32(1)
        mixed = ((code * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int64)  # top 12 bits: DIM buckets
        out[:, n] = np.where(left > n, mixed, -1)
    counts = 3 * size + 3  # (s+2) + (s+1) + s
    flat = out.reshape(-1)
    return flat[flat >= 0], counts


def shares(texts: list[str]) -> np.ndarray:
    """Documents x DIM: share of each n-gram, scaled to make weights of order one."""
    x = np.zeros((len(texts), DIM), np.float32)
    for a, b, data, off in K.slices(pa.array(texts, pa.string()), 1 << 18):  # small slices: this runs in the driver
        w = K.Words(data, off, lower=True)
        g, counts = grams(w.data, w.starts, w.ends)
        per = np.concatenate([[0], np.cumsum(counts)])[w.bounds]
        for i in range(b - a):
            part = g[per[i] : per[i + 1]]
            if len(part):
                x[a + i] = np.bincount(part, minlength=DIM) * (np.float32(20) / len(part))
    return x


def svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, steps: int = 150) -> tuple[np.ndarray, float, float]:
    """Squared-hinge linear SVM by accelerated gradient steps; weights, bias and the slope of its confidence."""
    y = np.where(y, 1.0, -1.0).astype(np.float32)
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
    w = np.zeros(x.shape[1] + 1, np.float32)
    v, rate, t = w.copy(), 1.0 / (1.0 + 2 * cost * (float(np.einsum("ij,ij->", x, x)) / len(x) + 1)), 1.0
    for _ in range(steps):
        m = 1 - y * (x @ v[:-1] + v[-1])
        c = -2 * cost * weight * y * np.maximum(m, 0)
        g = np.append(c @ x, c.sum()) + np.append(v[:-1], 0)
        new = v - rate * g
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + np.float32((t - 1) / t2) * (new - w), new, t2
    m = x @ w[:-1] + w[-1]
    return w[:-1], float(w[-1]), 4.0 / max(float(np.abs(m).mean()), 1e-6)


class Model:
    """Family classifiers (one against the rest) and, within families, one SVM for each pair of languages."""

    def __init__(self, texts: list[str], langs: list[str]):
        self.langs = sorted(set(langs))
        family = {c: FAMILY.get(c.split("-")[0].lower(), c) for c in self.langs}
        self.families = sorted(set(family.values()))
        self.members = {f: [c for c in self.langs if family[c] == f] for f in self.families}
        x, y = shares(texts), np.array(langs)
        fy = np.array([family[c] for c in langs])
        models = []
        self.pairs = []
        if len(self.families) > 1:
            first = self.families[:1] if len(self.families) == 2 else self.families
            models += [svm(x, fy == f) for f in first]
        self.n_family = len(models)
        for f in self.families:
            for a, b in combinations(self.members[f], 2):
                use = (y == a) | (y == b)
                models.append(svm(x[use], y[use] == a))
                self.pairs.append((a, b))
        self.w = np.stack([m[0] for m in models], axis=1) * np.float32(20) if models else np.zeros((DIM, 0), np.float32)
        self.b = np.array([m[1] for m in models])
        self.slope = np.array([m[2] for m in models])

    def words(self, strings: list[bytes]) -> np.ndarray:
        """Per word: the sum of the weights of its n-grams for each model, and the number of n-grams."""
        data = np.frombuffer(b"".join(strings), np.uint8)
        size = np.fromiter(map(len, strings), np.int64, len(strings))
        ends = np.cumsum(size)
        g, counts = grams(data, ends - size, ends)
        return np.column_stack([K.sums(self.w[g], np.concatenate([[0], np.cumsum(counts)])), counts])

    def predict(self, col: pa.Array, memo: K.Memo) -> tuple[list[str], np.ndarray]:
        names, score = np.full(len(col), UND, object), np.zeros(len(col))
        if not self.langs:
            return names.tolist(), score
        for a, b, data, off in K.slices(col):
            w = K.Words(data, off, lower=True)
            total = np.zeros((b - a, self.w.shape[1] + 1))
            if len(w.starts):
                at, values = memo(w.data, w.starts, w.ends)
                total = w.sums(values[at])
            z = (total[:, :-1] / np.maximum(total[:, -1:], 1) + self.b) * self.slope
            p = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
            fam = p[:, : self.n_family]
            if self.n_family == 1:
                fam = np.column_stack([fam, 1 - fam])
            elif not self.n_family:
                fam = np.ones((b - a, 1))
            fam = fam / np.maximum(fam.sum(1, keepdims=True), 1e-12)
            best = fam.argmax(1)
            ascii_letter = K.sums(LETTER[data].astype(np.int64), off) > 0
            for i in range(b - a):
                if not ascii_letter[i]:
                    raw = data[off[i] : off[i + 1]]
                    if not (raw > 127).any() or not any(map(str.isalpha, raw.tobytes().decode("utf-8", "replace"))):
                        continue
                members = self.members[self.families[best[i]]]
                votes, conf = dict.fromkeys(members, 0.0), dict.fromkeys(members, 1.0)
                for j, (c, d) in enumerate(self.pairs, self.n_family):
                    if c in votes:
                        q = p[i, j]
                        votes[c] += (q > 0.5) + q / 1000
                        votes[d] += (q <= 0.5) + (1 - q) / 1000
                        conf[c], conf[d] = min(conf[c], q), min(conf[d], 1 - q)
                win = max(members, key=lambda m: (votes[m], m))
                names[a + i], score[a + i] = win, float(fam[i, best[i]] * conf[win])
        return names.tolist(), score


#: Languages that are learned, the commonest ones of the column; texts and bytes of all of them together.
LANGUAGES, TEXTS, BYTES = 256, 8000, 192 << 20


def fit(docs: DataFrame, most: int = SAMPLE) -> Model:
    """From the ``most`` documents of each language with the smallest hash of their id, outside fold 2 of 4.

    The sample is bounded whatever the column holds: at most LANGUAGES languages, TEXTS texts and BYTES bytes in all, of which
    each language has its even share.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", 4) != 2)).select("doc_id", "lang")
    sizes = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    if not sizes:
        return Model([], [])
    most = min(most, max(1, TEXTS // len(sizes)))
    below = docs.sparkSession.createDataFrame([(r.lang, share(r.n, most)) for r in sizes], "lang string, below long")  # at most LANGUAGES rows
    order = Window.partitionBy("lang").orderBy(place(), "doc_id")
    ids = known.join(F.broadcast(below), "lang").where(place() < F.col("below")).withColumn("r", F.row_number().over(order)).where(F.col("r") <= most)
    picked = [(int(r.doc_id), r.lang) for r in ids.select(F.col("doc_id").cast("long").alias("doc_id"), "lang").collect()]
    got = sampled_texts(docs.where(F.col("lang").isNotNull()), sorted(picked), "string", room=min(ROOM, BYTES // len(sizes)))
    return Model([t for t, _ in got], [lang for _, lang in got])


SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


def language_id(docs: DataFrame, most: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row; extra columns are ignored."""
    model = fit(docs, most)

    def run(batches):
        memo = K.Memo(model.words)
        for b in batches:
            names, score = model.predict(b.column(2), memo)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1), pa.array(names, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    return rows(docs.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "text"), run, SCHEMA)


def known_language(docs: DataFrame, least: float = 0.5, short: int = 20, most: int = SAMPLE) -> DataFrame:
    """Rows whose language is recognised: not ``und``, and score at least ``least`` once there are ``short`` words.

    Shorter texts give too little evidence to be rejected for a low score and stay.
    """
    model = fit(docs, most)

    def make():
        memo = K.Memo(model.words)

        def mask(col):
            names, score = model.predict(col, memo)
            n = np.concatenate([K.Words(d, o).counts for _, _, d, o in K.slices(col)]) if len(col) else np.zeros(0)
            return np.array([c != UND for c in names], bool) & ((score >= least) | (n < short))

        return mask

    return keep(docs, make)
