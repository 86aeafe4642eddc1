"""Quality rules: an isolation forest on rule statistics.

Every text is described by rule statistics that are exact and cover the whole text. An isolation forest
(random axis-parallel splits of small subsamples; anomalous rows are isolated by short paths) gives each text an
anomaly score. Every labelled row may be drawn for a tree, each as likely as any other, and the threshold is the best one
over the scores of all labelled rows, found without collecting them. Null or empty texts have no words and fail the rules.
Texts of any length are read whole; repeated rows get equal results; no row is dropped. Ties of thresholds go to the largest;
extra columns are ignored; no rows give no rows; words and lines are told apart by their bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexigrove.llm import kernel as K
from lexigrove.llm.common import fold, forget, rows, saved

SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
PUNCT = np.zeros(256, bool)
PUNCT[[ord(c) for c in "!?.,;:"]] = True
#: Order of the columns that ``statistics`` returns.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_digit", "n_punct", "n_bytes", "n_top_word")
#: Trees of the forest and rows that each is grown from.
TREES, PSI = 100, 256
#: Bad rows among those the forest is grown from, for each good one.
RARE = 0.03


def statistics(col: pa.Array) -> np.ndarray:
    """One row of COUNTS for each text."""
    out = np.zeros((len(col), len(COUNTS)), np.int64)
    for a, b, data, off in K.slices(col):
        w = K.Words(data, off)
        n = w.counts
        chars = (data & 0xC0) != 0x80
        cum = lambda mask: K.sums(mask.astype(np.int64), off)
        r = out[a:b]
        r[:, 0] = n
        r[:, 1] = cum(chars & w.inside)
        r[:, 2] = cum(SYMBOL[data])
        r[:, 7], r[:, 8], r[:, 9] = cum(UPPER[data]), cum(DIGIT[data]), cum(PUNCT[data])
        r[:, 10] = np.diff(off)
        # lines: runs between newlines that hold a word
        s, e = K.runs(data != 10, off)
        if len(s):
            wc = np.concatenate([[0], np.cumsum(w.inside)])
            has = wc[e] > wc[s]
            s, e = s[has], e[has]
            line_doc = np.searchsorted(off, s, "right") - 1
            r[:, 5] = np.bincount(line_doc, minlength=b - a)
            code, lines = K.distinct(data, s, e)
            first = np.unique(line_doc * len(lines) + code, return_index=True)[1]
            r[:, 3] = r[:, 5] - np.bincount(line_doc[first], minlength=b - a)
        if len(w.starts):
            docs, (code, words) = w.docs(), K.distinct(data, w.starts, w.ends)
            own, count = np.unique(docs * len(words) + code, return_counts=True)
            owner = own // len(words)
            r[:, 6] = np.bincount(owner, minlength=b - a)
            np.maximum.at(r[:, 11], owner, count)
            at = np.flatnonzero(docs[:-2] == docs[2:])  # where three words of one text begin
            if len(at):
                pair = K.joined(K.joined(docs[at], code[at]), code[at + 1])
                hit = at[K.repeated(K.joined(pair, code[at + 2]))]
                mark = np.zeros(len(code), np.int64)
                for i in range(3):
                    mark[hit + i] = 1
                r[:, 4] = K.sums(mark, w.bounds)
    return out


def failed(c: np.ndarray) -> np.ndarray:
    """The fixed base rules."""
    return (c[:, 0] < 50) | (100 * c[:, 4] > 50 * c[:, 0])


def features(c: np.ndarray) -> np.ndarray:
    """Ratios that do not depend on length alone: symbols, distinct words and the commonest word by words, capitals by bytes."""
    n = np.maximum(c[:, 0], 1).astype(np.float64)
    return np.stack([c[:, 2] / n, c[:, 6] / n**0.85, c[:, 7] / np.maximum(c[:, 10], 1), c[:, 11] / n], axis=1)


class IsolationForest:
    """Isolation trees (Liu, Ting and Zhou 2008) over subsamples of ``psi`` rows, kept as flat arrays."""

    def __init__(self, x: np.ndarray, trees: int = TREES, psi: int = PSI, seed: int = 7):
        rng = np.random.default_rng(seed)
        psi = min(psi, len(x))
        self.limit = int(np.ceil(np.log2(max(psi, 2))))
        self.norm = self.c(np.array([psi]))[0] or 1.0
        self.trees = [self.grow(x[rng.choice(len(x), psi, replace=False)], rng) for _ in range(trees)]

    @staticmethod
    def c(n: np.ndarray) -> np.ndarray:
        """Mean path length of an unsuccessful search among n rows."""
        n = n.astype(np.float64)
        m = np.maximum(n, 2)
        return np.where(n <= 1, 0.0, 2 * (np.log(m - 1 + (m == 2) * 1e-12) + np.euler_gamma) - 2 * (m - 1) / m) * (n > 2) + (n == 2) * 1.0

    def grow(self, x: np.ndarray, rng) -> tuple[np.ndarray, ...]:
        feature, cut, left, right, value = [], [], [], [], []

        def node(x: np.ndarray, depth: int) -> int:
            i = len(feature)
            for a, v in ((feature, -1), (cut, 0.0), (left, i), (right, i), (value, depth + self.c(np.array([len(x)]))[0])):
                a.append(v)
            spread = np.flatnonzero(x.max(0) > x.min(0)) if len(x) > 1 else []
            if depth < self.limit and len(spread):
                f = int(rng.choice(spread))
                t = float(rng.uniform(x[:, f].min(), x[:, f].max()))
                below = x[:, f] <= t
                feature[i], cut[i] = f, t
                left[i], right[i] = node(x[below], depth + 1), node(x[~below], depth + 1)
            return i

        node(x, 0)
        return tuple(map(np.array, (feature, cut, left, right, value)))

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / norm): towards 1 for anomalies."""
        total, row = np.zeros(len(x)), np.arange(len(x))
        for feature, cut, left, right, value in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.limit):
                f = feature[at]
                at = np.where(x[row, f] <= cut[at], left[at], right[at])  # a leaf leads to itself
            total += value[at]
        return 2.0 ** (-total / len(self.trees) / self.norm)


def labelled(counts: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, y, x): features of every labelled row that passes the base rules, for learning.

    The rows come from documents whose crc32(doc_id as text) mod 3 is not 1. Of several labels the largest counts, of several texts of
    an id the one with the smallest hash (equal texts have equal features); null labels and null texts do not count.
    """
    lab = labels.select("doc_id", F.col("quality").cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & (fold("doc_id", 3) != 1))
    lab = lab.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("y").alias("y"))
    one = counts.where(F.col("hash").isNotNull()).select("doc_id", "hash", "base_failed", "x").join(lab, "doc_id").groupBy("doc_id", "y").agg(F.min(F.struct("hash", "x", "base_failed")).alias("t"))
    return one.select("doc_id", "y", "t.x", "t.base_failed").where(~F.col("base_failed")).drop("base_failed")


def grown(rows_: DataFrame, seed: int = 7) -> tuple[IsolationForest, dict[int, int]] | None:
    """Forest over rows labelled good, with ``RARE`` as many bad ones so that their directions are split too, and the rows by label.

    Each tree is grown from ``PSI`` rows, so TREES * PSI good ones with the smallest hashes of their ids are as many as all trees
    could draw; no rows labelled good: None.
    """
    sizes = {r.y: r["count"] for r in rows_.groupBy("y").count().collect()}
    if not sizes.get(1):
        return None
    most = TREES * PSI
    got = {}
    for y, n in ((1, most), (0, int(np.ceil(RARE * min(most, sizes[1]))))):
        drawn = rows_.where(F.col("y") == y).orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(n).select("x").collect()
        got[y] = np.array([r.x for r in drawn]).reshape(-1, 4)
    return IsolationForest(np.concatenate([got[1], got[0]]), seed=seed), sizes


def threshold(scores: DataFrame, good: int, bad: int) -> float:
    """The threshold that best separates (s, y), the scores and labels of ``good`` and ``bad`` rows; only totals of bins of scores reach the driver.

    Losing a clean text costs ten times what missing a bad one does; ties go to the largest threshold, which is put halfway to the next score.
    """
    by = scores.groupBy("s").agg(F.sum("y").alias("g"), F.sum(1 - F.col("y")).alias("b")).withColumn("bin", F.floor(F.col("s") * 4096))
    bins = sorted((r.bin, r.g, r.b) for r in by.groupBy("bin").agg(F.sum("g").alias("g"), F.sum("b").alias("b")).collect())
    before, g, b = [], 0, 0
    for k, x, y in bins:
        before.append((k, g, b))
        g, b = g + x, b + y
    first = scores.sparkSession.createDataFrame(before, "bin long, g0 long, b0 long")
    upto = Window.partitionBy("bin").orderBy("s")
    gain = 10 * (F.col("g0") + F.sum("g").over(upto)) / F.lit(good) - (F.col("b0") + F.sum("b").over(upto)) / F.lit(bad)
    cuts = by.join(F.broadcast(first), "bin").select("s", gain.alias("gain"))
    most = cuts.agg(F.max("gain")).first()[0]
    best = cuts.where(F.col("gain") >= most - 1e-12).agg(F.max("s")).first()[0]
    following = by.where(F.col("s") > best).agg(F.min("s")).first()[0]
    return best if following is None else (best + following) / 2


def fit(counts: DataFrame, labels: DataFrame, seed: int = 7) -> tuple[IsolationForest, float]:
    """Forest and threshold from all labelled rows; without labels of both kinds nothing but the base rules rejects."""
    learn = saved(labelled(counts, labels))
    try:
        found = grown(learn, seed)
        if found is None:
            return IsolationForest(np.zeros((2, 4)), 1), 1.0
        forest, sizes = found
        if not sizes.get(0):
            return forest, 1.0

        def run(batches):
            for b in batches:
                if b.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(forest.score(b.column(0).flatten().to_numpy().reshape(-1, 4))), b.column(1).cast(pa.int64())], names=["s", "y"])

        scores = saved(rows(learn.select("x", "y"), run, "s double, y long"))
        try:
            return forest, float(threshold(scores, sizes[1], sizes[0]))
        finally:
            forget(scores)
    finally:
        forget(learn)


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, anomaly double, kept boolean"


#: What is counted of each text, once: ``hash`` is null for a null text, ``x`` has the features.
COUNTED = SCHEMA.split(", anomaly")[0] + ", hash long, x array<double>"


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rule statistics, anomaly score and verdict for every document; extra columns are ignored."""

    def count(batches):
        for b in batches:
            c = statistics(b.column(1))
            x = pa.ListArray.from_arrays(pa.array(np.arange(0, 4 * len(c) + 1, 4, dtype=np.int32)), pa.array(features(c).ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *(pa.array(c[:, i]) for i in range(5)), pa.array(failed(c)), b.column(2), x], names=[f.split()[0] for f in COUNTED.split(", ")])

    counts = saved(rows(docs.select("doc_id", "text", F.when(F.col("text").isNotNull(), F.xxhash64("text")).alias("hash")), count, COUNTED))
    forest, most = fit(counts, labels)

    def judge(batches):
        for b in batches:
            s = forest.score(b.column(7).flatten().to_numpy().reshape(-1, 4))
            kept = ~b.column(6).to_numpy(zero_copy_only=False) & (s <= most)
            yield pa.RecordBatch.from_arrays([*b.columns[:7], pa.array(s), pa.array(kept)], names=[f.split()[0] for f in SCHEMA.split(", ")])

    return rows(counts.drop("hash"), judge, SCHEMA)
