"""Target-distribution importance resampling over hashed word n-grams, with long texts chunked.

Words are the runs outside ASCII signs, blanks and controls, A-Z lower-cased. Features are all runs of ``low`` to ``high``
words joined by one blank; a feature's bucket is the crc32 of its UTF-8 bytes modulo ``buckets``. A bucket's gain compares
its smoothed share in the target texts with that in all documents; a document's weight is the sum of its features' gains,
and adding a Gumbel number made from the id turns "highest scores first" into a draw without replacement.

Overlap chunking: a text of more than ``CHUNK`` bytes is split at word boundaries into chunks that own the words that begin
in them and carry the next ``high - 1`` words, so every feature belongs to the one chunk in which it begins. Chunks of long
texts are dealt to all tasks; shorter texts are one chunk and stay where they are. Counts and weights are summed by document.
A chunk's buckets are written once (about two bytes a feature), so texts are read and cut once; only that table, counts by
bucket (bounded by ``buckets``) and one small row a document are shuffled.

Null texts have no words. Repeated rows are documents of their own, told apart by a row number that is written with the
chunks. Ties of score go to the smaller doc_id, then to fewer features; a null id is hashed as an empty one and comes last.
A word longer than ``CHUNK`` makes a chunk of its own. Extra columns are ignored. No documents give no rows; an empty target
gives gains from documents alone.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrove.llm.common import forget, rows, saved

BUCKETS, SEED, PERCENT, LEAST = 10_000, 2024, 10, 20
#: Bytes a chunk owns, except for its last word, which it holds whole.
CHUNK = 256 << 10
WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")
_FEATURES = "row long, doc_id long, n_words long, buckets array<int>"


def chunks(text: bytes, carry: int, size: int = CHUNK):
    """(words owned, bytes of the chunk with ``carry`` words of what follows) of a text in lower case."""
    at, n = 0, len(text)
    while at < n:
        end = at + size
        if end >= n:
            yield None, text[at:]
            return
        tail = WORDS.match(text, end)
        if tail and WORDS.match(text, end - 1):  # a word that begins before the border is owned whole
            end = tail.end()
        own, stop = text[at:end], end
        for m in zip(range(carry), WORDS.finditer(text, end)):
            stop = m[1].end()
        yield (len(WORDS.findall(own)) if carry else None), text[at:stop]
        at = end


def features(text: bytes, owned: int | None, low: int, high: int, buckets: int) -> tuple[int, np.ndarray]:
    """Number of owned words and the buckets of the features that begin at them."""
    words = WORDS.findall(text)
    n = len(words) if owned is None else owned
    found = []
    for k in range(low, high + 1):
        runs = words[:n] if k == 1 else [b" ".join(words[i : i + k]) for i in range(min(n, len(words) - k + 1))]
        found.append(np.fromiter(map(zlib.crc32, runs), np.uint32, len(runs)) % np.uint32(buckets))
    return n, np.concatenate(found).astype(np.int32)


def featured(docs: DataFrame, low: int, high: int, buckets: int, size: int) -> DataFrame:
    """row, doc_id, n_words, buckets of every chunk; ``docs``: row, doc_id, text."""
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("buckets", pa.list_(pa.int32()))])

    def cut(batches):
        for b in batches:
            for row, doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                for i, (owned, piece) in enumerate(chunks(text.as_py().encode().lower(), high - 1, size)):
                    one = [[row], [doc], [i], [owned], [piece]]
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(one, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["row", "doc_id", "chunk", "owned", "piece"])

    def count(batches):
        for b in batches:
            got = [features(t.lower(), o, low, high, buckets) for t, o in zip(b.column(3).to_pylist(), b.column(2).to_pylist())]
            lengths = np.cumsum([0] + [len(f) for _, f in got]).astype(np.int32)
            flat = np.concatenate([f for _, f in got]) if got else np.zeros(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(lengths), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([n for n, _ in got], pa.int64()), lists], schema=schema)

    long = F.octet_length("text") > size
    cols = ["row", "doc_id", F.lit(None).cast("long").alias("owned"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("piece")]
    short = rows(docs.where(~F.coalesce(long, F.lit(False))).select(*cols), count, _FEATURES)
    # long texts take the numbers below zero, so that the two scans never share a row number
    pieces = rows(docs.where(long).select((-1 - F.col("row")).alias("row"), "doc_id", "text"), cut, "row long, doc_id long, chunk long, owned long, piece binary")
    return short.unionByName(rows(pieces.repartition("row", "chunk").select("row", "doc_id", "owned", "piece"), count, _FEATURES))


def bucket_counts(chunked: DataFrame, buckets: int) -> np.ndarray:
    """How many features fall in each bucket; tasks add up what they hold, the driver gets at most one row a bucket."""

    def add(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            total += np.bincount(b.column(0).flatten().to_numpy(zero_copy_only=False), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["bucket", "n"])

    total = np.zeros(buckets, np.int64)
    for r in rows(chunked.select("buckets"), add, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        total[r.bucket] = r.n
    return total


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of the smoothed share in the target by that in the source, for each bucket."""
    n, s, t = len(source), float(source.sum()), float(target.sum())
    ratio = (target + 1.0) * (s + n) / ((source + 1.0) * (t + n))
    return np.array([math.floor(1000 * math.log(r)) for r in ratio.tolist()], np.int64)


def weighed(chunked: DataFrame, gain: np.ndarray) -> DataFrame:
    """n_words, n_features and weight of every row, chunk by chunk and then summed by document."""
    schema = "row long, doc_id long, n_words long, n_features long, weight long"

    def add(batches):
        for b in batches:
            lists = b.column(3)
            per = np.concatenate([[0], np.cumsum(gain[lists.flatten().to_numpy(zero_copy_only=False)])])
            ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(np.diff(ends), pa.int64()), pa.array(np.diff(per[ends]), pa.int64())], ["row", "doc_id", "n_words", "n_features", "weight"])

    sums = [F.sum(c).alias(c) for c in ("n_words", "n_features", "weight")]
    return rows(chunked, add, schema).groupBy("row", "doc_id").agg(*sums)


def gumbel(doc_id: str, seed: int) -> F.Column:
    """floor(-1000 ln(-ln u)) of a fixed number u in (0, 1) made from the id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def ranked(scored: DataFrame, percent: int, least: int) -> DataFrame:
    """The rank of the drawn rows, without a task that sees them all.

    Rows are range-partitioned by their place in the order and written sorted with partition and place; the sizes of the
    partitions (one small row each) give what stands before each of them.
    """
    first = [F.col("able").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("row")]
    put = scored.withColumn("able", F.col("n_words") >= least).repartitionByRange(*first).sortWithinPartitions(*first)
    put = saved(put.withColumn("at", F.monotonically_increasing_id()))  # partition * 2^33 + place within it
    part = F.shiftright("at", 33)
    sizes = put.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.count_if("able").alias("able")).orderBy("part").collect()
    before = np.cumsum([0] + [r.n for r in sizes]).tolist()
    drawn = percent * sum(r.able for r in sizes) // 100
    starts = put.sparkSession.createDataFrame([(r["part"], b) for r, b in zip(sizes, before)], "part long, before long")
    out = put.withColumn("part", part).join(F.broadcast(starts), "part", "left")
    place = F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1) + 1
    return out.withColumn("rank", F.when(F.col("able") & (place <= drawn), place))


def importance(docs: DataFrame, target: DataFrame, low: int = 1, high: int = 1, buckets: int = BUCKETS, seed: int = SEED, percent: int = PERCENT, least: int = LEAST, size: int = CHUNK) -> DataFrame:
    """doc_id, n_features, weight, score, rank and n_words of every row of ``docs``; rank is null where a row is not drawn.

    ``docs`` needs doc_id and text, ``target`` text. ``percent`` of the rows with ``least`` words or more are drawn.
    """
    own = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    wanted = target.select(F.lit(0).cast("long").alias("row"), F.lit(0).cast("long").alias("doc_id"), F.col("text"))
    chunked = saved(featured(own, low, high, buckets, size))
    gain = gains(bucket_counts(chunked, buckets), bucket_counts(featured(wanted, low, high, buckets, size), buckets))
    scored = weighed(chunked, gain).withColumn("score", F.col("weight") + gumbel("doc_id", seed))
    out = ranked(scored, percent, least)
    forget(chunked)  # ranked() has written what was made from it
    return out.select("doc_id", "n_features", "weight", "score", "rank", "n_words")


def drawn(docs: DataFrame, target: DataFrame, **how) -> DataFrame:
    """The drawn rows of ``docs``, all columns as they are, in no order; an id that was drawn brings all rows that have it."""
    ids = importance(docs, target, **how).where("rank IS NOT NULL").select(F.col("doc_id").alias("_drawn")).distinct()
    return docs.join(ids, F.col("doc_id").cast("long") == F.col("_drawn"), "left_semi")


#: DuckDB SQL of ``importance`` with the parameters of the contract, over tables whose ids are distinct.
ORACLE_SQL = r"""
WITH words AS (
  SELECT 0 AS of_target, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM documents
  UNION ALL
  SELECT 1, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark
),
per_word AS (SELECT of_target, doc_id, word, count(*) AS n FROM words GROUP BY ALL),
step AS (
  SELECT list(v ORDER BY i) AS tab FROM (
    SELECT i, list_reduce(range(8), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS v FROM range(256) AS r(i))
),
hashed AS (
  SELECT word, xor(list_reduce(list_transform(range(1, length(h), 2), lambda k: 16 * (instr('0123456789ABCDEF', h[k]) - 1) + instr('0123456789ABCDEF', h[k + 1]) - 1),
           lambda c, b: xor(c >> 8, tab[1 + (xor(c, b) & 255)]), 4294967295), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT word, hex(encode(word)) AS h FROM per_word), step
),
counts AS (
  SELECT bucket, sum(n) FILTER (WHERE of_target = 0) AS s, sum(n) FILTER (WHERE of_target = 1) AS t
  FROM per_word JOIN hashed USING (word) GROUP BY bucket
),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * (sum(s) OVER () + 10000.0::DOUBLE) / ((coalesce(s, 0) + 1.0::DOUBLE) * (coalesce(sum(t) OVER (), 0) + 10000.0::DOUBLE)))) AS BIGINT) AS gain FROM counts
),
weights AS (
  SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS weight
  FROM per_word JOIN hashed USING (word) JOIN gains USING (bucket) WHERE of_target = 0 GROUP BY doc_id
),
scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
  FROM documents LEFT JOIN weights USING (doc_id)
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (WHERE n_features >= 20) OVER () AS n FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END AS rank, n_features AS n_words FROM placed
"""
