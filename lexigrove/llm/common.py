"""What the operators of this subpackage share: folds, bounded label samples, Arrow passes, saved tables."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexigrove.sources.tables import shared_folder as shared_dir

#: Where the public vocabulary files are; the driver reads them and ships their bytes to the executors.
TOKENIZERS = "/opt/tokenizers"


BATCH = 8 << 20
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column | str, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id falls in fold 0."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string")) % mod, F.lit(0))


def rows(df: DataFrame, make: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow with batches of ``BATCH`` bytes at most (or one longer row), which bounds a worker's memory.

    Spark reads the setting when the plan runs, so it stays in the session; a smaller one of the caller's is left as it is.
    """
    conf = df.sparkSession.conf
    if in_bytes(conf.get(_BATCH_KEY)) > BATCH:
        conf.set(_BATCH_KEY, f"{BATCH}b")

    def run(batches):
        yield from make(batches)
        released()

    return df.mapInArrow(run, schema)


def released() -> None:
    """Gives memory that a task no longer uses back to the system, as its Python worker lives on for other tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def in_bytes(size: str) -> int:
    """Bytes of a Spark size such as 64m, 8388608b or 1gb; a bare number counts bytes."""
    number = size.strip().lower().rstrip("b")
    unit = {"k": 10, "m": 20, "g": 30, "t": 40, "p": 50}.get(number[-1:], 0)
    return int(number[:-1] if unit else number) << unit


def keep(docs: DataFrame, make: Callable[[], Callable[[pa.Array], "pa.Array"]], text: str = "text") -> DataFrame:
    """Rows of ``docs`` whose text a mask accepts, all columns as they are; no join, no shuffle. ``make`` gives each task its mask."""
    at = docs.columns.index(text)

    def run(batches):
        mask = make()
        for b in batches:
            if b.num_rows:
                yield b.filter(pa.array(mask(b.column(at)), pa.bool_()))

    return rows(docs, run, docs.schema)


def saved(df: DataFrame) -> DataFrame:
    """The frame written to the shared folder and read again: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lexigrove-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lexigrove_path = path
    return out


def forget(df: DataFrame | None) -> None:
    """Deletes what ``saved`` wrote, once nothing reads it any more."""
    path = getattr(df, "_lexigrove_path", None)
    if path:
        jvm, spark = df.sparkSession._jvm, df.sparkSession
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


_SPREAD = 1 << 30


def place(doc_id: str = "doc_id") -> Column:
    """A fixed place of an id in [0, 2^30), spread evenly."""
    return F.pmod(F.xxhash64(doc_id), F.lit(_SPREAD))


def share(count: int, most: int) -> int:
    """Places below this hold about three times ``most`` of ``count`` rows, or all of them.

    Filtering by it before ranking keeps what a task passes on independent of the number of tasks.
    """
    return _SPREAD if count <= 3 * most else int(_SPREAD * 3 * most / count)


#: Bytes of sampled texts of one class or language that may reach the driver, and of one such text.
ROOM, LONGEST = 48 << 20, 4 << 20


def sampled_texts(docs: DataFrame, picked: list[tuple[int, object]], kind: str, room: int = ROOM, longest: int = LONGEST) -> list[tuple[str, object]]:
    """(text, value) of the picked (doc_id, value) pairs in a fixed order; ``kind``: SQL type of the values.

    One text an id, the one with the smallest hash (then the smallest) if an id repeats; null texts and texts of over ``longest``
    bytes do not count. Of each value the texts that come first by the hash of their id, as long as they fill at most ``room``
    bytes together. Both bounds are applied before anything is collected.
    """
    if not picked:
        return []
    spark = docs.sparkSession
    # the ids are bounded by the callers' samples, so broadcasting them does not grow with the data
    ids = spark.createDataFrame(picked, f"doc_id long, y {kind}").dropDuplicates(["doc_id"])
    size = F.octet_length("text")
    got = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).where(F.col("text").isNotNull() & (size <= longest)).join(F.broadcast(ids), "doc_id")
    one = got.groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), F.col("text"))).alias("t")).select("doc_id", "y", F.col("t.text").alias("text"))
    filled = F.sum(size).over(Window.partitionBy("y").orderBy(place(), "doc_id"))
    found = one.withColumn("filled", filled).where(F.col("filled") <= room).select("doc_id", "y", "text").collect()
    return [(r.text, r.y) for r in sorted(found, key=lambda r: r.doc_id)]


def labelled(docs: DataFrame, labels: DataFrame, target: str, most: int) -> list[tuple[str, int]]:
    """Up to ``most`` (text, label) rows of each class for fitting a classifier, in a fixed order.

    The rows come from documents whose crc32(doc_id as text) mod 3 is not 1, those with the smallest
    hash of the id first, within the bounds of ``sampled_texts``. A document with several
    labels counts with the largest; null labels and null texts do not count. No labels: no rows.
    """
    lab = labels.select("doc_id", F.col(target).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & (fold("doc_id", 3) != 1))
    lab = lab.groupBy("doc_id").agg(F.max("y").alias("y"))
    sizes = {r.y: r["count"] for r in lab.groupBy("y").count().collect()}
    picked = [(int(r.doc_id), int(r.y)) for y, n in sorted(sizes.items()) for r in lab.where((F.col("y") == y) & (place() < share(n, most))).orderBy(place(), "doc_id").limit(most).collect()]
    return sampled_texts(docs, picked, "int")
