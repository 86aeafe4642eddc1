"""Incremental runs as streams of files: pages are upserted as their documents arrive, vectors made once for each text.

The state of a run is what its target holds, so a batch that is repeated after a failure changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lexigrove.sources.pages import DOCUMENT, file_name, pages_of
from lexigrove.sources.tables import exists


def page_stream(spark: SparkSession, path: str, files_per_batch: int = 200) -> DataFrame:
    """Page documents (JSON) as they appear in a folder, one row a page."""
    docs = spark.readStream.schema(DOCUMENT).option("multiLine", True).option("columnNameOfCorruptRecord", "corrupt").option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", "*.json").json(path)
    return pages_of(docs.withColumn("file", file_name()))


def replace_documents(batch: DataFrame, target: str, key: str = "doc_id", page: str = "page") -> None:
    """Pages of ``batch`` replace those of ``target``; only the folders of documents in the batch are written.

    A page that comes twice in a batch counts once, with the last file's text.
    """
    spark = batch.sparkSession
    new = batch.dropDuplicates([key, page])
    if exists(spark, target):
        old = spark.read.schema(new.schema).parquet(target)
        touched = old.join(new.select(key).distinct(), key, "left_semi")
        # cut from the files that are written over
        kept = touched.join(new.select(key, page), [key, page], "left_anti").checkpoint()
        new = new.unionByName(kept.select(*new.columns))
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(target)


def ingest(pages: DataFrame, target: str, state: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """Starts a run over what there is: each batch goes through ``transform`` and is upserted into ``target``; ``state``: its checkpoint."""
    return pages.writeStream.foreachBatch(lambda batch, _: replace_documents(transform(batch), target)).option("checkpointLocation", state).trigger(availableNow=True).start()


def unchanged_skipped(found: DataFrame, manifest: str) -> DataFrame:
    """Files (path, mtime_ns, size) that a manifest table does not have with the same time and size."""
    spark = found.sparkSession
    return found.join(spark.read.parquet(manifest), ["path", "mtime_ns", "size"], "left_anti") if exists(spark, manifest) else found


def embed_stream(texts: DataFrame, encode: Callable[[DataFrame], DataFrame], target: str, state: str) -> StreamingQuery:
    """A stream of (sha256, text): vectors of texts that ``target`` (sha256, vector) lacks are made and added."""

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates(["sha256"])
        if exists(spark, target):
            new = new.join(spark.read.parquet(target).select("sha256"), "sha256", "left_anti")
        encode(new).select("sha256", "vector").write.mode("append").parquet(target)

    return texts.writeStream.foreachBatch(add).option("checkpointLocation", state).trigger(availableNow=True).start()
