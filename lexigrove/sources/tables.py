"""Intermediate tables in the folder that driver and executors share; lineage ends there and survives lost executors."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir or the context's checkpoint folder; a folder of this machine only where all runs in one process."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lexigrove-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def place(spark: SparkSession) -> str:
    """A new place in the shared folder."""
    return f"{shared_folder(spark)}/lexigrove-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str | None = None, mode: str = "errorifexists") -> DataFrame:
    """The frame written as Parquet (to ``path``, else to a new place in the shared folder) and read again."""
    spark = df.sparkSession
    own = path or place(spark)
    df.write.mode(mode).parquet(own)
    out = spark.read.schema(df.schema).parquet(own)
    out._lexigrove_own = None if path else own
    return out


def deleted(df: DataFrame) -> None:
    """Deletes what ``stored`` wrote to a place of its own, once nothing reads it any more."""
    own = getattr(df, "_lexigrove_own", None)
    if own:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(own)
        p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def version(spark: SparkSession, path: str) -> tuple[str, int, int]:
    """Path, bytes and time of change of a file or folder: differs once its files were written anew."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return path, fs.getContentSummary(p).getLength(), fs.getFileStatus(p).getModificationTime()


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)
