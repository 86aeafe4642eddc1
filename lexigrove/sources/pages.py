"""Sources and sinks of page collections: files, page and region documents, admission, manifests, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrove.functions import text as T

LAYOUT = "struct<n_columns:int,likely_table:boolean,unusual_layout:boolean,notes:array<string>,vlm_notes:string>"
PAGE = (
    f"struct<doc_id:string,page:int,page_class:string,status:string,text:string,text_source:string,layout:{LAYOUT},tlq_score:double,lexical_quality:double,iqs_level:string,"
    "confidence:double,preview_path:string,notes:array<string>,provenance:map<string,string>,needs_vlm:boolean,vlm_attempted:boolean,vlm_used:boolean,vlm_quality:string,ocr_fallback_used:boolean,elapsed_ms:int>"
)
DOCUMENT = f"doc_id string, source_path string, page_count int, pages array<{PAGE}>, summary map<string,string>, corrupt string"
BOX = "struct<x1:double,y1:double,x2:double,y2:double>"
REGIONS = (
    f"doc_id string, source_path string, page_count int, pages array<struct<doc_id:string,page:int,summary:map<string,string>,"
    f"blocks:array<struct<region_id:string,type:string,bbox:{BOX},content:map<string,string>,quality:map<string,string>,provenance:map<string,string>>>>>, corrupt string"
)


def files(spark: SparkSession, path: str, glob: str = "*.{pdf,PDF}") -> DataFrame:
    """(path, modificationTime, length, content) of one file, or of all that match below a folder, each once."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path).dropDuplicates(["path"])


def file_name() -> Column:
    """Name of the file a row is from; Spark gives it as part of a URI."""
    return F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))


def page_ranges(c: Column, skip_blanks: bool = True) -> Column:
    """``1-3,7`` as sorted distinct page numbers; null or empty means all pages and gives null.

    Without ``skip_blanks`` an empty item is an error.
    """
    items = F.transform(F.split(c, ","), lambda x: F.trim(x))
    items = F.filter(items, lambda x: x != "") if skip_blanks else items
    ends = lambda x: F.split(x, "-")
    one = F.transform(items, lambda x: F.sequence(F.get(ends(x), F.lit(0)).cast("int"), F.coalesce(F.get(ends(x), F.lit(1)), F.get(ends(x), F.lit(0))).cast("int")))
    return F.when(F.coalesce(F.trim(c), F.lit("")) != "", F.array_sort(F.array_distinct(F.flatten(one))))


def sampled_pages(pages: Column, n: int) -> Column:
    """``n`` page numbers spread evenly from the first to the last; all of them if there are no more."""
    every = F.when(pages > 0, F.sequence(F.lit(1), pages)).otherwise(F.array().cast("array<int>"))
    if n <= 0:
        return every
    if n == 1:
        return F.when(pages > 1, F.array(F.lit(1))).otherwise(every)
    spread = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (1 + F.bround(i * (pages - 1) / (n - 1), 0)).cast("int"))
    return F.when(pages > n, F.slice(F.array_sort(F.array_distinct(F.concat(F.array(F.lit(1), pages), spread))), 1, n)).otherwise(every)


def documents(spark: SparkSession, path: str, schema: str = DOCUMENT) -> DataFrame:
    """Page (or region) documents, one JSON file each; a file that is no JSON has its text in ``corrupt``."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "corrupt").option("pathGlobFilter", "*.json").json(path).withColumn("file", file_name())


def pages_of(docs: DataFrame) -> DataFrame:
    """One row a page; a page without an id takes its document's, a document without one its file's name."""
    name = F.coalesce("doc_id", F.regexp_replace("file", r"_pages\.json$", ""))
    source = F.coalesce(F.element_at(F.split("source_path", r"[\\/]"), -1), name)
    return docs.where(F.col("corrupt").isNull()).select(name.alias("d"), source.alias("source_file"), F.explode("pages").alias("p")).select("p.*", "source_file", "d").withColumn("doc_id", F.coalesce("doc_id", "d")).drop("d")


def low_confidence(provenance: Column, notes: Column) -> Column:
    flag = lambda k: F.coalesce(F.lower(provenance[k]).isin("true", "1"), F.lit(False))
    return flag("low_confidence") | flag("garbage_veto") | F.coalesce(F.array_contains(notes, "low_confidence"), F.lit(False))


def admission(pages: DataFrame) -> DataFrame:
    """``pages`` with ``reason``: the first rule that keeps a page out of the index, null for an admitted one."""
    return pages.withColumn("reason", T.reject_reason(F.col("page_class"), F.col("status"), low_confidence(F.col("provenance"), F.col("notes")), F.col("text")))


def build_report(docs: DataFrame, judged: DataFrame, raw_chunks: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row of counters: files, bad and empty ones, pages by fate, admitted pages in no chunk, chunks and documents."""
    n = lambda r: F.count_if(F.col("reason") == r)
    empty = F.col("corrupt").isNull() & (F.coalesce(F.size("pages"), F.lit(0)) <= 0)
    a = docs.agg(F.count("*").alias("files"), F.count_if(F.col("corrupt").isNotNull()).alias("bad_json"), F.count_if(empty).alias("empty_json"))
    b = judged.agg(F.count("*").alias("pages_seen"), n("class").alias("skipped_class"), n("status").alias("skipped_status"), n("low_confidence").alias("skipped_low_confidence"), n("short").alias("skipped_empty"), n("toc").alias("skipped_toc"), F.count_if(F.col("reason").isNull()).alias("admitted"))
    used = raw_chunks.select(F.col("doc_id").cast("string").alias("doc_id"), F.explode(F.sequence("page_start", "page_end")).alias("page")).distinct()
    c = judged.where("reason IS NULL").select(F.col("doc_id").cast("string").alias("doc_id"), "page").distinct().join(used, ["doc_id", "page"], "left_anti").agg(F.count("*").alias("skipped_short"))
    d = raw_chunks.agg(F.count("*").alias("raw"))
    e = chunks.agg(F.count("*").alias("chunks"), F.countDistinct("doc_id").alias("docs"))
    # each has one row
    out = a.crossJoin(b).crossJoin(c).crossJoin(d).crossJoin(e)
    return out.withColumn("skipped_garbage", F.col("raw") - F.col("chunks")).drop("raw")


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` without the keys that ``new`` has, and ``new``; ordered by the keys."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True).orderBy(*keys)


def fingerprints(found: DataFrame) -> DataFrame:
    """(path, mtime_ns, size) of files, without reading them."""
    return found.select("path", (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), F.col("length").alias("size"))


def changed(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """The files whose time or size the manifest does not have."""
    return found.join(manifest, ["path", "mtime_ns", "size"], "left_anti")


def pages_to_do(wanted: DataFrame, done: DataFrame, mode: str = "merge") -> DataFrame:
    """(doc_id, page) still to do. resume: none of a document whose wanted pages are all done; merge: those not done; reprocess: all."""
    if mode == "reprocess":
        return wanted
    left = wanted.join(done, ["doc_id", "page"], "left_anti")
    return left if mode == "merge" else wanted.join(left.select("doc_id").distinct(), "doc_id", "left_semi")


def write_regions(regions: DataFrame, path: str) -> None:
    """By document; a document that is written again replaces its old rows."""
    regions.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("doc_id").parquet(path)


def write_texts(pages: DataFrame, path: str) -> None:
    """Page texts by document and page, as text files."""
    pages.select("doc_id", "page", F.coalesce("text", F.lit("")).alias("text")).write.mode("overwrite").partitionBy("doc_id", "page").text(path)


# Columns of the report on garbage text layers.
GARBAGE_COLUMNS = "priority doc_id page page_count tlq lexical_quality garbage_score dict_hit typo_ratio oov_hard route lang_hint char_count sample_bad_tokens source_path".split()


def write_garbage_report(candidates: DataFrame, path: str) -> None:
    """Candidate pages as CSV with a header, and as JSON."""
    flat = candidates.select(*GARBAGE_COLUMNS)
    flat.write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    flat.write.mode("overwrite").json(f"{path}/json")


def gold_figures(c: Column, dpi: float = 150.0) -> Column:
    """``x1,y1,x2,y2[|caption[|kind]]`` in pixels as a struct of a box in points (rounded to tenths), caption, kind."""
    part = lambda i: F.get(F.split(c, r"\|"), F.lit(i))
    side = lambda i: F.round(F.get(F.split(part(0), ","), F.lit(i)).cast("double") * 72.0 / dpi, 1)
    return F.struct(F.struct(*(side(i).alias(k) for i, k in enumerate(("x1", "y1", "x2", "y2")))).alias("bbox"), F.coalesce(part(1), F.lit("")).alias("caption"), F.coalesce(part(2), F.lit("figure")).alias("kind"))


def gold_formulas(c: Column) -> Column:
    """``x1,y1,x2,y2|latex|kind|status`` as a struct; missing parts are empty, the kind display, the status ok."""
    part = lambda i: F.get(F.split(c, r"\|"), F.lit(i))
    side = lambda i: F.get(F.split(part(0), ","), F.lit(i)).cast("double")
    return F.struct(F.struct(*(side(i).alias(k) for i, k in enumerate(("x1", "y1", "x2", "y2")))).alias("bbox"), F.coalesce(part(1), F.lit("")).alias("latex"), F.coalesce(part(2), F.lit("display")).alias("kind"), F.coalesce(part(3), F.lit("ok")).alias("status"))


def proofread(spark: SparkSession, path: str) -> DataFrame:
    """(name, page, draft, text, formulas) of proofread text files ``*_pN.txt``: # lines are comments, ~ lines are formulas."""
    raw = spark.read.option("pathGlobFilter", "*.txt").text(path, wholetext=True).withColumn("file", file_name())
    found = F.split("value", T.BREAK)
    kept = F.filter(found, lambda x: ~x.rlike(r"^\s*[#~]"))
    formulas = F.transform(F.filter(found, lambda x: x.rlike(r"^\s*~")), lambda x: F.trim(F.regexp_replace(x, r"^\s*~", "")))
    draft = F.exists(found, lambda x: x.rlike(r"(?iu)^\s*#.*(?:draft|черновик)"))
    return raw.select(F.regexp_replace("file", r"(?:_p[0-9]+)?\.txt$", "").alias("name"), F.nullif(F.regexp_extract("file", r"_p([0-9]+)\.txt$", 1), F.lit("")).cast("int").alias("page"), draft.alias("draft"), T.strip(F.array_join(kept, "\n")).alias("text"), formulas.alias("formulas"))


def best_named(references: DataFrame, docs: DataFrame, shared: int = 2) -> DataFrame:
    """(name, doc_id): the document that a reference file names: equal, else one name within the other, else most common words.

    ``docs`` (doc_id) are the names of a collection; names meet by their words, so no pair without a common word is looked at.
    """
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= 2))
    a = references.select("name").distinct().select("name", F.explode(words(F.col("name"))).alias("w"))
    b = docs.select("doc_id").distinct().select("doc_id", F.explode(words(F.col("doc_id"))).alias("w"))
    j = a.join(b, "w").groupBy("name", "doc_id").agg(F.count("*").alias("n"))
    x, y = F.lower("name"), F.lower("doc_id")
    rank = F.when(x == y, 1_000_000).when(F.contains(x, y) | F.contains(y, x), 1_000 + F.col("n")).when(F.col("n") >= shared, F.col("n"))
    return j.withColumn("rank", rank).where("rank IS NOT NULL").groupBy("name").agg(F.max_by("doc_id", F.struct("rank", "doc_id")).alias("doc_id"))
