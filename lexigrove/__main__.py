"""Commands: build an index of page documents, ask it, probe it, evaluate it, audit and summarise pages.

    python -m lexigrove build PAGES INDEX        python -m lexigrove query INDEX "TEXT" [--mode lexical] [--top-k 3] [--json]
    python -m lexigrove probe INDEX              python -m lexigrove eval INDEX GOLD.json
    python -m lexigrove audit PAGES              python -m lexigrove summary PAGES
    python -m lexigrove extract FILES OUT --reader module:factory [--pages 1-3,7] [--resume]
    python -m lexigrove regions FILES OUT --reader module:factory [--pages 1-3,7] [--mode merge] [--skip-unchanged]
    python -m lexigrove check

Ends with 0; 1 for an empty question or a failed check, 2 for a missing index, gold file or file, 3 when nothing was found.
"""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrove.functions import text as T
from lexigrove.functions.lookalikes import repaired
from lexigrove.functions.quality import problem_flags
from lexigrove.operators import audits, chunks, evaluate, index, search
from lexigrove.plans import runs
from lexigrove.sources import pages as sources
from lexigrove.sources import reader
from lexigrove.sources.tables import exists, stored

GOLD = "query string, doc_id string, clause_id string, page int, relevant boolean"


def build_index(spark: SparkSession, pages: str, path: str, encode=None, model: str | None = None, force: bool = False) -> dict:
    """Admitted pages of a folder of page documents as an index at ``path``; returns its counters."""
    docs = sources.documents(spark, pages)
    judged = sources.admission(sources.pages_of(docs))
    raw = stored(chunks.chunk_documents(judged.where("reason IS NULL").select("doc_id", "page", "page_class", "text", "source_file")))
    kept = raw.where(~F.coalesce(T.is_garbage(F.col("text")), F.lit(False)))
    # positions in the order of documents and clauses, by which ties are broken
    ordered = stored(kept.repartitionByRange("doc_id", "group_no", "part").sortWithinPartitions("doc_id", "group_no", "part").withColumn("chunk_ord", F.monotonically_increasing_id()))
    report = sources.build_report(docs, judged, raw, ordered).first().asDict()
    report["notes"] = index.write(ordered, path, report, encode, model, force)
    return report


def questions(spark: SparkSession, texts: list[str]) -> DataFrame:
    """(query_id, query) with lookalikes repaired, as the chunks' were when they were cut."""
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, query string").select("query_id", repaired(F.col("query")).alias("query"))


def ask(spark: SparkSession, path: str, texts: list[str], mode: str = "lexical", top_k: int = 3) -> DataFrame:
    """Hits with their chunks; ``score`` rounded to four places."""
    hits = search.search(index.load(spark, path), questions(spark, texts), mode, top_k)
    found = spark.read.parquet(f"{path}/chunks")
    return hits.withColumn("score", F.round("score", 4)).join(found, "chunk_ord").orderBy("query_id", "rank")


def probe(spark: SparkSession, path: str, limit: int = 100, top_k: int = 5) -> dict:
    found = spark.read.parquet(f"{path}/chunks")
    asked = stored(evaluate.probes(found, limit))
    hits = search.search(index.load(spark, path), asked.select("query_id", "query"), top_k=top_k)
    return evaluate.probe_recall(hits, asked, found).first().asDict()


def evaluated(spark: SparkSession, path: str, items: list[dict], mode: str = "lexical", top_k: int = 5) -> dict:
    """Metrics over gold items: query, and doc_id, clause_id, page where they matter, or relevant = false for no answer."""
    rows = [(i, x["query"], x.get("doc_id"), x.get("clause_id"), x.get("page"), x.get("relevant", True)) for i, x in enumerate(items)]
    gold = spark.createDataFrame(rows, f"query_id long, {GOLD}")
    hits = ask(spark, path, [x["query"] for x in items], mode, top_k)
    has = F.coalesce("relevant", F.lit(True))
    return evaluate.metrics(gold, hits, evaluate.relevant_hits(hits, gold.where(has)), gold.where(~has), top_k).first().asDict()


# Lines with the clause that they open (with the line behind them), and questions with the chunk that answers them.
CLAUSES = (
    ("(a) Конструкция.", "", None), ("27.1435. Гидравлические системы", "", "27.1435"), ("13.5.8", "Меры безопасности", "13.5.8"), ("60 мин в штиле", "", None),
    ("1.", "Классификация комплектующих изделий", "1"), ("Глава 4 Приложение 6. Эксплуатация воздушных судов", "", "4"),
)
TEXTS = (
    ("4.1 Landing gear loads\nThe landing gear shall withstand the limit load of the airframe on the ground.", "limit load of the landing gear", "4.1"),
    ("4.2 Doors of the gear\nDoors are locked by hooks, and the lock is shown to the crew in the cockpit.", "locked doors and their hooks", "4.2"),
    ("5 Гидравлика\nКаждая гидравлическая си-\nстема должна выдерживать давление и не терять жидкость.", "гидравлическая система выдерживать давление", "5"),
)


def checks(spark: SparkSession) -> dict:
    """Admission, clauses, repair and search on a few small texts: how many checks there were, and which failed."""
    lines = spark.createDataFrame(CLAUSES, "line string, following string, want string")
    wrong = [f"heading of {r.line!r}" for r in lines.where(~chunks.heading_number(F.col("line"), F.col("following")).eqNullSafe(F.col("want"))).collect()]
    page = spark.createDataFrame([("own", i, "A", "ok", t) for i, (t, *_) in enumerate(TEXTS, 1)] + [("own", 9, "C", "ok", TEXTS[0][0]), ("own", 10, "A", "failed", TEXTS[0][0]), ("own", 11, "A", "ok", "short")], "doc_id string, page int, page_class string, status string, text string")
    judged = page.withColumn("provenance", F.lit(None).cast("map<string,string>")).withColumn("notes", F.array().cast("array<string>"))
    admitted = stored(sources.admission(judged).where("reason IS NULL"))
    wrong += [] if {r.page for r in admitted.collect()} == {1, 2, 3} else ["admission"]
    made = stored(chunks.chunk_documents(admitted.select("doc_id", "page", "page_class", "text")).withColumn("chunk_ord", F.xxhash64("chunk_id")))
    wrong += ["hyphens"] * (not made.where(F.contains("text", F.lit("система"))).count())
    asked = questions(spark, [q for _, q, _ in TEXTS])
    hits = search.search(index.build(made), asked, top_k=1).join(made.select("chunk_ord", "clause_id"), "chunk_ord")
    found = {r.query_id: r.clause_id for r in hits.collect()}
    wrong += [f"search for {q!r}" for i, (_, q, clause) in enumerate(TEXTS) if found.get(i) != clause]
    return {"checks": len(CLAUSES) + 2 + len(TEXTS), "failed": wrong}


def main(argv: list[str], spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="lexigrove", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="command", required=True)
    for name, args in (("build", ("pages", "index")), ("query", ("index", "text")), ("probe", ("index",)), ("eval", ("index", "gold")), ("audit", ("pages",)), ("summary", ("pages",)), ("extract", ("files", "out")), ("regions", ("files", "out")), ("check", ())):
        one = sub.add_parser(name)
        for a in args:
            one.add_argument(a)
        if name in ("query", "eval"):
            one.add_argument("--mode", default="lexical", choices=search.MODES)
            one.add_argument("--top-k", type=int, default=3 if name == "query" else 5)
        if name in ("extract", "regions"):
            one.add_argument("--reader", required=True)
            one.add_argument("--pages")
            one.add_argument("--pattern", default="*.{pdf,PDF}")
        if name == "extract":
            one.add_argument("--resume", action="store_true")
            one.add_argument("--no-ocr-fallback", action="store_true")
        if name == "regions":
            one.add_argument("--mode", default="new", choices=("new", "resume", "merge", "reprocess"))
            one.add_argument("--skip-unchanged", action="store_true")
        if name == "query":
            one.add_argument("--json", action="store_true")
    a = p.parse_args(argv)
    if a.command == "query" and not a.text.strip():
        print("the question is empty", file=sys.stderr)
        return 1
    if a.command == "eval" and not os.path.exists(a.gold):
        print(f"no gold file {a.gold}", file=sys.stderr)
        return 2
    spark = spark or SparkSession.builder.appName("lexigrove").getOrCreate()
    show = lambda x: print(json.dumps(x, ensure_ascii=False, default=str))
    try:
        if a.command == "build":
            show(build_index(spark, a.pages, a.index))
        elif a.command == "query":
            hits = ask(spark, a.index, [a.text], a.mode, a.top_k).drop("sha256")
            rows = hits.collect()  # at most top_k
            if a.json:
                show([r.asDict() for r in rows])
            else:
                print("\n\n".join(r.citation for r in search.formatted(hits.select("query_id", "chunk_ord", "score", "rank", "method"), spark.read.parquet(f"{a.index}/chunks")).orderBy("rank").collect()) or "not found")
            return 0 if rows else 3
        elif a.command == "probe":
            show(probe(spark, a.index))
        elif a.command == "eval":
            with open(a.gold, encoding="utf-8") as f:
                gold = json.load(f)
            show(evaluated(spark, a.index, gold["items"] if isinstance(gold, dict) else gold, a.mode, a.top_k))
        elif a.command in ("extract", "regions"):
            if not exists(spark, a.files):
                raise FileNotFoundError(f"no file or folder {a.files}")
            make = reader.factory(a.reader)
            if a.command == "extract":
                got = runs.run_extract(spark, a.files, a.out, make, a.pages, a.resume, a.pattern, fallback=not a.no_ocr_fallback)
            else:
                got = runs.run_regions(spark, a.files, a.out, make, a.pages, a.mode, a.skip_unchanged, a.pattern)
            show([r.asDict() for r in got.orderBy("doc_id", "page").collect()])  # one short row a page
        elif a.command == "check":
            report = checks(spark)
            show(report)
            return 1 if report["failed"] else 0
        else:
            pages = sources.pages_of(sources.documents(spark, a.pages))
            if a.command == "summary":
                show([r.asDict() for r in audits.page_summary(pages, ["doc_id"]).orderBy("doc_id").collect()])  # one row a document
            else:
                flags = problem_flags(F.col("text"), repaired(F.col("text")))
                judged = sources.admission(pages).select("doc_id", F.col("reason").isNull().alias("admitted"), flags.alias("f")).select("doc_id", "admitted", "f.*")
                show([r.asDict() for r in audits.audit_priority(audits.layer_audit(judged)).collect()])
    except FileNotFoundError as e:
        print(e, file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
