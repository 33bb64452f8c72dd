"""Command line: ``claims`` and ``chunks`` over a folder of reports, or over Parquet tables of pages and layouts.

    python -m millrace claims FOLDER OUTPUT [--company NAME] [--pages-table] [--text-folders] [--report-files] [--learn-sentences]
    python -m millrace chunks FOLDER OUTPUT [--company NAME] [--year YEAR] [--report-type TYPE] [--layout-tables] [--report-files]
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.functions import sentence_model, text as T
from millrace.operators import chunks as C, claims as K, layout as L
from millrace.sources import reports, sinks


def report_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages of a folder's reports, parsed once, by path; tells of files that can't be read."""
    pages = sinks.kept(spark.read.format("report").load(folder), "pages")
    for r in pages.where("page_number is null").select("path", "error").orderBy("path").collect():  # one row for each bad file
        print(f"{r.path}: {r.error}", file=sys.stderr)
    return pages.where("page_number is not null")


def run_claims(spark: SparkSession, args: argparse.Namespace) -> int:
    if args.pages_table:
        pages = spark.read.parquet(args.folder).select("doc_id", "page_number", "text")
    else:
        reports.register(spark)
        pages = report_pages(spark, args.folder).select(sinks.stem(F.col("path")).alias("doc_id"), "page_number", "text")
    if pages.isEmpty():
        print(f"no reports in {args.folder}", file=sys.stderr)
        return 1
    if args.report_files:
        sinks.write_page_files(pages, f"{args.output}/text")
    else:
        sinks.write_page_text(pages, f"{args.output}/text", args.text_folders)
    split = sentence_model.learned(pages.select("text").distinct(), sinks.kept).split if args.learn_sentences else T.sentences
    rows, told = K.observed(pages, split)
    if args.company:
        rows = rows.withColumn("Company", F.lit(args.company))
    sinks.write_tsv(rows, f"{args.output}/claims")
    for kind, n in sorted(told.types().items()):
        print(f"{kind}: {n}")
    for reason, n in sorted(told.dropped().items(), key=lambda x: (-x[1], x[0])):
        print(f"dropped, {reason}: {n}")
    return 0


def run_chunks(spark: SparkSession, args: argparse.Namespace) -> int:
    """Reports as JSON. Files that can't be read and scanned reports are told of and left out."""
    if args.layout_tables:
        blocks, tables = (spark.read.parquet(f"{args.folder}/{x}") for x in ("blocks", "tables"))
        pages, name = None, F.col("doc_id").cast("string")
    else:
        reports.register(spark)
        read = lambda part: spark.read.format("report").option("part", part).load(args.folder).withColumn("doc_id", F.col("path"))
        pages, name = report_pages(spark, args.folder).withColumn("doc_id", F.col("path")), F.col("doc_id")
        scanned = sinks.kept(L.scanned(pages).where("scanned").select("doc_id"), "scanned")
        for r in scanned.orderBy("doc_id").collect():
            print(f"{r.doc_id}: the report appears to be scanned; a text-based one is needed", file=sys.stderr)
        pages = sinks.kept(pages.join(scanned, "doc_id", "left_anti").select("doc_id", "page_number", "error"), "pages")
        if pages.isEmpty():
            return 2
        blocks = sinks.kept(reports.blocks(sinks.kept(read("spans"), "spans")).join(scanned, "doc_id", "left_anti"), "blocks")
        tables = sinks.kept(read("tables").join(scanned, "doc_id", "left_anti"), "tables")
    counted = (pages if pages is not None else blocks).groupBy("doc_id").agg(F.max("page_number").alias("total_pages"))
    about = counted.select("doc_id", name.alias("source_pdf"), F.lit(args.company).alias("company"), F.lit(args.year).cast("int").alias("year"), F.lit(args.report_type).alias("report_type"), "total_pages")
    nested = sinks.kept(C.reports(C.ordered_items(blocks, tables, pages), blocks, about, pages), "reports")
    if args.report_files:
        sinks.write_json_files(nested, args.output)
    else:
        sinks.write_json(nested, args.output)
    total = nested.agg(F.sum(F.size("chunks")).alias("chunks"), F.sum(F.size("extraction_warnings")).alias("warnings")).first()
    print(f"{total.chunks} chunks, {total.warnings} warnings")
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="millrace", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("claims", "chunks"):
        p = commands.add_parser(name)
        p.add_argument("folder")
        p.add_argument("output")
        p.add_argument("--company")
        p.add_argument("--report-files", action="store_true", help="one file for each report, all or none of a run")
        if name == "claims":
            p.add_argument("--pages-table", action="store_true")
            p.add_argument("--text-folders", action="store_true", help="page text in one folder for each report")
            p.add_argument("--learn-sentences", action="store_true", help="learn abbreviations from the pages before they are cut into sentences")
        else:
            p.add_argument("--year", type=int)
            p.add_argument("--report-type")
            p.add_argument("--layout-tables", action="store_true")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("millrace").getOrCreate()
    return run_claims(spark, args) if args.command == "claims" else run_chunks(spark, args)


if __name__ == "__main__":
    sys.exit(main())
