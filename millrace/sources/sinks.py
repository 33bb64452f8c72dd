"""Outputs: page-marked text, tab-separated claims, JSON reports, and their names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from millrace.sources import report_files

# Options under which the writer's bytes equal those of a csv module with minimal quoting.
TSV = {"sep": "\t", "header": True, "escape": '"', "emptyValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "lineSep": "\r\n", "encoding": "UTF-8"}


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share; on one machine a local one where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", named)
    return f"{named.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the scratch folder and read back, for what is used more than once and costly to make."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def output_name(name: Column) -> Column:
    """The name with a table's ending, in place of another table or text ending."""
    return F.concat(F.regexp_replace(name, r"(?i)\.(tsv|csv|txt)$", ""), F.lit(".tsv"))


def stem(path: Column) -> Column:
    """A file's name without folder and last ending."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"(?<=.)\.[^.]*$", "")


def page_dump(document: Column | None = None) -> Column:
    """A page's marker line, with the document's name if given, its text without trailing white space, and an empty line."""
    body = F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)[\s\x1c-\x1f]+$", "")
    name = F.lit("") if document is None else F.concat(document.cast("string"), F.lit(" "))
    return F.concat(F.lit("========== "), name, F.lit("PAGE "), F.col("page_number").cast("string"), F.lit(" ==========\n"), body, F.lit("\n"))


def write_page_text(pages: DataFrame, folder: str, folders: bool = False) -> None:
    """Pages in order, in a few large files whose markers name the document; or in one folder for each document."""
    ordered = pages.repartition("doc_id").sortWithinPartitions("doc_id", "page_number")
    if folders:
        ordered.select("doc_id", page_dump().alias("value")).write.partitionBy("doc_id").text(folder)
    else:
        ordered.select(page_dump(F.col("doc_id")).alias("value")).write.text(folder)


def write_report_files(rows: DataFrame, folder: str, suffix: str, mode: str = "append", indent: int | None = None) -> None:
    """One file for each name of rows (name, content) or (name, order, content), in that order; all of them or none."""
    rows.sparkSession.dataSource.register(report_files.ReportFiles)
    if "order" in rows.columns:
        rows = rows.repartition("name").sortWithinPartitions("name", "order").select("name", "content")
    out = rows.write.format("report-files").option("suffix", suffix).mode(mode)
    (out if indent is None else out.option("indent", indent)).save(folder)


def write_page_files(pages: DataFrame, folder: str, mode: str = "append") -> None:
    """A text file for each document: its pages in order."""
    write_report_files(pages.select(F.col("doc_id").cast("string").alias("name"), F.col("page_number").alias("order"), F.concat(page_dump(), F.lit("\n")).alias("content")), folder, ".txt", mode)


def write_json_files(reports: DataFrame, folder: str, mode: str = "append") -> None:
    """An indented JSON file for each report, null fields kept, named like its source."""
    body = [c for c in reports.columns if c != "doc_id"]
    named = reports.select(stem(F.col("report_metadata.source_pdf")).alias("name"), F.to_json(F.struct(*body), {"ignoreNullFields": "false"}).alias("content"))
    write_report_files(named, folder, ".json", mode, indent=2)


def read_json_files(spark: SparkSession, folder: str, schema) -> DataFrame:
    """What ``write_json_files`` wrote."""
    return report_files.texts(spark, folder, ".json").select(F.from_json("text", schema).alias("r")).select("r.*")


def read_page_files(spark: SparkSession, folder: str) -> DataFrame:
    """name, text of what ``write_page_files`` wrote."""
    return report_files.texts(spark, folder, ".txt")


def write_tsv(rows: DataFrame, folder: str) -> None:
    rows.write.options(**TSV).csv(folder)


def read_tsv(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """What ``write_tsv`` wrote; empty fields come back as empty strings."""
    options = {k: v for k, v in TSV.items() if k != "lineSep"} | {"multiLine": True}
    found = spark.read.schema(schema).options(**options).csv(folder)
    return found.select(*[F.coalesce(c, F.lit("")).alias(c) if t == "string" else F.col(c) for c, t in found.dtypes])


def read_json(spark: SparkSession, folder: str, schema) -> DataFrame:
    """What ``write_json`` wrote."""
    return spark.read.schema(schema).json(folder)


def read_variants(spark: SparkSession, folder: str, whole_files: bool = False) -> DataFrame:
    """report: each JSON report as a variant, whatever fields it has; null where a line isn't JSON.

    One object to a line, or to a file with ``whole_files``. Fields are taken by path: ``F.variant_get("report", "$.a.b", "int")``.
    """
    return spark.read.text(folder, wholetext=whole_files).select(F.try_parse_json("value").alias("report"))


def variant_chunks(reports: DataFrame, *more: Column) -> DataFrame:
    """source_pdf, total_pages, pos, chunk: a row for each chunk of variant reports, the chunk itself a variant.

    ``more`` are named columns of the reports that go with each of their chunks.
    """
    path = lambda p, kind: F.try_variant_get("report", p, kind)
    named = reports.select(path("$.report_metadata.source_pdf", "string").alias("source_pdf"), path("$.report_metadata.total_pages", "int").alias("total_pages"), path("$.chunks", "array<variant>").alias("chunks"), *more)
    return named.select(*[c for c in named.columns if c != "chunks"], F.posexplode("chunks").alias("pos", "chunk"))


def write_json(reports: DataFrame, folder: str, compression: str = "none") -> None:
    """A JSON object for each report, null fields kept, one to a line."""
    body = [c for c in reports.columns if c != "doc_id"]
    reports.select(F.to_json(F.struct(*body), {"ignoreNullFields": "false"}).alias("value")).write.text(folder, compression=compression)
