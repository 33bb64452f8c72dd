"""Test corpora made from the star-schema tables, by formulas that SQL can repeat: claim pages, page layouts, grids."""

from __future__ import annotations

import json
from functools import cache
from importlib import resources

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.sources import reports, sinks

PAGE_HEIGHT = 792.0


@cache
def golden() -> tuple[tuple[int, str, str, str], ...]:
    """(id, sentence, expected, hits) of sentences with a known outcome."""
    lines = (resources.files(__package__) / "golden.tsv").read_text("utf-8").splitlines()[2:]
    rows = (x.split("\t") for x in lines)
    return tuple((int(r[0]), r[1].replace("⍽", " "), r[2], r[3]) for r in rows)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def claim_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page_number, text: each document's text, and two golden sentences on a second page."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    known = F.broadcast(spark.createDataFrame([r[:2] for r in golden()], "id int, sentence string"))  # 35 rows
    n = len(golden())
    first = docs.select("doc_id").join(known, F.col("id") == F.col("doc_id") % n + 1).select("doc_id", F.col("sentence").alias("one"))
    both = first.join(known, F.col("id") == (F.col("doc_id") * 2 + 31) % n + 1).select("doc_id", F.lit(2).alias("page_number"), F.concat_ws(" ", "one", "sentence").alias("text"))
    return docs.select("doc_id", F.lit(1).alias("page_number"), "text").unionByName(both)


def gold_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, gold_id, text, original, is_real: the known sentences of each labelled document as annotators wrote them down.

    One in four is as it was, one in capitals, one without its last word, and one retold so that it can't be recognised.
    A sentence is real where the document's label says so.
    """
    known = F.broadcast(spark.createDataFrame([r[:2] for r in golden()], "id int, sentence string"))  # 35 rows
    n = len(golden())
    each = F.posexplode(F.array(F.col("doc_id") % n + 1, (F.col("doc_id") * 2 + 31) % n + 1)).alias("gold_id", "id")
    rows = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality")).select("doc_id", "quality", each).join(known, "id")
    words = F.split("sentence", " ")
    told = F.when(F.col("doc_id") % 4 == 0, F.col("sentence")).when(F.col("doc_id") % 4 == 1, F.upper("sentence")).when(F.col("doc_id") % 4 == 2, F.array_join(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(1))), " "))
    retold = F.concat(F.array_join(F.slice(words, F.lit(1), F.floor(F.size(words) / 2).cast("int")), " "), F.lit(" and so on, in other terms that nobody kept"))
    return rows.select("doc_id", "gold_id", F.coalesce(told, retold).alias("text"), F.col("sentence").alias("original"), (F.col("quality") == 1).alias("is_real"))


def judges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, reader, length_rule, tone_rule: three answers to whether a document is good, some of them missing."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    words = F.size(F.split(F.trim("text"), " "))
    length = F.when(F.col("text").isNotNull() & (F.col("doc_id") % 11 != 0), (words >= 20).cast("int"))
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select("doc_id", "lang", F.col("quality").alias("reader"), length.alias("length_rule"), (1 - F.col("toxic")).alias("tone_rule"))


def order_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page_number, text: a third page for each order, four sentences with abbreviations, an initial and numbers inside."""
    segments = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.initcap(F.lower("c_mktsegment")).alias("who"))
    rows = table(spark, sf_dir, "orders").join(segments, "o_custkey")
    key, price = F.col("o_orderkey").cast("string"), F.col("o_totalprice").cast("long").cast("string")
    text = F.concat(
        F.lit("Order No. "), key, F.lit(" of Dr. "), "who", F.lit(" holds approx. "), price, F.lit(" crowns and may cost more crowns. It was placed on "), F.date_format("o_orderdate", "yyyy-MM-dd"),
        F.lit(" by mail. Is it urgent? The desk of J. "), "who", F.lit(" holds more mail, cf. note "), key, F.lit("."),
    )
    return rows.select(F.col("o_orderkey").alias("doc_id"), F.lit(3).alias("page_number"), text.alias("text"))


def layout_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of pages of eight lines of text, with a running header, a page number, captions, lists and headings."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", F.posexplode(lines).alias("i", "line"))
    rows = rows.withColumns({"page_number": F.floor(F.col("i") / 8).cast("int") + 1, "j": F.col("i") % 8})
    text = F.when(F.col("j") == 3, F.concat(F.lit("- "), "line")).when(F.col("j") == 5, F.concat(F.lit("Table "), (F.col("i") + 1).cast("string"), F.lit(" "), "line")).otherwise(F.col("line"))
    font = F.when(F.col("j") == 0, 18.0).otherwise(10.0)

    def block(src, what, box, large, median):
        return F.struct(src.cast("int").alias("src_idx"), what.alias("text"), *[x.cast("double").alias(k) for k, x in zip(("x0", "y0", "x1", "y1"), box, strict=True)], large.alias("max_font"), median.alias("median_font"))

    j = F.col("j")
    body = block(j + 1, text, (F.lit(72), 100 + 80 * j, F.lit(540), 160 + 80 * j), font, font)
    header = block(F.lit(0), F.col("source"), map(F.lit, (72, 20, 540, 40)), F.lit(9.0), F.lit(9.0))
    footer = block(F.lit(9), F.col("page_number").cast("string"), map(F.lit, (300, 750, 320, 765)), F.lit(9.0), F.lit(9.0))
    each = F.when(j == 0, F.array(header, body, footer)).otherwise(F.array(body))
    return rows.select("doc_id", "page_number", F.explode(each).alias("b")).select("doc_id", "page_number", "b.*", F.lit(PAGE_HEIGHT).alias("page_height"))


def layout_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page_number, error of all pages of the layouts: one document in four has an empty page at its end."""
    shown = layout_blocks(spark, sf_dir).select("doc_id", "page_number").distinct()
    last = shown.where("doc_id % 4 = 0").groupBy("doc_id").agg((F.max("page_number") + 1).alias("page_number"))
    broken = F.when(F.col("doc_id") % 8 == 0, F.lit("no such font"))
    return shown.withColumn("error", F.lit(None).cast("string")).unionByName(last.withColumn("error", broken))


def layout_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid on the first page of two documents in three, from lineitem rows; one in three has no box."""
    docs = table(spark, sf_dir, "documents").where("doc_id % 3 <> 2").select("doc_id")
    fields = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_returnflag", "l_linestatus")
    shown = lambda r: F.array(*[x.cast("long").cast("string") for x in (F.col("doc_id") + 1, *(r[c] for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")))], r["l_returnflag"], r["l_linestatus"])
    # Rows that no document has go before they are gathered; cells are written once they are.
    items = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") - 1).alias("doc_id"), *fields).join(docs, "doc_id", "left_semi")
    grids = items.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("r")).select("doc_id", F.transform("r", shown).alias("body"))
    head = F.array(F.array(*map(F.lit, ("order", "line", "part", "supplier", "quantity", "flag", "status"))))
    boxed = F.col("doc_id") % 3 == 0
    box = [F.when(boxed, F.lit(x)).alias(k) for k, x in (("x0", 60.0), ("y0", 250.0), ("x1", 560.0), ("y1", 345.0))]
    return docs.join(grids, "doc_id", "left").select("doc_id", F.lit(1).alias("page_number"), F.lit(0).alias("src_idx"), F.concat(head, F.coalesce("body", F.array().cast("array<array<string>>"))).alias("data"), *box)


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of each layout block: one at the largest size, two at the median, one without a size."""
    sizes = F.array("max_font", "median_font", F.col("median_font") - 1, F.lit(0.0))
    return layout_blocks(spark, sf_dir).select("doc_id", "page_number", "src_idx", F.explode(sizes).alias("size"))


def text_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each layout block as spans: a line of eight words, a span of a word with the blank after it, and an empty line of a larger size in some."""
    found = layout_blocks(spark, sf_dir).withColumn("words", F.split("text", "(?<= )"))
    even = (F.col("doc_id") + F.col("src_idx")) % 2 == 0
    words = found.select("*", F.posexplode("words").alias("i", "word")).withColumns({"line": F.floor(F.col("i") / 8).cast("int"), "span": F.col("i") % 8, "size": F.when(F.col("i") % 3 == 2, F.lit(None).cast("double")).otherwise(F.col("max_font") - F.col("i") % 2)})
    blank = found.where(even).withColumns({"word": F.lit("  "), "line": F.lit(1 << 20), "span": F.lit(0), "size": F.col("max_font") + 2})
    columns = ["doc_id", "page_number", F.col("src_idx").alias("block"), "line", "span", F.col("word").alias("text"), "size", "x0", "y0", "x1", "y1", "page_height"]
    return words.select(*columns).unionByName(blank.select(*columns))


def write_stand_ins(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """A file for each document as the report source may meet it, in a format of our own that ``parse_stand_in`` reads.

    One in seven is no report by its name, of the others one in nine is locked; endings are upper case in every other.
    Page 2 of one in five is broken; every second report has a blank grid beside its table.
    """
    pages = claim_pages(spark, sf_dir).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page_number", "text"))).alias("p"))
    broken = lambda p: (p["page_number"] == 2) & (F.col("doc_id") % 5 == 0)
    told = F.transform("p", lambda p: F.struct(F.when(broken(p), F.lit("")).otherwise(p["text"]).alias("text"), F.when(broken(p), "no such font").alias("error")))
    box = F.when(F.col("x0").isNotNull(), F.array("x0", "y0", "x1", "y1"))
    blank = F.struct(F.lit(1).alias("page"), F.array(F.array(F.lit(" "), F.lit(None).cast("string"))).alias("data"), F.lit(None).cast("array<double>").alias("box"))
    table_ = F.struct(F.col("page_number").alias("page"), "data", box.alias("box"))
    grids = F.when(F.col("data").isNotNull(), F.when(F.col("doc_id") % 2 == 0, F.array(blank, table_)).otherwise(F.array(table_)))
    body = F.to_json(F.struct(told.alias("pages"), grids.alias("tables")), {"ignoreNullFields": "false"})
    ending = F.when(F.col("doc_id") % 7 == 0, ".txt").when(F.col("doc_id") % 2 == 1, ".PDF").otherwise(".pdf")
    named = pages.join(layout_tables(spark, sf_dir), "doc_id", "left").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), ending).alias("name"), F.when(F.col("doc_id") % 9 == 0, "locked").otherwise(body).alias("content"))
    sinks.write_report_files(named, folder, "")


def parse_stand_in(raw: bytes) -> reports.Parsed:
    if raw == b"locked":
        raise RuntimeError("encrypted")
    found = json.loads(raw)
    pages = [(p["text"] or "", PAGE_HEIGHT, p["error"]) for p in found["pages"]]
    return reports.Parsed(pages, [], [(t["page"], t["data"], t["box"]) for t in found["tables"] or []])
