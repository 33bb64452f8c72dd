"""Page layout: margins, repeated headers, page numbers, blocks under tables, reading order, block types.

Blocks are rows (doc_id, page_number, src_idx, text, x0, y0, x1, y1, max_font, median_font, page_height); tables are
rows (doc_id, page_number, src_idx, data, x0, y0, x1, y1) whose box may be null. Everything keys on doc_id, so one
hash partitioning by it serves the joins and windows that follow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from millrace.functions import text as T

MARGIN = 0.12
LONGEST_HEADER, LEAST_PAGES, TENTHS = 80, 4, 3
OVERLAP, TOLERANCE = 0.3, 2.0
HEADING_RATIO, HEADING_LINE, HEADING_ANY, DEFAULT_FONT = 1.2, 200, 120, 10.0
SPARSE_CHARS = 20


def in_margin(y0: Column, y1: Column, height: Column) -> Column:
    """Does a box lie in the top or bottom band of its page?"""
    return F.coalesce((height > 0) & ((y1 < height * MARGIN) | (y0 > height * F.lit(1.0 - MARGIN))), F.lit(False))


def margin_of_block() -> Column:
    return in_margin(F.col("y0"), F.col("y1"), F.col("page_height"))


def iou(a: list[Column], b: list[Column]) -> Column:
    """Intersection over union of two boxes (x0, y0, x1, y1), 0 where one is missing or empty."""
    width = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    height = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    area = [F.greatest(F.lit(0.0), x[2] - x[0]) * F.greatest(F.lit(0.0), x[3] - x[1]) for x in (a, b)]
    both = width * height
    whole = area[0] + area[1] - both
    known = a[0].isNotNull() & b[0].isNotNull()
    return F.when(known & (both > 0) & (whole > 0), both / whole).otherwise(0.0)


def contained(a: list[Column], b: list[Column]) -> Column:
    """Does box a lie inside box b, give or take the tolerance?"""
    return (a[0] >= b[0] - TOLERANCE) & (a[1] >= b[1] - TOLERANCE) & (a[2] <= b[2] + TOLERANCE) & (a[3] <= b[3] + TOLERANCE)


def page_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("doc_id").agg(F.max("page_number").alias("n_pages"))


def repeated_texts(blocks: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """(doc_id, header): short margin texts on three tenths of a document's pages, and on two at least.

    ``pages`` (doc_id, page_number) lists all pages, as those without a block count too.
    """
    marginal = blocks.select("doc_id", "page_number", T.clean(F.col("text")).alias("header"), margin_of_block().alias("margin"))
    seen = marginal.where(F.col("margin") & F.length("header").between(1, LONGEST_HEADER)).groupBy("doc_id", "header").agg(F.countDistinct("page_number").alias("on"))
    n = page_counts(blocks if pages is None else pages).where(F.col("n_pages") >= LEAST_PAGES)
    return seen.join(n, "doc_id").where(F.col("on") >= F.greatest(F.lit(2), F.floor(F.col("n_pages") * TENTHS / 10))).select("doc_id", "header")


def without_headers(blocks: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Blocks without repeated margin texts and margin page numbers."""
    marked = blocks.withColumns({"header": F.when(margin_of_block(), T.clean(F.col("text"))), "margin": margin_of_block()})
    numbered = marked.where(~(F.col("margin") & T.is_page_number(F.col("header"))))
    # By document alone, so that texts are shuffled once for all steps: a join by more keys would deal them out anew.
    gone = repeated_texts(blocks, pages).groupBy("doc_id").agg(F.collect_set("header").alias("gone"))
    shown = ~(F.col("margin") & F.coalesce(F.array_contains("gone", F.col("header")), F.lit(False)))
    # Headers of a document are few: hashed, so that the blocks needn't be sorted to meet them.
    return numbered.join(gone.hint("shuffle_hash"), "doc_id", "left").where(shown).select(*blocks.columns)


def page_median() -> Column:
    """Median of the blocks' positive medians, null without one."""
    return F.median(F.when(F.col("median_font") > 0, F.col("median_font")))


def page_fonts(blocks: DataFrame) -> DataFrame:
    """(doc_id, page_number, page_font): a page's median font."""
    return blocks.groupBy("doc_id", "page_number").agg(F.coalesce(page_median(), F.lit(DEFAULT_FONT)).alias("page_font"))


def block_fonts(spans: DataFrame) -> DataFrame:
    """(doc_id, page_number, src_idx, max_font, median_font) from spans (…, size); zero and null sizes don't count."""
    size = F.when(F.col("size") != 0, F.col("size").cast("double"))
    return spans.groupBy("doc_id", "page_number", "src_idx").agg(F.coalesce(F.max(size), F.lit(0.0)).alias("max_font"), F.coalesce(F.median(size), F.lit(0.0)).alias("median_font"))


def uncovered(blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """Blocks that no table of their page contains or overlaps much."""
    return with_cover(blocks, tables).where(~F.col("covered")).select(*blocks.columns)


def with_cover(blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """Blocks with ``covered``: does a table of their page contain or much overlap them?"""
    sides = ("x0", "y0", "x1", "y1")
    boxes = tables.where(F.col("x0").isNotNull()).groupBy("doc_id").agg(F.collect_list(F.struct(F.col("page_number").alias("page"), *sides)).alias("boxes"))
    a = [F.col(c) for c in sides]

    def covers(t: Column) -> Column:
        b = [t[c] for c in sides]
        return (t["page"] == F.col("page_number")) & (contained(a, b) | (iou(a, b) > OVERLAP))

    covered = F.coalesce(F.exists("boxes", covers), F.lit(False))
    return blocks.join(boxes.hint("shuffle_hash"), "doc_id", "left").select(*[blocks[c] for c in blocks.columns], covered.alias("covered"))


def block_type(text: Column, max_font: Column, page_font: Column) -> Column:
    """caption, heading, list_item or paragraph, from the text as extracted, line breaks included."""
    whole = T.stripped(text)
    line = T.first_line(whole)
    large = (page_font > 0) & (max_font >= page_font * HEADING_RATIO)
    short = ((F.length(whole) < HEADING_LINE) & ~whole.contains("\n")) | (F.length(whole) < HEADING_ANY)
    return F.when(T.is_caption(line), "caption").when(large & short, "heading").when(T.is_list_item(line), "list_item").otherwise("paragraph")


def items(blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """Blocks with their cover and tables as one list with a place in reading order: page, height to a tenth, blocks before tables."""
    b = blocks.select("doc_id", "page_number", F.lit(0).alias("kind"), F.col("src_idx").cast("int").alias("src_idx"), "text", F.lit(None).cast("array<array<string>>").alias("data"), "x0", "y0", "x1", "y1", "max_font", "median_font", "covered")
    t = tables.select("doc_id", "page_number", F.lit(1).alias("kind"), F.col("src_idx").cast("int").alias("src_idx"), F.lit(None).cast("string").alias("text"), "data", "x0", "y0", "x1", "y1", F.lit(None).cast("double").alias("max_font"), F.lit(None).cast("double").alias("median_font"), F.lit(False).alias("covered"))
    return b.unionByName(t).withColumn("y", F.bround(F.coalesce("y0", F.lit(0.0)), 1))


def in_order(*more: Column):
    return Window.partitionBy("doc_id").orderBy("page_number", "y", "kind", "src_idx", *more)


def scanned(pages: DataFrame) -> DataFrame:
    """doc_id, sparse_share, scanned: is half of a document's pages or more nearly without text?"""
    sparse = (F.length(T.stripped(F.coalesce("text", F.lit("")))) < SPARSE_CHARS).cast("double")
    return pages.groupBy("doc_id").agg(F.avg(sparse).alias("sparse_share")).withColumn("scanned", F.col("sparse_share") >= 0.5)
