"""Chunks: cleaned, typed and token-bounded pieces of blocks and tables, with heading context and numbers.

Packing works on one block's sentences or one table's rows, as a fold inside the row, so it needs no shuffle; the
heading and the numbers are windows over a document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from millrace.functions import text as T
from millrace.functions.text import cells_of, let
from millrace.functions.tokens import SignTokens, WordPiece
from millrace.operators import layout

MOST, OVERLAP = 480, 50
Counter = SignTokens | WordPiece


def sentences_of(text: Column, split: Callable[[Column], Column] = T.sentences) -> Column:
    return F.filter(F.transform(split(text), T.stripped), lambda s: s != "")


def packed(text: Column, counter: Counter, most: int = MOST, split: Callable[[Column], Column] = T.sentences) -> Column:
    """Pieces of a cleaned text: whole if it fits, else sentences packed greedily, an oversize one cut into windows."""
    counted = counter.measure(sentences_of(text, split), most, OVERLAP)
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("done"), F.lit(None).cast("string").alias("held"), F.lit(0).alias("n"))

    def flushed(acc: Column) -> Column:
        return F.when(acc["held"].isNotNull(), F.concat(acc["done"], F.array(acc["held"]))).otherwise(acc["done"])

    def step(acc: Column, x: Column) -> Column:
        over = F.struct(F.concat(flushed(acc), x["windows"]).alias("done"), F.lit(None).cast("string").alias("held"), F.lit(0).alias("n"))
        new = F.struct(flushed(acc).alias("done"), x["s"].alias("held"), x["n"].alias("n"))
        more = F.struct(acc["done"].alias("done"), F.concat_ws(" ", acc["held"], x["s"]).alias("held"), (acc["n"] + x["n"]).alias("n"))
        return F.when(x["n"] > most, over).when(acc["held"].isNotNull() & (acc["n"] + x["n"] > most), new).otherwise(more)

    fold = F.aggregate(counted, start, step, flushed)
    return F.when(T.blank(text), none).when(~counter.over(text, most), F.array(text)).otherwise(fold)


def markdown(rows: Column) -> Column:
    """A grid as a markdown table, as wide as its widest row; the empty string for no rows."""

    def shown(cells: Column, width: Column) -> Column:
        def line(parts: Column) -> Column:
            return F.concat(F.lit("| "), F.array_join(parts, " | "), F.lit(" |"))

        lines = F.transform(cells, lambda r: line(F.concat(r, F.array_repeat(F.lit(""), (width - F.size(r)).cast("int")))))
        rule = line(F.array_repeat(F.lit("---"), width.cast("int")))
        return let(lines, lambda x: F.array_join(F.concat(F.slice(x, 1, 1), F.array(rule), F.slice(x, 2, F.greatest(F.lit(1), F.size(x)))), "\n"))

    whole = let(F.transform(rows, cells_of), lambda c: let(F.array_max(F.transform(c, F.size)), lambda w: shown(c, w)))
    return F.when(F.size(rows) > 0, whole).otherwise("")


def split_table(rows: Column, counter: Counter, most: int = MOST) -> Column:
    """Pieces of a grid as (text, oversize): whole if it fits, else rows packed greedily under a repeated header.

    A rendered table's tokens are its cells' tokens, a rule for each column, and a bar on either side of each cell of
    all lines, so the fold needs only each row's cell tokens and width; pieces are rendered once their rows are known.
    """
    bar, dash = counter.sign("|"), counter.sign("---")

    def tokens(n: Column, w: Column, lines: Column) -> Column:
        return n + w * dash + (lines + 1) * (w + 1) * bar

    def spans(measured: Column) -> Column:
        """(first body row, how many, oversize) of each piece."""
        none = F.array().cast("array<struct<at:int,rows:int,big:boolean>>")
        head = measured[0]
        start = F.struct(none.alias("done"), F.lit(1).alias("at"), F.lit(0).alias("rows"), head["n"].alias("n"), head["w"].alias("w"), F.lit(False).alias("big"))

        def piece(acc: Column) -> Column:
            return F.concat(acc["done"], F.array(F.struct(acc["at"].alias("at"), acc["rows"].alias("rows"), acc["big"].alias("big"))))

        def step(acc: Column, row: Column) -> Column:
            n, w = acc["n"] + row["n"], F.greatest(acc["w"], row["w"])
            own, wide = head["n"] + row["n"], F.greatest(head["w"], row["w"])
            full = (tokens(n, w, acc["rows"] + 2) > most) & (acc["rows"] > 0)
            new = F.struct(piece(acc).alias("done"), (acc["at"] + acc["rows"]).alias("at"), F.lit(1).alias("rows"), own.alias("n"), wide.alias("w"), (tokens(own, wide, F.lit(2)) > most).alias("big"))
            more = F.struct(acc["done"].alias("done"), acc["at"].alias("at"), (acc["rows"] + 1).alias("rows"), n.alias("n"), w.alias("w"), acc["big"].alias("big"))
            return F.when(full, new).otherwise(more)

        return F.aggregate(F.slice(measured, 2, F.greatest(F.lit(1), F.size(measured))), start, step, lambda a: F.when(a["rows"] > 0, piece(a)).otherwise(a["done"]))

    none = F.array().cast("array<struct<text:string,oversize:boolean>>")
    measured = F.zip_with(rows, counter.rows(rows), lambda row, n: F.struct(n.alias("n"), F.size(row).alias("w")))
    rendered = F.transform(let(measured, spans), lambda p: F.struct(markdown(F.concat(F.slice(rows, 1, 1), F.slice(rows, p["at"] + 1, p["rows"]))).alias("text"), p["big"].alias("oversize")))
    total = let(measured, lambda m: tokens(F.aggregate(m, F.lit(0), lambda n, row: n + row["n"]), F.array_max(F.transform(m, lambda row: row["w"])), F.size(m)))
    whole = F.when(total <= most, F.array(F.struct(markdown(rows).alias("text"), F.lit(False).alias("oversize"))))
    return F.when(F.size(rows) == 0, none).otherwise(F.coalesce(whole, rendered))


def ordered_items(blocks: DataFrame, tables: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Cleaned and typed items in reading order, each with the heading above it.

    ``pages`` (doc_id, page_number) lists all pages of the documents, as those without a block count for headers.
    """
    cleaned = layout.without_headers(blocks, pages).where("doc_id is not null and page_number is not null")
    dealt = tables.repartition("doc_id")  # as the blocks are, so that both lie together as they come
    found = layout.items(layout.with_cover(cleaned, dealt), dealt)
    # Sorted once, for both windows that follow. Covered blocks count for a page's font.
    found = found.sortWithinPartitions("doc_id", "page_number", "y", "kind", "src_idx")
    on_page = Window.partitionBy("doc_id", "page_number")
    found = found.withColumns({"page_font": F.coalesce(layout.page_median().over(on_page), F.lit(layout.DEFAULT_FONT)), "whole": F.when(F.col("kind") == 0, T.clean(F.col("text")))})
    found = found.where(~F.col("covered") & ((F.col("kind") == 1) | ~T.blank(F.col("text")))).drop("covered", "median_font")
    typed = found.withColumn("content_type", F.when(F.col("kind") == 1, "table").otherwise(layout.block_type(F.col("text"), F.col("max_font"), F.col("page_font"))))
    above = F.last(F.when(F.col("content_type") == "heading", F.col("whole")), ignorenulls=True).over(layout.in_order().rowsBetween(Window.unboundedPreceding, 0))
    return typed.withColumn("heading_context", F.when(F.col("content_type") != "heading", above))


def chunks(items: DataFrame, counter: Counter | None = None) -> DataFrame:
    """Of ordered items: doc_id, number, kind, src_idx, chunk_id, page_number, content_type, text, token_count, bbox, heading_context, oversize."""
    counter = counter or SignTokens()
    out = items.select("*", F.posexplode(pieces(counter)).alias("piece_idx", "piece")).withColumn("number", F.row_number().over(layout.in_order(F.col("piece_idx"))))
    return out.select("doc_id", "number", "kind", "src_idx", T.chunk_id(F.col("number")).alias("chunk_id"), F.col("page_number").cast("int").alias("page_number"), "content_type", F.col("piece.text").alias("text"), counter.count(F.col("piece.text")).cast("int").alias("token_count"), bbox().alias("bbox"), "heading_context", F.col("piece.oversize").alias("oversize"))


def pieces(counter: Counter) -> Column:
    """(text, oversize) of each piece of an item."""
    texts = F.transform(packed(F.col("whole"), counter), lambda s: F.struct(s.alias("text"), F.lit(False).alias("oversize")))
    return F.when(F.col("kind") == 0, F.filter(texts, lambda p: ~T.blank(p["text"]))).otherwise(split_table(F.col("data"), counter))


def bbox() -> Column:
    return F.when(F.col("x0").isNotNull(), F.array("x0", "y0", "x1", "y1"))


# Messages as readers of the reports know them.
EMPTY_PAGE, FAILED_PAGE = "text extraction returned empty", "extraction error: "
LONG_SENTENCE = f"sentence exceeded {MOST} tokens (%d); split on tokens with {OVERLAP}-token overlap"
LONG_ROW = f"table row exceeded {MOST} tokens after header; kept as single oversized chunk"


def bent(counter: Counter, made: Column) -> Column:
    """A message for each sentence of an item, or row of its table, that doesn't fit; ``made`` are its pieces."""
    too_long = F.filter(counter.measure(sentences_of(F.col("whole")), MOST, OVERLAP)["n"], lambda n: n > MOST)
    rows = F.transform(F.filter(made, lambda p: p["oversize"]), lambda p: F.lit(LONG_ROW))
    return F.when(F.col("kind") == 1, rows).when(counter.over(F.col("whole"), MOST), F.transform(too_long, lambda n: F.format_string(LONG_SENTENCE, n)))


def unread(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, page_number, message of the pages without a block."""
    bare = pages.join(blocks.select("doc_id", "page_number").distinct(), ["doc_id", "page_number"], "left_anti")
    return bare.select("doc_id", "page_number", F.when(F.col("error").isNotNull(), F.concat(F.lit(FAILED_PAGE), F.col("error"))).otherwise(EMPTY_PAGE).alias("message"))


def of_page(page: Column, message: Column) -> Column:
    return F.concat(F.lit("page "), page.cast("string"), F.lit(": "), message)


def warnings(items: DataFrame, blocks: DataFrame, pages: DataFrame | None = None, counter: Counter | None = None) -> DataFrame:
    """doc_id, phase, page_number, seq, message: what extraction and packing had to bend.

    ``items`` are ordered ones; ``pages`` (doc_id, page_number, error) lists all pages, so that those without a block
    are told of. Messages are made before they are put in order, so no text is sorted or shuffled for them.
    """
    counter = counter or SignTokens()
    place = ("y", "kind", "src_idx")
    out = items.withColumn("made", pieces(counter)).select("doc_id", F.lit("chunking").alias("phase"), "page_number", *place, F.posexplode(bent(counter, F.col("made"))).alias("sub", "message"))
    if pages is not None:
        out = out.unionByName(unread(blocks, pages).withColumn("phase", F.lit("extraction")), allowMissingColumns=True)
    order = Window.partitionBy("doc_id").orderBy(F.col("phase") != "extraction", "page_number", *place, "sub")
    return out.select("doc_id", "phase", "page_number", F.row_number().over(order).alias("seq"), of_page(F.col("page_number"), F.col("message")).alias("message"))


def reports(items: DataFrame, blocks: DataFrame, metadata: DataFrame, pages: DataFrame | None = None, counter: Counter | None = None) -> DataFrame:
    """One nested row for each report of metadata (doc_id, source_pdf, company, year, report_type, total_pages): chunks and warnings of its items.

    Items are gathered by document as they lie and numbered in the row, so their texts aren't shuffled or kept for it.
    """
    counter = counter or SignTokens()
    made = items.withColumn("made", pieces(counter)).withColumns({"n": counter.measure(F.transform("made", lambda p: p["text"]), MOST, OVERLAP)["n"], "told": bent(counter, F.col("made")), "bbox": bbox()})
    parts = F.zip_with("made", "n", lambda p, n: F.struct(p["text"].alias("text"), n.alias("n")))
    item = F.struct("page_number", "y", "kind", "src_idx", "content_type", "heading_context", "bbox", F.coalesce(parts, F.array().cast("array<struct<text:string,n:int>>")).alias("parts"), F.coalesce("told", F.array().cast("array<string>")).alias("told"))
    nested = made.groupBy("doc_id").agg(F.sort_array(F.collect_list(item)).alias("i"))
    about = F.struct("source_pdf", "company", F.col("year").cast("int").alias("year"), "report_type", F.col("total_pages").cast("int").alias("total_pages"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("extraction_timestamp"))
    each = F.flatten(F.transform("i", lambda i: F.transform(i["parts"], lambda p: F.struct(i["page_number"].cast("int").alias("page_number"), i["content_type"].alias("content_type"), p["text"].alias("text"), p["n"].alias("token_count"), i["bbox"].alias("bbox"), i["heading_context"].alias("heading_context")))))
    fields = ("page_number", "content_type", "text", "token_count", "bbox", "heading_context")
    numbered = F.transform(each, lambda c, k: F.struct(T.chunk_id(k + 1).alias("chunk_id"), *[c[f].alias(f) for f in fields]))
    told = F.flatten(F.transform("i", lambda i: F.transform(i["told"], lambda m: of_page(i["page_number"], m))))
    # Hashed, so that whole reports needn't be sorted to meet what is small.
    full = metadata.hint("shuffle_hash").join(nested, "doc_id", "left")
    none = F.array().cast("array<string>")
    if pages is not None:
        first = unread(blocks, pages).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page_number", "message"))).alias("u"))
        full = full.join(first.hint("shuffle_hash"), "doc_id", "left")
        unread_first = F.transform("u", lambda w: of_page(w["page_number"], w["message"]))
    else:
        unread_first = none
    return full.select("doc_id", about.alias("report_metadata"), F.coalesce(numbered, F.array().cast(chunk_list())).alias("chunks"), F.concat(F.coalesce(unread_first, none), F.coalesce(told, none)).alias("extraction_warnings"))


def chunk_list() -> str:
    return "array<struct<chunk_id:string,page_number:int,content_type:string,text:string,token_count:int,bbox:array<double>,heading_context:string>>"
