"""Folds and geometry at their limits, and chunks end to end."""

import pytest
from pyspark.sql import functions as F

from millrace.functions.text import chunk_id
from millrace.functions.tokens import SignTokens
from millrace.operators import chunks as C, layout as L
from millrace.sources import derived

COUNTER = SignTokens()
BLOCK = "doc_id long, page_number int, src_idx int, text string, x0 double, y0 double, x1 double, y1 double, max_font double, median_font double, page_height double"
TABLE = "doc_id long, page_number int, src_idx int, data array<array<string>>, x0 double, y0 double, x1 double, y1 double"


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def words(n, end="."):
    return " ".join(["w"] * (n - 1)) + end


@pytest.mark.parametrize(("n", "count"), [(480, 1), (481, 2), (910, 2), (911, 3)])
def test_windows(spark, n, count):
    got = value(spark, COUNTER.windows(F.lit(" ".join(map(str, range(n)))), 480, 50))
    assert len(got) == count and got[-1].endswith(str(n - 1)) and all(len(x.split()) <= 480 for x in got)


def test_windows_keep_the_text(spark):
    text = "First Words, with  CAPITALS (and signs) " * 90
    got = value(spark, COUNTER.windows(F.lit(text), 480, 50))
    assert len(got) == 2 and all(x in text and x == x.strip() for x in got) and got[0].startswith("First Words, with  CAPITALS (and")


def test_packing(spark):
    def packed(text):
        return value(spark, C.packed(F.lit(text), COUNTER))

    assert packed("") == [] and packed(words(480)) == [words(480)]
    assert packed(f"{words(200)} {words(280)} {words(1)}") == [f"{words(200)} {words(280)}", words(1)]
    over = packed(f"{words(100)} {words(600)} {words(50)}")
    assert over[0] == words(100) and over[-1] == words(50) and len(over) == 4


def test_markdown(spark):
    grid = F.array(F.array(F.lit("a"), F.lit("b")), F.array(F.lit(" x\ny ")), F.array(F.lit(None).cast("string"), F.lit("c|d"), F.lit("e")))
    assert value(spark, C.markdown(grid)) == "| a | b |  |\n| --- | --- | --- |\n| x y |  |  |\n|  | c|d | e |"
    assert value(spark, C.markdown(F.array().cast("array<array<string>>"))) == ""


def plain_split(rows, most=480):
    """The same cut, measuring each candidate as rendered."""
    import re

    def md(g):
        width = max(map(len, g))
        line = lambda r: "| " + " | ".join([*r, *[""] * (width - len(r))]) + " |"
        return "\n".join([line(g[0]), line(["---"] * width), *map(line, g[1:])])

    n = lambda g: len(re.findall(r"[a-z0-9_]+|[^a-z0-9_\s]", md(g).lower()))
    if n(rows) <= most:
        return [(md(rows), False)]
    out, held, big = [], [], False
    for row in rows[1:]:
        if held and n([rows[0], *held, row]) > most:
            out.append((md([rows[0], *held]), big))
            held, big = [row], n([rows[0], row]) > most
        else:
            held.append(row)
    return out + ([(md([rows[0], *held]), big)] if held else [])


@pytest.mark.parametrize("rows", [
    [["h", "i"], *[[f"r{k}", "x y z"] for k in range(150)]],
    [["h"], *[["c"] * (k % 7) for k in range(120)]],
    [["h"], ["w " * 600], ["a"], ["w " * 500], ["b"]],
    [["w " * 500]],
    [["h"]],
])
def test_table_split(spark, rows):
    df = spark.createDataFrame([(rows,)], "data array<array<string>>").select(C.split_table(F.col("data"), COUNTER).alias("p"))
    trimmed = [[c.strip() for c in r] for r in rows]
    assert [(p.text, p.oversize) for p in df.first().p] == plain_split(trimmed)


def test_chunk_ids_widen(spark):
    got = spark.createDataFrame([(1,), (9999,), (10000,)], "n int").select(chunk_id(F.col("n"))).collect()
    assert [r[0] for r in got] == ["chunk_0001", "chunk_9999", "chunk_10000"]


def test_geometry_at_its_limits(spark):
    box = lambda *x: [F.lit(float(v)) for v in x]
    assert value(spark, L.contained(box(-2, 0, 10, 12), box(0, 0, 10, 10))) is True
    assert value(spark, L.contained(box(-2.1, 0, 10, 10), box(0, 0, 10, 10))) is False
    assert value(spark, L.iou(box(0, 0, 10, 10), box(0, 0, 10, 3))) == pytest.approx(0.3)
    assert value(spark, L.iou(box(0, 0, 1, 1), box(5, 5, 6, 6))) == 0
    assert value(spark, L.iou(box(0, 0, 0, 0), box(0, 0, 0, 0))) == 0
    assert value(spark, L.in_margin(F.lit(1.0), F.lit(11.9), F.lit(100.0))) is True
    assert value(spark, L.in_margin(F.lit(1.0), F.lit(12.0), F.lit(100.0))) is False
    assert value(spark, L.in_margin(F.lit(1.0), F.lit(2.0), F.lit(0.0))) is False
    assert value(spark, L.in_margin(F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(9.0))) is False


def page(n, text, y=20.0, doc=1, idx=0, font=9.0):
    return (doc, n, idx, text, 72.0, y, 540.0, y + 10, font, font, 792.0)


@pytest.mark.parametrize(("pages", "length", "kept"), [(4, 80, 0), (4, 81, 4), (3, 10, 3)])
def test_headers_need_four_pages_and_eighty_characters(spark, pages, length, kept):
    rows = [page(k, "h" * length) for k in range(1, pages + 1)] + [page(k, "body text", 300.0, idx=1) for k in range(1, pages + 1)]
    got = L.without_headers(spark.createDataFrame(rows, BLOCK)).where("src_idx = 0").count()
    assert got == kept


def test_pages_without_a_block_count_for_headers(spark):
    rows = [page(k, "running head") for k in range(1, 4)] + [page(k, "body text", 300.0, idx=1) for k in range(1, 4)]
    blocks, pages = spark.createDataFrame(rows, BLOCK), spark.createDataFrame([(1, k) for k in range(1, 5)], "doc_id long, page_number int")
    assert L.without_headers(blocks).where("src_idx = 0").count() == 3
    assert L.without_headers(blocks, pages).where("src_idx = 0").count() == 0


def test_page_numbers_go_from_short_documents_too(spark):
    rows = [page(1, "- 12 -"), page(1, "12", 300.0, idx=1), page(1, "12345", idx=2)]
    assert {r.src_idx for r in L.without_headers(spark.createDataFrame(rows, BLOCK)).collect()} == {1, 2}


@pytest.mark.parametrize(("text", "font", "expected"), [
    ("Figure 1 x", 30.0, "caption"), ("x" * 199, 12.0, "heading"), ("x" * 200, 12.0, "paragraph"), ("x" * 100 + "\ny", 12.0, "heading"),
    ("x" * 130 + "\ny", 12.0, "paragraph"), ("- item", 11.9, "list_item"), ("a) item", 10.0, "list_item"), ("12. item", 10.0, "list_item"), ("plain", 11.9, "paragraph"),
])
def test_block_types(spark, text, font, expected):
    assert value(spark, L.block_type(F.lit(text), F.lit(font), F.lit(10.0))) == expected


def test_headings_carry_over_pages_and_tables_follow_blocks(spark):
    blocks = [page(1, "Top", 100.0, font=20.0), page(1, "one", 200.0, idx=1), page(1, "two", 300.0, idx=2), page(2, "three", 100.0), page(2, "four", 150.0, idx=1)]
    tables = [(1, 2, 0, [["a"], ["b"]], 0.0, 100.0, 1.0, 101.0), (1, 1, 0, [["c"]], None, None, None, None)]
    got = C.chunks(C.ordered_items(spark.createDataFrame(blocks, BLOCK), spark.createDataFrame(tables, TABLE))).orderBy("number").collect()
    assert [(r.content_type, r.heading_context) for r in got] == [("table", None), ("heading", None), ("paragraph", "Top"), ("paragraph", "Top"), ("paragraph", "Top"), ("table", "Top"), ("paragraph", "Top")]
    assert [r.chunk_id for r in got] == [f"chunk_{k:04d}" for k in range(1, 8)] and got[0].bbox is None


def test_chunks_properties(spark):
    b, t = (f(spark, "/root/testdata/sf0.001") for f in (derived.layout_blocks, derived.layout_tables))
    items = C.ordered_items(b, t).cache()
    rows = C.chunks(items).cache()
    gaps = rows.groupBy("doc_id").agg(F.max("number").alias("m"), F.count("*").alias("n")).where("m <> n")
    assert gaps.isEmpty() and rows.where("token_count > 480 and not oversize").isEmpty()
    warned = C.warnings(items, b)
    assert warned.where("message not like 'page %: sentence exceeded 480 tokens (%'").isEmpty()


def test_warnings_of_pages_and_rows(spark):
    blocks = spark.createDataFrame([page(2, "text", 300.0)], BLOCK)
    grid = [["h"], ["a"], ["w " * 600], ["b"]]
    tables = spark.createDataFrame([(1, 2, 0, grid, None, None, None, None)], TABLE)
    pages = spark.createDataFrame([(1, 1, None), (1, 2, None), (1, 3, "bad")], "doc_id long, page_number int, error string")
    got = [r.message for r in C.warnings(C.ordered_items(blocks, tables, pages), blocks, pages).orderBy("seq").collect()]
    assert got == ["page 1: text extraction returned empty", "page 3: extraction error: bad", "page 2: table row exceeded 480 tokens after header; kept as single oversized chunk"]


def test_scanned(spark):
    rows = [(1, "x" * 19), (1, "x" * 20), (2, "x" * 20), (3, None)]
    got = {r.doc_id: r.scanned for r in L.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: True, 2: False, 3: True}


def test_empty_layouts(spark):
    assert C.chunks(C.ordered_items(spark.createDataFrame([], BLOCK), spark.createDataFrame([], TABLE))).count() == 0
