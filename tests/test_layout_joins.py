"""Items in order are keyed by document alone: texts are dealt out once, whatever steps follow."""

import re

from millrace.operators import chunks as C, layout as L
from millrace.plans import registry
from millrace.sources import sinks

BLOCKS = "doc_id long, page_number int, src_idx int, text string, x0 double, y0 double, x1 double, y1 double, max_font double, median_font double, page_height double"


def tables_of(spark):
    rows = [(d, p, 0, "Head", 70.0, 20.0, 540.0, 40.0, 9.0, 9.0, 792.0) for d in (1, 2) for p in range(1, 6)]
    rows += [(d, p, i, f"text {d} {p} {i}", 70.0, 100.0 * i, 540.0, 100.0 * i + 60, 10.0, 10.0, 792.0) for d in (1, 2) for p in range(1, 6) for i in range(1, 5)]
    rows += [(1, 1, 9, None, 70.0, 100.0, 540.0, 160.0, 0.0, 0.0, 792.0), (1, None, 1, "no page", 70.0, 100.0, 540.0, 160.0, 10.0, 10.0, 792.0), (None, 1, 1, "no document", 70.0, 100.0, 540.0, 160.0, 10.0, 10.0, 792.0)]
    grid = [["a", "b"], ["1", "2"]]
    boxes = [(1, 2, 0, grid, 60.0, 190.0, 560.0, 270.0), (1, 2, 1, grid, None, None, None, None), (2, 9, 0, grid, 0.0, 0.0, 600.0, 792.0), (3, 1, 0, grid, 0.0, 0.0, 600.0, 792.0)]
    return sinks.kept(spark.createDataFrame(rows, BLOCKS), "blocks"), sinks.kept(spark.createDataFrame(boxes, "doc_id long, page_number int, src_idx int, data array<array<string>>, x0 double, y0 double, x1 double, y1 double"), "boxes")


def test_items_are_those_left_by_headers_and_tables(spark):
    blocks, boxes = tables_of(spark)
    got = {(r.doc_id, r.page_number, r.src_idx) for r in C.ordered_items(blocks, boxes).where("kind = 0").collect()}
    assert got == {(d, p, i) for d in (1, 2) for p in range(1, 6) for i in range(1, 5)} - {(1, 2, 2)}
    assert {(r.doc_id, r.page_number, r.src_idx) for r in L.uncovered(blocks, boxes).where("doc_id is null or page_number is null").collect()} == {(1, None, 1), (None, 1, 1)}


def test_no_step_deals_texts_out_by_page(spark):
    blocks, boxes = tables_of(spark)
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = C.ordered_items(blocks, boxes)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert not re.findall(r"hashpartitioning\(doc_id#\d+L?, (?:page_number#\d+, \d+|header#\d+, margin)", plan)


def test_reports_deal_texts_out_and_sort_them_once(spark):
    """Nested reports with warnings take one shuffle and one sort of the blocks' texts."""
    blocks, boxes = tables_of(spark)
    pages = sinks.kept(spark.createDataFrame([(1, p, None) for p in range(1, 7)] + [(2, 1, None), (4, 1, "bad")], "doc_id long, page_number int, error string"), "pages")
    about = sinks.kept(spark.createDataFrame([(d, f"{d}.pdf", "A", 2024, None, 6) for d in (1, 2, 3, 4)], "doc_id long, source_pdf string, company string, year int, report_type string, total_pages int"), "about")
    registered = registry.nested_reports(spark, "/root/testdata/sf0.001")
    for threshold in ("-1", "10m"):
        held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        try:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
            plan = registered.select("*")._jdf.queryExecution().executedPlan().toString().splitlines()
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
        dealt = [below for x, below in zip(plan, plan[1:]) if "Exchange hashpartitioning" in x and re.search(r"\b(text|whole)#", below)]
        assert len(dealt) == 1 and sum(bool(re.search(r"Sort \[.* y#", x)) for x in plan) == 1
    nested = C.reports(C.ordered_items(blocks, boxes), blocks, about, pages)
    got = {r.doc_id: r for r in nested.collect()}
    assert got.keys() == {1, 2, 3, 4} and got[4].extraction_warnings == ["page 1: extraction error: bad"]
    assert got[1].extraction_warnings == ["page 6: text extraction returned empty"] and got[3].chunks[0].content_type == "table"
    assert [c.chunk_id for c in got[1].chunks] == [f"chunk_{k:04d}" for k in range(1, len(got[1].chunks) + 1)]
    want = C.chunks(C.ordered_items(blocks, boxes)).where("doc_id = 1").orderBy("number").collect()
    assert [(c.chunk_id, c.page_number, c.content_type, c.text, c.token_count, c.bbox, c.heading_context) for c in got[1].chunks] == [(r.chunk_id, r.page_number, r.content_type, r.text, r.token_count, r.bbox, r.heading_context) for r in want]
