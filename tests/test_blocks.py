import random
import statistics
from collections import defaultdict

from millrace.sources import reports

SCHEMA = "doc_id long, page_number int, block int, line int, span int, text string, size double, x0 double, y0 double, x1 double, y1 double, page_height double"


def plain(rows):
    """Blocks by loops: (doc_id, page_number, src_idx, text, max_font, median_font)."""
    by = defaultdict(list)
    for r in rows:
        by[r[:3]].append(r)
    out, seen = [], defaultdict(int)
    for key in sorted(by):
        lines = defaultdict(list)
        for r in by[key]:
            if r[3] is not None:
                lines[r[3]].append(((-1 if r[4] is None else r[4]), r[5] or ""))
        text = "\n".join(x for n in sorted(lines) if (x := "".join(t for _, t in sorted(lines[n]))).strip()).strip()
        sizes = [r[6] for r in by[key] if r[6]]
        if text:
            seen[key[:2]] += 1
            out.append((key[0], key[1], seen[key[:2]], text, max(sizes, default=0.0), statistics.median(sizes) if sizes else 0.0))
    return out


def test_blocks_of_spans_in_any_order(spark):
    deal = random.Random(3)
    rows = [
        (d, p, b, line, span, deal.choice(["a ", "ü", "", None, " ", "word "]), deal.choice([None, 0.0, 9.0, 10.5, 12.0]), 1.0, 2.0, 3.0, 4.0, 792.0)
        for d in range(4) for p in (1, 2) for b in range(5) for line in range(b) for span in range(6)
    ]
    rows += [(1, 1, 3, 1, 2, "twice ", 9.0, 1.0, 2.0, 3.0, 4.0, 792.0), (1, 1, 3, None, 0, "no line", 30.0, 1.0, 2.0, 3.0, 4.0, 792.0), (2, 1, 4, 2, None, "no span ", 9.0, 1.0, 2.0, 3.0, 4.0, 792.0)]
    mixed = deal.sample(rows, len(rows))
    for given, parts in ((rows, 1), (mixed, 3)):
        got = reports.blocks(spark.createDataFrame(given, SCHEMA).repartition(parts)).collect()
        assert sorted((r.doc_id, r.page_number, r.src_idx, r.text, r.max_font, r.median_font) for r in got) == plain(rows)
    assert reports.blocks(spark.createDataFrame([], SCHEMA)).collect() == []


def test_spans_are_shuffled_once_and_by_line(spark):
    spans = spark.range(0, 40_000, 1, 2).selectExpr("id div 400 as doc_id", "1 as page_number", "int(id % 400 div 40) as block", "int(id % 40 div 8) as line", "int(id % 8) as span", "'word ' as text", "9.0D as size", "0D as x0", "0D as y0", "0D as x1", "0D as y1", "792D as page_height")
    found = reports.blocks(spans)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert found.count() == 1000
