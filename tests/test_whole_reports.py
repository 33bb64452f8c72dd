"""Pages that arrive apart give what a batch gives, however they are split; totals and levels of a run."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millrace.operators import claims as K, layout as L
from millrace.plans import registry
from millrace.sources import derived, sinks
from millrace.streaming import whole_reports as W

D = "/root/testdata/sf0.001"
START = datetime(2024, 1, 1)


def fed(spark, folder, rows, schema):
    """Append rows as a file of the stream's folder."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def ran(spark, tmp_path, batches, schema, write):
    """Each batch in a run of its own, from the last run's checkpoint, with one file in a micro-batch."""
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in batches:
        fed(spark, folder, rows, schema)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
        write(stream, out, str(tmp_path / "check")).awaitTermination()
    return spark.read.parquet(out)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_any_split_of_pages_gives_the_claims_of_a_batch(spark, tmp_path, seed):
    pages = derived.claim_pages(spark, D).where("doc_id < 30")
    rng = random.Random(seed)
    rows = [(r.doc_id, START + timedelta(seconds=rng.randint(0, 240)), r.page_number, r.text) for r in pages.collect()]
    rng.shuffle(rows)
    k = sorted(rng.sample(range(len(rows)), 2))
    end = [(-1, START + timedelta(hours=2), 1, "The end.")]  # moves the watermark past all reports
    schema = "doc_id long, arrived timestamp, page_number int, text string"
    got = ran(spark, tmp_path, [rows[: k[0]], rows[k[0] : k[1]], rows[k[1] :], end], schema, lambda s, o, c: W.write_claims(s, o, c, "5 minutes", "5 minutes"))
    want = K.claims(pages)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect())) and not got.isEmpty()


def test_headers_of_reports_that_arrive_in_parts(spark, tmp_path):
    blocks = derived.layout_blocks(spark, D).where("doc_id < 40")
    rows = [(r.doc_id, START + timedelta(seconds=i % 90), *list(r)[1:]) for i, r in enumerate(blocks.collect())]
    fields = [f for f in blocks.schema.simpleString()[7:-1].split(",")]
    schema = ", ".join(["doc_id long", "arrived timestamp", *(f.replace(":", " ") for f in fields[1:])])
    parts = [[r for r in rows if r[2] % 3 == p] for p in range(3)]
    end = [(-1, START + timedelta(hours=2), *list(blocks.first())[1:])]
    got = ran(spark, tmp_path, [*parts, end], schema, lambda s, o, c: W.write_body_blocks(s, o, c, "5 minutes", "5 minutes"))
    want = L.without_headers(blocks)
    key = ["doc_id", "page_number", "src_idx"]
    assert sorted(map(tuple, got.select(key).collect())) == sorted(map(tuple, want.select(key).collect()))
    assert want.count() < blocks.count()


def test_later_copies_win_and_late_pages_are_dropped(spark, tmp_path):
    schema = "doc_id long, arrived timestamp, page_number int, text string"
    at = lambda m: START + timedelta(minutes=m)
    batches = [
        [(1, at(0), 1, "old"), (1, at(2), 1, "new"), (1, at(1), 2, "two"), (2, at(0), 1, None)],
        [(3, at(60), 1, "moves the watermark")],
        [(1, at(3), 3, "too late"), (4, at(61), 1, "x")],
        [(5, at(200), 1, "end")],
    ]

    def write(stream, out, check):
        return W._started(W.whole_reports(stream, W.PAGE, "5 minutes", "5 minutes"), lambda b, n: b.write.mode("overwrite").parquet(f"{out}/batch={n}"), check)

    got = ran(spark, tmp_path, batches, schema, write)
    assert sorted((r.doc_id, r.page_number, r.text) for r in got.collect()) == [(1, 1, "new"), (1, 2, "two"), (2, 1, None), (3, 1, "moves the watermark"), (4, 1, "x")]


def test_observed_totals_are_those_counted(spark, tmp_path):
    """While claims are written in one pass: every page is read once."""
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            reads.add(len(batch))
            yield batch

    pages = derived.claim_pages(spark, D)
    source = sinks.kept(pages, "pages")
    rows, told = K.observed(source.mapInPandas(counted, source.schema))
    rows.write.parquet(str(tmp_path / "claims"))
    assert reads.value == source.count()
    want = K.drop_counts(K.with_reason(K.features(K.sentences(pages)))).groupBy("reason").agg(F.sum("n").alias("n")).collect()
    assert told.dropped() == {r.reason: r.n for r in want}
    assert told.types() == Counter(r.Claim_Type for r in K.claims(pages).collect())
    none, told = K.observed(pages.where("false"))
    none.write.parquet(str(tmp_path / "none"))
    assert told.dropped() == told.types() == {}


def test_levels_are_those_of_a_loop(spark):
    rows = [("a", 1, "x", "E", "Strong", "Yes", ""), ("a", 1, "y", "E", "Vague", "No", ""), ("a", 2, "z", "S", "Vague", "No", ""), ("b", 1, "x", "E", "Strong", "Yes", ""), (None, 1, "x", "E", "Vague", "No", "")]
    df = spark.createDataFrame(rows, "Company string, Page int, Claim_Text string, ESG_Type string, Claim_Type string, Evidence_Exists string, Risk_Signal string")
    at = {"Company": 0, "ESG_Type": 3, "Claim_Type": 4}
    want = []
    for level in K.LEVELS:
        groups = {}
        for r in rows:
            groups.setdefault(tuple(r[at[c]] if c in level else None for c in at), []).append(r)
        for g, mine in groups.items():
            want.append((",".join(c for c in at if c in level) or "all", *g, len(mine), len({r[:2] for r in mine if r[0]}), sum(r[5] == "Yes" for r in mine)))
    got = [tuple(r) for r in K.level_counts(df).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_sketches_merge_within_their_bound(spark):
    """Of many different texts, spread over reports and repeated: the estimate of merged sketches, at 2^12 registers."""
    df = spark.range(60_000).select((F.col("id") % 50).cast("string").alias("Company"), F.concat(F.lit("Text "), (F.col("id") % 20_000).cast("string")).alias("Claim_Text"), F.when(F.col("id") % 2 == 0, "E").otherwise("S").alias("ESG_Type"))
    kept = sinks.kept(K.text_sketches(df, "Company", "ESG_Type"), "sketches")
    got = {r.ESG_Type: (r.claims, r.distinct_texts) for r in K.merged_sketches(kept, "ESG_Type").collect()}
    assert all(n == 30_000 and abs(d - 10_000) < 500 for n, d in got.values()) and kept.count() == 50
    assert abs(K.merged_sketches(kept).first().distinct_texts - 20_000) < 1000


def test_variants_hold_what_no_schema_names(spark, tmp_path):
    lines = ['{"report_metadata": {"source_pdf": "a.pdf", "total_pages": 3}, "chunks": [{"chunk_id": "chunk_0001", "new": {"x": [1, 2.5]}}, {"chunk_id": 7}]}', "not json", '{"report_metadata": {"source_pdf": "b.pdf"}, "chunks": []}', '{"chunks": "odd"}']
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(str(tmp_path / "json"))
    found = sinks.read_variants(spark, str(tmp_path / "json"))
    assert found.count() == 4 and found.where("report is null").count() == 1
    got = sinks.variant_chunks(found).select("source_pdf", "total_pages", "pos", F.try_variant_get("chunk", "$.chunk_id", "string").alias("id"), F.try_variant_get("chunk", "$.new.x[1]", "double").alias("x")).collect()
    assert [tuple(r) for r in got] == [("a.pdf", 3, 0, "chunk_0001", 2.5), ("a.pdf", 3, 1, "7", None)]

    more = sinks.variant_chunks(found, F.try_variant_get("report", "$.chunks[0].new.x[0]", "int").alias("x0")).collect()
    assert [(r.source_pdf, r.pos, r.x0) for r in more] == [("a.pdf", 0, 1), ("a.pdf", 1, 1)]


def test_chunks_of_variants_are_not_shuffled(spark):
    """What a report says goes with its chunks; nothing is joined to them."""
    plan = registry.queries()["s09_variants"](spark, D)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_registered_levels_cover_every_claim(spark):
    got = registry.queries()["a02_levels"](spark, D).collect()
    assert next(r.claims for r in got if r.level == "all") == sum(r.claims for r in got if r.level == "Company,ESG_Type")
