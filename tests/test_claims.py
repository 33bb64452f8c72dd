"""The golden sentences, the cascade's properties, and claims end to end."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions.lexicon import vocabulary
from millrace.operators import claims as K
from millrace.sources import derived

CELLS = {("Strong", "Yes"), ("Future Promise", "Partial"), ("Future Promise", "No"), ("Vague", "Partial"), ("Vague", "No")}


@pytest.fixture(scope="module")
def golden(spark):
    rows = [(r[0], 1, 0, r[1]) for r in derived.golden()]
    sents = spark.createDataFrame(rows, "doc_id long, page_number int, sent_idx int, raw string")
    return K.with_reason(K.features(sents)).cache()


def test_golden_reasons_and_labels(golden):
    reasons = {r.doc_id: r.reason for r in golden.select("doc_id", "reason").collect()}
    labels = {int(r.Company): f"keep: {r.ESG_Type} / {r.Claim_Type} / {r.Evidence_Exists} / {r.Risk_Signal}" for r in K.classified(K.first_seen(golden)).collect()}
    for k, _, expected, _ in derived.golden():
        assert (f"drop: {reasons[k]}" if reasons[k] else labels[k]) == expected, k


def test_golden_hits(golden):
    counts = [c.alias(k) for k, c in zip("esg", K.topic_counts(F.col("low")), strict=True)]
    got = {r.doc_id: f"{r.e},{r.s},{r.g}" for r in golden.select("doc_id", *counts).collect()}
    for k, _, _, expected in derived.golden():
        if expected:
            assert got[k] == expected, k


def test_vocabulary_keeps_spaces():
    v = vocabulary()
    assert "will " in v["action_keywords"] and " iro" in v["method_phrases"] and "board's" in v["gov_plumbing"]
    assert len(v["method_phrases"]) == 61 and len(v["topic_keywords"]) == 27


def test_word_limits(spark):
    texts = [" ".join(["we", "reduce", "waste"] + ["now"] * n) for n in (0, 1, 42, 43)]
    sents = spark.createDataFrame([(1, 1, k, t) for k, t in enumerate(texts)], "doc_id long, page_number int, sent_idx int, raw string")
    got = [r.reason for r in K.with_reason(K.features(sents)).orderBy("sent_idx").collect()]
    assert got == ["length", None, None, "length"]


@pytest.mark.parametrize(("text", "expected"), [("5 %", True), ("64000 tonnes", False), ("6,400 tonnes", True), ("55M", False), ("55 million", True), ("٥٥ kWh", True), ("3 kg", True), ("3 kgs", False), ("2030", False), ("1.2 TCO2E", True)])
def test_quantities(spark, text, expected):
    assert spark.range(1).select(T.has_quantity(F.lit(text))).first()[0] is expected


def test_white_space_is_unicode(spark):
    assert spark.range(1).select(T.clean(F.lit(" a\x1c　 b\n"))).first()[0] == "a b"


def test_claims_and_drops_add_up_to_sentences(spark):
    pages = derived.claim_pages(spark, "/root/testdata/sf0.001")
    sents = K.sentences(pages)
    rows = K.claims(pages).cache()
    drops = K.drop_counts(K.with_reason(K.features(sents)))
    assert rows.count() + drops.agg(F.sum("n")).first()[0] == sents.count()
    assert {(r.Claim_Type, r.Evidence_Exists) for r in rows.select("Claim_Type", "Evidence_Exists").distinct().collect()} <= CELLS
    assert rows.groupBy("Company", F.lower("Claim_Text")).count().where("count > 1").isEmpty()


def test_first_use_is_kept_in_page_order(spark):
    s = "We reduced landfill waste to 640 tonnes last year."
    pages = spark.createDataFrame([(1, 2, s.upper()), (1, 1, f"{s} {s}"), (2, 5, s)], "doc_id long, page_number int, text string")
    assert sorted((r.Company, r.Page) for r in K.claims(pages).collect()) == [("1", 1), ("2", 5)]


def test_null_and_empty_pages(spark):
    pages = spark.createDataFrame([(1, 1, None), (1, 2, ""), (None, 1, "We reduced waste to 640 tonnes.")], "doc_id long, page_number int, text string")
    assert [r.Company for r in K.claims(pages).collect()] == [None]
