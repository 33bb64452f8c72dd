"""Each stage of the pipeline against what a plain version of it would keep."""

from collections import Counter

import pytest

import corpus_pipeline
from millrace.llm import decontaminate, mixing, neardup, quality, token_store
from tests.llm.conftest import rows


@pytest.fixture
def docs(spark, odd):
    return spark.read.parquet(f"{odd}/documents.parquet")


def ids(df):
    return Counter(r.doc_id for r in df.select("doc_id").collect())


def test_stages_are_in_order():
    assert [f for _, f in corpus_pipeline.STAGES] == [quality.stage, neardup.stage, decontaminate.stage, mixing.stage, token_store.stage]


def test_quality_stage_keeps_what_the_query_selects(spark, odd, docs):
    want = Counter(r.doc_id for r in quality.query(spark, odd).where("selected").collect())
    assert ids(quality.stage(spark, docs, odd)) == want


def test_one_document_of_each_class_stays(spark, odd, docs):
    before, after = ids(docs), ids(neardup.stage(spark, docs, odd))
    gone = {r.doc_id for r in neardup.query(spark, odd).where("doc_id <> class_id").collect()}  # as brute force has it
    assert set(before) - set(after) == gone >= {70, 71, 72}  # among them copies of 1, exact and near
    assert before[5] == 3 and all(n == 1 for n in after.values())  # rows that repeat an id with its text are copies too


def test_the_leak_goes(spark, odd, docs):
    assert ids(docs) - ids(decontaminate.stage(spark, docs, odd)) == Counter({81: 1})


def test_mixing_repeats_by_rate_and_loses_none(spark, odd, docs):
    found, _ = mixing.rates(docs.selectExpr("doc_id as id", "text"), mixing.labelled_rows(spark, docs, odd))
    rate = {r.id: r.rate for r in found.collect()}
    before, after = ids(docs), ids(mixing.stage(spark, docs, odd))
    assert set(after) == set(before)
    assert all(after[i] in (before[i] * int(rate[i]), before[i] * (int(rate[i]) + 1)) for i in before)


def test_store_has_a_row_for_each_document(spark, odd, docs):
    twice = docs.union(docs)
    got = token_store.stage(spark, twice, odd)
    assert ids(got) == ids(twice)
    starts = sorted((r.start, r.n_tokens) for r in got.collect())
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False)) and len(starts) == 2 * len(rows()[0])
