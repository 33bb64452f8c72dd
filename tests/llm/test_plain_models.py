"""The quality, language and mixing models against plain loops; archives in several packages."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import language, mixing, quality, warc_zip
from millrace.llm.common import Memo, new_folder
from tests.llm.conftest import DE, FR, other, sentence


def sigmoid(x):
    return 1 / (1 + math.exp(-x))


def test_op1_scores_are_those_of_the_cumulative_links(spark):
    rng = np.random.default_rng(1)
    model = quality.OrdinalModel(rng.normal(size=quality.BUCKETS).astype(np.float32) * 0.1, np.array([-0.7, 0.2, 1.1]))
    texts = [sentence(k, 5 + 7 * k) for k in range(12)] + ["", None, "ONE!!! 12 ###"]
    got = quality.score(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), "text", model).orderBy("id").collect()
    for row, f in zip(got, quality.features(texts, Memo(quality._word)), strict=True):
        if f is None:
            assert row.expected_grade == row.p_top == 0
            continue
        score = sum(float(model.weights[i]) * float(v) for i, v in zip(*f, strict=True))
        above = [sigmoid(score - t) for t in model.thresholds]
        grades = [1 - above[0], above[0] - above[1], above[1] - above[2], above[2]]  # probability of each grade
        assert row.expected_grade == pytest.approx(sum(g * p for g, p in enumerate(grades)), abs=1e-5)
        assert row.p_top == pytest.approx(grades[3], abs=1e-6) and min(grades) > 0


def test_op1_training_lowers_the_loss_of_its_rows_to_a_minimum():
    """No small step of a weight or threshold does better on the plain loss than the fit, but for the penalty's part."""
    rng = np.random.default_rng(2)
    x = (rng.random((300, 5)) < 0.4).astype(float)
    latent = x @ np.array([2.0, -1.5, 1.0, 0.0, -0.5]) + rng.logistic(size=300)
    grade = (latent > -0.5).astype(int) + (latent > 1.2)
    at = 100 + np.arange(5)
    rows = [{"grade": int(g), "ids": at[r > 0].astype("<i4").tobytes(), "vals": np.ones(int((r > 0).sum()), "<f4").tobytes()} for g, r in zip(grade, x, strict=True)]
    counts = Counter(grade.tolist())
    model = quality._train(rows, [0, 1, 2], counts, 2000, 1e-6, 2)
    weight = np.ones(300) / 300

    def loss(w, theta):
        p = 1 / (1 + np.exp(-((x @ w)[:, None] - theta)))
        over = grade[:, None] > np.arange(2)
        return float((weight[:, None] * -np.where(over, np.log(p), np.log(1 - p))).sum())

    w, theta = model.weights[at].astype(float), model.thresholds
    best = loss(w, theta)
    assert theta[0] < theta[1]
    for k in range(5):
        for step in (-0.1, 0.1):
            assert loss(w + step * (np.arange(5) == k), theta) > best - 2e-4
    for k in range(2):
        for step in (-0.1, 0.1):
            assert loss(w, theta + step * (np.arange(2) == k)) > best - 2e-4


def test_op1_repeated_labels_and_documents_bound_the_sample(spark):
    docs = spark.createDataFrame([(i % 40, sentence(i % 40)) for i in range(400)], "id long, text string")
    labels = spark.createDataFrame([(i % 40, (i % 40) % 2) for i in range(4000)], "id long, grade int")
    seen = []
    train = quality._train
    try:
        quality._train = lambda rows, *a: seen.append(len(rows)) or train(rows, *a)
        quality.fit(docs, labels, sample_rows=10_000, rounds=2)
    finally:
        quality._train = train
    assert seen == [40]


@pytest.mark.parametrize("n", [2, 3, 4, 7])
def test_op4_decoding_is_that_of_a_plain_loop(n):
    rng = np.random.default_rng(n)
    code = language.codewords(n)
    model = language.Codes([str(k) for k in range(n)], code, np.zeros((1, 1)), np.zeros(1), rng.random(code.shape[1]) + 0.1)
    out = rng.normal(size=(20, code.shape[1])) * 3
    best, p, lead = language.decode(model, out)
    for r in range(20):
        loss = [sum(model.trust[b] * math.log1p(math.exp(-code[k, b] * out[r, b])) for b in range(code.shape[1])) for k in range(n)]
        share = [math.exp(-x) / sum(math.exp(-y) for y in loss) for x in loss]
        order = sorted(share, reverse=True)
        assert best[r] == loss.index(min(loss)) and p[r] == pytest.approx(order[0]) and lead[r] == pytest.approx(order[0] - order[1])


def test_op4_held_out_texts(spark):
    rows = [(k, other(DE, k), "de") for k in range(60)] + [(100 + k, other(FR, k), "fr") for k in range(60)] + [(200 + k, sentence(k), "en") for k in range(60)]
    train = spark.createDataFrame([r for r in rows if r[0] % 3], "id long, text string, lang string")
    model = language.fit(train)
    held = spark.createDataFrame([r for r in rows if r[0] % 3 == 0], "id long, text string, lang string")
    got = language.predict(held, "text", model).collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.98 * len(got)
    mixed = spark.createDataFrame([(other(DE, 1) + " " + other(FR, 1),)], "text string")
    clear, unclear = min(r.score for r in got), language.predict(mixed, "text", model).first().score
    assert unclear < 1 and clear > 0.5


def test_op10_posteriors_and_rates_are_those_of_plain_numpy(spark):
    docs = [(k, other(DE, k, 20 + k), "de") for k in range(30)] + [(100 + k, other(FR, k, 10 + 2 * k), "fr") for k in range(25)] + [(200 + k, other(DE, k, 15) + " " + other(FR, k, 25), None) for k in range(10)] + [(300, "", None), (301, None, None), (302, "zzz qqq", None)]
    df = spark.createDataFrame(docs, "id long, text string, domain string")
    model = mixing.learned(df, least_docs=2)
    assert model[0] == ["de", "fr"]
    # The table: words by the documents of each domain that hold them.
    texts = {d: [set(t.lower().split()) for _, t, x in docs if x == d] for d in ("de", "fr")}
    count = {d: Counter(w for t in texts[d] for w in t) for d in texts}
    words = {w for w in count["de"] | count["fr"] if count["de"][w] + count["fr"][w] >= 2}
    total = {d: sum(count[d][w] for w in words) for d in texts}
    log = {d: {w: math.log((count[d][w] + 0.5) / (total[d] + 0.5 * len(words))) for w in words} for d in texts}
    prior = {"de": 30 / 55, "fr": 25 / 55}
    want = {}
    for i, t, _ in docs:
        ws = (t or "").lower().split()
        s = {d: math.log(prior[d]) + sum(log[d].get(w, 0.0) - (log["de"].get(w, 0.0) + log["fr"].get(w, 0.0)) / 2 for w in ws) for d in texts}
        top = max(s.values())
        mass = {d: math.exp(x - top) for d, x in s.items()}
        want[i] = (len(ws), mass["de"] / sum(mass.values()))
    soft = mixing.posteriors(df, model)
    got = {r.id: (r.n_tokens, r.p0) for r in soft.collect()}
    assert got.keys() == want.keys() and all(got[i][0] == want[i][0] and got[i][1] == pytest.approx(want[i][1], abs=1e-9) for i in want)
    # The rates: the same projected steps over arrays, and the optimality of the least squares.
    ids = sorted(want)
    n, p = np.array([want[i][0] for i in ids], float), np.array([[want[i][1], 1 - want[i][1]] for i in ids])
    a = (n[:, None] * p).T
    base = a.sum(1)
    for targets in (np.array([700.0, 1500.0]), np.array(mixing.tempered(base.tolist())), np.array([0.0, 900.0])):
        r = np.ones(len(ids))
        for _ in range(300):
            r = np.maximum(0, r - p @ ((a @ r - targets) / base))
        found = mixing.matched(soft, 2, targets.tolist(), tolerance=1e-3)
        mine = np.array([x.rate for x in found.orderBy("id").collect()])
        assert (mine >= 0).all() and np.allclose(a @ mine, a @ r, rtol=1e-2, atol=2)
    assert mine[ids.index(0)] < 0.05 < mine[ids.index(100)]  # a domain that is to have none


def test_op10_tempered_targets():
    totals = [900.0, 90.0, 10.0, 0.0]
    same, more = mixing.tempered(totals), mixing.tempered(totals, grow=True)
    assert sum(same) == pytest.approx(1000) and same[0] < 900 and same[2] > 10 and same[3] == 0
    assert all(b >= a for a, b in zip(totals, more, strict=True)) and more[1] / more[0] == pytest.approx(same[1] / same[0])


def test_op10_the_stage_loses_no_document(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    found, _ = mixing.rates(docs.select(F.col("doc_id").alias("id"), "text"), mixing.labelled_rows(spark, docs, odd), grow=True)
    assert found.where("rate < 1").isEmpty()


def test_op5_packages_are_cut_by_bytes(spark, odd):
    pages = spark.read.parquet(f"{odd}/pages.parquet").select("page_id", "url", "html").coalesce(1)
    folder = new_folder(spark, "warc")
    manifest = warc_zip.write_packages(warc_zip.decided(pages).coalesce(1), folder, package_bytes=1500)
    lines = manifest.collect()
    assert len(lines) > 2 and sum(r.records for r in lines) == pages.count()
    got = warc_zip.read_packages(manifest, folder)
    want = warc_zip.query(spark, odd)
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert Counter(map(tuple, got.select(*columns).collect())) == Counter(map(tuple, want.select(*columns).collect()))
