"""The language model's score and gradients against plain loops over the same classes and weights."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

from millrace.llm import lm_score
from millrace.llm.common import run_sums, table
from tests.llm.conftest import rows

MASK = (1 << 64) - 1


def plain_features(keys, t, buckets):
    """Hash of each of the four features of token t, and its bucket."""

    def word(i):
        return (keys[i] + 7) * 0x9E3779B97F4A7C15 & MASK

    one, two, three = (word(t - k) if t >= k else k for k in (1, 2, 3))
    out = []
    for w in (one, two ^ 0x51ED270B, three ^ 0x2545F491, one * 3 + two * 0xC2B2AE3D27D4EB4F & MASK):
        out.append((w ^ w >> 31) * 0xD6E8FEB86659FD93 & MASK)
    return out, [h >> 64 - buckets.bit_length() + 1 for h in out]


def log_softmax(z, k):
    top = max(z)
    return z[k] - top - math.log(sum(math.exp(x - top) for x in z))


def test_scores_are_those_of_a_plain_loop(spark, tmp_path, monkeypatch):
    """With a head of 40 words most words lie beyond it; some are in held-out texts only."""
    monkeypatch.setattr(lm_score, "HEAD", 40)
    kept = []
    learned = lm_score.learned
    monkeypatch.setattr(lm_score, "learned", lambda codes: kept.append(learned(codes)) or kept[-1])
    new = next(i for i in range(1000, 2000) if zlib.crc32(str(i).encode()) % 7 == 2)
    docs = [(i, t) for i, t, _, _ in rows()[0]] + [(new, "words that nobody zyzzyva Qwertz, 12345678901 has met before zyzzyva é")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = lm_score.query(spark, str(tmp_path)).collect()
    model = kept[0][0]
    word = re.compile(rb"[^\x20\x09-\x0D]+")
    texts = [(i, [*map(lm_score.word_key, word.findall((t or "").encode().lower())), lm_score.END]) for i, t in docs]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in texts]
    count = Counter(k for (_, ks), h in zip(texts, held, strict=True) if not h for k in ks)
    head = {int(k): n for n, k in enumerate(model.classes.keys)}
    assert len(head) == 40 and lm_score.END in head
    assert set(head) - {lm_score.END} == set(sorted((k for k in count if k != lm_score.END), key=lambda k: (-count[k], k))[:39])
    mass = defaultdict(int)
    for k, n in count.items():
        if k in head:
            mass[int(model.classes.of[head[k]]), int(model.classes.sub[head[k]])] += n
        else:
            mass["tail", k & 15] += n + 1
    weights, buckets = model.weights, len(model.weights.first) - 1
    want = []
    for i, keys in texts:
        total = 0.0
        for t, k in enumerate(keys):
            known = k in head
            c, s = (int(model.classes.of[head[k]]), int(model.classes.sub[head[k]])) if known else (lm_score.CLASSES - 1, k & 15)
            hashes, at = plain_features(keys, t, buckets)
            z = [float(weights.first[buckets, j] + sum(weights.first[b, j] for b in at)) for j in range(lm_score.CLASSES)]
            again = [(h ^ (c + 1) * 0x9FB21C651E98DF25 & MASK) * 0xD6E8FEB86659FD93 & MASK for h in hashes]
            y = [float(weights.second[buckets + c, j] + sum(weights.second[h >> 64 - buckets.bit_length() + 1, j] for h in again)) for j in range(lm_score.SUBS)]
            total += (log_softmax(z, c) + log_softmax(y, s)) / math.log(10)
            total += math.log10(count[k] / mass[c, s]) if known else math.log10((count[k] + 1) / (mass["tail", s] + 1))
        want.append((-1 if i is None else i, len(keys), total))
    want.sort()
    close = sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.score) for r in got)
    assert [x[:2] for x in close] == [x[:2] for x in want] and all(abs(x[2] - y[2]) < 1e-5 * x[1] + 1e-3 for x, y in zip(close, want, strict=True))
    assert any(h and k not in count for (_, ks), h in zip(texts, held, strict=True) for k in ks)


def test_all_words_and_an_unknown_of_each_form_add_up_to_one(spark, odd, monkeypatch):
    """In several contexts, the ends of texts and words beyond the head included."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(lm_score, "HEAD", 60)
    docs = table(spark, odd, "documents").select("text", F.monotonically_increasing_id().alias("id"))
    model, counts = lm_score.learned(lm_score.encoded(docs.withColumn("round", (F.col("id") % 2 + 1).cast("int"))))
    head = {int(k): n for n, k in enumerate(model.classes.keys)}
    tail = [(r.key, r.n) for r in counts.collect() if r.key not in head]
    assert len(head) == 60 and len(tail) > 20
    words = lm_score.hashed(np.array([lm_score.word_key(w) for w in (b"the", b"of", b"zyzzyva", b"12,")], np.int64))
    at = lm_score.context(words, np.array([0, 1, 2, 3, 0, 1]), np.array([4, 2]))
    total = 0.0
    for k, c, s in zip(model.inside, model.classes.of, model.classes.sub, strict=True):
        total = total + 10 ** (lm_score.log_model(model.weights, at, np.full(6, c), np.full(6, s)) + k)
    form = {s: 10 ** lm_score.log_model(model.weights, at, np.full(6, lm_score.CLASSES - 1), np.full(6, s)) / 10 ** model.forms[s] for s in range(lm_score.FORMS)}
    for key, n in [*tail, *((s, 0) for s in range(lm_score.FORMS))]:
        total = total + form[key & 15] * (n + 1)
    assert np.allclose(total, 1, atol=1e-4)
    ends = np.full(6, lm_score.ENDING)
    assert np.allclose(lm_score.log_share(model.weights.second, lm_score.features(at, len(model.weights.first) - 1, ends), len(model.weights.first) - 1 + ends, np.zeros(6, int)), 0, atol=1e-6)


def test_replicas_follow_from_the_tokens(spark, odd, monkeypatch):
    from pyspark.sql import functions as F

    seen = []
    real = lm_score.trained
    monkeypatch.setattr(lm_score, "trained", lambda codes, classes, buckets, replicas: seen.append(replicas) or real(codes, classes, buckets, replicas))
    codes = lm_score.encoded(table(spark, odd, "documents").select("text", F.lit(1).cast("long").alias("id"), F.lit(2).alias("round")))
    tokens = lm_score.learned(codes)[0].total
    lm_score.learned(codes, replica_tokens=tokens // 3)
    assert seen == [1, 4]


def test_a_step_follows_the_gradient():
    rng = np.random.default_rng(3)
    for buckets in (64, (1 << 16) + 40):
        start = rng.normal(size=(buckets, 5)).astype(np.float32)
        at, constant, goal = rng.integers(0, buckets - 1, (4, 50)), np.full(50, buckets - 1), rng.integers(0, 5, 50)
        at[:, 1] = at[:, 0]
        learner = lm_score.Learner(start, 0.3)
        learner.step(at, constant, goal)
        z = start[constant] + sum(start[r] for r in at)
        miss = np.exp(z) / np.exp(z).sum(1, keepdims=True) - np.eye(5)[goal]
        grad = np.zeros(start.shape)
        for r in (*at, constant):
            np.add.at(grad, r, miss)
        assert np.allclose(learner.weights, start - 0.3 * grad / np.sqrt(1e-2 + grad**2), atol=1e-3)
        assert np.array_equal(learner.seen, np.bincount(np.concatenate([at.ravel(), constant]), minlength=buckets))


def test_run_sums():
    rng = np.random.default_rng(6)
    rows = rng.normal(size=(300, 3)).astype(np.float32)
    for runs in ([1] * 5, [7, 1, 2, 300, 3, 64, 65], [1000]):
        order, first = rng.integers(0, 300, sum(runs)), np.cumsum([0, *runs[:-1]])
        assert np.allclose(run_sums(rows, order, first), np.add.reduceat(rows[order], first, axis=0), atol=1e-3)


def test_codes_hold_every_token(spark, odd):
    from pyspark.sql import functions as F

    texts = table(spark, odd, "documents").select("text", F.monotonically_increasing_id().alias("id"), F.lit(1).alias("round"))
    want = {r.id: [*map(lm_score.word_key, (r.text or "").encode().lower().split()), lm_score.END] for r in texts.collect()}
    got = {}
    for r in lm_score.encoded(texts).collect():
        at = 0
        for i, n in zip(r.ids, r.sizes, strict=True):
            got[i] = [r["keys"][p] for p in r.places[at : at + n]]
            at += n
    assert got == want


def test_buckets_grow_with_the_root_of_the_tokens():
    sizes = [lm_score.buckets_for(n) for n in (0, 10**5, 10**7, 10**9, 10**15)]
    assert sizes == sorted(sizes) and sizes[0] == 1 << 12 and sizes[-1] == 1 << 18 and sizes[2] < sizes[3]


def test_rows_of_codes_are_read_a_few_at_a_time(spark, tmp_path, monkeypatch):
    """A row of codes is a quarter of a megabyte: Parquet's 4,096 rows at once are a gigabyte of an executor's heap."""
    names, seen = ("spark.sql.parquet.columnarReaderBatchSize", "spark.sql.execution.arrow.maxRecordsPerBatch"), {}
    usual = [spark.conf.get(k) for k in names]
    write = lm_score.written
    monkeypatch.setattr(lm_score, "written", lambda df, name: (seen.update({name: [spark.conf.get(k) for k in names]}), write(df, name))[1])
    spark.createDataFrame([(i, t) for i, t, _, _ in rows()[0]], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    lm_score.query(spark, str(tmp_path)).collect()
    assert seen.pop("lm-codes") == usual == [spark.conf.get(k) for k in names]
    assert seen == dict.fromkeys(("word-counts", "lm-cells", "lm-weights", "lm-parts"), ["16", "16"])
