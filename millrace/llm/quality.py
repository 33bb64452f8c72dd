"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One weight vector over hashed text features is shared by all grades; ordered thresholds cut the score into
grades: P(grade > k) = sigmoid(w.x - theta_k), theta_1 < theta_2 < ... The weights are fitted on a bounded sample
of labelled rows (``sample_rows``); every text is scored whole, one batch at a time.

Defined cases: a null text, or one without a word, has expected grade 0 and tail probabilities 0. Rows with a
null grade or text are not learned from. With fewer than two grades among the labelled rows nothing can be
learned: scores are then null and every row with a word is selected. Repeated rows are scored alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField

from millrace.llm.common import Memo, as_ids, fresh, table, with_columns, word_hash

BUCKETS = 1 << 18
SHAPES = 64  # buckets below this number are kept for the shape of the text


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold k, a column each."""
        return 1 / (1 + np.exp(-(score[:, None] - self.thresholds[None, :])))


def _word(word: str) -> int:
    """Hash bucket of a word in the low bits; flags of its form above them."""
    core = word.strip(".,;:!?\"'()[]")
    letters = sum(c.isalpha() for c in core)
    caps = letters > 1 and core.isupper()
    marks = len(word) - letters - sum(c.isdigit() for c in word) - sum(word.endswith(x) for x in (".", ","))
    bucket = SHAPES + word_hash(core.lower()) % (BUCKETS - SHAPES)
    return bucket | caps << 20 | (marks > 0) << 21 | (letters == 0) << 22 | (word[-1] in ".!?") << 23


def _levels(value: float, base: int, steps: int = 8) -> tuple[int, float]:
    """A share between 0 and 1 as one of ``steps`` indicator features."""
    return base + min(steps - 1, int(value * steps)), 1.0


def features(texts: list[str | None], memo: Memo) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
    """(bucket ids, values) of each text; None where the text has no word."""
    for text in texts:
        words = (text or "").split()
        if not words:
            yield None
            continue
        coded = as_ids(memo, words)
        memo.trim()
        n, ids = len(words), coded & (BUCKETS - 1)
        unique, counts = np.unique(ids, return_counts=True)
        flags = [float(((coded >> k) & 1).mean()) for k in (20, 21, 22, 23)]
        again = float((ids[1:] == ids[:-1]).mean()) if n > 1 else 0.0
        shape = [_levels(flags[0], 1), _levels(flags[1], 9), _levels(flags[2], 17), _levels(again, 25), _levels(len(unique) / n, 33), _levels(min(1.0, flags[3] * 2), 41), _levels(min(1.0, np.log2(n) / 16), 49), (57, flags[0] + flags[1] + flags[2]), (58, again)]
        at, value = zip(*shape, strict=True)
        yield np.concatenate([np.array(at), unique]), np.concatenate([np.array(value), 0.5 * np.log2(1 + counts)])


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 9000, rounds: int = 300, l2: float = 1e-4, least_docs: int = 40) -> OrdinalModel | None:
    """Fit on at most about ``sample_rows`` labelled rows, as many of each grade; weights undo the sampling.

    ``docs`` has id and text, ``labels`` id and grade (int, any ordered set of values).
    """
    labels = labels.where(F.col("id").isNotNull() & F.col("grade").isNotNull())
    counts = {r["grade"]: r["n"] for r in labels.groupBy("grade").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return None
    grades, each = sorted(counts), sample_rows / len(counts)
    share = F.create_map(*[F.lit(x) for g in grades for x in (g, min(1.0, each / counts[g]))])
    picked = labels.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < share[F.col("grade")] * 1_000_000)
    # An id that labels or documents repeat is drawn once for each of its grades, so the sample's size is bounded.
    joined = docs.join(F.broadcast(picked.select("id", "grade").distinct()), "id").dropDuplicates(["id", "grade"]).select("grade", "text")

    def run(batches):
        import pyarrow as pa

        memo = Memo(_word)
        for batch in batches:
            got = [(g, f) for g, f in zip(batch.column(0).to_pylist(), features(batch.column(1).to_pylist(), memo), strict=True) if f]
            yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in got], pa.int32()), pa.array([f[0].astype("<i4").tobytes() for _, f in got], pa.binary()), pa.array([f[1].astype("<f4").tobytes() for _, f in got], pa.binary())], ["grade", "ids", "vals"])

    rows = joined.withColumn("grade", F.col("grade").cast("int")).mapInArrow(run, "grade int, ids binary, vals binary").collect()
    rows.sort(key=lambda r: (r["grade"], r["ids"], r["vals"]))
    if len({r["grade"] for r in rows}) < 2:
        return None
    return _train(rows, grades, counts, rounds, l2, least_docs)


def _train(rows: list, grades: list, counts: dict, rounds: int, l2: float, least_docs: int) -> OrdinalModel:
    """Full-batch Adam on the weighted log loss of the cumulative links."""
    ids, vals = np.concatenate([np.frombuffer(r["ids"], "<i4") for r in rows]), np.concatenate([np.frombuffer(r["vals"], "<f4") for r in rows]).astype(np.float64)
    least_docs = min(least_docs, max(2, len(rows) // 100))
    row_of = np.repeat(np.arange(len(rows)), [len(r["ids"]) // 4 for r in rows])
    kept = (np.bincount(ids, minlength=BUCKETS)[ids] >= least_docs) | (ids < SHAPES)  # a rare word tells nothing yet
    ids, vals, row_of = ids[kept], vals[kept], row_of[kept]
    y = np.array([grades.index(r["grade"]) for r in rows])
    seen = np.bincount(y, minlength=len(grades))
    weight = np.array([counts[g] for g in grades])[y] / np.maximum(1, seen)[y]
    weight = np.sqrt(weight / weight.mean())
    weight /= weight.sum()
    k = len(grades) - 1
    over = (y[:, None] > np.arange(k)[None, :]).astype(float)  # targets of P(grade > k)
    w, first, gaps = np.zeros(BUCKETS), -1.0, np.zeros(max(0, k - 1))
    m, v = np.zeros(BUCKETS + k), np.zeros(BUCKETS + k)
    for step in range(1, rounds + 1):
        theta = first + np.concatenate([[0], np.cumsum(np.exp(gaps))])
        score = np.bincount(row_of, weights=w[ids] * vals, minlength=len(rows))
        miss = (1 / (1 + np.exp(-(score[:, None] - theta[None, :]))) - over) * weight[:, None]
        g_w = np.bincount(ids, weights=miss.sum(1)[row_of] * vals, minlength=BUCKETS) + l2 * w
        g_theta = -miss.sum(0)
        g = np.concatenate([g_w, [g_theta.sum()], [g_theta[i + 1 :].sum() * np.exp(gaps[i]) for i in range(k - 1)]])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
        w, first, gaps = w - move[:BUCKETS], first - move[BUCKETS], gaps - move[BUCKETS + 1 :]
    return OrdinalModel(w.astype(np.float32), first + np.concatenate([[0], np.cumsum(np.exp(gaps))]))


def score(df: DataFrame, text: str, model: OrdinalModel | None, names: tuple[str, str] = ("expected_grade", "p_top")) -> DataFrame:
    """``df`` with the expected grade (0 to the number of thresholds) and the probability of the top grade."""
    fields = [StructField(n, DoubleType()) for n in names]
    if model is None:
        return df.withColumns({n: F.lit(None).cast("double") for n in names})
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        m, memo = shared.value, Memo(_word)

        def step(texts):
            s, empty = np.zeros(len(texts)), np.zeros(len(texts), bool)
            for i, f in enumerate(features(texts, memo)):
                if f:
                    s[i] = float(m.weights[f[0]] @ f[1])
                else:
                    empty[i] = True
            p = m.above(s)
            p[empty] = 0
            return [p.sum(1), p[:, -1]]

        return step

    return with_columns(df, text, fields, make)


def graded(labels: DataFrame) -> DataFrame:
    """The ratings as grades: 0 poor, 1 readable but abusive, 2 good."""
    return labels.select(F.col("doc_id").alias("id"), (F.col("quality") * (2 - F.coalesce("toxic", F.lit(0)))).cast("int").alias("grade"))


def selected(expected: str | Column, top: str | Column) -> Column:
    return F.coalesce(F.col(top) >= 0.5, F.lit(True)) if isinstance(top, str) else F.coalesce(top >= 0.5, F.lit(True))


def query(spark, sf_dir: str) -> DataFrame:
    """doc_id, expected_grade, p_top, selected for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs.select(F.col("doc_id").alias("id"), "text"), graded(table(spark, sf_dir, "labels")))
    out = score(docs, "text", model)
    return out.select("doc_id", "expected_grade", "p_top", selected("expected_grade", "p_top").alias("selected"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier selects: those more likely than not of the top grade."""
    model = fit(docs.select(F.col("doc_id").alias("id"), "text"), graded(table(spark, sf_dir, "labels")))
    e, p = fresh(docs, "expected_grade"), fresh(docs, "p_top")
    return score(docs, "text", model, (e, p)).where(selected(e, p)).select(*docs.columns)
