"""Hard negatives and the Voronoi join against loops over plain integers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import hard_negatives, integer_vectors, voronoi_join

LONG = 2**63


def wholes(rows, labelled=False):
    """id -> (integers, label) as the operators define them, from (id, label, vector)."""
    rows = [r for r in rows if not labelled or r[1] is not None]
    lengths = [len(v) for _, _, v in rows if v]
    if not lengths:
        return {}
    usual = min(set(lengths), key=lambda n: (-lengths.count(n), n))
    found = {}
    for i, label, v in rows:
        if i is not None and v and len(v) == usual and all(c is not None and math.isfinite(256.0 * c) for c in v):
            x = ([math.floor(256.0 * c) for c in v], label)
            found[i] = min(found.get(i, x), x)
    return found


def dot(a, b):
    return min(max(sum(x * y for x, y in zip(a, b, strict=True)), -LONG), LONG - 1)


def nearest(rows, step, k):
    have = wholes(rows)
    out = []
    for q in (i for i in have if i % step == 0):
        ranked = sorted((-dot(have[q][0], v), i) for i, (v, _) in have.items() if i != q)[:k]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(ranked, 1)]
    return sorted(out)


def hard(rows, step, n_positives=5, n_negatives=10):
    have = wholes(rows, True)
    out = []
    for a in (i for i in have if i % step == 0):
        ranked = sorted((-dot(have[a][0], v), i, label) for i, (v, label) in have.items() if i != a)
        for s, p, _ in [r for r in ranked if r[2] == have[a][1]][:n_positives]:
            fit = [(-n, i) for n, i, label in ranked if label != have[a][1] and 30 * -s <= 100 * -n <= 90 * -s][:n_negatives]
            out += [(a, p, k, i, -s, n) for k, (n, i) in enumerate(fit, 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, label long, vector array<double>").repartition(4)


def gathered(n, dims=8, groups=12, spread=0.02, seed=5):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dims))
    centres /= np.sqrt((centres * centres).sum(1))[:, None]
    return [(i, int(g % 4), v.tolist()) for i, g in enumerate(rng.integers(0, groups, n)) for v in [centres[g] + spread * rng.normal(size=dims)]]


def strange():
    rng = np.random.default_rng(9)
    rows = [(i, i % 3, rng.normal(size=4).round(2).tolist()) for i in range(300)]
    rows += [(1000 + i, i % 2, [0.5, 0.25, -0.5, 1.0]) for i in range(90)]  # one vector many times
    rows += [(2000, 0, None), (2050, 0, []), (2100, 0, [1.0, None, 1.0, 1.0]), (2150, 0, [float("nan"), 1.0, 1.0, 1.0]), (2200, 0, [1.0, 1.0]), (2250, 0, [float("inf"), 0.0, 0.0, 0.0]), (None, 0, [9.0] * 4), (2300, None, [1.0, 2.0, 3.0, 4.0])]
    rows += [(2400, 1, [0.0] * 4), (2500, 7, [1.0, 1.0, 1.0, 1.0]), (50, 1, [-9.0, 0.0, 0.0, 0.0]), (-100, 2, [0.1, 0.2, 0.3, 0.4]), (0, 0, [1e-9, -1e-9, 0.0, 0.0])]
    return rows


def searched(spark, rows, **settings):
    got = voronoi_join.joined(frame(spark, rows), F.col("id") % 50 == 0, **settings)
    return sorted(tuple(r) for r in got.collect())


def mined(spark, rows, step=50, **settings):
    got = hard_negatives.mined(frame(spark, rows), F.col("id") % step == 0, **settings)
    return sorted(tuple(r) for r in got.collect())


@pytest.mark.parametrize("settings", [{}, {"pivots": 7, "group_queries": 2, "block_rows": 16}, {"pivots": 1, "sample_rows": 3}])
def test_join_equals_brute_force(spark, settings):
    rows = strange()
    want = nearest(rows, 50, 5)
    assert searched(spark, rows, **settings) == want and (2400, 1, -100, 0) in want and any(q == -100 for q, *_ in want)


@pytest.mark.parametrize("settings", [{}, {"cells": 3, "part_anchors": 2, "block_rows": 16}, {"cells": 1, "sample_rows": 2}])
def test_negatives_equal_brute_force(spark, settings):
    rows = strange()
    want = hard(rows, 50)
    assert mined(spark, rows, **settings) == want and want


def test_a_hot_label_and_a_hot_vector_are_cut(spark):
    """Most rows share a label, a third one vector: ties are decided by id across blocks."""
    rng = np.random.default_rng(2)
    rows = [(i, 0 if i % 5 else i % 3, (rng.normal(size=6).round(1) if i % 3 else np.array([1, -1, 0.5, 0.5, 0, 0])).tolist()) for i in range(1200)]
    assert mined(spark, rows, 100, part_anchors=4, block_rows=100) == hard(rows, 100)
    assert searched(spark, rows, k=7, group_queries=4, block_rows=100, pivots=9) == nearest(rows, 50, 7)


@pytest.mark.parametrize("size", [1e4, 1e9, 1e30, 1e300])
def test_huge_components_stay_exact(spark, size):
    """Products beyond exact doubles are computed as integers and held at a long's ends."""
    rng = np.random.default_rng(4)
    rows = [(i, i % 2, (rng.normal(size=3) * (size if i % 4 == 0 else 1)).tolist()) for i in range(120)]
    assert searched(spark, rows, block_rows=30) == nearest(rows, 50, 5)
    assert mined(spark, rows, block_rows=30) == hard(rows, 50)


def test_few_and_no_candidates(spark):
    assert searched(spark, [(0, 1, [1.0, 2.0])]) == [] and mined(spark, [(0, 1, [1.0, 2.0])]) == []
    few = [(0, 1, [1.0, 0.0]), (1, 1, [1.0, 0.0]), (2, 2, [0.5, 0.0]), (3, 2, [0.95, 0.0])]
    assert searched(spark, few) == [(0, 1, 1, 65536), (0, 2, 3, 62208), (0, 3, 2, 32768)]
    assert mined(spark, few) == [(0, 1, 1, 2, 65536, 32768)]  # the other lies above the window
    assert searched(spark, [(1, 1, [1.0])]) == [] and mined(spark, [(50, None, [1.0])]) == []


def test_join_sends_rows_only_where_they_may_be_needed(spark):
    """Gathered vectors of about the same norm: most rows are spared, and nothing is lost."""
    rows = gathered(1500)
    df = frame(spark, rows)
    found = integer_vectors.whole(df.drop("label"))
    space = voronoi_join.spaced(found, 24, 1000, 3)
    cells, plan = voronoi_join.celled(found, space, F.col("id") % 50 == 0, 5, 3, 8192)
    sent = voronoi_join.dealt(found, space, plan, cells)[0].count()
    assert len(plan.parts) >= 8 and sent < 0.5 * 1500 * sum(plan.parts)
    assert searched(spark, rows, pivots=24, group_queries=3) == nearest(rows, 50, 5)


def test_bounds_hold_every_score_and_spare_most(spark):
    rng = np.random.default_rng(6)
    rows = [(i, i % 5, v.tolist()) for i, v in enumerate(rng.normal(size=(2000, 16)) / 4)]
    found = integer_vectors.whole(frame(spark, rows))
    cells = hard_negatives.cut(found, 64, 500)  # the sample doesn't hold the extremes
    held = found.rows.orderBy("id").collect()
    y = np.array([r.vector for r in held], float)
    codes, x = cells.encoded(y), y[:20]
    low, high = hard_negatives.bounds(cells, x, codes)
    assert (low <= x @ y.T).all() and (x @ y.T <= high).all()
    scored = []
    real = integer_vectors.pair_products
    ids, labels = np.array([r.id for r in held]), np.array([r.label for r in held])
    best = np.sort(x @ y.T, axis=1)[:, -2].astype(np.int64)
    windows = np.array([[hard_negatives.window(int(s))] for s in best])
    try:
        hard_negatives.pair_products = lambda a, b: scored.append(len(a)) or real(a, b)
        found = [t for part in hard_negatives.negatives(cells, x, labels[:20], windows, y, codes, ids, labels, 10) for t in zip(*part, strict=True)]
    finally:
        hard_negatives.pair_products = real
    assert len(found) == 200 and sum(scored) < 0.1 * 20 * 2000


def test_queries_are_the_contracts(spark, odd):
    from millrace.llm import queries

    rows = [(r.vec_id, ((r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) if r.vec_id is not None else r.label, r.embedding) for r in spark.read.parquet(f"{odd}/embeddings.parquet").collect()]
    assert sorted(tuple(r) for r in queries.queries()["op12_voronoi_join"](spark, odd).collect()) == nearest(rows, 50, 5)
    assert sorted(tuple(r) for r in queries.queries()["op11_hard_negatives"](spark, odd).collect()) == hard(rows, 100)
