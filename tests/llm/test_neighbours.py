"""The forest on vectors that gather: several levels of trees, bounded work, recall against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import neighbours


def gathered(n, dims=16, seed=5):
    """Groups of some twenty vectors around centres."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(max(1, n // 20), dims))
    return centres[rng.integers(0, len(centres), n)] + 0.15 * rng.normal(size=(n, dims))


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>").repartition(4)


def recall(got, x, step, k=10):
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append((r["rank"], r.score, r.vec_id))
    hit = 0
    for q, rows in found.items():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, len(rows) + 1)) and all(abs(s - np.sqrt(((x[q] - x[i]) ** 2).sum())) < 1e-12 and i != q for _, s, i in rows)
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hit += len({i for *_, i in rows} & set(np.argsort(d, kind="stable")[:k].tolist()))
    assert len(found) == -(-len(x) // step)
    return hit / (k * len(found))


def test_work_for_a_query_does_not_grow_with_the_table(spark, monkeypatch):
    """Leaves of 60 rows at most, so the trees grow on from leaf to leaf."""
    deep = []
    real = neighbours.grown_on
    monkeypatch.setattr(neighbours, "grown_on", lambda *a: deep.append(real(*a)) or deep[-1])
    figures = []
    for n in (800, 2400, 7200):
        x = gathered(n)
        step = n // 50
        got = neighbours.nearest(frame(spark, x), F.col("id") % step == 0, trees=4, leaf_rows=60, sample_rows=200, split=25, candidates=600).collect()
        places, rounds = deep.pop()
        sizes = places.groupBy("tree", "leaf").count().agg(F.max("count"), F.count("*")).first()
        assert sizes[0] <= 60 and len(rounds) >= 1
        figures.append((n, recall(got, x, step), len(rounds)))
    assert figures[-1][2] >= 2  # several levels of trees
    assert all(r >= 0.9 for _, r, _ in figures), figures


def test_distances_are_bounded_by_the_candidates(spark):
    """The leaves that are met hold the candidates and at most one leaf more for each level."""
    x = gathered(6000)
    rng = np.random.default_rng(3)
    forest = [neighbours.grow(x[rng.permutation(6000)[:2000]], 20, rng) for _ in range(4)]
    sizes = [np.bincount(neighbours.leaves(t, x), minlength=len(t.sizes)) for t in forest]
    for q in x[:40]:
        met = neighbours.searched(forest, q, 300)
        margins = [m for *_, m in met]
        assert margins == sorted(margins)  # best first over all trees
        assert sum(forest[t].sizes[leaf] for t, leaf, _ in met) < 300 + 20
        assert sum(sizes[t][leaf] for t, leaf, _ in met) < 3 * (300 + 20) * 1.5


def test_vectors_without_structure_take_a_share_of_the_table(spark):
    x = np.random.default_rng(1).normal(size=(3000, 24))
    got = neighbours.nearest(frame(spark, x), F.col("id") % 100 == 0, leaf_rows=200, candidates=100, share=0.8).collect()
    assert recall(got, x, 100) >= 0.9


@pytest.mark.parametrize("leaf_rows", [8, 2048])
def test_equal_vectors_and_leaves_that_can_not_be_split(spark, leaf_rows):
    """All points on a line, and one vector two hundred times: ties go to the smaller ids."""
    rows = [(i, [1.0, float(i % 7 + 1)]) for i in range(70)] + [(1000 + i, [5.0, 5.0]) for i in range(200)]
    got = neighbours.nearest(spark.createDataFrame(rows, "id long, vector array<double>"), F.col("id") % 100 == 0, leaf_rows=leaf_rows, sample_rows=50, split=4, candidates=10_000).collect()
    ids = {q: [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] for q in (0, 1000, 1100)}
    assert ids[1000] == list(range(1001, 1011)) and ids[1100] == list(range(1000, 1010))
    assert ids[0][:9] == list(range(7, 70, 7)) and ids[0][9] == 1


@pytest.mark.parametrize("size", [1e-250, 1e200, 1e300])
def test_components_whose_squares_leave_the_range_of_doubles(spark, size):
    x = np.random.default_rng(8).normal(size=(200, 8))
    rows = [(i, (v * size).tolist()) for i, v in enumerate(x)]
    got = neighbours.nearest(spark.createDataFrame(rows, "id long, vector array<double>"), F.col("id") % 100 == 0).collect()
    assert len(got) == 20
    for q in (0, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        mine = sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == q)
        assert [i for _, i, _ in mine] == np.argsort(d)[:10].tolist() and np.allclose([s / size for *_, s in mine], np.sort(d)[:10], rtol=1e-9)
