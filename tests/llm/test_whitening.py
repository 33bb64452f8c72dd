"""Whitening against dense numpy and exact integers."""

import math

import numpy as np
import pytest

from millrace.llm import whitening


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, vector array<double>").repartition(4)


def plain(rows, dims):
    """(kept rows, n, S, eigenvalues, axes) with the covariance of the distinct whole vectors."""
    kept = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in rows if v and len(v) == dims and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[float(n * c - s) / n for c, s in zip(x, sums, strict=True)] for x in fit])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    return kept, n, sums, values[::-1], axes[:, ::-1]


def held(spark, rows, dims, most=16):
    got = whitening.whitened(frame(spark, rows), most).collect()
    kept, n, sums, values, axes = plain(rows, dims)
    k = min(most, int((values > 1e-11 * values[0]).sum()))
    assert len(got) == k * len(kept) and all(r.n == n and 0 <= r.identity_error < 1e-4 for r in got)
    trace = sum(values)
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.deviation_exact), {})[r.component] = r
    for i, x in kept:
        exact = sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True))
        mine = by[i, exact]
        assert sorted(mine) == list(range(1, k + 1))
        assert all(r.deviation == (exact if exact < 2**63 else None) for r in mine.values())
    signs = np.sign([sum(by[i, sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True))][c + 1].whitened * (np.array([(n * a - s) / n for a, s in zip(x, sums, strict=True)]) @ axes[:, c]) for i, x in kept) for c in range(k)])
    for i, x in kept:
        mine = by[i, sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True))]
        at = np.array([(n * a - s) / n for a, s in zip(x, sums, strict=True)])
        for c in range(k):
            assert mine[c + 1].whitened == pytest.approx(signs[c] * (at @ axes[:, c]) / math.sqrt(values[c]), abs=1e-8)
            assert mine[c + 1].explained == pytest.approx(values[c] / trace, rel=1e-9)
    return got


def test_whitening_equals_dense_numpy(spark):
    rng = np.random.default_rng(3)
    mix = rng.normal(size=(24, 24)) * np.linspace(3, 0.2, 24)
    rows = [(i, (rng.normal(size=24) @ mix).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[3][1]) for i in range(150)]  # copies count once in the fit
    rows += [(7, rows[8][1]), (None, rows[9][1])]
    rows += [(2000, None), (2001, [float("nan")] * 24), (2002, [None] * 24), (2003, [1.0] * 5), (2004, []), (2005, [float("inf")] + [0.0] * 23)]
    held(spark, rows, 24)


def test_whitened_covariance_is_the_identity(spark):
    rng = np.random.default_rng(8)
    rows = [(i, (rng.normal(size=20) * np.logspace(3, 0, 20)).tolist()) for i in range(600)]  # variances over six orders
    got = whitening.whitened(frame(spark, rows)).collect()
    w = np.zeros((600, 16))
    for r in got:
        w[r.vec_id, r.component - 1] = r.whitened
    error = np.abs(np.cov(w.T, bias=True) - np.eye(16)).max()
    assert error < 1e-8 and abs(error - got[0].identity_error) < 1e-9


def test_fewer_dimensions_than_columns(spark):
    """Rows on a plane have two components; the others have no variance."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(a), float(b), float(a + b), 0.5, float(a - b)]) for i, (a, b) in enumerate(rng.integers(-40, 40, (90, 2)))]
    assert {r.component for r in held(spark, rows, 5)} == {1, 2}


def test_far_from_zero_and_beyond_long_deviations(spark):
    """Means as large as 2^40 leave the result as it is; deviations beyond a long are kept as decimals."""
    rng = np.random.default_rng(6)
    held(spark, [(i, (2.0**34 + rng.normal(size=4)).tolist()) for i in range(100)], 4)
    held(spark, [(i, (1e9 * rng.normal(size=4)).tolist()) for i in range(50)], 4)


def test_exact_deviations_of_any_size():
    rng = np.random.default_rng(7)
    for top in (10, 10**6, 10**12, 2**62):
        x = rng.integers(-top, top, (20, 3))
        sums = [int(s) for s in rng.integers(-top, top, 3)]
        for n in (1, 20, 10**9):
            assert whitening.deviations(x, n, sums) == [sum((n * int(c) - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]


def test_degenerate_tables(spark):
    for rows in ([], [(1, [1.0, 2.0])], [(i, [1.0, 2.0]) for i in range(5)], [(1, None)]):
        assert whitening.whitened(frame(spark, rows) if rows else spark.createDataFrame([], "id long, vector array<double>")).count() == 0
    huge = whitening.whitened(frame(spark, [(1, [1e300, 0.0]), (2, [1.0, 2.0]), (3, [2.0, 5.0]), (4, [0.0, 0.0])])).collect()
    assert {r.vec_id for r in huge} == {2, 3, 4}
