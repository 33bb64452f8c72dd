"""Vectors as whole numbers, for searches whose scores are exact integer inner products.

A component c becomes floor(256 c). Vectors that are null, empty, of another length than most, or hold a component that
is null or not finite (also once it is multiplied) take no part, and neither do rows without id. Rows that repeat an id
count once, with the least of their (vector, label). Scores beyond a long's range count as its ends.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from millrace.llm.common import written

EXACT = 2.0**53  # whole doubles are exact up to here


@dataclass
class Whole:
    """rows (id, label?, vector of ``kind``); their number, the vectors' length, the largest component's size."""

    rows: DataFrame
    n: int
    dims: int
    top: float
    kind: str


def finite(vector: Column, dims: int, factor: float = 1.0) -> Column:
    each = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double") * factor) < float("inf")))
    return F.coalesce((F.size(vector) == dims) & each, F.lit(False))


def usual_length(vectors: DataFrame, column: str = "vector") -> int:
    """The length that most vectors have, the smaller of equals; 0 where none has any."""
    sizes = vectors.where(F.size(column) > 0).groupBy(F.size(column).alias("n")).count().orderBy(F.desc("count"), "n").first()
    return sizes["n"] if sizes else 0


def floored(c: Column, factor: float) -> Column:
    """floor(factor c) as a double: from 2^52 on doubles are whole."""
    v = c.cast("double") * F.lit(float(factor))
    return F.when(F.abs(v) < 2.0**52, F.floor(v).cast("double")).otherwise(v)


def whole(vectors: DataFrame, factor: float = 256.0) -> Whole | None:
    """The usable rows of (id, vector) or (id, label, vector), written once; None where there are none."""
    dims = usual_length(vectors)
    if not dims:
        return None
    more = [c for c in ("label",) if c in vectors.columns]
    usable = vectors.where(F.col("id").isNotNull() & finite(F.col("vector"), dims, factor))
    made = usable.select("id", F.transform("vector", lambda c: floored(c, factor)).alias("vector"), *more)
    once = made.groupBy("id").agg(F.min(F.struct("vector", *more)).alias("s")).select("id", *(f"s.{c}" for c in ("vector", *more)))
    rows = written(once, "whole")
    n, top = rows.agg(F.count("*"), F.max(F.array_max(F.transform("vector", F.abs)))).first()
    if not n:
        return None
    kind = "smallint" if top < 2**15 else "int" if top < 2**31 else "double"
    return Whole(rows.withColumn("vector", F.col("vector").cast(f"array<{kind}>")), n, dims, top, kind)


def matrix(column, dims: int) -> np.ndarray:
    """An Arrow column of equally long lists as a matrix of doubles."""
    parts = [c.flatten().to_numpy(zero_copy_only=False) for c in getattr(column, "chunks", [column])]
    return (np.concatenate(parts) if parts else np.empty(0)).astype(float).reshape(-1, dims)


def exact(dims: int, top: float) -> bool:
    """Whether sums of ``dims`` products of components up to ``top`` are exact in doubles, in any order."""
    return dims * top * top <= EXACT


def held(values) -> np.ndarray:
    return np.array([min(max(v, -(2**63)), 2**63 - 1) for v in values], np.int64)


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of all rows of ``x`` with all of ``y``, exact: whole doubles, or longs where doubles aren't enough."""
    top = max(np.abs(x).max(initial=0), np.abs(y).max(initial=0))
    if exact(x.shape[1], top):
        return x @ y.T
    a, b = ([[int(c) for c in row] for row in m] for m in (x, y))
    return np.array([held(sum(map(int.__mul__, p, q)) for q in b) for p in a], np.int64).reshape(len(x), len(y))


def pair_products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of each row of ``x`` with that of ``y`` at the same place, as exact longs."""
    top = max(np.abs(x).max(initial=0), np.abs(y).max(initial=0))
    if exact(x.shape[1], top):
        return np.einsum("ij,ij->i", x, y).astype(np.int64)
    return held(sum(int(a) * int(b) for a, b in zip(p, q, strict=True)) for p, q in zip(x, y, strict=True))


def sample(rows: DataFrame, n: int, most: int, dims: int) -> np.ndarray:
    """Vectors of at most ``most`` rows, drawn by a hash of the id: the same on every run."""
    h = F.xxhash64("id", F.lit(29))
    picked = rows.select("vector", h.alias("h")).where(F.pmod("h", F.lit(1_000_000)) < int(1_000_000 * min(1.0, 1.1 * most / n)) + 1)
    return np.array([r["vector"] for r in picked.orderBy("h").limit(most).collect()], float).reshape(-1, dims)
