"""Whitening of embeddings by the singular values of the centred rows, computed on distributed rows by Spark's MLlib.

Entries become whole numbers, floor(64 c) + 1,000,000. Means and total variance are taken from exact sums of these, so
neither depends on how rows are spread. The distinct rows, each less the mean, are the rows of a ``RowMatrix``; its right
singular vectors are the components, and a singular value s gives the variance s^2 / n. All components are asked for,
so that MLlib decomposes the Gramian in double precision instead of iterating to a tolerance; what it holds on the driver
has dimensions x dimensions entries. Whitened values and exact deviations are computed in the tasks.

Defined cases: vectors that are null, empty, of another length than most, or hold a null or non-finite entry or one whose
whole number would leave the range of longs take no part; rows with a null or repeated vec_id are all kept; components
whose variance is under 1e-11 of the largest (as where rows lie in fewer dimensions) have no direction of their own and
are left out, so identical rows give no result; ``deviation`` is null where it doesn't fit a long and
``deviation_exact`` holds it always; an empty table gives an empty result.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, functions as F

from millrace.llm.common import table, written
from millrace.llm.integer_vectors import finite, floored, usual_length

SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)"
SHIFT, FACTOR = 1_000_000, 64
LEAST = 1e-11  # of the largest variance, below which a component isn't told from rounding


def whole(vectors: DataFrame) -> tuple[DataFrame, int]:
    """(id, x) with entries as longs, of the rows of (id, vector) that take part, and their length."""
    dims = usual_length(vectors)
    usable = vectors.where(finite(F.col("vector"), dims, FACTOR) & F.coalesce(F.forall("vector", lambda c: F.abs(c.cast("double") * FACTOR) < 2.0**62), F.lit(False)))
    return usable.select("id", F.transform("vector", lambda c: floored(c, FACTOR).cast("long") + F.lit(SHIFT).cast("long")).alias("x")), dims


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Sum of (n x - S)^2 over the dimensions of each row, exact."""
    near = np.array([s // n for s in sums], dtype=object)
    rest = np.array([s % n for s in sums], dtype=object)
    top = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) + max(map(abs, near.tolist()), default=0)
    if (n * (top + 1)) ** 2 * len(sums) < 2**63:
        d = n * (x - near.astype(np.int64)) - rest.astype(np.int64)
        return (d * d).sum(1).tolist()
    small = x - near if top >= 2**62 else x - near.astype(np.int64)
    most = int(np.abs(small).max(initial=0)) + 1
    if (n * most) ** 2 * len(sums) < 2**63:
        d = n * small.astype(np.int64) - rest.astype(np.int64)
        return (d * d).sum(1).tolist()
    return [sum((n * int(v) - int(r)) ** 2 for v, r in zip(row, rest, strict=True)) for row in small]


def whitened(vectors: DataFrame, most: int = 16) -> DataFrame:
    """``SCHEMA``: each row of (id, vector) on the first ``most`` components."""
    spark = vectors.sparkSession
    rows, dims = whole(vectors)
    if not dims:
        return spark.createDataFrame([], SCHEMA)
    fit = written(rows.select("x").distinct(), "fit")
    totals = fit.agg(F.count("*"), F.array(*(F.sum(F.col("x")[d].cast("decimal(38,0)")) for d in range(dims)))).first()
    n, sums = totals[0], [int(s) for s in totals[1]] if totals[0] else []
    if n < 2:
        return spark.createDataFrame([], SCHEMA)
    # Entries less the whole part of the mean are exact, so rounding is that of the result.
    near, rest = [s // n for s in sums], [s % n / n for s in sums]
    centred = F.transform("x", lambda v, i: (v - F.array(*(F.lit(c).cast("long") for c in near))[i]).cast("double") - F.array(*map(F.lit, rest))[i])
    points = MLUtils.convertVectorColumnsFromML(fit.select(array_to_vector(centred).alias("point")), "point")
    svd = RowMatrix(points).computeSVD(dims, computeU=False)
    variances, axes = svd.s.toArray() ** 2 / n, svd.V.toArray()
    kept = [c for c in np.argsort(-variances, kind="stable")[:most] if variances[c] > LEAST * variances.max()]
    variances, axes = variances[kept], axes[:, kept]
    trace = fit.mapInArrow(deviating(n, sums), "deviation decimal(38,0)").agg(F.sum("deviation")).first()[0]
    explained = [float(Fraction(float(e)) * n**3 / int(trace)) for e in variances] if trace else []
    if not explained:
        return spark.createDataFrame([], SCHEMA)
    shared = spark.sparkContext.broadcast((np.array(near), np.array(rest), axes / np.sqrt(variances)))

    def projected(x: np.ndarray) -> np.ndarray:
        a, b, to = shared.value
        return ((x - a).astype(float) - b) @ to

    k = len(kept)

    def project(batches):
        for batch in batches:
            values = projected(entries(batch.column("x"), dims))
            yield pa.RecordBatch.from_arrays([pa.array(values[:, c]) for c in range(k)], [f"w{c}" for c in range(k)])

    checked = fit.mapInArrow(project, ", ".join(f"w{c} double" for c in range(k)))
    covariance = checked.agg(*(F.covar_pop(f"w{a}", f"w{b}") for a in range(k) for b in range(a, k))).first()
    wanted = [float(a == b) for a in range(k) for b in range(a, k)]
    error = max(abs(c - w) for c, w in zip(covariance, wanted, strict=True))

    def finish(batches):
        exact = deviating(n, sums)
        for batch in batches:
            values = projected(entries(batch.column("x"), dims))
            size, deviation = len(values), next(exact([batch])).column(0)
            at = np.repeat(np.arange(size), k)
            ids = batch.column("id").take(pa.array(at))
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.tile(np.arange(1, k + 1), size), pa.int32()), deviation.take(pa.array(at)), pa.array(values.ravel())], ["vec_id", "component", "deviation_exact", "whitened"])

    found = rows.mapInArrow(finish, "vec_id long, component int, deviation_exact decimal(38,0), whitened double")
    share = F.array(*map(F.lit, explained))[F.col("component") - 1]
    short = F.col("deviation_exact").try_cast("long")
    return found.select("vec_id", "component", F.lit(n).cast("long").alias("n"), short.alias("deviation"), "whitened", share.alias("explained"), F.lit(float(error)).alias("identity_error"), "deviation_exact")


def entries(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def deviating(n: int, sums: list[int]):
    """A function from batches with a column x to batches of exact deviations; what 38 digits can't hold is null."""

    def run(batches):
        for batch in batches:
            found = deviations(entries(batch.column("x"), len(sums)), n, sums)
            short = pa.array([d if d < 10**18 else 0 for d in found], pa.int64()).cast(pa.decimal128(38, 0))
            if any(d >= 10**18 for d in found):
                from decimal import Decimal

                short = pa.array([Decimal(d) if d < 10**38 else None for d in found], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([short], ["deviation"])

    return run


def query(spark, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")))
