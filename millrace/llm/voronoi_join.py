"""Exact top-k search by inner product: a Voronoi join of queries and data around shared pivots.

Largest inner products are smallest Euclidean distances once a data vector s gets one more component,
sqrt(M^2 - |s|^2) with M the largest norm, and a query, drawn out to the norm M, a zero: the squared distance of q and s
is 2 M^2 - 2 M/|q| q.s. In that space rows and queries fall into the cells of ``pivots`` centres found on a bounded sample. Summaries of the cells (how
many, nearest, farthest, the k + 1 smallest distances to the pivot; for queries how many and the farthest) bound how
far the k-th neighbour of any query of a cell can be. A row goes to a group of query cells only if the rings around the
pivots and the planes between them leave it a chance to be that near; what goes there is solved exactly.

Cells with few queries share a group with their neighbours, those with many are cut into parts, and a group's rows into
blocks, so no task holds more than about ``group_queries`` queries and ``block_rows`` rows, however many rows one cell
or one vector has. Bounds only ever spare work, most where vectors gather and have about the same norm: for directions
without structure every row goes to every group, and the search is N rows for each group of queries.

Defined cases, besides those of ``integer_vectors``: fewer than k candidates are all returned; ties go to the smaller id;
an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from millrace.llm.common import table, written
from millrace.llm.integer_vectors import Whole, matrix, products, sample, whole

SCHEMA = "query_id long, rank int, vec_id long, score long"
SLACK = 1e-6  # of bounds computed in doubles, in units of the largest component
FAR = 1e9  # beyond any distance, in the same units
TILE = 256  # queries scored together


def best(scores: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the m largest of each row, of equals those in the first columns."""
    m = min(m, scores.shape[1])
    last = np.partition(scores, scores.shape[1] - m, axis=1)[:, scores.shape[1] - m][:, None]
    above, tie = scores > last, scores == last
    tie &= np.cumsum(tie, axis=1) <= m - above.sum(1)[:, None]
    return np.nonzero(above | tie)


@dataclass
class Space:
    """Pivots in the space with one component more, and what its coordinates are measured in."""

    pivots: np.ndarray
    top: float
    reach: float  # the largest squared norm

    def points(self, x: np.ndarray) -> np.ndarray:
        y = x / self.top
        return np.hstack([y, np.sqrt(np.maximum(0, self.reach - (y * y).sum(1)))[:, None]])

    def queries(self, x: np.ndarray) -> np.ndarray:
        y = x / self.top
        long = np.sqrt((y * y).sum(1))[:, None]
        return np.hstack([np.divide(y * self.reach**0.5, long, out=np.zeros_like(y), where=long > 0), np.zeros((len(x), 1))])

    def distances(self, points: np.ndarray) -> np.ndarray:
        return distances(points, self.pivots)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T))


def centres(points: np.ndarray, count: int, rng: np.random.Generator, rounds: int = 5) -> np.ndarray:
    """At most ``count`` different centres of the sample."""
    found = np.unique(points[rng.permutation(len(points))[:count]], axis=0)
    for _ in range(rounds):
        near = distances(points, found).argmin(1)
        sums, n = np.zeros_like(found), np.bincount(near, minlength=len(found))
        np.add.at(sums, near, points)
        found = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], found)
    return np.unique(found, axis=0)


@dataclass
class Plan:
    """Query cells in the order of their groups, with bounds on the rows each needs."""

    cells: np.ndarray
    first: np.ndarray  # where each group's cells begin
    group: dict[int, int]  # of a query cell
    parts: list[int]  # of each group's queries
    blocks: list[int]  # of each group's rows
    low: np.ndarray  # query cells x cells: rows nearer to their pivot aren't needed
    high: np.ndarray
    theta: np.ndarray


def planned(space: Space, data: dict[int, tuple], near: dict[int, list[float]], asked: dict[int, tuple], k: int, group_queries: int, block_rows: int) -> Plan:
    """``data``: cell -> (rows, nearest, farthest); ``near``: cell -> its k + 1 smallest distances; ``asked``: cell -> (queries, farthest)."""
    apart = distances(space.pivots, space.pivots)
    theta, low, high = {}, {}, {}
    for i, (_, far) in asked.items():
        # One more than k rows are within this distance of any query of the cell, and one of them may be its own.
        reach = np.sort(np.concatenate([apart[i, j] + far + np.array(d) for j, d in near.items()]))
        theta[i] = (reach[k] if len(reach) > k else FAR) + SLACK
        low[i], high[i] = apart[i] - far - theta[i] - SLACK, apart[i] + far + theta[i] + SLACK
    left, groups = set(asked), []
    while left:
        i = max(left, key=lambda c: (asked[c][0], -c))
        chosen, n = [i], asked[i][0]
        for j in sorted(left - {i}, key=lambda c: (apart[i, c], c)):
            if n + asked[j][0] > group_queries:
                break
            chosen.append(j)
            n += asked[j][0]
        left -= set(chosen)
        groups.append((chosen, n))
    cells = [c for g, _ in groups for c in g]
    rows = [sum(n for j, (n, a, b) in data.items() if any(low[i][j] <= b and high[i][j] >= a for i in g)) for g, _ in groups]
    return Plan(
        np.array(cells), np.cumsum([0, *(len(g) for g, _ in groups)])[:-1], {c: k for k, (g, _) in enumerate(groups) for c in g}, [-(-n // group_queries) for _, n in groups],
        [max(1, -(-n // block_rows)) for n in rows], np.array([low[c] for c in cells]), np.array([high[c] for c in cells]), np.array([theta[c] for c in cells]),
    )


def needed(space: Space, plan: Plan, points: np.ndarray) -> np.ndarray:
    """Rows x groups: whether a row may be among the k nearest of a query of the group."""
    d = space.distances(points)
    cell = d.argmin(1)
    far = d[np.arange(len(d)), cell]
    ring = (far[:, None] >= plan.low[:, cell].T) & (far[:, None] <= plan.high[:, cell].T)
    apart = distances(space.pivots, space.pivots)[plan.cells][:, cell].T
    plane = (d[:, plan.cells] ** 2 - far[:, None] ** 2) <= 2 * apart * plan.theta + SLACK
    return np.logical_or.reduceat(ring & plane, plan.first, axis=1)


def joined(vectors: DataFrame, is_query: Column, k: int = 5, pivots: int = 128, sample_rows: int = 4096, group_queries: int = 2048, block_rows: int = 8192, seed: int = 3) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of each row of (id, vector) that is a query."""
    spark, found = vectors.sparkSession, whole(vectors)
    if found is None:
        return spark.createDataFrame([], SCHEMA)
    space = spaced(found, pivots, sample_rows, seed)
    cells, plan = celled(found, space, is_query, k, group_queries, block_rows)
    if plan is None:
        return spark.createDataFrame([], SCHEMA)
    rows, asked = dealt(found, space, plan, cells)
    dims = found.dims

    def solve(queries: pa.Table, held: pa.Table) -> pa.Table:
        """The k best of a block of rows for each query of a part."""
        out: list[tuple] = []
        if queries.num_rows and held.num_rows:
            held = held.sort_by("id")
            x, y, ids, own = matrix(queries["vector"], dims), matrix(held["vector"], dims), held["id"].to_numpy(), queries["id"].to_numpy()
            for at in range(0, len(x), TILE):
                scores = products(x[at : at + TILE], y)
                q, c = best(scores, k + 1)
                other = ids[c] != own[at + q]
                q, c = q[other], c[other]
                s = scores[q, c].astype(np.int64)
                order = np.lexsort((ids[c], -s.astype(float), q)) if scores.dtype == float else np.array(sorted(range(len(q)), key=lambda i: (q[i], -int(s[i]), ids[c[i]])), int)
                nth = np.arange(len(order)) - np.searchsorted(q[order], q[order])
                keep = order[nth < k]
                out.append((own[at + q[keep]], ids[c[keep]], s[keep]))
        three = [np.concatenate(z) for z in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 3
        return pa.table(dict(zip(("query_id", "vec_id", "score"), three, strict=True)))

    where = ["group", "part", "block"]
    local = asked.groupBy(*where).cogroup(rows.groupBy(*where)).applyInArrow(solve, "query_id long, vec_id long, score long")
    ranked = local.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def spaced(found: Whole, pivots: int, sample_rows: int, seed: int) -> Space:
    """The space around pivots of a bounded sample."""
    top = found.top or 1.0
    square = F.aggregate(F.col("vector").cast("array<double>"), F.lit(0.0), lambda a, c: a + c / top * c / top)
    reach = found.rows.agg(F.max(square)).first()[0]
    space = Space(np.empty((0, found.dims + 1)), top, reach)
    space.pivots = centres(space.points(sample(found.rows, found.n, sample_rows, found.dims)), pivots, np.random.default_rng(seed))
    return space


def celled(found: Whole, space: Space, is_query: Column, k: int, group_queries: int, block_rows: int) -> tuple[DataFrame, Plan | None]:
    """Rows with their cell and, for queries, the cell as a query; and what goes where."""
    dims, shared = found.dims, found.rows.sparkSession.sparkContext.broadcast(space)

    def place(batches):
        for batch in batches:
            x = matrix(batch.column("vector"), dims)
            asks = batch.column("asks").to_numpy(zero_copy_only=False).astype(bool)
            d, q = shared.value.distances(shared.value.points(x)), shared.value.distances(shared.value.queries(x))
            put = [pa.array(d.argmin(1), pa.int32()), pa.array(d.min(1)), pa.array(q.argmin(1), pa.int32(), mask=~asks), pa.array(q.min(1), mask=~asks)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vector"), *put], ["id", "vector", "cell", "far", "asked_cell", "asked_far"])

    asking = found.rows.select("id", "vector", F.coalesce(is_query, F.lit(False)).alias("asks"))
    cells = written(asking.mapInArrow(place, f"id long, vector array<{found.kind}>, cell int, far double, asked_cell int, asked_far double"), "cells")
    # Summaries: a few numbers for each of a bounded number of cells.
    data = {r.cell: (r.n, r.a, r.b) for r in cells.groupBy("cell").agg(F.count("*").alias("n"), F.min("far").alias("a"), F.max("far").alias("b")).collect()}
    asked = {r.asked_cell: (r.n, r.b) for r in cells.where("asked_cell is not null").groupBy("asked_cell").agg(F.count("*").alias("n"), F.max("asked_far").alias("b")).collect()}
    near: dict[int, list[float]] = {}
    for r in cells.select("cell", "far", F.row_number().over(Window.partitionBy("cell").orderBy("far")).alias("nth")).where(F.col("nth") <= k + 1).collect():
        near.setdefault(r.cell, []).append(r.far)
    return cells, planned(space, data, near, asked, k, group_queries, block_rows) if asked else None


def dealt(found: Whole, space: Space, plan: Plan, cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows and queries, each with (group, part, block): rows for every part that may need them, queries for every block."""
    dims, shared = found.dims, cells.sparkSession.sparkContext.broadcast((space, plan))
    parts, blocks, groups = np.array(plan.parts), np.array(plan.blocks), plan.group

    def copies(batch, row, *where):
        put = [*(pa.array(w, pa.int32()) for w in where), *(batch.column(c).take(pa.array(row)) for c in ("id", "vector"))]
        return pa.RecordBatch.from_arrays(put, ["group", "part", "block", "id", "vector"])

    def each(count):
        """0, 1, .. below each count."""
        return np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)

    def spread(batches):
        for batch in batches:
            space, plan = shared.value
            row, group = np.nonzero(needed(space, plan, space.points(matrix(batch.column("vector"), dims))))
            block = batch.column("spot").to_numpy()[row] % blocks[group]
            n = parts[group]
            yield copies(batch, np.repeat(row, n), np.repeat(group, n), each(n), np.repeat(block, n))

    def ask(batches):
        for batch in batches:
            group = np.array([groups[c] for c in batch.column("asked_cell").to_pylist()], int)
            part, n = batch.column("spot").to_numpy() % parts[group], blocks[group]
            yield copies(batch, np.repeat(np.arange(len(group)), n), np.repeat(group, n), np.repeat(part, n), each(n))

    spot = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 30)).alias("spot")
    schema = f"group int, part int, block int, id long, vector array<{found.kind}>"
    asked = cells.where("asked_cell is not null").select("id", "vector", "asked_cell", spot).mapInArrow(ask, schema)
    return cells.select("id", "vector", spot).mapInArrow(spread, schema), asked


def query(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return joined(vectors, F.col("id") % 50 == 0)


#: Every query against every row.
SQL = """
WITH usual AS (SELECT len(embedding) AS n FROM embeddings WHERE len(embedding) > 0 GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
whole AS (
  SELECT vec_id, min(list_transform(embedding, lambda c: floor(256 * c::DOUBLE))) AS v FROM embeddings, usual
  WHERE vec_id IS NOT NULL AND len(embedding) = usual.n AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 GROUP BY 1
), ranked AS (
  SELECT q.vec_id AS query_id, d.vec_id, list_inner_product(q.v, d.v)::BIGINT AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.v, d.v) DESC, d.vec_id) AS rank
  FROM whole q JOIN whole d ON q.vec_id % 50 = 0 AND d.vec_id <> q.vec_id
) SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""
