"""Hard negatives: a vector-approximation file whose bounds tell which rows may enter a window of scores.

Every dimension is cut into ``cells`` cells at quantiles of a bounded sample; a row's approximation is one byte for each
dimension. For an anchor, a table holds the least and the greatest product of its component with each cell, so adding up
a row's table entries gives bounds on its score. An anchor's positives are the best rows of its label, and each gives a
window of scores, 0.3 to 0.9 of its own, for rows of other labels. Rows whose bounds leave no place among the first of a
window (more than enough others surely lie in it and surely score higher), or that can't lie in any, aren't scored; the
rest are, exactly.

Anchors meet rows in blocks: of their own label for positives (labels of more rows than a block are cut into blocks, so
a label may hold any share of the rows), of all rows for negatives. A task holds ``part_anchors`` anchors and about
``block_rows`` rows, and hands on the first of each window only, so equal rows don't multiply. Each anchor meets each row
once: N rows for each part of anchors.

Defined cases, besides those of ``integer_vectors``: rows with a null label take no part; where the id is divisible by 7
the label is first raised by one, modulo ten; a positive of negative score has an empty window; ties go to the smaller
id; fewer positives or negatives than asked for are all returned; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from millrace.llm.common import table, written
from millrace.llm.integer_vectors import Whole, exact, matrix, pair_products, sample, whole

SCHEMA = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
TILE = 64  # anchors whose bounds are computed together
LOW, HIGH, BASE = 30, 90, 100  # a window: LOW * positive <= BASE * negative <= HIGH * positive


@dataclass
class Cells:
    """Bounds of the cells of each dimension, least and greatest whole number in each."""

    edges: list[np.ndarray]  # least number of each cell but the first
    low: np.ndarray  # dimensions x cells
    high: np.ndarray
    exact: bool  # whether sums are exact in single precision, or in double

    def encoded(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, d], "right") for d, e in enumerate(self.edges)], axis=1).astype(np.uint8)


def cut(found: Whole, cells: int, sample_rows: int) -> Cells:
    """Cells at quantiles of a sample, closed at the ends by the extremes of all rows."""
    x = sample(found.rows, found.n, sample_rows, found.dims)
    each = [F.col("vector")[d].cast("double") for d in range(found.dims)]
    ends = found.rows.agg(F.array(*map(F.min, each)).alias("a"), F.array(*map(F.max, each)).alias("b")).first()
    edges, low, high = [], np.empty((found.dims, cells)), np.empty((found.dims, cells))
    for d in range(found.dims):
        inner = np.unique(np.quantile(x[:, d], np.arange(1, cells) / cells, method="lower"))
        inner = inner[(inner > ends.a[d]) & (inner <= ends.b[d])]
        edges.append(inner)
        low[d], high[d] = ends.b[d], ends.b[d]
        low[d, : len(inner) + 1], high[d, : len(inner) + 1] = [ends.a[d], *inner], [*(inner - 1), ends.b[d]]
    return Cells(edges, low, high, found.dims * found.top * found.top < 2**24)


def bounds(cells: Cells, x: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest possible score of each row (codes) for each anchor in ``x``."""
    kind, n = np.float32 if cells.exact else np.float64, len(x)
    total = np.zeros((len(codes), 2 * n), kind)
    for d in range(x.shape[1]):
        a, b = x[:, d] * cells.low[d][:, None], x[:, d] * cells.high[d][:, None]
        total += np.hstack([np.minimum(a, b), np.maximum(a, b)]).astype(kind).take(codes[:, d], axis=0)
    size = np.abs(x) @ np.maximum(np.abs(cells.low), np.abs(cells.high)).max(1)
    blur = 0 if exact(x.shape[1], max(np.abs(x).max(initial=0), size.max(initial=0) ** 0.5)) else 1e-12 * size[:, None]
    return total[:, :n].T - blur, total[:, n:].T + blur


def nth_largest(values: np.ndarray, n: int) -> np.ndarray:
    """The n-th largest of each row, -inf where there are fewer."""
    return np.partition(values, -n, axis=1)[:, -n] if values.shape[1] >= n else np.full(len(values), -np.inf)


def first(q: np.ndarray, score: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Places of the first n of each q: higher scores first, then smaller ids."""
    order = np.lexsort((ids, ~score, q))  # ~ turns longs round without leaving their range
    q = q[order]
    return order[np.arange(len(q)) - np.searchsorted(q, q) < n]


def positives(cells: Cells, x: np.ndarray, own: np.ndarray, y: np.ndarray, codes: np.ndarray, ids: np.ndarray, n: int):
    """(anchor's place, row's place, score) of the n best rows other than the anchor itself."""
    for at in range(0, len(x), TILE):
        low, high = bounds(cells, x[at : at + TILE], codes)
        low = np.where(own[at : at + TILE, None] == ids, -np.inf, low)
        q, r = np.nonzero((high >= nth_largest(low, n)[:, None]) & (own[at : at + TILE, None] != ids))
        score = pair_products(x[at + q], y[r])
        keep = first(q, score, ids[r], n)
        yield at + q[keep], r[keep], score[keep]


def window(score: int) -> tuple[int, int]:
    """Least and greatest score of the negatives of a positive."""
    return -(-LOW * score // BASE), HIGH * score // BASE


def negatives(cells: Cells, x: np.ndarray, labels: np.ndarray, windows: np.ndarray, y: np.ndarray, codes: np.ndarray, ids: np.ndarray, of: np.ndarray, n: int):
    """(anchor's place, window, row's place, score) of the first n rows of other labels in each of an anchor's windows.

    ``windows``: anchors x windows x (least, greatest), as longs; an empty window has least > greatest.
    """
    for at in range(0, len(x), TILE):
        low, high = bounds(cells, x[at : at + TILE], codes)
        other, chosen = labels[at : at + TILE, None] != of, windows[at : at + TILE]
        may = np.zeros(low.shape, bool)
        for w in range(windows.shape[1]):
            a, b = (chosen[:, w, e].astype(float)[:, None] for e in (0, 1))
            sure = nth_largest(np.where(other & (low >= a) & (high <= b), low, -np.inf), n)[:, None]
            may |= other & (high >= np.maximum(a, sure)) & (low <= b) & (a <= b)
        q, r = np.nonzero(may)
        score = pair_products(x[at + q], y[r])
        for w in range(windows.shape[1]):
            inside = np.flatnonzero((score >= chosen[q, w, 0]) & (score <= chosen[q, w, 1]))
            keep = inside[first(q[inside], score[inside], ids[r[inside]], n)]
            yield at + q[keep], np.full(len(keep), w), r[keep], score[keep]


def mined(
    vectors: DataFrame, is_anchor: Column, n_positives: int = 5, n_negatives: int = 10, cells: int = 256, sample_rows: int = 8192, part_anchors: int = 2048, block_rows: int = 8192
) -> DataFrame:
    """The negatives of each anchor among the rows of (id, label, vector), as in ``SCHEMA``. ``cells`` is 256 at most."""
    spark, found = vectors.sparkSession, whole(vectors.where(F.col("label").isNotNull()))
    if found is None:
        return spark.createDataFrame([], SCHEMA)
    dims, shared = found.dims, spark.sparkContext.broadcast(cut(found, cells, sample_rows))

    def encode(batches):
        for batch in batches:
            codes = shared.value.encoded(matrix(batch.column("vector"), dims)).view(np.int8)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(codes) + 1, dtype=np.int32) * dims), pa.array(codes.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "code"])

    spot = lambda seed: F.xxhash64("id", F.lit(seed))
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    rows = found.rows.mapInArrow(encode, f"id long, vector array<{found.kind}>, label long, code array<tinyint>")
    rows = written(rows.withColumn("is_anchor", F.coalesce(is_anchor, F.lit(False))), "approximations")
    anchors = written(rows.where("is_anchor").select("id", "label", "vector"), "anchors")

    # Positives: of labels that have anchors. Only labels of more rows than a block are counted apart: at most n / block_rows.
    sizes = rows.groupBy("label").agg(F.count("*").alias("n"), F.count_if("is_anchor").alias("asked")).where(F.col("n") > block_rows)
    large = F.broadcast(written(sizes.select("label", F.ceil(F.col("n") / block_rows).cast("int").alias("blocks"), F.ceil(F.greatest("asked", F.lit(1)) / part_anchors).cast("int").alias("parts")), "large-labels"))
    sized = lambda df: df.join(large, "label", "left").fillna(1, ["blocks", "parts"])
    key = ["label", "part", "block"]
    held = sized(rows.select("id", "label", "vector", "code")).withColumn("block", F.pmod(spot(5), "blocks").cast("int")).withColumn("part", each(F.col("parts")))
    asked = sized(anchors).withColumn("part", F.pmod(spot(7), "parts").cast("int")).withColumn("block", each(F.col("blocks")))

    def alike(asked: pa.Table, held: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if asked.num_rows and held.num_rows:
            x, y, codes = matrix(asked["vector"], dims), matrix(held["vector"], dims), matrix(held["code"], dims).astype(np.int8).view(np.uint8)
            own, ids = asked["id"].to_numpy(), held["id"].to_numpy()
            out = [(own[q], ids[r], s) for q, r, s in positives(shared.value, x, own, y, codes, ids, n_positives)]
        return as_table(("anchor_id", "positive_id", "positive_score"), out)

    local = asked.select(*key, "id", "vector").groupBy(*key).cogroup(held.select(*key, "id", "vector", "code").groupBy(*key)).applyInArrow(alike, "anchor_id long, positive_id long, positive_score long")
    nth = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id"))
    pairs = local.withColumn("nth", nth).where(F.col("nth") <= n_positives)
    wanted = pairs.where("positive_score >= 0").groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("nth", "positive_id", "positive_score"))).alias("p"))
    wanted = written(anchors.join(wanted.withColumnRenamed("anchor_id", "id"), "id").select("id", "label", "vector", F.col("p.positive_id").alias("positive_ids"), F.col("p.positive_score").alias("scores")), "windows")

    # Negatives: all parts of anchors meet all blocks of rows.
    blocks, parts = max(1, -(-found.n // block_rows)), max(1, -(-wanted.count() // part_anchors))
    held = rows.select("id", "label", "vector", "code", F.pmod(spot(11), F.lit(blocks)).cast("int").alias("block")).withColumn("part", each(F.lit(parts)))
    asked = wanted.withColumn("part", F.pmod(spot(13), F.lit(parts)).cast("int")).withColumn("block", each(F.lit(blocks)))

    def unlike(asked: pa.Table, held: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if asked.num_rows and held.num_rows:
            x, y, codes = matrix(asked["vector"], dims), matrix(held["vector"], dims), matrix(held["code"], dims).astype(np.int8).view(np.uint8)
            own, ids, scores, positive = asked["id"].to_numpy(), held["id"].to_numpy(), asked["scores"].to_pylist(), asked["positive_ids"].to_pylist()
            windows = np.array([[*map(window, s), *[(1, 0)] * (n_positives - len(s))] for s in scores], np.int64)
            found = negatives(shared.value, x, asked["label"].to_numpy(), windows, y, codes, ids, held["label"].to_numpy(), n_negatives)
            whose = lambda lists, q, w: np.array([lists[i][j] for i, j in zip(q, w, strict=True)], np.int64)
            out = [(own[q], whose(positive, q, w), ids[r], whose(scores, q, w), s) for q, w, r, s in found]
        return as_table(("anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"), out)

    key = ["part", "block"]
    local = asked.groupBy(*key).cogroup(held.groupBy(*key)).applyInArrow(unlike, "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
    rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id"))
    ranked = local.withColumn("rank", rank).where(F.col("rank") <= n_negatives)
    return ranked.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def as_table(names: tuple[str, ...], parts: list[tuple]) -> pa.Table:
    columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.empty(0, np.int64)] * len(names)
    return pa.table(dict(zip(names, columns, strict=True)))


def query(spark, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    turned = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), turned.alias("label"), F.col("embedding").alias("vector"))
    return mined(vectors, F.col("id") % 100 == 0)


#: Every anchor against every row.
SQL = """
WITH usual AS (SELECT len(embedding) AS n FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0 GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
whole AS (
  SELECT vec_id, s.v, s.label FROM (
    SELECT vec_id, min(struct_pack(v := list_transform(embedding, lambda c: floor(256 * c::DOUBLE)), label := CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)) AS s FROM embeddings, usual
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) = usual.n AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 GROUP BY 1)
), scored AS (
  SELECT a.vec_id AS anchor_id, d.vec_id, a.label = d.label AS alike, list_inner_product(a.v, d.v)::BIGINT AS score FROM whole a JOIN whole d ON a.vec_id % 100 = 0 AND d.vec_id <> a.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), ranked AS (
  SELECT p.*, d.vec_id AS negative_id, d.score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY d.score DESC, d.vec_id) AS rank
  FROM positives p JOIN scored d USING (anchor_id) WHERE NOT d.alike AND 30 * positive_score <= 100 * d.score AND 100 * d.score <= 90 * positive_score
) SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 10
"""
