"""Approximate nearest neighbours: a forest of random-projection trees under one priority queue.

Trees are grown on a bounded sample (``sample_rows``), each node splitting its points at the median of a random
direction; every row of the table is then routed to its leaf in each tree. A leaf that gets more than ``leaf_rows`` rows
is grown on, from a sample of its own, in distributed rounds, so leaves don't grow with the table. A query walks all
trees with one shared priority queue: nodes wait under the largest margin on the way to them, and leaves are taken best
first until they hold ``candidates`` rows, or ``share`` of the table if that is more. The rows of the chosen leaves are
reranked by exact Euclidean distance in double precision.

So the distances computed for a query are bounded by ``candidates`` and a leaf, whatever the size of the table. How
many it takes for a good recall depends on the vectors: those that gather need few, while for directions without any
structure no tree knows where the nearest are, and only a ``share`` of the table holds the recall.

Equal vectors are folded first; a vector keeps the smallest ids that could be among k neighbours. Leaves that no
direction can split are cut into blocks of rows, and the queries that reach a leaf into blocks too, so no task holds
more than a leaf's rows and ``QUERIES`` queries.

Defined cases: vectors that are null, zero, of another length than most, or hold null or non-finite components
take no part; fewer than k candidates are all returned; ties go to the smaller id; rows that repeat a vec_id count
once, with the least of their vectors; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import pickle
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from millrace.llm.common import table, written

QUERIES = 2000  # that meet a leaf's rows in one task
ROUTED = 20_000  # rows routed together


@dataclass
class Tree:
    directions: np.ndarray  # inner nodes x dimensions
    cuts: np.ndarray
    below: np.ndarray  # inner nodes x 2: an inner node's number, or -1 - leaf
    sizes: np.ndarray  # sample rows in each leaf


def grow(sample: np.ndarray, leaf_rows: int, rng: np.random.Generator) -> Tree:
    directions, cuts, below, sizes = [], [], [], []

    def node(rows: np.ndarray) -> int:
        if len(rows) > leaf_rows:
            a, b = sample[rng.choice(rows, 2, replace=False)]
            d = a - b if (a != b).any() else rng.standard_normal(sample.shape[1])
            d = d / np.sqrt(d @ d)
            at = sample[rows] @ d
            cut = float(np.median(at))
            right = at > cut
            if 0 < right.sum() < len(rows):
                k = len(cuts)
                directions.append(d), cuts.append(cut), below.append([0, 0])
                below[k] = [node(rows[~right]), node(rows[right])]
                return k
        sizes.append(len(rows))
        return -len(sizes)

    root = node(np.arange(len(sample)))
    if root < 0:  # one leaf: a node that sends everything there
        directions, cuts, below = [np.zeros(sample.shape[1])], [0.0], [[-1, -1]]
    return Tree(np.array(directions), np.array(cuts), np.array(below), np.array(sizes))


def leaves(tree: Tree, x: np.ndarray) -> np.ndarray:
    """The leaf of each row."""
    at, out = np.zeros(len(x), int), np.full(len(x), -1)
    todo = np.arange(len(x))
    while len(todo):
        side = (np.einsum("ij,ij->i", x[todo], tree.directions[at[todo]]) > tree.cuts[at[todo]]).astype(int)
        nxt = tree.below[at[todo], side]
        out[todo[nxt < 0]] = -1 - nxt[nxt < 0]
        at[todo] = nxt
        todo = todo[nxt >= 0]
    return out


def searched(forest: list[Tree], q: np.ndarray, reach: float, most: float = np.inf) -> list[tuple[int, int, float]]:
    """(tree, leaf, margin) in the order in which the shared queue gives them, until they hold ``reach`` sample rows.

    A leaf counts for ``most`` sample rows at most: one that is grown on won't be taken whole.
    """
    margins = [t.directions @ q - t.cuts for t in forest]
    queue = [(0.0, t, 0) for t in range(len(forest))]
    out, got = [], 0.0
    while queue and got < reach:
        far, t, node = heapq.heappop(queue)
        if node < 0:
            out.append((t, -1 - node, far))
            got += min(most, forest[t].sizes[-1 - node])
            continue
        m = margins[t][node]
        near, other = (1, 0) if m > 0 else (0, 1)
        heapq.heappush(queue, (far, t, int(forest[t].below[node, near])))
        heapq.heappush(queue, (max(far, abs(m)), t, int(forest[t].below[node, other])))
    return out


def grown_on(places: DataFrame, points: DataFrame, leaf_rows: int, sample_rows: int, split: int, seed: int) -> tuple[DataFrame, list[DataFrame]]:
    """Places (tree, leaf, point) with leaves of at most ``leaf_rows`` rows where they can be split, and the subtrees of each round.

    Subtrees are rows (tree, leaf, n, subtree). A leaf's rows are routed some at a time, each time with its subtree.
    """
    rounds: list[DataFrame] = []
    while True:
        sizes = places.groupBy("tree", "leaf").agg(F.count("*").alias("n"))
        big = written(sizes.where(F.col("n") > leaf_rows), "big-leaves")
        if big.isEmpty():
            return places, rounds
        members = places.join(big, ["tree", "leaf"]).join(points.select("point", "vector"), "point")
        draw = F.pmod(F.xxhash64("point", "tree", F.lit(seed + len(rounds))), F.lit(1_000_000)) * F.col("n") < F.lit(sample_rows * 1_000_000)

        def grow_leaf(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            t = grow(np.stack(pdf.sort_values("point")["vector"].to_numpy()), split, np.random.default_rng([seed, key[0], len(pdf)]))
            found = [(key[0], key[1], pdf["n"].iloc[0], pickle.dumps(t))] if len(t.sizes) > 1 else []
            return pd.DataFrame(found, columns=["tree", "leaf", "n", "subtree"])

        subtrees = written(members.where(draw).groupBy("tree", "leaf").applyInPandas(grow_leaf, "tree int, leaf string, n long, subtree binary"), "subtrees")
        if subtrees.isEmpty():
            return places, rounds

        def route(held: pd.DataFrame, tree: pd.DataFrame) -> pd.DataFrame:
            if not len(held) or not len(tree):
                return pd.DataFrame({"tree": [], "leaf": [], "point": []})
            below = leaves(pickle.loads(tree["subtree"].iloc[0]), np.stack(held["vector"].to_numpy()))
            return pd.DataFrame({"tree": held["tree"], "leaf": held["leaf"] + "/" + below.astype(str).astype(object), "point": held["point"]})

        parts = F.ceil(F.col("n") / ROUTED).cast("int")
        each = subtrees.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
        split_rows = members.join(subtrees.select("tree", "leaf"), ["tree", "leaf"], "left_semi").withColumn("part", F.pmod("point", parts).cast("int"))
        key = ["tree", "leaf", "part"]
        moved = split_rows.groupBy(*key).cogroup(each.groupBy(*key)).applyInPandas(route, "tree int, leaf string, point long")
        places = written(places.join(subtrees.select("tree", "leaf"), ["tree", "leaf"], "left_anti").unionByName(moved), "places")
        rounds.append(subtrees)


def walked_on(asked: DataFrame, rounds: list[DataFrame], most: float, leaf_rows: int) -> DataFrame:
    """The leaves asked for, (query_id, vector, tree, leaf, margin), with those that were grown on replaced by leaves below."""

    def down(queries: pd.DataFrame, tree: pd.DataFrame) -> pd.DataFrame:
        if not len(tree):
            return queries[["query_id", "vector", "tree", "leaf", "margin", "n"]]
        below, whole = pickle.loads(tree["subtree"].iloc[0]), tree["n"].iloc[0] if len(tree) else 0
        share = whole / max(1, below.sizes.sum())
        out = []
        for q, v, t, leaf, margin in zip(*(queries[c] for c in ("query_id", "vector", "tree", "leaf", "margin")), strict=True):
            out += [(q, v, t, f"{leaf}/{k}", max(margin, far), below.sizes[k] * share) for _, k, far in searched([below], np.asarray(v), most / share, leaf_rows / share)]
        return pd.DataFrame(out, columns=["query_id", "vector", "tree", "leaf", "margin", "n"])

    for subtrees in rounds:
        key = ["tree", "leaf", "part"]
        queries = asked.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(16)).cast("int"))
        each = subtrees.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(15))))
        found = queries.groupBy(*key).cogroup(each.groupBy(*key)).applyInPandas(down, "query_id long, vector array<double>, tree int, leaf string, margin double, n double")
        before = F.sum(F.least("n", F.lit(float(leaf_rows)))).over(Window.partitionBy("query_id").orderBy("margin", "tree", "leaf").rowsBetween(Window.unboundedPreceding, -1))
        asked = written(found.withColumn("before", F.coalesce(before, F.lit(0.0))).where(F.col("before") < most).drop("before"), "asked")
    return asked


def usable(vector: Column, dimensions: int) -> Column:
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == dimensions) & whole & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 10, trees: int = 6, leaf_rows: int = 2048, sample_rows: int = 20000, split: int = 40, candidates: int = 20000, share: float = 0.0, seed: int = 11
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row of ``vectors`` (id, vector) that is a query.

    ``split`` is the number of sample rows from which a node is split. A query's leaves hold ``candidates`` rows, or
    ``share`` times the table's distinct vectors, counted in each tree in which they are met.
    """
    spark = vectors.sparkSession
    common = vectors.where(F.col("vector").isNotNull()).groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if common is None or not common["n"]:
        return spark.createDataFrame([], schema)
    dims = common["n"]
    rows = vectors.where(F.col("id").isNotNull() & usable(F.col("vector"), dims)).select("id", F.col("vector").cast("array<double>").alias("vector")).groupBy("id").agg(F.min("vector").alias("vector"))
    rows = written(rows, "vectors")
    # Squares of very large or very small components leave the range of doubles: such tables are measured in a power of two.
    top = rows.agg(F.max(F.array_max(F.transform("vector", F.abs)))).first()[0] or 1.0
    power = int(np.clip(np.frexp(top)[1], -1000, 1000)) if not 2.0**-300 < top < 2.0**300 else 0
    if power:
        rows = rows.withColumn("vector", F.transform("vector", lambda c: c * F.lit(2.0**-power)))
    # Of equal vectors only the k + 1 smallest ids can be among k neighbours.
    few = rows.withColumn("n", F.row_number().over(Window.partitionBy("vector").orderBy("id"))).where(F.col("n") <= k + 1)
    points = written(few.groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("point"), "ids", "vector"), "points")
    n = points.count()
    picked = points.select("vector", F.xxhash64("point").alias("h")).where(F.pmod("h", F.lit(1_000_000)) < int(1_000_000 * min(1.0, 1.1 * sample_rows / max(1, n))) + 1)
    sample = np.array([r["vector"] for r in picked.orderBy("h").limit(sample_rows).collect()])
    if not len(sample):
        return spark.createDataFrame([], schema)
    rng = np.random.default_rng(seed)
    forest = [grow(sample, split, rng) for _ in range(trees)]
    shared = spark.sparkContext.broadcast(forest)
    most, scale = float(max(candidates, share * n)), n / len(sample)

    def index(batches):
        for pdf in batches:
            x = np.stack(pdf["vector"].to_numpy()) if len(pdf) else np.empty((0, dims))
            for t, tree in enumerate(shared.value):
                yield pd.DataFrame({"tree": t, "leaf": leaves(tree, x).astype(str), "point": pdf["point"]})

    def walk(batches):
        for pdf in batches:
            out = [(q, v, t, str(leaf), far, shared.value[t].sizes[leaf] * scale) for q, v in zip(pdf["id"], pdf["vector"], strict=True) for t, leaf, far in searched(shared.value, np.asarray(v), most / scale, leaf_rows / scale)]
            yield pd.DataFrame(out, columns=["query_id", "vector", "tree", "leaf", "margin", "n"])

    places, rounds = grown_on(written(points.mapInPandas(index, "tree int, leaf string, point long"), "places"), points, leaf_rows, sample_rows, split, seed)
    asked = written(rows.where(is_query).mapInPandas(walk, "query_id long, vector array<double>, tree int, leaf string, margin double, n double"), "asked")
    asked = walked_on(asked, rounds, most, leaf_rows).select("query_id", "vector", "tree", "leaf")
    sizes = places.groupBy("tree", "leaf").agg(F.ceil(F.count("*") / leaf_rows).cast("int").alias("blocks"))
    met = written(asked.groupBy("tree", "leaf").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("parts")).join(sizes, ["tree", "leaf"]), "met")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    held = places.join(met, ["tree", "leaf"]).join(points, "point").withColumn("block", F.pmod("point", "blocks").cast("int")).withColumn("part", each("parts"))
    asked = asked.join(met, ["tree", "leaf"]).withColumn("part", F.pmod(F.xxhash64("query_id"), "parts").cast("int")).withColumn("block", each("blocks"))

    def rerank(queries: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        """The k nearest ids of one block of rows for each of some queries that reach its leaf."""
        empty = pd.DataFrame({"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0)})
        if not len(queries) or not len(held):
            return empty
        x, y = (np.stack(p["vector"].to_numpy()) for p in (queries, held))
        asked, ids, copies = queries["query_id"].to_numpy(), np.concatenate(held["ids"].to_numpy()), held["ids"].map(len).to_numpy()
        rough = (y * y).sum(1) - 2 * x @ y.T  # squared distances but for the query's own part
        keep = min(k, len(y) - 1)  # the query itself may be one of them
        bound = np.partition(rough, keep, axis=1)[:, keep] + 1e-9 * (1 + np.abs(rough).max(1))
        q, near = np.nonzero(rough <= bound[:, None])
        gap = y[near] - x[q]
        d, n = np.sqrt((gap * gap).sum(1)), copies[near]
        of = np.repeat(np.arange(len(near)), n)
        vec = ids[np.repeat((np.cumsum(copies) - copies)[near] - (np.cumsum(n) - n), n) + np.arange(len(of))]
        q, d = q[of], d[of]
        other = np.flatnonzero(vec != asked[q])
        order = other[np.lexsort((vec[other], d[other], q[other]))]
        nth = np.arange(len(order)) - np.searchsorted(q[order], q[order])
        order = order[nth < k]
        return pd.DataFrame({"query_id": asked[q[order]], "vec_id": vec[order], "score": d[order]})

    where = ["tree", "leaf", "block", "part"]
    found = asked.groupBy(*where).cogroup(held.select(*where, "ids", "vector").groupBy(*where)).applyInPandas(rerank, "query_id long, vec_id long, score double")
    ranked = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", (F.col("score") * F.lit(2.0**power)).alias("score"))


def query(spark, sf_dir: str) -> DataFrame:
    """Its vectors have directions without structure, so the recall asked for takes a share of the table."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return nearest(vectors, F.col("id") % 100 == 0, share=0.8)
