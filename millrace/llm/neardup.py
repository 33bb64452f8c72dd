"""Near duplicates by BagMinHash: weighted-Jaccard signatures of shingle multisets, banded and verified.

A text is the multiset of its five-word shingles. A shingle that occurs c times has weight c, and the weight axis is
cut into the unit interval and then [1,2), [2,4), [4,8), ... Each (shingle, interval) has its own Poisson process in
time whose rate is the interval's length; a point also falls on one of ``SIZE`` components and on a unit of weight
inside the interval, and counts if that unit is below c. The earliest point of each component is the signature, so
two signatures agree in a component with probability sum(min)/sum(max) of the weights. A process is followed only
until its time passes the latest component of its text.

Equal texts are folded into one node before anything is compared. Bands of the signature name buckets. All members of
a bucket are compared with one of them, its pivot, which is linear in its size; every comparison is made on the whole
multisets. As 1 - similarity is a metric, two texts that are linked (0.8) are either both within 0.6 of the pivot or
both beyond 0.4. The former make up a family; the latter stay in the bucket for another round with another pivot, until
so few are left that they can be a family themselves. In a family whose links don't join all of it yet, the members
outside its largest class are compared with all others, in pairs of blocks inside the tasks, which return no more than
the links that join classes. So no link of a bucket is lost, and no join makes pairs of a group. Classes are the
connected components of the links.

A key that many rows share is never one task's: pivots' texts are dealt out under a salt, one copy for ``SHARE`` of
their partners, and keys with more than a small share of all rows (so they are few) are joined by broadcast.

Defined cases: null texts and texts without a word are alike to nothing and form classes of their own, named after
their doc_id; every other row has the class of its text, also where a doc_id is null or repeats with other texts. A
text of under five words is one shingle. The class id is the smallest doc_id of the class, null where it has none.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from millrace.llm.common import Memo, as_ids, fresh, mix, shingles, table, word_hash, written

SIZE, BANDS, ROWS = 128, 25, 5
WORDS, SIMILAR = 5, 0.8
AT_ONCE = 1 << 19  # shingles signed together
BLOCK, COLUMNS = 256, 8192  # texts of a family, and shingles, compared at a time
SHARE = 1000  # rows of a key that one task may have in any case
MANTISSA = np.float64(2.0**-53)


def multiset(text: str | None, memo: Memo) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of a text and how often each occurs."""
    words = (text or "").lower().split()
    ids = as_ids(memo, words)
    memo.trim()
    return np.unique(shingles(ids, WORDS), return_counts=True)


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], size: int = SIZE) -> np.ndarray:
    """BagMinHash signatures (texts x size) of multisets, all of them followed side by side; inf for an empty one."""
    out = np.full((len(bags), size), np.inf)
    flat = out.reshape(-1)
    text = np.repeat(np.arange(len(bags)), [len(b[0]) for b in bags])
    what = np.concatenate([b[0] for b in bags] or [np.empty(0, np.uint64)])
    count = np.concatenate([b[1] for b in bags] or [np.empty(0, np.int64)])
    level, parts = 0, []
    while True:  # the intervals of weight each shingle reaches into
        low = 0 if level == 0 else 1 << (level - 1)
        reach = np.flatnonzero(count > low)
        if not len(reach):
            break
        parts.append((text[reach], mix(what[reach], 1000 + level), count[reach], np.full(len(reach), low), np.full(len(reach), max(1, low))))
        level += 1
    if not parts:
        return out
    text, state, count, low, length = (np.concatenate(x) for x in zip(*parts, strict=True))
    when, step = np.zeros(len(text)), 0
    while len(text):
        step += 1
        draw = mix(state, step)
        when = when - np.log1p(-((draw >> np.uint64(11)) * MANTISSA)) / length
        place = mix(draw, 1)
        unit = low + ((place >> np.uint64(20)) % length.astype(np.uint64)).astype(np.int64)
        inside = unit < count
        np.minimum.at(flat, text[inside] * size + (place[inside] & np.uint64(0xFFFFF)).astype(np.int64) % size, when[inside])
        alive = when < out.max(1)[text]
        text, state, count, low, length, when = (x[alive] for x in (text, state, count, low, length, when))
    return out


def band_hashes(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A 63-bit hash for each band of each signature; the band's number is part of it."""
    bits = signature[:, : bands * rows].astype(np.float64).view(np.uint64).reshape(len(signature), bands, rows)
    h = np.broadcast_to(np.arange(bands, dtype=np.uint64), bits.shape[:2]).copy()
    for i in range(rows):
        h = mix(h * np.uint64(0x100000001B3) + bits[:, :, i], i)
    return (h >> np.uint64(1)).astype(np.int64)


def signed(docs: DataFrame) -> DataFrame:
    """id, md5 (of the text, null without a word), bands of each (id, text); bands once for each text of a task."""

    def run(batches):
        import pyarrow as pa

        memo, seen = Memo(word_hash), {}
        for batch in batches:
            ids, md5s, texts = batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            at = 0
            while at < len(texts):
                bags, end, total = [], at, 0
                while end < len(texts) and (total < AT_ONCE or end == at):
                    if texts[end] is not None and md5s[end] not in seen:
                        bag = multiset(texts[end], memo)
                        seen[md5s[end]] = bool(len(bag[0]))
                        if len(bag[0]):
                            bags.append((end - at, bag))
                            total += len(bag[0])
                    end += 1
                bands: list = [None] * (end - at)
                if bags:
                    for (i, _), hashes in zip(bags, band_hashes(signatures([b for _, b in bags])).tolist(), strict=True):
                        bands[i] = hashes
                marks = [m if m is not None and seen[m] else None for m in md5s[at:end]]
                yield pa.RecordBatch.from_arrays([ids.slice(at, end - at), pa.array(marks, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["id", "md5", "bands"])
                at = end

    return docs.select("id", F.unhex(F.md5("text")).alias("md5"), "text").mapInArrow(run, "id long, md5 binary, bands array<long>")


def joined(rows: DataFrame, to: DataFrame, key: str) -> DataFrame:
    """Inner join of rows with a written table that has each key once and in ``n`` how many rows have it.

    Keys with over a 10,000th of all rows, which are under 10,000, go to every task; no other is too large for one.
    """
    most = max(SHARE, (to.agg(F.sum("n")).first()[0] or 0) // 10_000)
    hot = to.where(F.col("n") > most).drop("n")
    if hot.isEmpty():
        return rows.join(to.drop("n"), key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(to.where(F.col("n") <= most).drop("n"), key)
    return rest.unionByName(rows.join(F.broadcast(hot), key))


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both / max(1, int(a[1].sum()) + int(b[1].sum()) - both)


def compared(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b, n) with the similarity of their whole texts; n is at least the number of a's pairs."""
    pairs = pairs.groupBy("a", "b").agg(F.ceil(F.max("n") / SHARE).cast("int").alias("shares"))
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.col("shares")).cast("int"))
    copies = pairs.groupBy("a").agg(F.max("shares").alias("shares")).join(texts.withColumnRenamed("node", "a"), "a")
    left = copies.select("a", F.col("text").alias("text_a"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("salt"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    both = salted.join(right, "b").join(left, ["a", "salt"]).select("a", "b", "text_a", "text_b")

    def run(batches):
        import pyarrow as pa

        memo, bags = Memo(word_hash), {}

        def bag(i: int, text: str):
            if i not in bags:
                if len(bags) >= 64:
                    bags.pop(next(iter(bags)))
                bags[i] = multiset(text, memo)
            return bags[i]

        for batch in batches:
            alike = [overlap(bag(a, s), bag(b, t)) for a, b, s, t in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(alike, pa.float64())], ["a", "b", "alike"])

    return both.mapInArrow(run, "a long, b long, alike double")


def joined_up(rows: pd.DataFrame, similar: float) -> pd.DataFrame:
    """Links of the rows (id, root, asked, text) that join different roots, as few as will do; one of two is asked for.

    Occurrences of a shingle are told apart, so the size of a plain intersection is the multisets' overlap; one matrix
    product for some columns of shingles at a time gives it for all pairs.
    """
    empty = pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64)})
    if rows["root"].nunique() < 2 or not rows["asked"].any():
        return empty
    rows = rows.sort_values("id", ignore_index=True)
    memo, sizes, parts = Memo(word_hash), [], []
    for text in rows["text"]:
        what, count = multiset(text, memo)
        nth = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        parts.append(mix(np.repeat(what, count) + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        sizes.append(len(parts[-1]))
    of = np.repeat(np.arange(len(rows)), sizes)
    _, column, times = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    shared = times[column] > 1
    new = np.cumsum(times > 1) - 1
    of, column = of[shared], new[column[shared]]
    order = np.argsort(column, kind="stable")
    of, column = of[order], column[order]
    both = np.zeros((len(rows), len(rows)), np.float32)
    for low in range(0, int(times[times > 1].size), COLUMNS):
        a, b = np.searchsorted(column, [low, low + COLUMNS])
        some = np.zeros((len(rows), COLUMNS), np.float32)
        some[of[a:b], column[a:b] - low] = 1
        both += some @ some.T
    size, root, asked = np.array(sizes), rows["root"].to_numpy(), rows["asked"].to_numpy(bool)
    alike = both / np.maximum(1, size[:, None] + size[None, :] - both)
    across = (root[:, None] != root[None, :]) & (asked[:, None] | asked[None, :])
    head = {r: r for r in root}

    def top(r):
        while head[r] != r:
            r = head[r]
        return r

    out = []
    for i, j in np.argwhere(np.triu(across & (alike >= similar - 1e-6), 1)):
        p, q = top(root[i]), top(root[j])
        if p != q:
            head[max(p, q)] = min(p, q)
            out.append((rows["id"][i], rows["id"][j]))
    return pd.DataFrame(out, columns=["a", "b"]) if out else empty


def with_least(rows: DataFrame, least: DataFrame, edges: int) -> DataFrame:
    """Rows (u, v) with the m of their u in the written ``least`` (u, m, n); centres of over a share of all edges, which are few, by broadcast."""
    most = max(SHARE, edges // 10_000)
    if (least.agg(F.max("n")).first()[0] or 0) <= most:
        return rows.join(least.drop("n"), "u")
    hot, other = F.broadcast(least.where(F.col("n") > most).drop("n")), least.where(F.col("n") <= most).drop("n")
    return rows.join(hot.select("u"), "u", "left_anti").join(other, "u").unionByName(rows.join(hot, "u"))


def components(links: DataFrame) -> DataFrame:
    """(id, root) for every linked id, root the smallest id of its component: alternating large and small stars.

    What a star uses more than once is written, so the plans of a round are small and alike, and so is what the driver holds of them.
    """
    edges, before = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges"), None
    n = edges.count()
    while True:
        around = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
        least = written(around.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"), "least")
        large = written(with_least(around, least, n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
        down = written(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "down")
        small = with_least(large, down, n).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        edges = written(small, "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
        before, n = now, now[0]


def linked(crowded: DataFrame, texts: DataFrame, similar: float) -> tuple[DataFrame, DataFrame]:
    """(links found with pivots, pairs that put nodes into one family) of crowded buckets (bucket, node, pivot, n)."""

    def pairs(of: DataFrame) -> DataFrame:
        return of.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b"), "n")

    active, links, near = crowded, [], []
    while True:
        told = written(compared(pairs(active), texts), "compared")
        links.append(told.where(F.col("alike") >= similar).select("a", "b"))
        near.append(told.where(F.col("alike") >= similar - 2 * (1 - similar)).select("a", "b"))
        far = told.where(F.col("alike") < similar - (1 - similar)).select(F.col("a").alias("pivot"), F.col("b").alias("node"))
        left = written(active.join(far, ["pivot", "node"]).select("bucket", "node"), "far")  # the pivot is the least of its bucket
        again = written(left.groupBy("bucket").agg(F.min("node").alias("pivot"), F.count("*").alias("n")).where("n > 1"), "pivots")
        left = written(joined(left, again.withColumn("size", F.col("n")), "bucket").withColumnRenamed("size", "n"), "left")
        few = left.where(F.col("n") <= 4 * BLOCK)  # few enough to be a family as they are
        told = written(compared(pairs(few), texts), "compared")
        links.append(told.where(F.col("alike") >= similar).select("a", "b"))
        near.append(told.select("a", "b"))
        active = left.where(F.col("n") > 4 * BLOCK)
        if active.isEmpty():
            return reduce(DataFrame.union, links), reduce(DataFrame.union, near)


def joined_families(near: DataFrame, roots: DataFrame, texts: DataFrame, similar: float) -> DataFrame:
    """Links (a, b) between the classes of each family that its links don't join yet.

    Members outside a family's largest class, in blocks, meet all members in blocks: a text is sent as often as there
    are blocks of the former, those outside as often as there are blocks of all.
    """
    families = components(near).select("id", F.col("root").alias("family"))
    families = families.union(families.select(F.col("family").alias("id"), "family").distinct())
    placed = written(families.join(roots, "id", "left").select("id", "family", F.coalesce("root", "id").alias("root")), "families")
    parts = placed.groupBy("family", "root").agg(F.count("*").alias("n"))
    mixed = parts.groupBy("family").agg(F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("most"), F.count("*").alias("classes")).where("n > 2 and classes > 1")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    mixed = written(mixed.select("family", "n", F.col("most.root").alias("main"), blocks(F.col("n")).alias("all"), blocks(F.col("n") - F.col("most.n")).alias("few")), "mixed")
    cut = joined(placed, mixed, "family").withColumn("hash", F.xxhash64("id")).withColumn("outside", F.col("root") != F.col("main"))
    cut = cut.join(texts.withColumnRenamed("node", "id"), "id")
    every = cut.select("family", "id", "root", "text", F.lit(False).alias("asked"), F.explode(F.sequence(F.lit(0), F.col("few") - 1)).alias("i"), F.pmod("hash", "all").cast("int").alias("j"))
    asked = cut.where("outside").select("family", "id", "root", "text", F.lit(True).alias("asked"), F.pmod("hash", "few").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("all") - 1)).alias("j"))

    def one_each(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["id", "asked"], ascending=[True, False]).drop_duplicates("id")  # one that is in both blocks
        return joined_up(rows[["id", "root", "asked", "text"]], similar)

    return every.union(asked).groupBy("family", "i", "j").applyInPandas(one_each, "a long, b long")


def classes(docs: DataFrame, similar: float = SIMILAR) -> tuple[DataFrame, DataFrame]:
    """(rows, texts) of docs (id, text): id and md5 of every row, and for each md5 its class.

    The second has md5, n (rows), rep (its least id), class_id, and keep_md5 and keep_id of the row that a class would
    keep. md5 is null in rows without a word.
    """
    marks = written(signed(docs), "signatures")
    copies = marks.where("md5 is not null").groupBy("md5").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.first("bands", ignorenulls=True).alias("bands"))
    copies = written(copies.withColumn("node", F.monotonically_increasing_id()), "texts")
    buckets = written(copies.select("node", F.explode("bands").alias("bucket")), "buckets")
    shared = written(buckets.groupBy("bucket").agg(F.min("node").alias("pivot"), F.count("*").alias("n")).where("n > 1"), "shared")
    crowded = written(joined(buckets, shared.withColumn("size", F.col("n")), "bucket").withColumnRenamed("size", "n"), "crowded")  # members of buckets that hold more than one text
    wanted = copies.join(crowded.select("node").distinct(), "node", "left_semi").select("node", F.col("rep").alias("id"), "md5")
    whole = docs.where("text is not null").select("id", F.unhex(F.md5("text")).alias("md5"), "text")
    same = whole["id"].eqNullSafe(wanted["id"]) & (whole["md5"] == wanted["md5"])
    texts = written(whole.join(wanted, same).select("node", "text").dropDuplicates(["node"]), "whole-texts")

    links, near = linked(crowded, texts, similar)
    links = written(links, "links")
    found = links.union(written(joined_families(near, components(links), texts, similar), "links"))
    roots = components(found)
    members = copies.select("node", "md5", "rep", "n").join(roots.withColumnRenamed("id", "node"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    members = written(members, "members")
    first = F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "md5")).alias("keep")
    named = written(members.groupBy("root").agg(F.count("*").alias("n"), first), "classes")
    of_text = joined(members.withColumnRenamed("n", "rows"), named, "root").select("md5", F.col("rows").alias("n"), "rep", F.col("keep.rep").alias("class_id"), F.col("keep.md5").alias("keep_md5"), F.col("keep.rep").alias("keep_id"))
    return marks.select("id", "md5"), written(of_text, "class-of-text")


def query(spark, sf_dir: str) -> DataFrame:
    """doc_id and class_id of every document."""
    rows, texts = classes(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))
    with_words = joined(rows, texts, "md5").select(F.col("id").alias("doc_id"), "class_id")
    return with_words.unionByName(rows.where("md5 is null").select(F.col("id").alias("doc_id"), F.col("id").alias("class_id")))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class stays, the one its class is named after; rows without a word all stay.

    Of rows with that doc_id and the same text one stays, whatever their other columns hold.
    """
    rows, texts = classes(docs.select(F.col("doc_id").alias("id"), "text"))
    found = joined(rows, texts, "md5").select("id", "md5", (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("md5") == F.col("keep_md5"))).alias("keep"))
    found = written(found.groupBy("id", "md5", "keep").agg(F.count("*").alias("n")), "decided")
    id_, md5, n = fresh(docs, "id"), fresh(docs, "md5"), fresh(docs, "n")
    seen = found.where("not keep or n > 1").select(F.col("id").alias(id_), F.col("md5").alias(md5), F.when(F.col("keep"), F.col("n")).alias(n))
    marked = docs.withColumn(md5, F.unhex(F.md5("text")))
    same = marked["doc_id"].eqNullSafe(seen[id_]) & (marked[md5] == seen[md5])
    once = marked.join(seen.where(F.col(n).isNotNull()), same, "left_semi").dropDuplicates(["doc_id", md5])
    return marked.join(seen, same, "left_anti").unionByName(once).select(*docs.columns)
