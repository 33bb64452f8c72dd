"""Near duplicates: hot keys, families beyond one block, and the stage's rows."""

from collections import Counter

import pandas as pd
from pyspark.sql import functions as F

from millrace.llm import neardup
from millrace.llm.common import Memo, word_hash, written
from tests.llm.conftest import sentence

BASE = [f"w{i}" for i in range(100)]


def plain_classes(texts):
    """Component of each text number under links of 0.8 or more, over all pairs."""
    memo = Memo(word_hash)
    bags = [neardup.multiset(t, memo) for t in texts]
    head = list(range(len(texts)))

    def top(x):
        while head[x] != x:
            x = head[x]
        return x

    for i, a in enumerate(bags):
        for j in range(i):
            if len(a[0]) and neardup.overlap(a, bags[j]) >= 0.8:
                p, q = sorted((top(i), top(j)))
                head[q] = p
    return [top(i) for i in range(len(texts))]


def test_links_between_classes_are_as_few_as_will_do():
    texts = [" ".join(BASE), " ".join(BASE[:95] + ["x"] * 5), " ".join(["y"] * 30 + BASE[30:]), " ".join(["y"] * 30 + BASE[30:98])]
    rows = pd.DataFrame({"id": [1, 2, 3, 4], "root": [1, 2, 3, 4], "asked": [True, False, True, False], "text": texts})
    assert {tuple(r) for r in neardup.joined_up(rows, 0.8).itertuples(index=False)} == {(1, 2), (3, 4)}
    assert {tuple(r) for r in neardup.joined_up(rows.assign(asked=[True, False, False, False]), 0.8).itertuples(index=False)} == {(1, 2)}
    assert not len(neardup.joined_up(rows.assign(asked=False), 0.8))


def variants():
    """Families of near copies whose links don't all go by one pivot: words are changed further and further from a base."""
    texts = []
    for family in range(3):
        base = [f"f{family}w{i}" for i in range(120)]
        for k in range(14):
            drift = [f"f{family}x{i}" if i < 2 * k else w for i, w in enumerate(base)]
            texts.append(" ".join(drift))
        texts += [" ".join(base[: 118 - k]) for k in range(3)]
    return texts + [sentence(k) for k in range(20)]


def test_families_match_all_pairs(spark, monkeypatch):
    """With blocks of four texts, families span many blocks and buckets take more than one pivot."""
    monkeypatch.setattr(neardup, "BLOCK", 4)
    monkeypatch.setattr(neardup, "SHARE", 3)  # every pivot is salted
    texts = variants()
    want = plain_classes(texts)
    rows, of_text = neardup.classes(spark.createDataFrame(list(enumerate(texts)), "id long, text string"))
    got = {r.id: r.class_id for r in neardup.joined(rows, of_text, "md5").collect()}
    assert got == dict(enumerate(want))


def test_hot_keys_join_as_others(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SHARE", 5)
    rows = spark.createDataFrame([(i, "a") for i in range(40)] + [(i, "b") for i in range(4)] + [(0, "c"), (1, None)], "v int, key string")
    to = written(spark.createDataFrame([("a", 40, 1), ("b", 4, 2), ("d", 0, 3)], "key string, n long, x int"), "to")
    got = Counter((r.key, r.x) for r in neardup.joined(rows, to, "key").collect())
    assert got == {("a", 1): 40, ("b", 2): 4}


def test_repeated_and_null_ids_follow_their_texts(spark):
    near = sentence(1, 120)
    rows = [(7, near, 1), (7, near, 2), (7, sentence(9), 3), (None, near + " more", 4), (None, sentence(9), 5), (None, sentence(20), 6), (3, near + " of it", 7), (8, "", 8), (8, "", 9), (None, None, 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int")
    found, of_text = neardup.classes(docs.select(F.col("doc_id").alias("id"), "text"))
    got = Counter((r.id, r.class_id) for r in neardup.joined(found, of_text, "md5").collect())
    assert got == {(7, 3): 2, (7, 7): 1, (None, 3): 1, (None, 7): 1, (None, None): 1, (3, 3): 1}
    kept = neardup.stage(spark, docs, "")
    assert kept.columns == docs.columns
    left = sorted((r.n, r.doc_id) for r in kept.collect())
    assert left == [(3, 7), (6, None), (7, 3), (8, 8), (9, 8), (10, None)]


def test_of_equal_rows_one_stays(spark):
    text = sentence(4, 80)
    docs = spark.createDataFrame([(5, text, "a"), (5, text, "b"), (5, text, "b"), (6, text, "a"), (None, sentence(50), "c"), (None, sentence(50), "c")], "doc_id long, text string, md5 string")
    assert Counter((r.doc_id, r.text) for r in neardup.stage(spark, docs, "").collect()) == {(5, text): 1, (None, sentence(50)): 1}


def test_a_round_of_stars_reads_each_table_a_few_times(spark, monkeypatch):
    """What a round uses again is written: a plan that holds every earlier step again and again takes the driver's memory."""
    monkeypatch.setattr(neardup, "SHARE", 3)  # the first round has a centre that goes to every task
    seen = []

    def counted(df, name):
        seen.append(df._jdf.queryExecution().optimizedPlan().toString().count("Relation ["))
        return written(df, name)

    links = written(spark.createDataFrame([(0, i) for i in range(1, 9)] + [(i, i + 1) for i in range(20, 30)], "a long, b long"), "links")
    monkeypatch.setattr(neardup, "written", counted)
    got = {r.id: r.root for r in neardup.components(links).collect()}
    assert got == {i: 0 for i in range(1, 9)} | {i: 20 for i in range(21, 31)}
    assert max(seen) <= 6
