"""Block-max WAND against full scoring, an index in parts against one, and the stage's rows."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import decontaminate
from tests.llm.conftest import sentence


@pytest.fixture(scope="module")
def drawn():
    """Items and texts over one skewed vocabulary: most terms are in many items."""
    rng = np.random.default_rng(3)
    zipf = 1 / np.arange(1, 401)
    draw = lambda n: [f"w{i}" for i in rng.choice(400, n, p=zipf / zipf.sum())]
    items = [(k, " ".join(draw(25)), " ".join(draw(12))) for k in range(60)] + [(60, " ".join(draw(200)), " ".join(draw(40)))]
    texts = [" ".join(draw(150) + items[k][1].split() + items[k][2].split() + draw(70)) for k in range(30)] + [" ".join(items[60][1:]), "", "w1", ", ."]
    return items, texts


def one_index(items):
    rows = [(i, *(np.array([decontaminate.term_of(w) for w in x.split()]) for x in (q, a))) for i, q, a in items]
    cut = [np.concatenate(r[1:])[s : s + decontaminate.PASSAGE] for r in rows for s in range(0, len(r[1]) + len(r[2]), decontaminate.PASSAGE)]
    terms, df = np.unique(np.concatenate([np.unique(c) for c in cut]), return_counts=True)
    return decontaminate.build(rows, terms, df, len(cut), float(np.mean([len(c) for c in cut]))), cut, dict(zip(terms.tolist(), df.tolist(), strict=True))


def test_wand_finds_what_full_scoring_does(drawn):
    items, texts = drawn
    index, segments, df = one_index(items)
    mean, n = np.mean([len(s) for s in segments]), len(segments)
    weights = []
    for s in segments:
        tf = Counter(s.tolist())
        w = {t: np.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(s) / mean)) for t, c in tf.items()}
        weights.append({t: x / sum(w.values()) for t, x in w.items()})
    for threshold in (0.3, 0.5, 0.8):
        want = {}
        for i, text in enumerate(texts):
            words = [t for t in map(decontaminate.term_of, text.split()) if t >= 0]
            for at in range(0, len(words), 32):
                passage = set(words[at : at + 64])
                for k, w in enumerate(weights):
                    if (score := sum(x for t, x in w.items() if t in passage)) >= threshold:
                        want[i, at, k] = score
        got = {r[:3]: r[3] for r in decontaminate.retrieved(index, *decontaminate.terms_of(pa.array(texts)), threshold)}
        assert got.keys() == want.keys() and len(want) >= 30
        assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_blocks_are_skipped(drawn, monkeypatch):
    """Most cursors never stop in most blocks: fewer steps than items."""
    items, texts = drawn
    index, *_ = one_index(items * 20)
    steps = []
    real = np.argsort
    monkeypatch.setattr(decontaminate.np, "argsort", lambda a, **k: steps.append(1) or real(a, **k))
    term = np.unique(np.searchsorted(index.words, [decontaminate.term_of(w) for w in texts[0].split()[:64]]))
    decontaminate.wand(index, term[None, :], 0.8)
    assert 0 < len(steps) < len(index.owner) / 4


def test_parts_do_not_change_the_result(spark, drawn):
    items, texts = drawn
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (5, None)], "id long, text string")
    rows = spark.createDataFrame(items + items[:5], "item_id long, question string, answer string")
    size = sum(len(q) + len(a) for _, q, a in items)
    got = []
    for parts in (1, 4, 20):
        found = decontaminate.find(docs, rows, index_bytes=-(-size // parts)).collect()
        got.append(Counter((r.doc_id, r.item_id, round(r.score, 9), r.question_overlap, r.answer_overlap, r.leak) for r in found))
    assert got[0] == got[1] == got[2]
    assert {(i, i) for i in range(30)} | {(30, 60), (None, 0)} <= {x[:2] for x in got[0] if x[5]}


def test_stage_decides_row_by_row(spark, tmp_path):
    item = sentence(900, 36)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    leak = sentence(40) + " " + item
    rows = [(None, leak, 1), (None, sentence(1), 2), (7, leak, 3), (7, sentence(2), 4), (8, None, 5), (9, "", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id int")
    got = decontaminate.stage(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    assert Counter(map(tuple, got.collect())) == Counter(r for r in rows if r[1] != leak)


def test_parts_are_read_once_for_the_texts_that_are_held(drawn, monkeypatch):
    """Twenty parts and many slices: reads don't grow with the slices, and rows and hits stay as they are."""
    items, texts = drawn
    index, *_ = one_index(items)
    reads = []
    monkeypatch.setattr(decontaminate, "read_part", lambda folder, name: reads.append(name) or index)
    monkeypatch.setattr(decontaminate, "SLICE", 4096)
    batches = [pa.RecordBatch.from_arrays([pa.array(range(k, k + len(texts))), pa.array(texts)], ["id", "text"]) for k in range(6)]
    names = [f"part-{k}" for k in range(20)]
    one = list(decontaminate.searched(iter(batches), 1, "", names[:1], 0.5, 0.8, 0.5))
    assert len(one) > 40 and len(reads) == len(one)  # a single part is looked through slice by slice
    reads.clear()
    got = list(decontaminate.searched(iter(batches), 1, "", names, 0.5, 0.8, 0.5))
    assert reads == names
    assert [r.column(0).to_pylist() for r, _ in got] == [r.column(0).to_pylist() for r, _ in one] and sum(r.num_rows for r, _ in got) == 6 * len(texts)
    assert [sorted(h) for _, h in got] == [sorted(h * 20) for _, h in one] and any(h for _, h in got)
    reads.clear()
    monkeypatch.setattr(decontaminate, "HELD", sum(b.nbytes for b in batches))
    assert len(list(decontaminate.searched(iter(batches), 1, "", names, 0.5, 0.8, 0.5))) == len(one) and 40 <= len(reads) <= 200
    assert list(decontaminate.searched(iter([]), 1, "", names, 0.5, 0.8, 0.5)) == []
