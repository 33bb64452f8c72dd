"""Every query over odd and empty tables, against brute force where there is one."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from millrace.llm import decontaminate, html_text, language, lm_score, mixing, neardup, neighbours, quality, queries, token_store, warc_zip
from millrace.llm.common import Memo, word_hash
from tests.llm.conftest import rows, sentence


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_empty_tables_give_empty_results(spark, empty, name):
    assert queries.queries()[name](spark, empty).count() == 0


def test_pipeline_on_empty_and_odd_tables(spark, empty, odd):
    assert corpus_pipeline.run(spark, empty).count() == 0
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, odd).columns == docs.columns
    assert corpus_pipeline.run(spark, odd).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_op1_scores_every_row(spark, odd):
    got = quality.query(spark, odd).collect()
    assert len(got) == len(rows()[0])
    by = {r.doc_id: r for r in got}
    assert by[60].expected_grade == by[61].expected_grade == by[62].expected_grade == 0 and not by[60].selected
    assert all(0 <= r.p_top <= 1 and r.p_top <= r.expected_grade + 1e-9 for r in got)


def test_op1_thresholds_are_ordered_and_tails_fall():
    model = quality.OrdinalModel(np.zeros(4), np.array([-1.0, 0.5]))
    p = model.above(np.array([0.0, 2.0]))
    assert (p[:, 0] > p[:, 1]).all() and (p[1] > p[0]).all()


def test_op2_matches_brute_force(spark, odd):
    got = neighbours.query(spark, odd).collect()
    src = {}
    for r in spark.read.parquet(f"{odd}/embeddings.parquet").select("vec_id", "embedding").collect():
        v = r.embedding
        if r.vec_id is not None and v and len(v) == 4 and all(x is not None and math.isfinite(x) for x in v) and any(v):
            src[r.vec_id] = np.array(v, float)
    asked = [i for i in src if i % 100 == 0]
    assert {r.query_id for r in got} == set(asked) == {0, 100, 800}
    hit = 0
    for q in asked:
        want = sorted((float(np.sqrt(((src[q] - v) ** 2).sum())), i) for i, v in src.items() if i != q)[:10]
        mine = sorted((r["rank"], r.score, r.vec_id) for r in got if r.query_id == q)
        assert [x[0] for x in mine] == list(range(1, 11))
        assert all(abs(s - np.sqrt(((src[q] - src[i]) ** 2).sum())) < 1e-12 for _, s, i in mine)
        hit += len({i for _, i in want} & {x[2] for x in mine})
    assert hit >= 0.9 * 10 * len(asked)


def test_op2_gives_fewer_candidates_when_there_are_fewer(spark):
    from pyspark.sql import functions as F

    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, vector array<double>")
    got = neighbours.nearest(few, F.col("id") == 0).orderBy("rank").collect()
    assert [(r["rank"], r.vec_id) for r in got] == [(1, 1), (2, 2)]


def test_op3_cases(spark, odd):
    got = {r.page_id: r for r in html_text.query(spark, odd).collect() if r.page_id != 1}
    assert got[22].text == got[23].text == "" and got[22].n_chars == 0
    assert got[0].text.startswith("Title\n\n") and "home" not in got[0].text and "©" not in got[0].text
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_op3_blocks():
    long = "It was the best of the times and it was the worst of the times for all of us in the town that we had known. " * 3
    page = f"<body><div class='cookie-notice'>We use cookies on this site for you and for the others.</div><header>Site</header><div><p>{long}</p><p>Short one.</p><p>{long}&amp; more&nbsp;here</p></div><div id=sidebar><p>{long}</p></div><section class=comments><p>{long}</p></section><form>Name</form></body>"
    text = html_text.main_text(page)
    assert text.split("\n\n") == [long.strip(), "Short one.", " ".join((long + "& more here").split())]
    assert html_text.main_text("<article><p>Only this.</p></article>") == "Only this."
    assert html_text.main_text("<script>var x = '<p>no</p>'</script>") == ""
    assert html_text.main_text("<li>" * 20000 + "x") == ""


def test_op3_unclosed_elements_and_article_cards():
    long = ("It was the best of the times and it was the worst of the times for all of us in the town that we had known. " * 3).strip()
    for start in ("<html><head><title>T</title><body>", "<head><meta charset=utf-8><title>T</title><style>p {}</style>", "<head><title>T</title><noscript><img src=x></noscript><div>"):
        assert html_text.main_text(f"{start}<p>{long}</p><p>{long}</p>") == f"{long}\n\n{long}"
    for name in ("noscript", "button", "svg", "select", "iframe", "object", "template"):
        for opened in (f"<{name}>", f"<{name}>hidden"):
            assert html_text.main_text(f"<body><p>{long}</p><div>{opened}</div><p>{long}</p>") == f"{long}\n\n{long}"
        assert html_text.main_text(f"<body><p>{long}</p><div><{name}><div>hidden</div></{name}></div><p>{long}</p>") == f"{long}\n\n{long}"
    assert html_text.main_text(f"<head><title>T</title></head><p>{long}</p><script>var x = '<p>{long}</p>'") == long
    card = "Read also what we have seen in the town last week, it is short."
    assert html_text.main_text(f"<body><div><p>{long}</p><p>{long}</p><p>{long}</p></div><article><p>{card} {card}</p></article>").startswith(f"{long}\n\n{long}\n\n{long}")
    assert html_text.main_text(f"<body><article><p>{long}</p><p>{long}</p></article><div><p>{long}</p></div>") == f"{long}\n\n{long}"


def test_op4_languages(spark, odd):
    got = language.query(spark, odd).collect()
    assert len(got) == len(rows()[0])
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (60, 61, 62, 64))
    truth = {i: lang for i, t, lang, _ in rows()[0] if i is not None and t and len(t) > 100}
    assert sum(by[i].lang_pred == truth[i] for i in truth) >= 0.95 * len(truth)
    assert all(0 <= r.score <= 1 for r in got)
    assert by[30].held_out == (zlib.crc32(b"30") % 5 == 0)


def test_op4_codewords_are_far_apart():
    for n in (2, 4, 9):
        code = language.codewords(n)
        apart = (code[:, None] != code[None]).sum(-1)[~np.eye(n, dtype=bool)]
        assert apart.min() >= code.shape[1] // 3


def brute_warc(pages):
    firsts = {}
    for i, _, html in pages:
        if i is not None:
            firsts[html or ""] = min(i, firsts.get(html or "", i))
    out = []
    for i, _, html in pages:
        raw, first = (html or "").encode(), firsts.get(html or "")
        again = first is not None and i != first
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", first if again else None))
    return Counter(out)


def test_op5_matches_brute_force(spark, odd):
    pages = [tuple(r) for r in spark.read.parquet(f"{odd}/pages.parquet").select("page_id", "url", "html").collect()]
    assert Counter(map(tuple, warc_zip.query(spark, odd).collect())) == brute_warc(pages)


def test_op5_reads_zip64_and_refuses_changed_payloads(tmp_path):
    import gzip
    import zipfile

    from pyarrow import fs

    raw = warc_zip.record(3, "http://x/ä b", b"payload", base64.b32encode(hashlib.sha1(b"payload").digest()).decode(), None, False)
    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        body = gzip.compress(raw) + gzip.compress(raw)
        with z.open("archive/data-0.warc.gz", "w", force_zip64=True) as f:
            f.write(body)
        z.writestr("indexes/data-0.jsonl", f"[0, {len(body) // 2}]\n[{len(body) // 2}, {len(body) // 2}]\n")
        z.writestr(zipfile.ZipInfo("other.txt"), "x", zipfile.ZIP_DEFLATED)
    package = warc_zip.Package(fs.LocalFileSystem(), str(path))
    got = [warc_zip.parse(gzip.decompress(x)) for _, x in package.records("archive/data-0.warc.gz")]
    assert [x["page_id"] for x in got] == [3, 3] and got[0]["payload_bytes"] == 7
    with pytest.raises(ValueError):
        package.begin("other.txt")
    with pytest.raises(ValueError):
        warc_zip.parse(raw.replace(b"payload\r", b"payl0ad\r"))


def test_op6_round_trip(spark, odd):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(token_store.word_tokenizer())
    docs = sorted(((i, t) for i, t, _, _ in rows()[0]), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want, start = [], 0
    for i, t in docs:
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert Counter(map(tuple, token_store.query(spark, odd).collect())) == Counter(want)


def test_op6_chunks_of_equal_passages_are_equal():
    rng = np.random.default_rng(1)
    shared, a, b = (rng.integers(0, 40000, n).astype(np.uint32) for n in (20000, 3000, 1111))

    def chunks(ids):
        ends = token_store.cuts(len(ids), token_store.hits_of(ids))
        assert ends[-1] == len(ids) and all(y - x <= token_store.MOST for x, y in zip([0, *ends], ends, strict=False))
        return {ids[x:y].tobytes() for x, y in zip([0, *ends], ends, strict=False)}

    one, two = chunks(np.concatenate([a, shared])), chunks(np.concatenate([b, shared]))
    assert len(one & two) > 0.8 * len(chunks(shared))


def test_op6_merkle_root_tells_changes():
    leaves = [bytes([i]) * 16 for i in range(5)]
    assert token_store.merkle(leaves) != token_store.merkle(leaves[::-1]) != token_store.merkle(leaves[:4])


def test_op7_finds_the_planted_item_only(spark, odd):
    got = decontaminate.query(spark, odd).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(81, 1)}


def test_op7_finds_short_items_and_short_answers(spark):
    qa = [(1, "which river runs through the old town of zembla", "blue wolga"), (2, "name of zembla capital", "onhava"), (3, "who wrote the long green poem about a waxwing and its azure window", "shade")]
    whole = [(11, "quartz vixen jumps nightly"), (12, "seven brass kettles whistle near amber docks while tired porters count turnips")]
    plain = sentence(3, 90)
    texts = [f"{plain} {q}? {'Answer: ' * (i == 1)}{a}. {plain}" for i, q, a in qa] + [f"{plain} {t} {plain}" for _, t in whole] + [whole[0][1]]
    texts += [f"{plain} {qa[0][1]} {plain}", f"{plain} {qa[2][1]} {plain} {plain} {plain} shade", f"{plain} quartz nightly {plain}", "vixen quartz nightly jumps"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    one = decontaminate.halves(spark.createDataFrame(whole, "item_id long, text string"))
    items = spark.createDataFrame(qa, "item_id long, question string, answer string").unionByName(one)
    got = {(r.doc_id, r.item_id) for r in decontaminate.find(docs, items).where("leak").collect()}
    assert got == {(0, 1), (1, 2), (2, 3), (3, 11), (4, 12), (5, 11)}


def test_op8_classes_match_brute_force(spark, odd):
    docs, memo = rows()[0], Memo(word_hash)
    bags = [(i, neardup.multiset(t, memo)) for i, t, _, _ in docs if i is not None]  # rows that repeat an id repeat its text here
    head = {i: i for i, _ in bags}

    def top(x):
        while head[x] != x:
            x = head[x]
        return x

    for i, a in bags:
        for j, b in bags:
            if i < j and len(a[0]) and neardup.overlap(a, b) >= 0.8:
                p, q = top(i), top(j)
                head[max(p, q)] = min(p, q)
    got = neardup.query(spark, odd).collect()
    assert len(got) == len(docs)
    assert all(r.class_id == (None if r.doc_id is None else top(r.doc_id)) for r in got)


def test_op8_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(5)
    what = rng.integers(0, 1 << 62, 300).astype(np.uint64)
    a, b = rng.integers(1, 6, 300), rng.integers(0, 6, 300)
    bags = [(what, a), (what[b > 0], b[b > 0])]
    order = [np.argsort(x) for x, _ in bags]
    bags = [(x[o], c[o]) for (x, c), o in zip(bags, order, strict=True)]
    s = neardup.signatures(bags, 4096)
    assert abs((s[0] == s[1]).mean() - neardup.overlap(*bags)) < 0.04


def test_op9_counts_and_base_scores(spark, odd):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [(i, [*word.findall((t or "").translate(lower)), None]) for i, t, _, _ in rows()[0]]
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in docs}
    c = Counter(w for i, ws in docs if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    want = Counter((i, held[i], len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)) for i, ws in docs)
    got = lm_score.query(spark, odd).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)


def test_op9_tells_more_than_twenty_contexts_apart(spark, tmp_path):
    """22 groups of words follow each other in a ring: who knows the group loses 0.60 a token, base scores 1.94."""
    rng = np.random.default_rng(4)
    word = lambda g: f"g{g % 22}x{rng.choice(5, p=[0.5, 0.125, 0.125, 0.125, 0.125])}"
    docs = [(i, " ".join(word(g) for g in range(a, a + 120))) for i, a in enumerate(rng.integers(0, 22, 400).tolist())]
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = [r for r in lm_score.query(spark, str(tmp_path)).collect() if r.held_out]
    n = sum(r.n_tokens for r in got)
    assert sum(r.base_score for r in got) / n < -1.9
    assert sum(r.score for r in got) / n > -0.85


def test_op10_totals_meet_targets(spark, odd):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{odd}/documents.parquet").select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("domain"))
    wanted = {"de": 900.0, "en": 4000.0, "fr": 1500.0}
    found, domains = mixing.rates(docs.select("id", "text"), docs, wanted)
    got = found.collect()
    assert len(got) == docs.count() and all(r.rate >= 0 for r in got)
    for k, d in enumerate(domains):
        assert abs(sum(r.rate * r.n_tokens * r[f"p{k}"] for r in got) - wanted[d]) < 1e-3 * wanted[d]
    assert all(abs(sum(r[f"p{k}"] for k in range(len(domains))) - 1) < 1e-9 for r in got)


def test_op10_goes_on_to_the_least_squares_or_raises(spark):
    def got(rows, targets, **options):
        soft = spark.createDataFrame(rows, "id long, n_tokens long, p0 double, p1 double").coalesce(1)
        return [r.rate for r in mixing.matched(soft, 2, targets, **options).orderBy("id").collect()]

    alike = [(1, 10, 0.7, 0.3), (2, 10, 0.3, 0.7)]
    assert np.allclose(got(alike, [14.75, 7.75]), [2, 0.25], atol=1e-4)
    assert np.allclose(got([(1, 10, 1.0, 0.0), (2, 10, 0.0, 1.0), (3, 10, 0.5, 0.5)], [20.0, 0.0]), [2, 0, 0], atol=1e-4)
    assert np.allclose(got([(1, 20, 0.5, 0.5)], [20.0, 0.0]), [1])  # can't be met: the best is half of each
    with pytest.raises(RuntimeError):
        got(alike, [14.75, 7.75], most=5)


def test_op10_query_keeps_every_row(spark, odd):
    got = mixing.query(spark, odd).collect()
    assert len(got) == len(rows()[0])
    assert {r.doc_id: r.n_tokens for r in got}[60] == 0
