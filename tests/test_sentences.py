"""Sentence ends learned from text: what the model finds, what it leaves alone, and that it cuts as the pattern does otherwise."""

import math

import pytest
from pyspark.sql import functions as F

from millrace.functions import sentence_model as M, text as T
from millrace.operators import chunks as C, claims as K
from millrace.sources import sinks

NAMES = ("Berg", "Lund", "Moss", "Holt")
PLACES = ("mill", "site", "plant", "yard")


def corpus(spark):
    """Notes in which stops stand after abbreviations, initials and numbers, and words stand with and without them."""
    rows = []
    for i in range(160):
        name, place = NAMES[i % 4], PLACES[i % 3]
        rows.append(f"We met Dr. {name} at the {place}. The {place} used approx. {i + 3} tonnes of water. Is that much? See No. {i + 1} of the list, e.g. the water of J. {name}. We saw the water. It was {1990 + i % 30}. The list is long and the small {place} has no yard. The yard is small and there is no list.")
        rows.append(f"It cost approx. {i} crowns and more crowns than once. The yard and the plant saw the dr. once! We like water and a list.")
    return spark.createDataFrame([(i, 1, t) for i, t in enumerate(rows)], "doc_id long, page_number int, text string").repartition(3)


@pytest.fixture(scope="module")
def model(spark):
    return M.learned(corpus(spark), sinks.kept)


def cut(spark, model, text):
    return spark.createDataFrame([(text,)], "text string").select(model.split(F.col("text"))).first()[0]


def test_lists_are_what_they_should_be(model):
    assert {"dr", "approx", "e.g"} <= set(model.abbreviations) and not {"water", "mill", "list", "no", "j"} & set(model.abbreviations)
    assert {"we", "the"} & set(model.starters) and ("no", "#") in model.collocations


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("Ask Dr. Berg now. He knows.", ["Ask Dr. Berg now.", "He knows."]),
        ("It used approx. 5 tonnes. We saw it.", ["It used approx. 5 tonnes.", "We saw it."]),
        ("See No. 5 of it. Then go.", ["See No. 5 of it.", "Then go."]),
        ("The yard, e.g. the small one, of J. Moss. It is old.", ["The yard, e.g. the small one, of J. Moss.", "It is old."]),
        ("It was 1995. The mill ran.", ["It was 1995.", "The mill ran."]),
        ("I saw the dr. We left.", ["I saw the dr.", "We left."]),  # a frequent starter after an abbreviation
        ("Really? dr. Holt! No.", ["Really?", "dr. Holt!", "No."]),  # no model takes away other ends
    ],
)
def test_stops_inside_sentences(spark, model, text, expected):
    assert cut(spark, model, text) == expected


@pytest.mark.parametrize("text", ["", "  ", "One. Two.  Three! four? ", " lead. x", "aa\x01bb. cc", "no end", ". . .", "Wait... What?"])
def test_an_empty_model_cuts_as_the_pattern(spark, text):
    df = spark.createDataFrame([(text.replace("\x01", " "),)], "text string")
    assert cut(spark, M.SentenceModel(), text) == df.select(T.sentences(F.col("text"))).first()[0]


def test_nothing_of_a_text_is_lost(spark, model):
    text = "Ask Dr. Berg.  He used approx.\n5 tonnes! e.g. here.\tWe saw No. 7."
    pieces = cut(spark, model, text)
    assert "".join("".join(p.split()) for p in pieces) == "".join(text.split()) and "Dr. Berg" in pieces[0] and any("approx.\n5" in p for p in pieces)
    assert cut(spark, model, None) is None


def test_scores_are_those_of_a_plain_loop(spark):
    """Abbreviations from counts in Python."""
    counts = sinks.kept(M.counted(corpus(spark)), "counts")
    words = {}
    for r in counts.collect():
        k, n = words.get(r.word, (0, 0))
        words[r.word] = (k + r.n * r.stop, n + r.n)
    words.pop("", None)
    p = sum(k for k, _ in words.values()) / sum(n for _, n in words.values())
    held = lambda k, n, p: k * math.log(p) + (n - k) * math.log(1 - p)
    want = {}
    for w, (k, n) in words.items():
        size = len(w.replace(".", ""))
        if k and any(c.isalpha() for c in w) and len(w) > 1:
            score = -2 * (held(k, n, p) - held(k, n, 0.99)) * (len(w) - size + 1) * math.exp(-size) * size ** -(n - k)
            if score >= 0.3:
                want[w] = score
    got = {r.word: r.score for r in M.abbreviations(counts).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[w], want[w], rel_tol=1e-9) for w in want)
    assert counts.agg(F.sum("n")).first()[0] == sum(len(r.text.split()) for r in corpus(spark).collect())


def test_claims_and_chunks_take_the_model(spark, model):
    page = spark.createDataFrame([(1, 1, "We reduced landfill waste by approx. 640 tonnes last year.")], "doc_id long, page_number int, text string")
    assert [r.Claim_Text for r in K.claims(page, model.split).collect()] == [page.first().text]
    assert [r.Claim_Text for r in K.claims(page).collect()] == ["We reduced landfill waste by approx."]
    text = "Dr. Berg reduced waste. Dr. Lund did so too. " * 8
    parts = spark.createDataFrame([(text,)], "text string").select(C.packed(F.col("text"), C.SignTokens(), 20, model.split)).first()[0]
    assert all(p.startswith("Dr. ") and not p.endswith("Dr.") for p in parts) and " ".join(parts) == text.strip()


def test_empty_corpora_and_bounds(spark):
    none = spark.createDataFrame([], "text string")
    assert M.learned(none, sinks.kept) == M.SentenceModel()
    assert M.learned(spark.createDataFrame([(None,), ("",), ("...",)], "text string"), sinks.kept) == M.SentenceModel()
    with pytest.raises(ValueError, match="over 1"):
        M.learned(corpus(spark), sinks.kept, most=1)


def test_numbers_are_counted_by_their_shape(spark):
    """A corpus has ever more different numbers; what is grouped first must not grow with them."""
    texts = [f"Order No. {i * 7919 % 100_000:05d} of 2020-01-{i % 28 + 1:02d} costs {i % 900 + 100}.5 crowns. CO2x{i} and {i % 90 + 10}. Then 7%." for i in range(200)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    counts = sinks.kept(M.counted(df), "counts")
    assert counts.agg(F.sum("n")).first()[0] == sum(len(t.split()) for t in texts)
    assert {r.word for r in counts.collect()} >= {"#", "co2x7", "co2x8"} and counts.where("word = 'no' and stop").count() == 1
    seen = df.select(F.explode(F.split("text", " ")).alias("token")).select(M._one_of_its_shape(F.col("token")).alias("shape"), "token")
    assert seen.where("token not like 'CO2%'").select("shape").distinct().count() == 12
    alike = [getattr(M, f) for f in ("word_of", "ending_of", "case_of")]
    assert not seen.select(*[(f(F.col("token")) == f(F.col("shape"))).alias(f.__name__) for f in alike]).where("not (word_of and ending_of and case_of)").count()
