"""Gold recall, agreement and versions against plain loops."""

import math
import re
from collections import Counter, defaultdict
from itertools import product

import pytest
from pyspark.sql import functions as F

from millrace.operators import claims as K, evaluate, versions as V
from millrace.sources import derived

D = "/root/testdata/sf0.001"


def words(text):
    return set(re.findall(r"[^\W_]+", (text or "").lower()))


GOLD = [
    (1, 0, "We reduced landfill waste to 640 tonnes last year.", True, "E"),
    (1, 1, "we REDUCED landfill waste to 640 tonnes last", True, "S"),  # shortened and recased
    (1, 2, "We reduced landfill waste by a fifth in 2020.", True, "E"),  # half the words
    (2, 0, "We reduced landfill waste to 640 tonnes last year.", True, "E"),  # another document's
    (1, 3, "Water use fell by 12 % at our sites.", False, "E"),
    (1, 4, None, True, "G"),
    (1, 5, "...", False, "G"),
    (1, 6, "Water use", None, "E"),
    (3, 0, "a b c d e f g h i j", True, "G"),
    (3, 1, "a b c d e f g h i j k", True, "G"),
]
CLAIMS = [
    (1, "We reduced landfill waste to 640 tonnes last year.", "E"),
    (1, "Water use fell by 12 % at our sites and offices.", "S"),
    (1, "Water use fell by 12 % at our sites and offices.", "S"),
    (3, "h g f e d c b a x y", "S"),
    (3, "a b c d e f g h i y z", "G"),
    (3, None, "E"),
]


@pytest.fixture(scope="module")
def matched(spark):
    gold = spark.createDataFrame(GOLD, "doc_id long, gold_id int, text string, is_real boolean, topic string")
    claims = spark.createDataFrame(CLAIMS, "doc_id long, text string, topic string")
    return evaluate.found_gold(gold, claims, ["doc_id"]).cache()


def plain_match(doc, text):
    fits = sorted((-len(words(text) & words(c)), c, t) for d, c, t in CLAIMS if d == doc and c and words(text) and 5 * len(words(text) & words(c)) >= 4 * len(words(text)))
    return fits[0][2] if fits else None


def test_gold_rows_find_their_claims(matched):
    got = {(r.doc_id, r.gold_id): (r.found, r.as_topic) for r in matched.collect()}
    want = {(d, g): ((t := plain_match(d, text)) is not None, t) for d, g, text, _, _ in GOLD}
    assert got == want and want[1, 1] == (True, "E") and want[1, 2][0] is False and want[3, 0] == (True, "G")


def test_recall_counts(matched):
    got = {r.topic: r for r in evaluate.recall(matched, "topic").collect()}
    by = defaultdict(list)
    for d, _, text, real, topic in GOLD:
        if real is not None:
            by[topic].append((real, plain_match(d, text), topic))
    for topic, rows in by.items():
        real, hit = [r for r in rows if r[0]], [r for r in rows if r[1]]
        both = [r for r in real if r[1]]
        r = got[topic]
        assert (r.real, r.found, r.admitted) == (len(real), len(both), len(hit) - len(both))
        assert r.recall == (len(both) / len(real) if real else None) and r.precision == (len(both) / len(hit) if hit else None)
        assert r.typed == (sum(x[1] == x[2] for x in both) / len(both) if both else None)
    assert got.keys() == by.keys()


def test_candidates_come_from_rare_words(spark):
    """Many claims share all frequent words; the index looks up rare ones only, and finds what a loop finds."""
    common = "we use less water and power at all sites of the group"
    claims = [(1, f"{common} number{i} case{i % 7}", "E") for i in range(300)]
    gold = [(1, i, f"{common} number{i} case{i % 7}", True, "E") for i in range(0, 300, 10)] + [(1, 1000, "entirely other text", True, "S")]
    got = evaluate.found_gold(spark.createDataFrame(gold, "doc_id long, gold_id int, text string, is_real boolean, topic string"), spark.createDataFrame(claims, "doc_id long, text string, topic string"), ["doc_id"])
    assert {r.gold_id for r in got.collect() if r.found} == set(range(0, 300, 10))


def kappa_alpha(pairs):
    both = [(a, b) for a, b in pairs if a is not None and b is not None]
    n = len(both)
    if not n:
        return 0, None, None, None
    observed = sum(a == b for a, b in both) / n
    first, second = Counter(a for a, _ in both), Counter(b for _, b in both)
    expected = sum(first[c] * second[c] for c in first) / n**2
    values = first + second
    agree = sum(values[c] * (values[c] - 1) for c in values)
    disagree_expected = 1 - agree / (2 * n * (2 * n - 1))
    return n, observed, (observed - expected) / (1 - expected) if expected != 1 else None, 1 - (1 - observed) / disagree_expected if disagree_expected else None


def test_agreement_of_two_judges(spark):
    answers = [None, "E", "S", "G"]
    rows = [("x", answers[(i * 7) % 4], answers[(i * i) % 4]) for i in range(40)] + [("x", "E", "E")] * 20
    rows += [("same", "E", "E")] * 5 + [("none", None, "E"), ("none", "S", None)] + [(None, "E", "S"), (None, "E", "E"), (None, "S", "S")] + [("apart", "E", "S"), ("apart", "S", "E")]
    got = {r.kind: r for r in evaluate.agreement(spark.createDataFrame(rows, "kind string, a string, b string"), "a", "b", "kind").collect()}
    for kind in {r[0] for r in rows}:
        pairs = [r[1:] for r in rows if r[0] == kind]
        n, observed, kappa, alpha = kappa_alpha(pairs)
        r = got[kind]
        assert (r.rows, r.paired) == (len(pairs), n)
        for mine, want in ((r.observed, observed), (r.kappa, kappa), (r.alpha, alpha)):
            assert (mine is None) == (want is None) and (want is None or math.isclose(mine, want, abs_tol=1e-12))
    assert got["apart"].kappa == -1 and got["same"].kappa is None


def test_reliability_of_many_judges(spark):
    """Against the definition: pairs of answers within units, and among all answers."""
    rows = [("x", u, (u * j + u // 3 + j) % 3 if (u + j) % 5 else None) for u in range(30) for j in range(4)] + [("x", 99, 1)] + [("one", u, 1) for u in (1, 1, 2, 2)] + [(None, 1, 0), (None, 1, 1)]
    got = {r.kind: r for r in evaluate.reliability(spark.createDataFrame(rows, "kind string, unit long, answer int"), "kind").collect()}
    units = defaultdict(list)
    for k, u, a in rows:
        if k == "x" and a is not None:
            units[u].append(a)
    units = {u: v for u, v in units.items() if len(v) > 1}
    values = [a for v in units.values() for a in v]
    apart = sum(sum(a != b for a, b in product(v, v)) / (len(v) - 1) for v in units.values()) / len(values)
    expected = sum(a != b for a, b in product(values, values)) / (len(values) * (len(values) - 1))
    assert (got["x"].units, got["x"].answers) == (len(units), len(values)) and math.isclose(got["x"].alpha, 1 - apart / expected, abs_tol=1e-12)
    assert got["one"].alpha is None and got["one"].units == 2 and got[None].alpha == 0


@pytest.fixture(scope="module")
def feats(spark):
    return K.features(K.sentences(derived.claim_pages(spark, D))).cache()


def separate(feats, version):
    """One version by itself."""
    tests = K.predicates(F.col("s"), F.col("low"), F.col("words"), F.col("quantity"))
    if not version.every_topic:
        tests["not_assertion"] = tests["not_assertion"] | (K.environment_hits(F.col("low")) == 0)
    reasoned = feats.withColumn("reason", F.coalesce(*[F.when(tests[r], F.lit(r)) for r in version.reasons]))
    topic = V.plain_topic(F.col("low")) if version.plain_topic else K.esg_type(F.col("low"))
    return reasoned.withColumn("topic", topic)


def test_versions_side_by_side_are_those_run_apart(feats):
    got = defaultdict(set)
    for r in V.claims(V.first_of(V.judged(feats))).collect():
        got[r.version].add((r.doc_id, r.page_number, r.sent_idx, r.text, r.topic))
    for v in V.VERSIONS:
        want = {(r.doc_id, r.page_number, r.sent_idx, r.s, r.topic) for r in K.first_seen(separate(feats, v)).collect()}
        assert got[v.name] == want and want
    assert got["v2.1"] < got["v2"]  # only more reasons to drop
    shipped = {(int(r.Company), r.Page, r.Claim_Text, r.ESG_Type) for r in K.claims(derived.claim_pages(feats.sparkSession, D)).collect()}
    assert {(d, p, s, t) for d, p, _, s, t in got["v2.1"]} == shipped


def test_progress_and_changes_add_up(feats):
    first = V.first_of(V.judged(feats)).cache()
    table = {r.version: r for r in V.progress(V.claims(first)).collect()}
    rows = V.changes(first).collect()
    for older, newer in (("v1", "v2"), ("v2", "v2.1")):
        n = Counter()
        for r in rows:
            if (r.older, r.newer) == (older, newer):
                n[r.change] += r.n
        assert n["kept"] + n["relabelled"] + n["lost"] == table[older].claims and n["kept"] + n["relabelled"] + n["gained"] == table[newer].claims
    assert {r.detail for r in rows if r.change == "lost" and r.newer == "v2.1"} <= {"governance_plumbing", "activity_report"}
    assert all(r.detail in "ESG" for r in rows if r.change == "relabelled")


def test_a_version_of_ones_own(feats):
    """Names with signs, any subset of the reasons."""
    mine = (V.Version("my rules, 1", ("length",)), V.Version("my.rules 2", ("length", "not_assertion")))
    got = Counter(r.version for r in V.claims(V.first_of(V.judged(feats, mine), mine), mine).collect())
    for v in mine:
        assert got[v.name] == K.first_seen(separate(feats, v)).count()
