"""Claims: sentences through a first-match cascade of reasons to drop them, then four labels for what is left.

``sentences`` and ``features`` are narrow projections; ``first_seen`` is the one shuffle. Everything stays in
built-in functions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F

from millrace.functions import text as T
from millrace.functions.lexicon import any_of, hits

#: Reasons in the order in which the first that holds is given.
REASONS = ("length", "not_assertion", "boilerplate", "reference_dense", "navigation", "governance_plumbing", "activity_report", "methodology", "general_statement", "risk_description")
MIN_WORDS, MAX_WORDS = 4, 45
CLAIM_TYPES = ("Strong", "Future Promise", "Vague")

# Fixed values: (claim type, evidence, risk signal).
RISK = (
    ("Strong", "Yes", "Supported"),
    ("Strong", "Partial", "Supported"),
    ("Strong", "No", "Unverified"),
    ("Future Promise", "Yes", "Credible"),
    ("Future Promise", "Partial", "Weak Evidence"),
    ("Future Promise", "No", "Unsubstantiated"),
    ("Vague", "Yes", "Needs Review"),
    ("Vague", "Partial", "Weak Evidence"),
    ("Vague", "No", "Vague"),
)


def sentences(pages: DataFrame, split: Callable[[Column], Column] = T.sentences) -> DataFrame:
    """doc_id, page_number, sent_idx, raw of pages (doc_id, page_number, text).

    ``split`` gives a text's sentences as an array: a pattern by default, or a trained splitter by ``text.splitter``.
    """
    return pages.select("doc_id", "page_number", F.posexplode(split(F.col("text"))).alias("sent_idx", "raw"))


def features(sents: DataFrame) -> DataFrame:
    """What the rules look at, a column each, beside the sentence's keys."""
    # A generator's output is computed once; plain columns would be put into each of the tests that filters repeat.
    cleaned = sents.select("*", F.explode(F.array(T.clean(F.col("raw")))).alias("s")).select("*", F.explode(F.array(F.lower("s"))).alias("low"))
    return cleaned.withColumns({"words": T.word_count(F.col("s")), "quantity": T.has_quantity(F.col("s"))})


def environment_hits(low: Column) -> Column:
    return hits(low, "topic_keywords") + F.rlike(low, F.lit(T.NATURE)).cast("int")


def predicates(s: Column, low: Column, words: Column, quantity: Column) -> dict[str, Column]:
    """Reason -> whether it holds by itself."""
    topic = (environment_hits(low) + hits(low, "social_keywords") + hits(low, "governance_keywords")) > 0
    headings = hits(low, "section_nav_words")
    titled = low.contains("impact report") | low.contains("sustainability report")
    return {
        "length": ~words.between(MIN_WORDS, MAX_WORDS),
        "not_assertion": ~((quantity | any_of(low, "action_keywords")) & topic),
        "boilerplate": any_of(low, "boilerplate_phrases"),
        "reference_dense": (T.number_count(s) >= 5) | (T.page_mentions(low) >= 2),
        "navigation": any_of(low, "nav_pointer_phrases") | (headings >= 2) | (titled & (headings >= 1)),
        "governance_plumbing": ~quantity & any_of(low, "gov_plumbing"),
        "activity_report": any_of(low, "activity_phrases"),
        "methodology": any_of(low, "method_phrases"),
        "general_statement": ~quantity & any_of(low, "general_statement_phrases"),
        "risk_description": ~quantity & any_of(low, "risk_phrases"),
    }


def with_reason(feats: DataFrame) -> DataFrame:
    """``feats`` with the first reason to drop the sentence, null where there is none."""
    tests = predicates(F.col("s"), F.col("low"), F.col("words"), F.col("quantity"))
    return feats.withColumn("reason", F.coalesce(*[F.when(tests[r], F.lit(r)) for r in REASONS]))


def numbered(reasoned: DataFrame) -> DataFrame:
    """Sentences without a reason; ``seen`` counts a document's uses of the same text in page and sentence order."""
    order = Window.partitionBy("doc_id", "low").orderBy("page_number", "sent_idx")
    return kept(reasoned).withColumn("seen", F.row_number().over(order))


def first_seen(reasoned: DataFrame) -> DataFrame:
    """Sentences without a reason, each text once for each document."""
    return numbered(reasoned).where("seen = 1").drop("seen")


def repeated(reasoned: DataFrame) -> DataFrame:
    """Sentences without a reason whose text the document has already."""
    return numbered(reasoned).where("seen > 1").drop("seen")


def kept(reasoned: DataFrame) -> DataFrame:
    return reasoned.where(F.col("reason").isNull())


def claim_type(low: Column, quantity: Column) -> Column:
    return F.when(any_of(low, "future_markers"), "Future Promise").when(quantity, "Strong").otherwise("Vague")


def evidence(low: Column, quantity: Column) -> Column:
    return F.when(quantity & ~any_of(low, "future_markers"), "Yes").when(any_of(low, "evidence_refs") | quantity, "Partial").otherwise("No")


def topic_counts(low: Column) -> tuple[Column, Column, Column]:
    """Hits of the three topics; a workplace "environment" counts for people and not for the planet."""
    work = F.rlike(low, F.lit(T.WORKPLACE))
    found = environment_hits(low)
    return F.when(work & (found > 0), found - 1).otherwise(found), hits(low, "social_keywords") + work.cast("int"), hits(low, "governance_keywords")


def esg_type(low: Column) -> Column:
    """Topic by most hits; strong governance terms win ties."""
    e, s, g = topic_counts(low)
    strong = any_of(low, "strong_gov") & (g >= e) & (g >= s)
    return F.when(strong | ((g > e) & (g >= s)), "G").when((s > e) & (s >= g), "S").otherwise("E")


def risk_table(spark) -> DataFrame:
    return spark.createDataFrame(RISK, "Claim_Type string, Evidence_Exists string, Risk_Signal string")


def with_risk(labelled: DataFrame) -> DataFrame:
    """The risk signal by lookup; the empty string where a pair has none."""
    table = F.broadcast(risk_table(labelled.sparkSession))  # nine rows
    return labelled.join(table, ["Claim_Type", "Evidence_Exists"], "left").withColumn("Risk_Signal", F.coalesce("Risk_Signal", F.lit("")))


def classified(first: DataFrame) -> DataFrame:
    """The claim rows: company, page, text and labels."""
    low, quantity = F.col("low"), F.col("quantity")
    labelled = first.select(
        F.col("doc_id").cast("string").alias("Company"), F.col("page_number").cast("int").alias("Page"), F.col("s").alias("Claim_Text"),
        esg_type(low).alias("ESG_Type"), claim_type(low, quantity).alias("Claim_Type"), evidence(low, quantity).alias("Evidence_Exists"),
    )
    return with_risk(labelled).select("Company", "Page", "Claim_Text", "ESG_Type", "Claim_Type", "Evidence_Exists", "Risk_Signal")


def claims(pages: DataFrame, split: Callable[[Column], Column] = T.sentences) -> DataFrame:
    """Claim rows of pages (doc_id, page_number, text)."""
    return classified(first_seen(with_reason(features(sentences(pages, split)))))


def drop_counts(reasoned: DataFrame) -> DataFrame:
    """doc_id, reason, n: how many sentences each document loses to each reason, repeated claims included.

    One pass: all but the first of a document's claims with the same text are its duplicates.
    """
    same = reasoned.groupBy("doc_id", "reason", F.when(F.col("reason").isNull(), F.col("low")).alias("claim")).agg(F.count("*").alias("n"))
    lost = same.select("doc_id", F.coalesce("reason", F.lit("duplicate")).alias("reason"), F.when(F.col("reason").isNull(), F.col("n") - 1).otherwise(F.col("n")).alias("n"))
    return lost.where("n > 0").groupBy("doc_id", "reason").agg(F.sum("n").alias("n"))


def type_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("Company", "Claim_Type").agg(F.count("*").alias("n"))


LEVELS = (("Company", "ESG_Type", "Claim_Type"), ("Company", "ESG_Type"), ("Company",), ("ESG_Type", "Claim_Type"), ("ESG_Type",), ("Claim_Type",), ())


def level_counts(rows: DataFrame, levels: tuple[tuple[str, ...], ...] = LEVELS) -> DataFrame:
    """level, Company, ESG_Type, Claim_Type, claims, pages, supported: one pass over the claims for all levels.

    ``level`` names the columns that a row is of, "all" for the total; the others are null in it.
    """
    names = list(dict.fromkeys(c for level in levels for c in level))
    named = F.concat_ws(",", *[F.when(F.grouping(c) == 0, F.lit(c)) for c in names])
    counts = [F.count("*").alias("claims"), F.count_distinct("Company", "Page").alias("pages"), F.count_if(F.col("Evidence_Exists") == "Yes").alias("supported")]
    found = rows.groupingSets([[F.col(c) for c in level] for level in levels], *names).agg(F.when(named == "", "all").otherwise(named).alias("level"), *counts)
    return found.select("level", *names, "claims", "pages", "supported")


def text_sketches(rows: DataFrame, *by: str, size: int = 12) -> DataFrame:
    """by, claims, sketch: how many claims, and a mergeable sketch of their different texts (2^size registers at most).

    Kept for each report, such sketches answer for any set of reports without reading claims again.
    """
    return rows.groupBy(*by).agg(F.count("*").alias("claims"), F.hll_sketch_agg(F.lower("Claim_Text"), F.lit(size)).alias("sketch"))


def merged_sketches(sketches: DataFrame, *by: str) -> DataFrame:
    """by, claims, distinct_texts: sketches of smaller groups put together; distinct_texts is an estimate."""
    return sketches.groupBy(*by).agg(F.sum("claims").alias("claims"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_texts"))


class Summary:
    """Totals of a run, observed while its claims are written; ask after that."""

    def __init__(self):
        self.sentences, self.rows = Observation(), Observation()

    def dropped(self) -> dict[str, int]:
        """Sentences lost to each reason that took any, repeated claims as "duplicate"."""
        seen = self.sentences.get
        counts = {r: seen[r] or 0 for r in REASONS} | {"duplicate": (seen["kept"] or 0) - (self.rows.get["claims"] or 0)}
        return {k: n for k, n in counts.items() if n}

    def types(self) -> dict[str, int]:
        return {t: n for t in CLAIM_TYPES if (n := self.rows.get[t] or 0)}


def observed(pages: DataFrame, split: Callable[[Column], Column] = T.sentences) -> tuple[DataFrame, Summary]:
    """The claims of ``claims`` and a summary that fills while they are written, so that pages are read once."""
    summary = Summary()
    reasons = [F.count_if(F.col("reason") == r).alias(r) for r in REASONS]
    reasoned = with_reason(features(sentences(pages, split))).observe(summary.sentences, F.count_if(F.col("reason").isNull()).alias("kept"), *reasons)
    kinds = [F.count_if(F.col("Claim_Type") == t).alias(t) for t in CLAIM_TYPES]
    return classified(first_seen(reasoned)).observe(summary.rows, F.count("*").alias("claims"), *kinds), summary
