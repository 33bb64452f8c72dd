"""Versions of the rules, run side by side in one pass over the sentences, and what changes from one to the next.

A version is the reasons it drops sentences for, the topics that let a sentence in, and how it tells the topic. All
versions read the same features and tests, each computed once; a document's repeated sentences are told apart once too, as
every version decides by the text alone.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from millrace.functions.lexicon import any_of, hits
from millrace.operators import claims as K

TOPICS = ["E", "S", "G"]


@dataclass(frozen=True)
class Version:
    name: str
    reasons: tuple[str, ...]
    every_topic: bool = True  # or the environment alone lets a sentence in
    plain_topic: bool = False  # most hits decide, the environment where none has more


_FIRST = ("length", "not_assertion", "boilerplate", "reference_dense")
_SECOND = (*_FIRST, "navigation", "methodology", "general_statement", "risk_description")
VERSIONS = (Version("v1", _FIRST, every_topic=False, plain_topic=True), Version("v2", _SECOND), Version("v2.1", K.REASONS))


def plain_topic(low: Column) -> Column:
    """The topic with more hits than the environment's; people before governance where they are equal."""
    e, s, g = K.environment_hits(low), hits(low, "social_keywords"), hits(low, "governance_keywords")
    return F.when((s > e) & (s >= g), "S").when(g > e, "G").otherwise("E")


def judged(feats: DataFrame, versions: Sequence[Version] = VERSIONS) -> DataFrame:
    """``feats`` with ``by``: version -> (reason or null, topic)."""
    low, quantity = F.col("low"), F.col("quantity")
    tests = K.predicates(F.col("s"), low, F.col("words"), quantity)
    tests["no_environment"] = ~((quantity | any_of(low, "action_keywords")) & (K.environment_hits(low) > 0))
    tests |= {"strong": K.esg_type(low), "plain": plain_topic(low)}
    # A generator's output is computed once; each test has a generator of its own, as code for all in one grows too long to compile.
    once = reduce(lambda df, k: df.select("*", F.explode(F.array(tests[k])).alias(f"_{k}")), tests, feats)

    def reason(v: Version) -> Column:
        name = {"not_assertion": "not_assertion" if v.every_topic else "no_environment"}
        return F.coalesce(*[F.when(F.col(f"_{name.get(r, r)}"), F.lit(r)) for r in v.reasons])

    each = [F.struct(reason(v).alias("reason"), F.col("_plain" if v.plain_topic else "_strong").alias("topic")).alias(v.name) for v in versions]
    return once.withColumn("by", F.struct(*each)).drop(*[f"_{k}" for k in tests])


def first_of(judged_rows: DataFrame, versions: Sequence[Version] = VERSIONS) -> DataFrame:
    """Sentences that a version keeps, each text once for each document."""
    kept = judged_rows.where(reduce(Column.__or__, [_reason(v).isNull() for v in versions]))
    order = Window.partitionBy("doc_id", "low").orderBy("page_number", "sent_idx")
    return kept.withColumn("seen", F.row_number().over(order)).where("seen = 1").drop("seen")


def _reason(v: Version) -> Column:
    return F.col(f"by.`{v.name}`.reason")


def claims(first: DataFrame, versions: Sequence[Version] = VERSIONS) -> DataFrame:
    """version, doc_id, page_number, sent_idx, text, topic: the claims of each version."""
    each = F.array(*[F.when(_reason(v).isNull(), F.struct(F.lit(v.name).alias("version"), F.col(f"by.`{v.name}`.topic").alias("topic"))) for v in versions])
    rows = first.select("doc_id", "page_number", "sent_idx", F.col("s").alias("text"), F.explode(F.array_compact(each)).alias("v"))
    return rows.select("v.version", "doc_id", "page_number", "sent_idx", "text", "v.topic")


def progress(versioned: DataFrame) -> DataFrame:
    """version, E, S, G, claims: how many claims each version makes of each topic."""
    table = versioned.groupBy("version").pivot("topic", TOPICS).agg(F.count(F.lit(1))).na.fill(0, TOPICS)
    return table.withColumn("claims", reduce(Column.__add__, map(F.col, TOPICS)))


def changes(first: DataFrame, versions: Sequence[Version] = VERSIONS) -> DataFrame:
    """older, newer, change, topic, detail, n of each version and the next.

    A claim is ``gained`` (detail: why the older dropped it), ``lost`` (why the newer drops it), ``relabelled``
    (its new topic) or ``kept``; topic is the older version's, the newer's where it is gained.
    """

    def step(a: Version, b: Version) -> Column:
        was, now = _reason(a), _reason(b)
        old, new = F.col(f"by.`{a.name}`.topic"), F.col(f"by.`{b.name}`.topic")
        change = F.when(was.isNotNull() & now.isNull(), F.struct(F.lit("gained").alias("change"), new.alias("topic"), was.alias("detail")))
        change = change.when(was.isNull() & now.isNotNull(), F.struct(F.lit("lost").alias("change"), old.alias("topic"), now.alias("detail")))
        change = change.when(was.isNull() & (old != new), F.struct(F.lit("relabelled").alias("change"), old.alias("topic"), new.alias("detail")))
        change = change.when(was.isNull(), F.struct(F.lit("kept").alias("change"), old.alias("topic"), F.lit("").alias("detail")))
        return F.struct(F.lit(a.name).alias("older"), F.lit(b.name).alias("newer"), change.alias("c"))

    each = first.select(F.explode(F.array(*[step(a, b) for a, b in zip(versions, versions[1:], strict=False)])).alias("x")).where("x.c is not null")
    return each.groupBy("x.older", "x.newer", "x.c.change", "x.c.topic", "x.c.detail").agg(F.count("*").alias("n"))
