"""Evaluation of labelled rows: precision, kinds of error, recall on gold rows, agreement of judges, supported claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from millrace.functions import text as T
from millrace.sources import derived, sinks

TOKEN = r"[\p{L}\p{N}]+"


def judgements(spark, sf_dir: str) -> DataFrame:
    """quality and toxic labels with the language and source of the document they judge."""
    docs = derived.table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return derived.table(spark, sf_dir, "labels").join(docs, "doc_id")


def precision(judged: DataFrame, by: str) -> DataFrame:
    return judged.groupBy(by).agg(F.count("*").alias("judged"), F.avg(F.col("quality").cast("double")).alias("precision"))


def error_kinds(judged: DataFrame, by: str) -> DataFrame:
    wrong, abusive = F.sum((F.col("quality") == 0).cast("long")), F.sum((F.col("toxic") == 1).cast("long"))
    return judged.groupBy(by).agg(wrong.alias("rejected"), abusive.alias("abusive"), F.count("*").alias("judged"))


def pivoted(judged: DataFrame, by: str, over: str, values: list[str]) -> DataFrame:
    """Accepted rows of each group, a column for each of the given values."""
    return judged.where("quality = 1").groupBy(by).pivot(over, values).agg(F.count(F.lit(1))).na.fill(0, values)


def contingency(rows: DataFrame, first: str, second: str, *by: str) -> DataFrame:
    """How often each pair of answers is given, nulls included."""
    return rows.groupBy(*by, F.col(first).alias("first"), F.col(second).alias("second")).agg(F.count("*").alias("n"))


def agreement(rows: DataFrame, first: str, second: str, by: str) -> DataFrame:
    """by, rows, paired, observed, kappa, alpha: how far two judges' answers to the same question agree.

    Cohen's kappa and Krippendorff's alpha for nominal answers, over the rows that both have judged. One aggregation of
    the rows; the rest is made from its counts, a row for each pair of answers. Both are null where chance alone
    would give full agreement, as with one answer only, or where no row has two answers.
    """
    cells = contingency(rows, first, second, by)
    paired = cells.where("first is not null and second is not null")
    none = F.lit(0).cast("long")
    side = lambda answer, a, b: F.struct(F.col(answer).alias("answer"), a.alias("a"), b.alias("b"))
    each = paired.select(by, F.explode(F.array(side("first", F.col("n"), none), side("second", none, F.col("n")))).alias("x")).select(by, "x.*")
    shares = each.groupBy(by, "answer").agg(F.sum("a").cast("double").alias("a"), F.sum("b").cast("double").alias("b"))
    chance = shares.groupBy(by).agg(F.sum(F.col("a") * F.col("b")).alias("cross"), F.sum((F.col("a") + F.col("b")) ** 2).alias("square")).withColumnRenamed(by, "by_")
    both = F.when(F.col("first").isNotNull() & F.col("second").isNotNull(), F.col("n")).otherwise(0)
    counted = cells.groupBy(by).agg(F.sum("n").alias("rows"), F.sum(both).alias("paired"), F.sum(F.when(F.col("first") == F.col("second"), F.col("n")).otherwise(0)).alias("same"))
    n = F.col("paired").cast("double")
    found = counted.join(chance, F.col(by).eqNullSafe(F.col("by_")), "left")
    observed, expected = _ratio(F.col("same").cast("double"), n), _ratio(F.col("cross"), n * n)
    kappa = _ratio(observed - expected, 1 - expected)
    alpha = 1 - _ratio((2 * n - 1) * 2 * (n - F.col("same")), 4 * n * n - F.col("square"))
    return found.select(by, "rows", "paired", observed.alias("observed"), kappa.alias("kappa"), alpha.alias("alpha"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def reliability(ratings: DataFrame, by: str) -> DataFrame:
    """by, units, answers, alpha: Krippendorff's alpha of any number of judges over ratings (by, unit, answer).

    Nominal answers, missing ones null; units with fewer than two answers can't be compared and don't count. Null where no
    disagreement could be expected.
    """
    cells = ratings.where(F.col("answer").isNotNull()).groupBy(by, "unit", "answer").agg(F.count("*").cast("double").alias("n"))
    units = cells.groupBy(by, "unit").agg(F.sum("n").alias("m"), F.sum(F.col("n") ** 2).alias("square"), F.collect_list(F.struct("answer", "n")).alias("given")).where("m > 1")
    apart = units.groupBy(by).agg(F.count("*").alias("units"), F.sum("m").alias("m"), F.sum((F.col("m") ** 2 - F.col("square")) / (F.col("m") - 1)).alias("apart"))
    totals = units.select(by, F.explode("given").alias("g")).groupBy(by, "g.answer").agg(F.sum("g.n").alias("n")).groupBy(F.col(by).alias("by_")).agg(F.sum(F.col("n") ** 2).alias("square"))
    found = apart.join(totals, F.col(by).eqNullSafe(F.col("by_")))
    return found.select(by, "units", F.col("m").cast("long").alias("answers"), (1 - _ratio((F.col("m") - 1) * F.col("apart"), F.col("m") ** 2 - F.col("square"))).alias("alpha"))


def tokens(text: Column) -> Column:
    """Different words and numbers of a text, in any case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(T.clean(text)), F.lit(f"({TOKEN})"), 1))


def found_gold(gold: DataFrame, claims: DataFrame, keys: list[str], least: int = 80) -> DataFrame:
    """Gold rows (keys, gold_id, text, ..) with the claim of the same keys that matches best: ``found``, ``as_topic``.

    A claim (keys, text, topic) matches if it holds at least ``least`` percent of the gold row's different words, so an
    annotator's shortened or recased copy is found; of several matches that with most words in common wins, then the
    first in order. Candidates come from an inverted index of the claims' words: to hold that many words a
    claim must have one of a gold row's rarest n - ceil(least n / 100) + 1, so only those are looked up. Rows with no word
    are never found. Claims are costly to make and used three times, so they are written to the scratch folder once.
    """
    words = claims.select(*keys, F.xxhash64("text").alias("claim"), tokens(F.col("text")).alias("words"), F.col("text").alias("claim_text"), F.col("topic").alias("as_topic")).distinct()
    words = sinks.kept(words, "claim-words")
    index = words.select(*keys, "claim", F.explode("words").alias("word"))
    often = index.groupBy("word").agg(F.count("*").alias("uses"))
    asked = gold.select(*keys, "gold_id", tokens(F.col("text")).alias("wanted"))
    # A gold row's words that no claim holds are its rarest; they find nothing but count among the prefix.
    rated = asked.select(*keys, "gold_id", "wanted", F.explode("wanted").alias("word")).join(often, "word", "left")
    ranked = rated.groupBy(*keys, "gold_id").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("uses", F.lit(0)).alias("uses"), "word"))).alias("r"), F.first("wanted").alias("wanted"))
    n = F.size("wanted")
    prefix = F.slice("r", F.lit(1), n - F.ceil(n * least / F.lit(100)).cast("int") + 1)
    looked = ranked.select(*keys, "gold_id", "wanted", F.explode(F.transform(prefix, lambda x: x["word"])).alias("word"))
    candidates = looked.join(index, [*keys, "word"]).select(*keys, "gold_id", "wanted", "claim").distinct()
    held = F.size(F.array_intersect("wanted", "words"))
    matches = candidates.join(words, [*keys, "claim"]).withColumn("held", held).where(F.col("held") * 100 >= F.size("wanted") * least)
    best = matches.groupBy(*keys, "gold_id").agg(F.min_by("as_topic", F.struct(-F.col("held"), F.col("claim_text"))).alias("as_topic"))
    return gold.join(best.withColumn("found", F.lit(True)), [*keys, "gold_id"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def recall(found: DataFrame, *by: str) -> DataFrame:
    """by, real, found, recall, admitted, precision, typed: of gold rows with ``is_real``, ``topic``, ``found`` and ``as_topic``.

    recall is the share of real rows that are found, precision that of real rows among those found, typed the share
    of found real rows with the annotators' topic. Rows that aren't judged (``is_real`` null) don't count.
    """
    real, hit = F.col("is_real"), F.col("found")
    right = F.when(real & hit, (F.col("topic") == F.col("as_topic")).cast("double"))
    counts = found.where(real.isNotNull()).groupBy(*by).agg(
        F.count_if(real).alias("real"), F.count_if(real & hit).alias("found"), F.avg(F.when(real, hit.cast("double"))).alias("recall"), F.count_if(~real & hit).alias("admitted"), F.avg(F.when(hit, real.cast("double"))).alias("precision"), F.avg(right).alias("typed")
    )
    return counts.select(*by, "real", "found", "recall", "admitted", "precision", "typed")


def supported(claims: DataFrame) -> DataFrame:
    """Claims of each company and the share with full evidence."""
    return claims.groupBy("Company").agg(F.count("*").alias("found"), F.avg((F.col("Evidence_Exists") == "Yes").cast("double")).alias("supported"))
