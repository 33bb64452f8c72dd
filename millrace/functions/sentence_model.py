"""Sentence ends learned from text alone: a stop doesn't end a sentence after an abbreviation, an initial or a number
where what follows speaks against it.

The model is unsupervised and follows published work on sentence boundary detection by log-likelihood ratios (Kiss and
Strunk, 2006). ``counted`` reads the texts once and leaves one row for each (word before a stop, word, its stop, its
case); everything else derives from that table by aggregations:

- abbreviations: words that occur with a stop far more often than words do, short ones, ones with stops inside;
- starters: words that follow sure sentence ends far more often than they occur;
- collocations: (abbreviation, initial, number or any word before a number, next word) that belong together;
- openers: words known in lower case that never are capitalised inside a sentence, so a capital means a beginning.

Repeated pages look like as many observations; where a corpus has many, learn from its distinct texts.

The four lists are small by nature (openers are kept only where an abbreviation, an initial or a number stands before
them); they are held on the driver and become sets in column functions, so cutting texts needs no join and no Python.
``most`` bounds each list: a corpus that gives a longer one raises, as its thresholds are too low for it.

A null text gives null, an empty one a single empty sentence, as with the plain pattern; a model without entries cuts
as the pattern does, but for stops after initials and, before lower case, after numbers. The control character U+0001 counts as white space.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from millrace.functions import text as T

# Fixed values of the method: least scores, and the probability of a stop after an abbreviation.
ABBREVIATION, COLLOCATION, STARTER = 0.3, 7.88, 30.0
AFTER_ABBREVIATION = 0.99

MARK = "\x01"
NUMBER = "#"
_BARE = r"(?s)[\p{L}\p{N}](?:.*[\p{L}\p{N}])?"
_WORD = r"[\p{L}\p{N}]"
_DIGITS = r"^[\p{N}.,:/-]*\p{N}[\p{N}.,:/-]*$"


def word_of(token: Column) -> Column:
    """A token without signs before it and without its last stop, in lower case; numbers are alike; '' without letter or digit."""
    return _or_number(_bare(token))


def _bare(token: Column) -> Column:
    return F.regexp_extract(F.lower(token), _BARE, 0)


def _or_number(bare: Column) -> Column:
    return F.when(F.rlike(bare, F.lit(_DIGITS)), NUMBER).otherwise(bare)


def _one_of_its_shape(token: Column) -> Column:
    """A number with each digit as 0: its word, ending and case are the same, and far fewer differ. Other tokens stay."""
    number = F.left(token, F.lit(1)).between("0", "9") & (F.translate(token, "0123456789.,:/-", "") == "")
    return F.when(number, F.translate(token, "123456789", "000000000")).otherwise(token)


def ending_of(token: Column) -> Column:
    """'.' after a letter or digit, '!' for what surely ends a sentence, or ''."""
    return F.when(F.rlike(token, F.lit(r"[\p{L}\p{N}]\.$")), ".").when(F.rlike(token, F.lit(r"[.!?]$")), "!").otherwise("")


def case_of(token: Column) -> Column:
    first = F.regexp_extract(token, r"\p{L}|\p{N}", 0)
    return F.when(F.rlike(first, F.lit(r"\p{Lu}")), "upper").when(F.rlike(first, F.lit(r"\p{Ll}")), "lower").otherwise("other")


def counted(texts: DataFrame) -> DataFrame:
    """before, ended, word, stop, case, n of the column ``text``: each token with what ends the one before it.

    ``before`` is the word before where that has a stop, else '' (also at a text's start, whose ``ended`` is '!').
    """
    tokens = F.filter(F.split(F.replace(F.col("text"), F.lit(MARK), F.lit(" ")), T.SPACE), lambda t: t != "")
    rows = texts.select(tokens.alias("t")).where(F.size("t") > 0).select("t", F.posexplode("t").alias("i", "token"))
    # Patterns are matched once for each different token, numbers by their shape, as a corpus has ever more of them; what
    # stands before matters only where it may end a sentence.
    previous = F.when(F.col("i") > 0, F.element_at("t", F.col("i"))).otherwise("!")  # element_at counts from one
    kept = F.explode(F.array(previous)).alias("p")
    tokens = rows.select("token", kept).select("token", F.when(F.right("p", F.lit(1)).isin(".", "!", "?"), F.col("p")).otherwise("").alias("p"))
    tokens = tokens.select(_one_of_its_shape(F.col("token")).alias("token"), _one_of_its_shape(F.col("p")).alias("p")).groupBy("token", "p").agg(F.count("*").alias("n"))
    ended = ending_of(F.col("p"))
    shaped = tokens.select(F.when(ended == ".", word_of(F.col("p"))).otherwise("").alias("before"), ended.alias("ended"), word_of(F.col("token")).alias("word"), (ending_of(F.col("token")) == ".").alias("stop"), case_of(F.col("token")).alias("case"), "n")
    return shaped.groupBy("before", "ended", "word", "stop", "case").agg(F.sum("n").alias("n"))


def likelihood(k: Column, n: Column, p: Column) -> Column:
    """log of p^k (1 - p)^(n - k), with the ends of p kept off 0 and 1."""
    p = F.least(F.greatest(p, F.lit(1e-10)), F.lit(1 - 1e-10))
    return k * F.ln(p) + (n - k) * F.ln(1 - p)


def association(both: Column, first: Column, second: Column, total: Column) -> Column:
    """Dunning's ratio: does ``second`` follow ``first`` more often than it occurs?"""
    rest, elsewhere = F.greatest(total - first, F.lit(0)), F.greatest(second - both, F.lit(0))
    alone, beside, without = second / total, both / first, F.when(rest > 0, elsewhere / rest).otherwise(F.lit(0.0))
    return -2 * (likelihood(both, first, alone) + likelihood(elsewhere, rest, alone) - likelihood(both, first, beside) - likelihood(elsewhere, rest, without))


def abbreviations(counts: DataFrame) -> DataFrame:
    """word, score of words that a stop belongs to."""
    words = counts.where("word <> ''").groupBy("word").agg(F.sum(F.when(F.col("stop"), F.col("n")).otherwise(0)).alias("k"), F.sum("n").alias("n"))
    stops, tokens = (float(x or 0) for x in words.agg(F.sum("k"), F.sum("n")).first())
    length = F.length(F.replace("word", F.lit("."), F.lit(""))).cast("double")
    inner = F.length("word") - length + 1
    n, k = F.col("n").cast("double"), F.col("k").cast("double")
    ratio = -2 * (likelihood(k, n, F.lit(stops / max(tokens, 1.0))) - likelihood(k, n, F.lit(AFTER_ABBREVIATION)))
    score = ratio * inner * F.exp(-length) * F.exp(-(n - k) * F.ln(length))
    candidates = words.where((F.col("k") > 0) & F.rlike("word", F.lit(r"\p{L}")) & ~single(F.col("word")))
    return candidates.select("word", score.alias("score")).where(F.col("score") >= ABBREVIATION)


def single(word: Column) -> Column:
    """Whether a word is one letter: an initial."""
    return F.rlike(word, F.lit(r"^\p{L}$"))


@dataclass
class SentenceModel:
    abbreviations: list[str] = field(default_factory=list)
    starters: list[str] = field(default_factory=list)
    collocations: list[tuple[str, str]] = field(default_factory=list)
    openers: list[str] = field(default_factory=list)

    def split(self, text: Column) -> Column:
        """A text's sentences, as ``text.sentences`` gives them but for ends that the model takes away."""
        marked = F.regexp_replace(F.replace(text, F.lit(MARK), F.lit(" ")), r"(?U)(?<=[.!?])(\s+)", f"{MARK}$1{MARK}")
        pieces = F.split(marked, MARK)  # text, space, text, space, ..
        return T.let(pieces, lambda p: F.split(F.array_join(F.transform(p, lambda x, i: F.when((i % 2 == 1) & self.ends(p[i - 1], p[i + 1]), F.lit(MARK)).otherwise(x)), ""), MARK))

    def ends(self, before: Column, after: Column) -> Column:
        """Whether a sentence ends between two pieces of text.

        Each part is computed once and what follows only where the word before can speak against an end: inside lambdas Spark
        computes a part anew wherever it stands.
        """
        firsts = sorted({*self.abbreviations, *(before for before, _ in self.collocations)})
        last, first = F.regexp_extract(before, r"(?U)(?<!\S)(\S++)$", 1), F.regexp_extract(after, r"(?U)^(\S+)", 1)

        def told(word: Column) -> Column:
            asks = _among(word, firsts) | single(word) | (word == NUMBER)
            return F.when(asks, T.let(first, lambda x: T.let(F.struct(_word(x).alias("w"), case_of(x).alias("c")), lambda y: self._goes_on(word, y["w"], y["c"])))).otherwise(False)

        return T.let(last, lambda x: F.when(ending_of(x) == ".", ~T.let(_word(x), told)).otherwise(True))

    def _goes_on(self, word: Column, following: Column, case: Column) -> Column:
        """Whether a stop after ``word`` is none of a sentence's end where ``following`` comes next."""
        opens = (case == "upper") & _among(following, self.openers)
        starts = (case == "upper") & (_among(following, self.starters) | opens)
        together = _among(F.concat(word, F.lit(" "), following), [" ".join(c) for c in self.collocations]) & ~opens
        initial = single(word) | (word == NUMBER)
        stays = F.when(_among(word, self.abbreviations), ~starts).when(initial, (case == "lower") | (single(word) & (case == "upper") & ~starts))
        return together | F.coalesce(stays, F.lit(False))


def _word(token: Column) -> Column:
    """``word_of`` for use inside a lambda."""
    return T.let(_bare(token), _or_number)


def _among(word: Column, words: list[str]) -> Column:
    return word.isin(words) if words else F.lit(False)


def lists(counts: DataFrame) -> dict[str, DataFrame]:
    """The model's four lists as tables, from the counts."""
    found = abbreviations(counts).select("word")
    known = found.select(F.col("word").alias("before"), F.lit(True).alias("abbreviated"))
    after = counts.where(F.col("ended") != "").join(known, "before", "left").withColumn("abbreviated", F.coalesce("abbreviated", F.lit(False)))
    unsure = F.col("abbreviated") | (F.col("before") == NUMBER) | single(F.col("before"))
    sure = after.where((F.col("ended") == "!") | ~unsure)
    total, breaks = (float(x.agg(F.sum("n")).first()[0] or 0) for x in (counts, sure))

    def counting(of: Column) -> Column:
        return F.sum(F.when(of, F.col("n")).otherwise(0))

    def tied(first: Column, least: float) -> Column:
        both, second = F.col("both").cast("double"), F.col("second").cast("double")
        return (association(both, first.cast("double"), second, F.lit(total)) >= least) & (both / first > second / total)

    of = counts.groupBy("word").agg(F.sum("n").alias("second"), counting(F.col("case") == "lower").alias("lower"), counting((F.col("case") == "upper") & (F.col("ended") == "")).alias("inside"))
    begun = sure.where(F.rlike("word", F.lit(r"\p{L}"))).groupBy("word").agg(F.sum("n").alias("both"))
    starters = begun.join(of, "word").where(tied(F.lit(breaks), STARTER)).select("word")

    pairs = after.where((F.col("ended") == ".") & (F.col("word") != "") & (F.col("before") != "") & (unsure | (F.col("word") == NUMBER))).groupBy("before", "word").agg(F.sum("n").alias("both"))
    firsts = counts.where("stop and word <> ''").groupBy(F.col("word").alias("before")).agg(F.sum("n").alias("first"))
    rated = pairs.where("both > 1").join(firsts, "before").join(of, "word").join(starters, "word", "left_anti")
    collocations = rated.where(tied(F.col("first"), COLLOCATION)).select("before", "word")

    met = after.where(unsure & (F.col("ended") == ".") & (F.col("case") == "upper")).select("word").distinct()
    openers = met.join(of, "word").where("lower > 0 and inside = 0").select("word")
    return {"abbreviations": found, "starters": starters, "collocations": collocations, "openers": openers}


def learned(texts: DataFrame, keep: Callable[[DataFrame, str], DataFrame], most: int = 100_000) -> SentenceModel:
    """The model of the column ``text``. ``keep`` writes a table and reads it back, as ``sinks.kept`` does."""
    tables = lists(keep(counted(texts), "sentence-counts"))
    found = {}
    for name, table in tables.items():
        rows = table.limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"over {most} {name}: the corpus needs higher thresholds")
        found[name] = sorted(tuple(r) if len(r) > 1 else r[0] for r in rows)
    return SentenceModel(**found)
