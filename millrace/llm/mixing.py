"""Soft-membership mixing: document rates whose expected domain token totals match targets.

A naive Bayes table of words by domain, learned from a bounded sample of labelled rows, gives each document a
posterior over domains. Document rates r >= 0 then minimise the weighted squares of A r - t, where row k of A holds
each document's expected tokens of domain k and t the targets. Projected gradient steps do this over the whole
table: a job adds up the residual of each domain, and the next rates are max(0, r - sum_k p_k residual_k / total_k),
the gradient scaled by each document's tokens and each domain's total, for which a step of 1 is safe.

Everything is DataFrame and SQL functions; the driver sees a few numbers for each domain.

Defined cases: a null or empty text has no tokens and the labelled rows' shares as its posterior; rows with a null
domain or text are not learned from; with no labelled row there are no domains and every rate is 1; a domain
without tokens can't be raised and is left out of the match; repeated rows each count with their tokens, and rows
that repeat a doc_id are mixed alike.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from millrace.llm.common import fresh, table, written


def words_of(text: Column) -> Column:
    return F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+")


def learned(rows: DataFrame, per_domain: int = 1500, words: int = 4096, least_docs: int = 5) -> tuple[list[str], list[float], DataFrame] | None:
    """(domains, their shares, table of word and w0, w1, ...: log-likelihood in each domain, centred).

    ``rows`` has id, text and domain. At most about ``per_domain`` rows of each domain are learned from, and the
    ``words`` words found in most of them are kept, so the table is small enough to send to every task.
    """
    rows = rows.where(F.col("text").isNotNull() & F.col("domain").isNotNull())
    counts = {r["domain"]: r["n"] for r in rows.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    domains = sorted(counts)
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, per_domain / n))])
    picked = rows.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < share[F.col("domain")] * 1_000_000)
    seen = picked.select("domain", F.explode(F.array_distinct(words_of(F.col("text")))).alias("word")).where("word <> ''")
    n = [F.sum((F.col("domain") == d).cast("double")).alias(f"n{k}") for k, d in enumerate(domains)]
    kept = written(seen.groupBy("word").agg(F.count("*").alias("docs"), *n).where(F.col("docs") >= least_docs).orderBy(F.desc("docs"), "word").limit(words), "domain-words")
    total = kept.agg(F.count("*").alias("v"), *[F.sum(f"n{k}").alias(f"t{k}") for k in range(len(domains))]).first()
    logs = [F.log((F.col(f"n{k}") + 0.5) / F.lit((total[f"t{k}"] or 0.0) + 0.5 * max(1, total["v"]))) for k in range(len(domains))]
    mean = reduce(Column.__add__, logs) / len(domains)
    whole = sum(counts.values())
    return domains, [counts[d] / whole for d in domains], kept.select("word", *[(x - mean).alias(f"w{k}") for k, x in enumerate(logs)])


def posteriors(docs: DataFrame, model: tuple[list[str], list[float], DataFrame]) -> DataFrame:
    """id, n_tokens and p0, p1, ... for each row of docs (id, text): its words looked up in the table and added up."""
    domains, shares, weights = model
    rows = docs.select("id", "text", F.monotonically_increasing_id().alias("row"))
    each = rows.select("id", "row", F.explode(words_of(F.col("text"))).alias("word"))
    found = each.join(F.broadcast(weights), "word", "left")  # learned() bounds the table
    sums = [F.coalesce(F.sum(f"w{k}"), F.lit(0.0)).alias(f"s{k}") for k in range(len(domains))]
    added = found.groupBy("row", "id").agg(F.count(F.when(F.col("word") != "", 1)).alias("n_tokens"), *sums)
    score = [F.col(f"s{k}") + F.log(F.lit(shares[k])) for k in range(len(domains))]
    top = F.greatest(*score) if len(score) > 1 else score[0]
    mass = added.select("id", "n_tokens", *[F.exp(x - top).alias(f"e{k}") for k, x in enumerate(score)])
    return mass.select("id", "n_tokens", *[(F.col(f"e{k}") / reduce(Column.__add__, [F.col(f"e{j}") for j in range(len(domains))])).alias(f"p{k}") for k in range(len(domains))])


def tempered(totals: list[float], power: float = 0.7, grow: bool = False, margin: float = 1.05) -> list[float]:
    """Targets in the ratio of the totals to a power, with the same sum: large domains shrink and small ones grow.

    ``grow`` makes them large enough that no domain has to shrink; the margin then keeps the rate of every document
    over 1 where posteriors are a little off, so none is left out.
    """
    weight = [x**power for x in totals]
    if not grow:
        return [w * sum(totals) / sum(weight) if sum(weight) else 0.0 for w in weight]
    scale = max((x / w for x, w in zip(totals, weight, strict=True) if w > 0), default=0.0)
    return [w * scale * margin for w in weight]


def matched(soft: DataFrame, k: int, targets: list[float] | None = None, grow: bool = False, tolerance: float = 1e-6, most: int = 1000, at_once: int = 8) -> DataFrame:
    """soft (id, n_tokens, p0 ...) with the column ``rate``; targets default to ``tempered`` totals.

    Steps end where the targets are met or, as they can't all be, where a projected step moves no rate; without either
    after ``most`` steps this raises.
    """

    def totals(df: DataFrame) -> list[float]:
        row = df.agg(*[F.coalesce(F.sum(F.col("n_tokens") * F.col(f"p{j}") * F.col("rate")), F.lit(0.0)) for j in range(k)]).first()
        return list(row)

    soft = soft.withColumn("rate", F.lit(1.0))
    base = totals(soft)
    targets = tempered(base, grow=grow) if targets is None else targets
    rate, fixed = F.col("rate"), soft
    for step in range(1, most + 1):
        have = totals(fixed.withColumn("rate", rate))
        miss = [(h - t) / b if b > 0 else 0.0 for h, t, b in zip(have, targets, base, strict=True)]
        if max(map(abs, miss), default=0.0) <= tolerance:
            return fixed.withColumn("rate", rate)
        down = reduce(Column.__add__, [F.col(f"p{j}") * F.lit(m) for j, m in enumerate(miss)])
        if step % at_once == 1 and fixed.withColumn("rate", rate).agg(F.max(F.abs(F.least("rate", down)))).first()[0] <= tolerance:
            return fixed.withColumn("rate", rate)
        rate = F.greatest(F.lit(0.0), rate - down)
        if step % at_once == 0:  # else the expression would grow with each step
            fixed, rate = written(fixed.withColumn("rate", rate), "rates"), F.col("rate")
    raise RuntimeError(f"rates are still moving after {most} steps; the largest share missed of a domain is {max(map(abs, miss)):.3g}")


def rates(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | None = None, grow: bool = False) -> tuple[DataFrame, list[str]]:
    """(id, n_tokens, p0 ..., rate) of docs (id, text), and the domains in the order of p0 ...

    ``labelled`` has id, text and domain; ``targets`` gives the tokens wanted of each domain, by default ``tempered``.
    """
    model = learned(labelled)
    if model is None:
        none = docs.select("id", F.size(F.filter(words_of(F.col("text")), lambda w: w != "")).cast("long").alias("n_tokens"))
        return none.withColumn("rate", F.lit(1.0)), []
    soft = written(posteriors(docs, model), "posteriors")
    return matched(soft, len(model[0]), None if targets is None else [targets.get(d, 0.0) for d in model[0]], grow), model[0]


def labelled_rows(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the labels table rates as readable, with their language as domain."""
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id").distinct()
    return docs.join(good, "doc_id", "left_semi").select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("domain"))


def query(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, domain (the likeliest), its probability and the document's rate, for tempered targets of the same sum."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found, domains = rates(docs.select(F.col("doc_id").alias("id"), "text"), labelled_rows(spark, docs, sf_dir))
    if not domains:
        return found.select(F.col("id").alias("doc_id"), "n_tokens", F.lit(None).cast("string").alias("domain"), F.lit(None).cast("double").alias("p_domain"), "rate")
    top = F.array_max(F.array(*[F.struct(F.col(f"p{k}").alias("p"), F.lit(d).alias("d")) for k, d in enumerate(domains)]))
    return found.select(F.col("id").alias("doc_id"), "n_tokens", top["d"].alias("domain"), top["p"].alias("p_domain"), "rate")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as their rates say: the whole part of a rate, and once more by chance for the rest.

    The targets let no domain shrink, as what the stages before kept is to stay.

    The chance is a hash of the doc_id, so that the outcome is the same on every run.
    """
    found, _ = rates(docs.select(F.col("doc_id").alias("id"), "text"), labelled_rows(spark, docs, sf_dir), grow=True)
    rate, draw = F.round("rate", 3), F.pmod(F.xxhash64("id", F.lit("copies")), F.lit(1_000_000)) / 1_000_000
    wanted = found.groupBy("id").agg(F.min("rate").alias("rate")).select("id", (F.floor(rate) + (draw < rate - F.floor(rate)).cast("int")).cast("int").alias("copies"))
    n, key = fresh(docs, "copies"), fresh(docs, "id_")
    joined = docs.join(wanted.select(F.col("id").alias(key), F.col("copies").alias(n)), F.col(key).eqNullSafe(docs["doc_id"]))
    return joined.select(*docs.columns, F.explode(F.array_repeat(F.lit(1), F.col(n)))).select(*docs.columns)
