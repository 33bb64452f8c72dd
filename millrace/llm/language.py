"""Language identification with error-correcting output codes over character n-grams.

Each language has a codeword; one binary logistic classifier for each bit, over hashed 1- to 3-grams of letters,
predicts that bit. Decoding weighs each bit's loss by how well its classifier does on its own sample and takes the
codeword with the least loss; a small lead over the second codeword flags the text as ambiguous. Classifiers are
fitted on a bounded sample (``per_language`` rows of each language); every text is read whole.

Defined cases: a null text, or one without a letter, is ``und`` with score 0. Rows with a null text or language
are not learned from. With one language learned, every text with a letter gets it with score 1; with none, all
texts are ``und``. Repeated rows are predicted alike.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField

from millrace.llm.common import table, with_columns

BUCKETS = 1 << 13
PIECE = 1 << 20  # code points looked at at a time
UNKNOWN = "und"


@dataclass
class Codes:
    languages: list[str]
    words: np.ndarray  # languages x bits of -1 and 1
    weights: np.ndarray  # buckets x bits
    bias: np.ndarray
    trust: np.ndarray  # of each bit


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n codewords of -1 and 1: the exhaustive code for up to 6 languages, else the best spread of some random codes."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 6:  # every split of the languages in two, once
        columns = [[1 if i == 0 or (k >> (i - 1)) & 1 else -1 for i in range(n)] for k in range(2 ** (n - 1) - 1)]
        return np.array(columns, float).T
    rng, best, spread = np.random.default_rng(seed), None, -1
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], size=(n, int(np.ceil(10 * np.log2(n)))))
        code = code[:, np.abs(code.sum(0)) < n]
        apart = (code[:, None, :] != code[None, :, :]).sum(-1)
        if (least := apart[~np.eye(n, dtype=bool)].min()) > spread:
            best, spread = code, least
    return best


def ngrams(text: str) -> np.ndarray:
    """Counts of hashed letter 1- to 3-grams in the whole text; everything but letters counts as one gap mark."""
    total = np.zeros(BUCKETS)
    for at in range(0, len(text), PIECE):
        piece = text[max(0, at - 2) : at + PIECE].lower()
        cp = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = ((cp >= 97) & (cp <= 122)) | ((cp >= 0xC0) & (cp != 0xD7) & (cp != 0xF7) & ((cp < 0x2000) | (cp > 0x2BFF)))
        cp = np.where(letter, cp, np.uint32(32))
        cp = cp[np.concatenate([[True], (cp[1:] != 32) | (cp[:-1] != 32)])] if len(cp) else cp
        one = cp * np.uint32(0x9E3779B1)
        two = (one[:-1] ^ (cp[1:] * np.uint32(0x85EBCA6B))) * np.uint32(0xC2B2AE35)
        three = (two[:-1] ^ (cp[2:] * np.uint32(0x27D4EB2F))) * np.uint32(0x165667B1)
        for grams in (one, two, three):
            total += np.bincount(grams >> np.uint32(19), minlength=BUCKETS)
    return total


def vector(text: str) -> np.ndarray | None:
    """The text's features, of length 1; None without a letter."""
    if not any(map(str.isalpha, text[:64])) and not any(map(str.isalpha, text)):
        return None
    counts = np.sqrt(ngrams(text))
    return counts / np.sqrt(counts @ counts)


def fit(rows: DataFrame, per_language: int = 600, sample_rows: int = 20_000, rounds: int = 200, l2: float = 1e-5) -> Codes | None:
    """Fit on ``rows`` (id, text, lang), at most about ``per_language`` of each language and ``sample_rows`` in all."""
    rows = rows.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    each = min(per_language, sample_rows / len(counts))
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, each / n))])
    picked = rows.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000).dropDuplicates(["id", "lang"]).select("lang", "text")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            got = [(k, v) for k, v in ((k, vector(x)) for k, x in zip(*(c.to_pylist() for c in batch.columns), strict=True)) if v is not None]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in got], pa.string()), pa.array([np.flatnonzero(v).astype("<u2").tobytes() for _, v in got], pa.binary()), pa.array([v[v > 0].astype("<f4").tobytes() for _, v in got], pa.binary())], ["lang", "ids", "vals"])

    sample = picked.mapInArrow(run, "lang string, ids binary, vals binary").collect()
    sample.sort(key=lambda r: (r["lang"], r["ids"]))
    languages = sorted({r["lang"] for r in sample})
    if not languages:
        return None
    x = np.zeros((len(sample), BUCKETS), np.float32)
    for i, r in enumerate(sample):
        x[i, np.frombuffer(r["ids"], "<u2")] = np.frombuffer(r["vals"], "<f4")
    return _train(x, np.array([languages.index(r["lang"]) for r in sample]), languages, rounds, l2)


def _train(x: np.ndarray, y: np.ndarray, languages: list[str], rounds: int, l2: float) -> Codes:
    """All bits at once by full-batch Adam on the logistic loss, languages weighing alike."""
    words = codewords(len(languages))
    target, weight = words[y], 1 / np.bincount(y)[y]
    weight = (weight / weight.sum())[:, None]
    w, b = np.zeros((BUCKETS, words.shape[1]), np.float32), np.zeros(words.shape[1])
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)
    for step in range(1, rounds + 1):
        miss = -target / (1 + np.exp(target * (x @ w + b))) * weight
        g, gb = x.T @ miss.astype(np.float32) + l2 * w, miss.sum(0)
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        up, down = 1 - 0.9**step, 1 - 0.99**step
        w -= (0.3 * (m / up) / (np.sqrt(v / down) + 1e-7)).astype(np.float32)
        b -= 0.3 * (mb / up) / (np.sqrt(vb / down) + 1e-7)
    right = (((x @ w + b) * target > 0) * weight).sum(0)
    return Codes(languages, words, w, b, np.clip(2 * right - 1, 0.01, 1))


def decode(model: Codes, outputs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the nearest codeword, its probability, lead over the second) for rows of bit outputs."""
    loss = (np.log1p(np.exp(-np.clip(model.words[None] * outputs[:, None, :], -30, 30))) * model.trust).sum(-1)
    p = np.exp(loss.min(1, keepdims=True) - loss)
    p /= p.sum(1, keepdims=True)
    order = np.sort(p, 1)
    second = order[:, -2] if p.shape[1] > 1 else np.zeros(len(p))
    return loss.argmin(1), order[:, -1], order[:, -1] - second


def predict(df: DataFrame, text: str, model: Codes | None, names: tuple[str, str, str] = ("lang_pred", "score", "ambiguous"), lead: float = 0.2) -> DataFrame:
    """``df`` with the predicted language, its probability, and whether the lead over the second is under ``lead``."""
    fields = [StructField(n, k) for n, k in zip(names, (StringType(), DoubleType(), BooleanType()), strict=True)]
    if model is None:
        return df.withColumns({names[0]: F.lit(UNKNOWN), names[1]: F.lit(0.0), names[2]: F.lit(True)})
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value

        def step(texts):
            out, seen = np.tile(m.bias, (len(texts), 1)), np.zeros(len(texts), bool)
            for i, t in enumerate(texts):
                if t is not None and (x := vector(t)) is not None:
                    out[i], seen[i] = x @ m.weights + m.bias, True
            best, p, ahead = decode(m, out)
            return [[m.languages[k] if s else UNKNOWN for k, s in zip(best, seen, strict=True)], np.where(seen, p, 0.0), ~seen | (ahead < lead)]

        return step

    return with_columns(df, text, fields, make)


def query(spark, sf_dir: str) -> DataFrame:
    """Learned where crc32(doc_id) mod 5 isn't 0, predicted for every document."""
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    model = fit(docs.where(~held).select(F.col("doc_id").alias("id"), "text", "lang"))
    out = predict(docs.select("doc_id", "text"), "text", model)
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "ambiguous")
