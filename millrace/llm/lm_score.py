"""Language-model scores: a hashed maximum-entropy model of words in classes and sub-classes.

p(word | context) = p(class | context) * p(sub-class | class, context) * p(word | sub-class). Both softmaxes are
log-linear models over hashed features: the word before, the second and the third word before, the two words before
together, and a constant; the features of the second are hashed with the class. A word has its share of its sub-class's
count. The ``HEAD`` most frequent words are classed by what stands beside them, and the words of a class again into its
sub-classes. All others, unknown ones too, form the last class, whose sub-classes are forms (how a word ends and its
length), with add-one counts: so every word has a context-dependent class, however many words there are. The number of
feature buckets grows with the square root of the training tokens.

Texts are cut into words once: the table of codes that this gives is what the counting, neighbour, training and
scoring passes read. Counts, neighbours and weights are learned from all training texts. The weights are trained by
distributed gradient updates: in each round every task starts from the shared weights, takes AdaGrad steps over its
own texts in sparse numpy batches, and the tasks' weights are averaged for each feature by how often each task has
seen it. The number of these replicas follows from the training tokens (``replica_tokens``), not from the cluster; which
texts a replica reads, and in which order, follows from the input's files and splits. Classes and sub-classes without a
word have no share, so the probabilities of all words, with one unknown word of each form, add up to one. The head fits in every task; the counts of all other words are joined by word.

Tokens are runs of bytes other than ASCII white space, A to Z lower-cased, and one end for each text. Words are told
apart by 58 bits of a hash. Base scores are add-one unigram log10 probabilities over the same counts.

Defined cases: a null or empty text is its end alone; without training texts the base score and the score are 0;
rows that repeat a doc_id are scored row by row.
"""

from __future__ import annotations

from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from millrace.llm.common import as_items, limit_threads, run_sums, split_words, table, text_slices, written

HEAD, CLASSES, SUBS, ANCHORS = 1 << 16, 24, 16, 32
BATCH = 1 << 15  # tokens in a gradient step
PART = 1 << 18  # bytes of text in a row of codes
END = 1  # key of the end; words get others
ENDING = CLASSES - 2  # the end has a class of its own
FORMS = 16  # of words outside the head, in the low bits of their keys; at most SUBS

#: Groups of words by their last byte: vowels, other letters in three groups, digits, commas and stops, other signs, beyond ASCII.
_LAST = [7 if b > 127 else 0 if chr(b) in "aeiouy" else 1 if chr(b) in "bcdfghj" else 2 if chr(b) in "klmnpq" else 3 if chr(b) in "rstvwxz" else 4 if chr(b) in "0123456789" else 5 if chr(b) in ",.;:!?" else 6 for b in range(256)]


def word_key(word: bytes) -> int:
    """A hash of a word that carries its form in its low bits; never ``END``."""
    return xxhash.xxh3_64_intdigest(word) >> 5 << 4 | 16 | _LAST[word[-1]] | (len(word) > 8) << 3


def buckets_for(tokens: int) -> int:
    """Feature buckets for a number of training tokens: about eight times its square root, and at most 2^18."""
    return 1 << int(np.clip(np.rint(np.log2(8 * max(1.0, tokens) ** 0.5)), 12, 18))


def encoded(texts: DataFrame) -> DataFrame:
    """Texts (text, id, round) as rows of about ``PART`` bytes of text, or of one longer text.

    A row has the ids, rounds and tokens of its texts, the keys of their distinct words, and each token's place in them.
    """

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        def one(values, kind):
            return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values if isinstance(values, pa.Array) else pa.array(values, kind))

        for batch in batches:
            for low, high in text_slices(batch.column(0), PART):
                part = batch.slice(low, high - low)
                words, places, sizes = split_words(pc.ascii_lower(part.column(0)), ascii_only=True)
                keys = np.fromiter(map(word_key, words), np.int64, len(words))
                places = np.insert(places, np.cumsum(sizes), len(keys))  # the end of each text
                yield pa.RecordBatch.from_arrays([one(part.column(1), None), one(part.column(2), None), one(sizes + 1, pa.int32()), one(np.append(keys, END), pa.int64()), one(places, pa.int32())], ["ids", "rounds", "sizes", "keys", "places"])

    return texts.select("text", "id", "round").mapInArrow(run, "ids array<long>, rounds array<int>, sizes array<int>, keys array<long>, places array<int>")


def opened(batches):
    """(ids, rounds, sizes, keys, places) of the rows of codes, a few together; places count over all their keys."""
    for batch in batches:
        tokens = np.cumsum(batch.column(4).value_lengths().to_numpy())
        low = 0
        while low < len(tokens):
            high = int(np.searchsorted(tokens, (tokens[low - 1] if low else 0) + BATCH)) + 1
            ids, rounds, sizes, keys, places = batch.slice(low, high - low).columns
            n = keys.value_lengths().to_numpy()
            yield ids.flatten(), rounds.flatten().to_numpy(), sizes.flatten().to_numpy(), keys.flatten().to_numpy(), places.flatten().to_numpy() + np.repeat(np.cumsum(n) - n, places.value_lengths().to_numpy())
            low = high


@contextmanager
def few_rows(spark, rows: int = 16):
    """Rows of codes are large: jobs run inside read them and hand them to Python a few at a time."""
    names = ("spark.sql.parquet.columnarReaderBatchSize", "spark.sql.execution.arrow.maxRecordsPerBatch")
    before = {name: spark.conf.get(name) for name in names}
    for name in names:
        spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        for name in names:
            spark.conf.set(name, before[name])


def gathered(df: DataFrame, name: str) -> DataFrame:
    """What a pass over codes makes, written: its small rows are read again as usual."""
    with few_rows(df.sparkSession):
        return written(df, name)


def codes_of(keys: np.ndarray, head: np.ndarray) -> np.ndarray:
    """The place of each key in the head, or -key."""
    at = np.minimum(np.searchsorted(head, keys), len(head) - 1)
    return np.where(head[at] == keys, at, -keys)


@dataclass
class Classes:
    """Where the words of the head belong; all others are in the last class, by their forms."""

    keys: np.ndarray  # of the head, ascending
    of: np.ndarray  # class of each
    sub: np.ndarray  # and its sub-class

    def place(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(class, sub-class) of each code."""
        head = np.maximum(codes, 0)
        return np.where(codes >= 0, self.of[head], CLASSES - 1), np.where(codes >= 0, self.sub[head], -codes & FORMS - 1)


@dataclass
class Weights:
    """Buckets and one more row for each constant: of the first softmax, and of the second for each class."""

    first: np.ndarray  # buckets + 1 x CLASSES
    second: np.ndarray  # buckets + CLASSES x SUBS

    @staticmethod
    def start(buckets: int, classes: Classes) -> Weights:
        """Zeros, but for outcomes without a word: those stay at minus infinity."""
        live = np.zeros((CLASSES, SUBS), bool)
        live[classes.of, classes.sub], live[CLASSES - 1, :FORMS] = True, True
        out = Weights(np.zeros((buckets + 1, CLASSES), np.float32), np.zeros((buckets + CLASSES, SUBS), np.float32))
        out.first[buckets, ~live.any(1)] = -np.inf
        out.second[buckets:][~live] = -np.inf
        return out


@dataclass
class Model:
    classes: Classes
    counts: np.ndarray
    inside: np.ndarray  # log10 p(word | sub-class)
    total: int  # training tokens
    distinct: int
    forms: np.ndarray  # log10 of the size of each sub-class of the last class, add-one
    weights: Weights


def counted(codes: DataFrame) -> DataFrame:
    """(key, n) of all tokens of the training texts: summed in each task first."""

    def run(batches):
        import pyarrow as pa

        keys, n, held, size = np.empty(0, np.int64), np.empty(0, np.int64), [], 0

        def merged():
            k, at = np.unique(np.concatenate([keys, *(x for x, _ in held)]), return_inverse=True)
            c = np.bincount(at, weights=np.concatenate([n, *(x for _, x in held)]), minlength=len(k)).astype(np.int64)
            held.clear()
            return k, c

        for _, rounds, sizes, words, places in opened(batches):
            c = np.bincount(places[np.repeat(rounds > 0, sizes)], minlength=len(words))
            held.append((words[c > 0], c[c > 0]))
            size += len(words)
            if size > 1 << 20:
                (keys, n), size = merged(), 0
            if len(keys) > 1 << 21:
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["key", "n"])
                keys, n = keys[:0], n[:0]
        keys, n = merged()
        for at in range(0, len(keys), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + (1 << 16)]), pa.array(n[at : at + (1 << 16)])], ["key", "n"])

    return codes.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def context(words: np.ndarray, places: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hashes of each token's features (4 x tokens): word before, second and third before, the two before.

    ``words`` are the hashes of distinct words, ``places`` says which of them each token is.
    """
    n = len(places)
    first = np.cumsum(sizes) - sizes
    word = words[places]
    before = []
    for k in (1, 2, 3):
        w = np.empty(n, np.uint64)
        w[k:], w[:k] = word[: max(0, n - k)], 0
        for j in range(k):  # before the text's first word
            at = first[sizes > j] + j
            w[at] = np.uint64(k)
        before.append(w)
    out = np.empty((4, n), np.uint64)
    for j, w in enumerate([before[0], before[1] ^ np.uint64(0x51ED270B), before[2] ^ np.uint64(0x2545F491), before[0] * np.uint64(3) + before[1] * np.uint64(0xC2B2AE3D27D4EB4F)]):
        out[j] = (w ^ (w >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return out


def hashed(keys: np.ndarray) -> np.ndarray:
    return (keys.view(np.uint64) + np.uint64(7)) * np.uint64(0x9E3779B97F4A7C15)


def features(contexts: np.ndarray, buckets: int, classes: np.ndarray | None = None) -> np.ndarray:
    """Rows of the weights for each token's features (4 x tokens), of the second softmax where classes are given."""
    if classes is not None:
        contexts = (contexts ^ (classes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9FB21C651E98DF25)) * np.uint64(0xD6E8FEB86659FD93)
    return (contexts >> np.uint64(64 - int(buckets).bit_length() + 1)).astype(np.int64)


def logits(weights: np.ndarray, at: np.ndarray, constant: np.ndarray) -> np.ndarray:
    """Scores (tokens x outcomes) for rows of features and of the constant; at most 80, so that their exponentials are finite."""
    z = weights.take(constant, axis=0, mode="clip")
    for rows in at:
        z += weights.take(rows, axis=0, mode="clip")
    return np.minimum(z, 80, out=z)


def log_share(weights: np.ndarray, at: np.ndarray, constant: np.ndarray, goal: np.ndarray) -> np.ndarray:
    """Natural log p(goal | features) of each token."""
    z = logits(weights, at, constant)
    own = z[np.arange(len(goal)), goal]
    return own - np.log(np.einsum("ij->i", np.exp(z, out=z)))


def log_model(weights: Weights, contexts: np.ndarray, classes: np.ndarray, subs: np.ndarray) -> np.ndarray:
    """log10 p(class and sub-class | context) of each token."""
    buckets = len(weights.first) - 1
    out = np.empty(len(classes))
    for low in range(0, len(out), BATCH):
        at, c, s = contexts[:, low : low + BATCH], classes[low : low + BATCH], subs[low : low + BATCH]
        out[low : low + BATCH] = log_share(weights.first, features(at, buckets), np.full(len(c), buckets), c)
        out[low : low + BATCH] += log_share(weights.second, features(at, buckets, c), buckets + c, s)
    return out / np.log(10)


def near_centres(x: np.ndarray, counts: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """k-means of rows weighted by the root of their counts; each first centre lies far from those before."""
    top = np.argsort(-counts, kind="stable")[: max(k, len(counts) // 16)]
    centres = [x[top[0]]]
    gap = ((x[top] - centres[0]) ** 2).sum(1)
    for _ in range(k - 1):
        centres.append(x[top[int(np.argmax(gap * np.sqrt(counts[top])))]])
        gap = np.minimum(gap, ((x[top] - centres[-1]) ** 2).sum(1))
    centres, weight = np.array(centres), np.sqrt(counts)
    for _ in range(rounds):
        near = np.argmin(-2 * x @ centres.T + (centres * centres).sum(1), axis=1)
        mass = np.bincount(near, weights=weight, minlength=k)
        for c in np.flatnonzero(mass):
            mine = near == c
            centres[c] = (x[mine] * weight[mine, None]).sum(0) / mass[c]
    return near


def classed(codes: DataFrame, keys: np.ndarray, counts: np.ndarray, rounds: int = 12) -> Classes:
    """Classes and sub-classes of the head, by which anchors (the most frequent words) stand before and after a word."""
    end, wide = int(np.searchsorted(keys, END)), 2 * ANCHORS
    by_count = np.argsort(-counts, kind="stable")
    anchors = [i for i in by_count if i != end][:ANCHORS]
    anchor_of = np.full(len(keys) + 1, -1, np.int32)
    anchor_of[anchors] = np.arange(len(anchors))

    def run(batches):
        import pyarrow as pa

        sums, held = np.zeros(len(keys) * wide, np.int64), []

        def add():
            np.add(sums, np.bincount(np.concatenate([*held, np.empty(0, np.int64)]), minlength=len(sums)), out=sums)
            held.clear()

        for _, rounds, sizes, words, places in opened(batches):
            code = codes_of(words, keys)
            tokens = np.where(code >= 0, code, len(keys))[places]
            train = np.repeat(rounds > 0, sizes)
            at = np.flatnonzero((anchor_of[tokens] >= 0) & train)  # anchors: none is an end, so a text's last token is none
            anchor = anchor_of[tokens[at]]
            for word, side in ((tokens[at + 1], 0), (np.where(at > 0, tokens[at - 1], end), ANCHORS)):
                ok = (word < len(keys)) & (word != end)
                held.append(word[ok] * wide + side + anchor[ok])
            if sum(map(len, held)) > 1 << 21:
                add()
        add()
        hit = np.flatnonzero(sums)
        for at in range(0, len(hit), 1 << 16):
            some = hit[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some])], ["cell", "n"])

    cells = gathered(codes.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")), "lm-cells").toArrow()  # HEAD x 2 ANCHORS at most
    x = np.zeros(len(keys) * wide, np.float32)
    x[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    x = np.log1p(x.reshape(len(keys), wide))
    x = np.hstack([x / np.maximum(1e-6, np.sqrt((x * x).sum(1, keepdims=True))), 0.08 * np.log2(counts)[:, None].astype(np.float32)])
    near = near_centres(x, counts, max(1, min(CLASSES - 2, len(keys) - 1)), rounds)
    near[end] = ENDING
    sub = np.zeros(len(keys), np.int64)
    for c in range(ENDING):
        mine = np.flatnonzero(near == c)
        if len(mine):
            sub[mine] = near_centres(x[mine], counts[mine], min(SUBS, len(mine)), rounds)
    return Classes(keys, near, sub)


class Learner:
    """AdaGrad steps on one softmax, in batches of tokens."""

    def __init__(self, weights: np.ndarray, rate: float):
        self.weights, self.rate = weights.copy(), rate
        self.slope, self.seen = np.full(weights.shape, 1e-2, np.float32), np.zeros(len(weights), np.float32)

    def step(self, at: np.ndarray, constant: np.ndarray, goal: np.ndarray) -> None:
        miss = logits(self.weights, at, constant)
        np.exp(miss, out=miss)
        miss *= (1 / np.einsum("ij->i", miss))[:, None]
        miss[np.arange(len(goal)), goal] -= 1
        hit = np.concatenate([at.ravel(), constant])
        order = np.argsort(hit.astype(np.uint16), kind="stable")  # 16 bits at a time are sorted by radix
        if len(self.weights) > 1 << 16:
            order = order[np.argsort((hit[order] >> 16).astype(np.uint16), kind="stable")]
        hit = hit[order]
        first = np.flatnonzero(np.diff(hit, prepend=-1))
        g, b = run_sums(miss, order % len(goal), first), hit[first]
        slope = self.slope.take(b, axis=0, mode="clip")
        slope += g * g
        as_items(self.slope)[b] = as_items(slope)
        np.sqrt(slope, out=slope)
        g /= slope
        g *= -self.rate
        g += self.weights.take(b, axis=0, mode="clip")
        as_items(self.weights)[b] = as_items(g)
        self.seen[b] += np.diff(first, append=len(hit))


def trained(codes: DataFrame, classes: Classes, buckets: int, replicas: int, rounds: tuple[int, ...] = (1, 2), rate: float = 0.3) -> Weights:
    """Weights of both softmaxes after each of the rounds of gradient updates over its own texts."""
    spark = codes.sparkSession
    weights = Weights.start(buckets, classes)
    codes = codes.coalesce(replicas)  # each task sends back its weights
    names = [f"w{k}" for k in range(max(CLASSES, SUBS))]
    for which in rounds:
        shared = spark.sparkContext.broadcast((classes, weights))

        def run(batches, shared=shared, which=which):
            import pyarrow as pa

            limit_threads()
            classes, start = shared.value
            first, second = Learner(start.first, rate), Learner(start.second, rate)

            def step(contexts, c, s):
                for low in range(0, len(c), BATCH):
                    at, goal, sub = contexts[:, low : low + BATCH], c[low : low + BATCH], s[low : low + BATCH]
                    first.step(features(at, buckets), np.full(len(goal), buckets), goal)
                    more = np.flatnonzero(goal != ENDING)  # one sub-class: nothing to tell apart
                    if len(more):
                        second.step(features(at[:, more], buckets, goal[more]), buckets + goal[more], sub[more])

            held, size = [], 0
            for _, nth, sizes, words, places in opened(batches):
                mine = nth == which
                if mine.any():
                    places = places[np.repeat(mine, sizes)]
                    code = codes_of(words, classes.keys)
                    c, s = classes.place(code)
                    held.append((context(hashed(words), places, sizes[mine]), c[places], s[places]))
                    size += len(places)
                    if size >= BATCH:
                        step(*(np.concatenate(x, axis=-1) for x in zip(*held, strict=True)))
                        held, size = [], 0
            if held:
                step(*(np.concatenate(x, axis=-1) for x in zip(*held, strict=True)))
            for which_table, learner in enumerate((first, second)):
                hit = np.flatnonzero(learner.seen)
                for low in range(0, len(hit), 4096):
                    some = hit[low : low + 4096]
                    n, mass = learner.seen[some], learner.weights[some] * learner.seen[some, None]
                    cols = [pa.array(mass[:, k], pa.float32()) if k < mass.shape[1] else pa.nulls(len(some), pa.float32()) for k in range(len(names))]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), which_table), pa.int32()), pa.array(some), pa.array(n, pa.float64()), *cols], ["table", "bucket", "n", *names])

        rows = codes.mapInArrow(run, "table int, bucket long, n double, " + ", ".join(f"{x} float" for x in names))
        mean = gathered(rows.groupBy("table", "bucket").agg(F.sum("n").alias("n"), *[F.sum(x).alias(x) for x in names]), "lm-weights").toArrow()  # a row for each bucket at most
        of = mean["table"].to_numpy()
        for k, to in enumerate((weights.first, weights.second)):
            some = mean.filter(of == k)
            if some.num_rows:
                to[some["bucket"].to_numpy()] = (np.stack([some[x].to_numpy() for x in names[: to.shape[1]]], 1) / some["n"].to_numpy()[:, None]).astype(np.float32)
    return weights


def learned(codes: DataFrame, replica_tokens: int = 16_000_000) -> tuple[Model | None, DataFrame]:
    """The model of the training texts among encoded ones, and the table (key, n) of all word counts."""
    counts = gathered(counted(codes), "word-counts")
    form = F.col("key").bitwiseAND(F.lit(FORMS - 1)).cast("int").alias("form")
    sums = counts.groupBy(form).agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect()  # FORMS rows
    total, distinct = sum(r["n"] for r in sums), sum(r["words"] for r in sums)
    if not total:
        return None, counts
    head = counts.orderBy((F.col("key") != END), F.desc("n"), "key").limit(HEAD).toArrow().sort_by("key")
    keys, n = head["key"].to_numpy(), head["n"].to_numpy()
    classes = classed(codes, keys, n)
    weights = trained(codes, classes, buckets_for(total), -(-total // replica_tokens))
    place = classes.of * SUBS + classes.sub
    mass = np.bincount(place, weights=n, minlength=CLASSES * SUBS)
    tail = np.ones(FORMS)  # an unknown word of each form
    for r in sums:
        tail[r["form"]] += r["n"] + r["words"]
    tail -= np.bincount(keys & FORMS - 1, weights=n + 1, minlength=FORMS)
    return Model(classes, n, np.log10(n / mass[place]), int(total), int(distinct), np.log10(tail), weights), counts


def scored(codes: DataFrame, model: Model | None, counts: DataFrame) -> DataFrame:
    """id, n_tokens, n_known, train_tokens, base_score, score of encoded texts."""
    if model is None:
        docs = codes.select(F.explode(F.arrays_zip("ids", "sizes")).alias("x"))
        return docs.select(F.col("x.ids").alias("id"), F.col("x.sizes").cast("long").alias("n_tokens"), F.lit(0).cast("long").alias("n_known"), F.lit(0).cast("long").alias("train_tokens"), F.lit(0.0).alias("base_score"), F.lit(0.0).alias("score"))
    shared = codes.sparkSession.sparkContext.broadcast(model)
    size = model.total + model.distinct + 1

    def run(batches):
        import pyarrow as pa

        limit_threads()
        m = shared.value
        row = TaskContext.get().partitionId() << 40
        base = np.log10((m.counts + 1) / size)
        for ids, _, sizes, words, places in opened(batches):
            code = codes_of(words, m.classes.keys)
            c, s = m.classes.place(code)
            known = code >= 0
            inside = np.where(known, m.inside[np.maximum(code, 0)], -m.forms[s])
            value = log_model(m.weights, context(hashed(words), places, sizes), c[places], s[places])
            value += inside[places]
            head = known[places]
            of = np.repeat(np.arange(len(sizes)), sizes)
            sums = [np.bincount(of, weights=x, minlength=len(sizes)) for x in (value, np.where(known, base[np.maximum(code, 0)], 0.0)[places], head)]
            tails = np.bincount(of[~head], minlength=len(sizes))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(tails)]), pa.int32()), pa.array(words[places[~head]]))
            yield pa.RecordBatch.from_arrays([ids, pa.array(row + np.arange(len(sizes))), pa.array(sizes, pa.int64()), pa.array(sums[2].astype(np.int64)), pa.array(sums[1]), pa.array(sums[0]), lists], ["id", "row", "n_tokens", "known", "base", "score", "tail"])
            row += len(sizes)

    parts = gathered(codes.mapInArrow(run, "id long, row long, n_tokens long, known long, base double, score double, tail array<long>"), "lm-parts")
    tail = parts.select("row", F.explode("tail").alias("key"))
    rare = tail.join(counts, "key", "left").select("row", F.coalesce("n", F.lit(0)).alias("n"))
    rest = rare.groupBy("row").agg(F.sum(F.log10((F.col("n") + 1) / F.lit(float(size)))).alias("rest_base"), F.sum(F.log10(F.col("n") + 1.0)).alias("rest_score"), F.sum((F.col("n") > 0).cast("long")).alias("rest_known"))
    zero = F.lit(0)
    return parts.drop("tail").join(rest, "row", "left").select("id", "n_tokens", (F.col("known") + F.coalesce("rest_known", zero)).alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("rest_base", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("rest_score", F.lit(0.0))).alias("score"))


def query(spark, sf_dir: str) -> DataFrame:
    """Learned where crc32(doc_id) mod 7 isn't 2, scored for every document."""
    docs = table(spark, sf_dir, "documents").select("text", F.col("doc_id").alias("id"))

    def held(of):
        return F.coalesce(F.crc32(F.col(of).cast("string")) % 7 == 2, F.lit(False))

    nth = F.when(held("id"), 0).when(F.pmod(F.xxhash64("id"), F.lit(8)) == 0, 1).otherwise(2)  # 0 isn't trained on
    codes = written(encoded(docs.withColumn("round", nth)), "lm-codes")
    model, counts = learned(codes)
    return scored(codes, model, counts).select(F.col("id").alias("doc_id"), held("id").alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
