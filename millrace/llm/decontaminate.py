"""Benchmark decontamination: training passages as queries on a BM25 index of test items, then exact overlap.

The test items are the indexed documents (long ones in segments); a term's impact on an item is its BM25 weight
divided by the item's own total, so a score is the share of an item's weight that a passage covers. Every passage of
every text is a query, and all items scoring at least ``threshold`` are retrieved by block-max WAND: cursors stand in
the posting lists of a passage's terms; in the order of their items, the cursor at which the terms' largest impacts
add up to the threshold gives the pivot; where the block maxima at the pivot don't reach the threshold all cursors up
to it skip the block, else the pivot is scored or the cursors before it move up to it. Many passages take these steps
side by side, each with cursors of its own; one whose terms' maxima reach the threshold in none of ``COARSE`` larger
blocks takes none.

A retrieved item is verified on whole five-word shingles of the passage's surroundings: shares of its question's and
of its answer's shingles found there. It is a leak if the item as a whole reaches ``similar`` and either part
``least_part``. Without separate columns, an item's last third of words counts as its answer. A part of under five
words is a run of its own length, looked for in the passage and as many words around it as the item has.

Passages overlap by half, so an item of up to half a passage lies whole in one. Document frequencies and the mean
length are those of the whole benchmark. Its index is built by tasks and kept in the shared folder in parts of
``index_bytes`` of text. A task reads its texts once, as term ids of up to ``HELD`` bytes at a time, and holds one part of
the index beside them; so it reads each part once for each ``HELD`` bytes (once in all if there is one part), and the parts
don't change the result.

Defined cases: null and empty texts and items have no words and match nothing; parts of under five words are one
run; repeated documents each get their rows; equal rows of a benchmark count once, others that repeat an item_id count
by their own text; ids are longs.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from millrace.llm.common import Memo, as_ids, filesystem, new_folder, run_sums, shingles, split_words, table, text_slices, word_hash, written

PASSAGE = 64
BLOCK, COARSE = 8, 32  # items of a block; parts of an index in the first look at a passage
K1, B = 1.2, 0.75
SHINGLE = 5
SLICE = 1 << 22  # bytes of text searched together
HELD = 1 << 26  # bytes of texts and term ids held while the parts of an index pass by
TOGETHER, CURSORS = 1 << 11, 1 << 14  # passages looked at together, cursors moved side by side
HITS = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, leak boolean"


@dataclass
class Index:
    words: np.ndarray  # hashes of the terms, ascending
    tops: np.ndarray  # largest impact of each term
    starts: np.ndarray  # postings of a term: starts[t] to starts[t + 1]
    postings: np.ndarray  # term * segments + segment, ascending
    impacts: np.ndarray
    cells: np.ndarray  # term * blocks + block where the term occurs, ascending
    maxima: np.ndarray  # largest impact there
    coarse: np.ndarray  # terms x up to COARSE equal parts of the items, largest impact there
    owner: np.ndarray  # the test item of each indexed segment
    ids: list  # item_id of each test item
    questions: list[np.ndarray]  # shingles of each test item's parts
    answers: list[np.ndarray]
    sizes: list[tuple[int, int, int]]  # words of each test item's shingles, question's and answer's, and of the item
    longest: int  # words of the longest item


def normal(word: str) -> str:
    """Lower case, without punctuation at the ends."""
    return word.lower().strip(".,;:!?\"'()[]{}*#%$&|")


def term_of(word: str) -> int:
    """The hash of a word's term, -1 for bare punctuation."""
    word = normal(word)
    return word_hash(word) if word else -1


def ascending(values: np.ndarray) -> np.ndarray:
    """The distinct values in order, by sorting."""
    values = np.sort(values)
    return values[np.diff(values, prepend=-1) != 0]


def terms_of(texts, memo: Memo | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of distinct terms, term of each word, words of each text) of an Arrow string array."""
    words, places, sizes = split_words(texts)
    memo = Memo(term_of) if memo is None else memo
    hashes, to = np.unique(as_ids(memo, words), return_inverse=True)
    memo.trim()
    places = to[places]
    if len(hashes) and hashes[0] < 0:
        kept = places > 0
        sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[kept], minlength=len(sizes))
        hashes, places = hashes[1:], places[kept] - 1
    return hashes, places, sizes


def build(items: list[tuple[int, np.ndarray, np.ndarray]], terms: np.ndarray, df: np.ndarray, segments: int, mean: float) -> Index:
    """The index of (item_id, question's terms, answer's terms) rows, whose distinct terms have these frequencies among all segments."""
    parts, owner = [], []
    for i, (_, q, a) in enumerate(items):
        words = np.searchsorted(terms, np.concatenate([q, a]))
        for at in range(0, len(words), PASSAGE):
            parts.append(np.unique(words[at : at + PASSAGE], return_counts=True))
            owner.append(i)
    n, blocks = len(parts), -(-len(parts) // BLOCK)
    length = np.array([c.sum() for _, c in parts])
    idf = np.log1p((segments - df + 0.5) / (df + 0.5))
    term, tf = (np.concatenate(x) for x in zip(*parts, strict=True))
    item = np.repeat(np.arange(n), [len(t) for t, _ in parts])
    weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[item] / mean))
    impact = weight / np.bincount(item, weights=weight, minlength=n)[item]
    order = np.lexsort((item, term))
    term, item, impact = term[order], item[order], impact[order]
    cells, first = np.unique(term * blocks + item // BLOCK, return_index=True)
    starts = np.searchsorted(term, np.arange(len(terms) + 1))
    coarse = np.zeros((len(terms), min(COARSE, blocks)), np.float32)
    np.maximum.at(coarse, (term, item // BLOCK * coarse.shape[1] // blocks), np.nextafter(impact.astype(np.float32), np.float32(9)))
    return Index(
        terms, np.maximum.reduceat(impact, starts[:-1]), starts, term * n + item, impact, cells, np.maximum.reduceat(impact, first), coarse, np.array(owner), [i for i, _, _ in items],
        [np.unique(shingles(q, SHINGLE)) for _, q, _ in items], [np.unique(shingles(a, SHINGLE)) for _, _, a in items],
        [(min(SHINGLE, len(q)), min(SHINGLE, len(a)), len(q) + len(a)) for _, q, a in items], max(len(q) + len(a) for _, q, a in items),
    )


def wand(index: Index, terms: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, segment, score) of everything at or above the threshold; a row of ``terms`` has a passage's distinct terms, filled with -1."""
    n = len(index.owner)
    blocks, last = -(-n // BLOCK), len(index.postings) - 1
    rows, used = np.arange(len(terms)), terms >= 0
    at = index.starts[np.maximum(terms, 0)]
    item = np.where(used, index.postings[at] - terms * n, n)  # n: the list has come to its end
    top = np.where(used, index.tops[np.maximum(terms, 0)], 0.0)
    slack = threshold * (1 - 1e-9)  # sums in another order may be a little smaller
    out = []
    while len(rows):
        order = np.argsort(item, axis=1)
        items = np.take_along_axis(item, order, 1)
        reach = np.take_along_axis(np.where(item < n, top, 0.0), order, 1).cumsum(1) >= slack
        live = reach[:, -1]
        if not live.all():
            rows, terms, at, item, top, items, reach = (x[live] for x in (rows, terms, at, item, top, items, reach))
            if not len(rows):
                break
        every = np.arange(len(rows))
        pivot = items[every, reach.argmax(1)]
        block = pivot // BLOCK
        row, col = np.nonzero(item <= pivot[:, None])
        cell = terms[row, col] * blocks + block[row]
        found = np.minimum(np.searchsorted(index.cells, cell), len(index.cells) - 1)
        able = np.bincount(row, weights=np.where(index.cells[found] == cell, index.maxima[found], 0.0), minlength=len(rows)) >= slack
        score = able & (items[:, 0] == pivot)
        if score.any():
            row, col = np.nonzero((item == pivot[:, None]) & score[:, None])
            total = np.bincount(row, weights=index.impacts[at[row, col]], minlength=len(rows))
            hit = score & (total >= threshold)
            out.append((rows[hit], pivot[hit], total[hit]))
        beyond = np.where(item > pivot[:, None], item, n).min(1)
        to = np.where(score, pivot + 1, np.where(able, pivot, np.minimum((block + 1) * BLOCK, beyond)))
        row, col = np.nonzero(item < to[:, None])
        term = terms[row, col]
        moved = np.searchsorted(index.postings, term * n + to[row])
        at[row, col] = moved
        item[row, col] = np.where(moved < index.starts[term + 1], index.postings[np.minimum(moved, last)] - term * n, n)
    if not out:
        return np.empty(0, int), np.empty(0, int), np.empty(0)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def retrieved(index: Index, hashes: np.ndarray, places: np.ndarray, sizes: np.ndarray, threshold: float) -> list[tuple[int, int, int, float]]:
    """(text, first word of the passage, segment, score) at or above the threshold, in this order, of texts as ``terms_of`` gives them."""
    half = PASSAGE // 2
    each = -(-sizes // half)  # passages of each text
    first = np.cumsum(each) - each
    term = np.searchsorted(index.words, hashes)
    term = np.where(index.words[np.minimum(term, len(index.words) - 1)] == hashes, term, -1)[places]
    nth = np.arange(len(places)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    passage = np.repeat(first, sizes) + nth // half
    known = term >= 0
    again = known & (nth >= half)  # the second half of the passage before
    v = len(index.words)
    pairs = ascending(np.concatenate([passage[known] * v + term[known], (passage[again] - 1) * v + term[again]]))
    passage, term = pairs // v, pairs % v
    total = np.bincount(passage, weights=index.tops[term], minlength=int(each.sum()))
    kept = total[passage] >= threshold * (1 - 1e-9)
    passage, term = passage[kept], term[kept]
    start = np.flatnonzero(np.diff(passage, prepend=-1))
    which, count = passage[start], np.diff(start, append=len(passage))
    able = np.zeros(len(which), bool)
    for low in range(0, len(which), TOGETHER):
        begin, end = start[low], start[low + TOGETHER] if low + TOGETHER < len(which) else len(term)
        able[low : low + TOGETHER] = (run_sums(index.coarse, term[begin:end], start[low : low + TOGETHER] - begin) >= threshold * (1 - 1e-5)).any(1)
    which, start, count = which[able], start[able], count[able]
    order = np.argsort(count, kind="stable")
    found, low = [], 0
    while low < len(order):
        high = low + 1
        while high < len(order) and (high + 1 - low) * count[order[high]] <= CURSORS:
            high += 1
        some = order[low:high]
        n = count[some]
        terms = np.full((len(some), int(n.max())), -1)
        col = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        terms[np.repeat(np.arange(len(some)), n), col] = term[np.repeat(start[some], n) + col]
        row, segment, score = wand(index, terms, threshold)
        found += zip(which[some[row]].tolist(), segment.tolist(), score.tolist(), strict=True)
        low = high
    text = np.repeat(np.arange(len(sizes)), each)
    return [(int(text[p]), int(p - first[text[p]]) * half, segment, score) for p, segment, score in sorted(found)]


def leaks(index: Index, texts, threshold: float, similar: float, least_part: float) -> list[tuple]:
    """(text, item_id, score, question overlap, answer overlap, leak) of each test item retrieved for a text, at its best place.

    ``texts`` is what ``terms_of`` gives.
    """
    hashes, places, sizes = texts
    best: dict[tuple[int, int], tuple] = {}
    memo: dict[tuple[int, int, int], np.ndarray] = {}
    last, begin = None, np.cumsum(sizes) - sizes

    def found(part: np.ndarray, at: int, size: int, around: int) -> int:
        place = (max(0, at - around), at + PASSAGE + around, size)
        if place not in memo:
            memo[place] = np.unique(shingles(words[place[0] : place[1]], size))
        return int(np.isin(part, memo[place], assume_unique=True).sum())

    for text, at, segment, score in retrieved(index, hashes, places, sizes, threshold):
        i = int(index.owner[segment])
        if (text, at) != last:
            memo.clear()
            last = (text, at)
            words = hashes[places[begin[text] : begin[text] + sizes[text]]]
        q, a = index.questions[i], index.answers[i]
        *own, length = index.sizes[i]
        in_q, in_a = (found(x, at, k, index.longest if k == SHINGLE else length) if len(x) else 0 for x, k in zip((q, a), own, strict=True))
        whole = (in_q + in_a) / (len(q) + len(a))
        part_q, part_a = (in_q / len(q) if len(q) else 1.0), (in_a / len(a) if len(a) else 1.0)
        leak = whole >= similar and min(part_q, part_a) >= least_part
        row = (leak, whole, score, part_q, part_a)
        best[text, i] = max(best.get((text, i), row), row)
    return [(text, index.ids[i], score, q, a, leak) for (text, i), (leak, _, score, q, a) in sorted(best.items())]


def shaped(items: DataFrame, index_bytes: int) -> DataFrame:
    """part, item_id and the terms of question and answer of each different item with a word."""
    items = items.select(F.col("item_id").cast("long"), F.coalesce("question", F.lit("")).alias("question"), F.coalesce("answer", F.lit("")).alias("answer")).distinct()
    size = items.agg(F.sum(F.octet_length("question").cast("long") + F.octet_length("answer"))).first()[0] or 0
    items = items.select(F.pmod(F.xxhash64("item_id", "question", "answer"), F.lit(max(1, -(-size // index_bytes)))).cast("int").alias("part"), "item_id", "question", "answer")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            lists = []
            for column in batch.columns[2:]:
                hashes, places, sizes = terms_of(column)
                lists.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(hashes[places], pa.int64())))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *lists], ["part", "item_id", "question", "answer"])

    return items.mapInArrow(run, "part int, item_id long, question array<long>, answer array<long>").where(F.size("question") + F.size("answer") > 0)


def write_index(items: DataFrame, folder: str, index_bytes: int) -> list[str]:
    """Write the index of items (item_id, question, answer) into files of the folder, a part each; returns their names."""
    rows = written(shaped(items, index_bytes), "items")
    words = F.concat("question", "answer")
    cut = F.transform(F.sequence(F.lit(0), F.ceil(F.size(words) / PASSAGE).cast("int") - 1), lambda k: F.slice(words, k * PASSAGE + 1, PASSAGE))
    segments = rows.select(F.explode(cut).alias("words"))
    n, mean = segments.agg(F.count("*"), F.avg(F.size("words"))).first()
    if not n:
        return []
    df = segments.select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    known = rows.select(F.col("part").alias("of"), F.explode(F.array_distinct(words)).alias("term")).distinct().join(df, "term")

    def write(part: pd.DataFrame, terms: pd.DataFrame) -> pd.DataFrame:
        part, terms = part.sort_values(["item_id"], kind="stable"), terms.sort_values("term")
        ids = [None if pd.isna(x) else int(x) for x in part["item_id"]]
        index = build([(i, np.asarray(q, np.int64), np.asarray(a, np.int64)) for i, q, a in zip(ids, part["question"], part["answer"], strict=True)], terms["term"].to_numpy(), terms["df"].to_numpy(), n, mean)
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        name, task = f"part-{int(part['part'].iloc[0]):06d}.index", TaskContext.get().taskAttemptId()
        with fs.open_output_stream(f"{root}/.{name}-{task}") as sink:
            sink.write(pickle.dumps(index))
        fs.move(f"{root}/.{name}-{task}", f"{root}/{name}")
        return pd.DataFrame({"name": [name]})

    names = written(rows.groupBy("part").cogroup(known.groupBy("of")).applyInPandas(write, "name string"), "index-parts")
    return sorted(r["name"] for r in names.collect())


@lru_cache(maxsize=1)
def read_part(folder: str, name: str) -> Index:
    """A part of an index; a worker keeps the last."""
    fs, root = filesystem(folder)
    with fs.open_input_stream(f"{root}/{name}") as source:
        return pickle.loads(source.read())


def searched(batches, at: int, folder: str, names: list[str], threshold: float, similar: float, least_part: float):
    """(rows, hits as ``leaks`` gives them) of some rows of Arrow batches at a time, in order; texts are in column ``at``."""
    memo, held, size = Memo(term_of), [], 0

    def looked_up():
        hits: list[list] = [[] for _ in held]
        for name in names:
            index = read_part(folder, name)
            for mine, (_, texts) in zip(hits, held, strict=True):
                mine += leaks(index, texts, threshold, similar, least_part)
        for (rows, _), mine in zip(held, hits, strict=True):
            yield rows, mine
        held.clear()

    for batch in batches:
        for low, high in text_slices(batch.column(at), SLICE):
            rows = batch.slice(low, high - low)
            hashes, places, sizes = terms_of(rows.column(at), memo)
            held.append((rows, (hashes, places, sizes)))
            size += rows.nbytes + hashes.nbytes + places.nbytes
            if size >= (HELD if len(names) > 1 else 0):
                yield from looked_up()
                size = 0
    if held:
        yield from looked_up()


def find(docs: DataFrame, items: DataFrame, threshold: float = 0.5, similar: float = 0.8, least_part: float = 0.5, index_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap, leak: every item retrieved for each of docs (id, text).

    ``items`` has item_id, question and answer.
    """
    folder = new_folder(docs.sparkSession, "bm25")
    names = write_index(items, folder, index_bytes)

    def run(batches):
        import pyarrow as pa

        for part, hits in searched(batches, 1, folder, names, threshold, similar, least_part):
            rows, *cols = zip(*hits, strict=True) if hits else ((),) * 6
            ids = part.column(0).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.bool_()), strict=True))], ["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "leak"])

    return docs.select("id", "text").where("text is not null").mapInArrow(run, HITS)


def without_leaks(docs: DataFrame, text: str, items: DataFrame, threshold: float = 0.5, similar: float = 0.8, least_part: float = 0.5, index_bytes: int = 8 << 20) -> DataFrame:
    """The rows of ``docs`` whose own text has no leak; nothing is joined or shuffled, and ids play no part."""
    folder, at = new_folder(docs.sparkSession, "bm25"), docs.columns.index(text)
    names = write_index(items, folder, index_bytes)

    def run(batches):
        import pyarrow as pa

        for part, hits in searched(batches, at, folder, names, threshold, similar, least_part):
            keep = np.ones(part.num_rows, bool)
            keep[[i for i, *_, leak in hits if leak]] = False
            yield part.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def halves(items: DataFrame) -> DataFrame:
    """item_id, question, answer of benchmark rows with one text: the last third of the words is the answer."""
    words = F.split(F.trim(F.coalesce("text", F.lit(""))), r"\s+")
    cut = F.floor(F.size(words) * 2 / 3).cast("int")
    return items.select("item_id", words.alias("w"), cut.alias("cut")).select("item_id", F.array_join(F.slice("w", 1, F.col("cut")), " ").alias("question"), F.array_join(F.slice("w", F.col("cut") + 1, F.size("w")), " ").alias("answer"))


def query(spark, sf_dir: str) -> DataFrame:
    """The verified leaks: doc_id, item_id and how well they match."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return find(docs, halves(table(spark, sf_dir, "benchmark"))).where("leak").drop("leak")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows without a leak: decided row by row, so a null or repeated doc_id neither keeps nor loses another row."""
    return without_leaks(docs, "text", halves(table(spark, sf_dir, "benchmark")))
