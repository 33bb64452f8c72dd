"""Token ids in a content-addressed store.

Documents in ascending doc_id order are encoded and end with an end id. Each document's id stream is cut into chunks
where a rolling hash of its last ``WINDOW`` ids hits a mask, so equal passages give equal chunks wherever they stand.
A chunk is addressed by the digest of its bytes and stored once, in a pack file; a document is a recipe, the list of
its chunks' places; a Merkle tree over the recipe's digests gives the document's root, and the roots of a part's
documents its manifest line. Reading first holds the recipes against the manifest, then follows them, range-reads the
packs and verifies every digest and root.

Packs, of about ``pack_bytes`` of text each, are first drafted by range of doc_id, each task storing a chunk once; then
the smallest place of each digest among all packs is found from the digests alone, and every pack is written from its
draft without the chunks owned elsewhere. Texts are shuffled once, ids never; no row holds more than a pack, and a task
goes through its packs one after the other.

Files (in the shared folder): ``packs/part-N.ids`` (zstd frames of about 64 k little-endian unsigned ids, each after
a header of its bytes and the ids' width) and the Parquet tables ``recipes`` (doc_id, start, n_tokens, root, places)
and ``manifest`` (part, documents, n_tokens, start, root). A place is (pack, frame offset, frame bytes, first id in the frame, ids, digest).

Defined cases: a null or empty text is just the end id; a null doc_id comes first; rows that repeat a doc_id are
documents of their own, ordered by a hash of their text; an empty table gives an empty store.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import unicodedata
from collections import OrderedDict
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from millrace.llm.common import filesystem, limit_threads, new_folder, remove_folder, split_words, table, text_slices, written

END_ID = 1
WINDOW, MASK, LEAST, MOST = 16, (1 << 9) - 1, 128, 4096  # chunks of about LEAST + 512 ids
FRAME_IDS = 1 << 16
SLICE = 1 << 22  # bytes of text encoded together
READ_BYTES = 4 << 20  # of ids in a batch read back
DIGEST = 16
LEVEL, DRAFT_LEVEL = 3, 1  # of compression; drafts are read once and removed
HEADER = struct.Struct("<IB")
PLACE = "struct<pack:int,at:long,bytes:int,first:int,ids:int,digest:binary>"
_TAIL = re.compile(r"(.*[A-Za-z0-9À-ÖØ-öø-įı-ɏ])([!-&(-/:-@\[-`{-~]+)\Z", re.S)  # signs without the apostrophe after a letter that stays one character


def digest(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=DIGEST).digest()


class Merkle:
    """Root over digests that come one by one: neighbours hashed in pairs, an odd last one passed on; leaves and nodes differ."""

    def __init__(self):
        self.whole: list[tuple[int, bytes]] = []  # roots of full subtrees and their heights, falling

    def add(self, leaf: bytes) -> None:
        height, node = 0, digest(b"\0" + leaf)
        while self.whole and self.whole[-1][0] == height:
            node, height = digest(b"\1" + self.whole.pop()[1] + node), height + 1
        self.whole.append((height, node))

    def root(self) -> bytes:
        nodes = [x for _, x in self.whole]
        while len(nodes) > 1:
            right = nodes.pop()
            nodes.append(digest(b"\1" + nodes.pop() + right))
        return nodes[0] if nodes else digest(b"")


def merkle(digests: list[bytes]) -> bytes:
    tree = Merkle()
    for d in digests:
        tree.add(d)
    return tree.root()


def hits_of(ids: np.ndarray) -> np.ndarray:
    """Positions behind which the rolling hash of the last ``WINDOW`` ids would cut a stream."""
    x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    roll, k = x, 1  # at i: a hash of ids i - k + 1 to i, each of twice as many as the last
    while k < WINDOW:
        more = roll.copy()
        more[k:] += roll[:-k] * np.uint64(pow(0x100000001B3, k, 1 << 64))
        roll, k = more, 2 * k
    return np.flatnonzero((roll >> np.uint64(40)) & np.uint64(MASK) == 0) + 1


def cuts(n: int, hits: np.ndarray, start: int = 0) -> list[int]:
    """Ends of the chunks of the n ids from ``start`` of a stream: content-defined, of LEAST to MOST ids but for the last.

    LEAST is over WINDOW, so no chunk depends on what stands before its document.
    """
    out, at, last = [], start, start + n
    while last - at > LEAST:
        i = int(np.searchsorted(hits, at + LEAST))
        at = min(int(hits[i]) if i < len(hits) else last, at + MOST, last)
        out.append(at)
    if at < last:
        out.append(last)
    return out


class Encoder:
    """Ids of texts by a tokenizers file.

    Where the file drops white space and lets no piece cross it, the words between it are encoded once and remembered
    for as long as they keep coming: what isn't met while ``most`` / 2 others are is forgotten. Any other file encodes
    whole texts, and so is a text with one of the separators that only tokenizers don't take for white space. New words of
    letters only are encoded together, a thousand in one text: such a word is one piece to the tokenizer, and its last id
    is one that ends a word. Words that hold the text of an added token, in any case, are never taken apart.
    """

    def __init__(self, path: str, most: int = 800_000):
        limit_threads()
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.by_words = drops_white_space(json.loads(self.tokenizer.to_str()))
        added = sorted({t.content for t in self.tokenizer.get_added_tokens_decoder().values()}, key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)", re.I)
        # A sign that each added token has, and what normalisers may turn into it: words without these can't hold one.
        signs = {next((c for c in t if not c.isalnum()), "") for t in added}
        self.signs = [c for c in map(chr, range(0x10000)) if c in signs or not c.isascii() and signs.intersection(unicodedata.normalize("NFKD", c))] + [""] * ("" in signs)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True

    def plain(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def holds_added(self, word: str) -> bool:
        """Whether an added token may be found in a word, as it is or as the tokenizer normalises it."""
        normal = self.tokenizer.normalizer
        return bool(self.added.search(word)) or (normal is not None and not word.isascii() and bool(self.added.search(normal.normalize_str(word))))

    def together(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters, as many as there are words, or of each by itself where the ends don't show them."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        ends = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
        if len(ends) != len(words) or ends[-1] != 4 * len(ids):
            return self.plain(words)
        raw = ids.tobytes()
        return [raw[x:y] for x, y in zip([0, *ends], ends, strict=False)]

    def learn(self, words: list[str]) -> None:
        """Take up words, from before if they were met then; one with ASCII signs at its end from its two parts."""
        known = self.known
        if self.before:
            met = list(map(self.before.get, words))
            known.update((w, x) for w, x in zip(words, met, strict=True) if x is not None)
            words = [w for w, x in zip(words, met, strict=True) if x is None]
        together = " ".join(words)
        if any(c in together for c in self.signs):  # hardly ever
            odd = [w for w in words if self.holds_added(w)]
            known.update(zip(odd, self.plain(odd), strict=True))
            words = [w for w in words if w not in known]
        letters, other, parts = [], [], []
        for w in words:
            if w.isalpha():
                letters.append(w)
            elif m := _TAIL.match(w):
                head, tail = m.groups()
                parts.append((w, head, tail))
                (letters if head.isalpha() else other).append(head)
                other.append(tail)
            else:
                other.append(w)
        letters = [w for w in dict.fromkeys(letters) if w not in known]
        for at in range(0, len(letters), 1000):
            some = letters[at : at + 1000]
            known.update(zip(some, self.together(some), strict=True))
        other = [w for w in dict.fromkeys(other) if w not in known]
        known.update(zip(other, self.plain(other), strict=True))
        for w, head, tail in parts:
            known[w] = known[head] + known[tail]

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, ids of each) of an Arrow string array."""
        import pyarrow.compute as pc

        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, "[\x1c-\x1f]")  # white space to Python and Arrow but not to tokenizers
        if not self.by_words or pc.any(odd).as_py():
            whole = texts if not self.by_words else texts.filter(odd)
            raw = self.plain(whole.to_pylist())
            if len(whole) < len(texts):
                ids, sizes = self.encode_words(pc.if_else(odd, "", texts))
                each = np.split(ids.view(np.uint8), np.cumsum(sizes[:-1]) * 4)
                given = iter(raw)
                raw = [next(given) if o else x.tobytes() for o, x in zip(odd.to_pylist(), each, strict=True)]
            return np.frombuffer(b"".join(raw), "<u4"), np.array([len(x) // 4 for x in raw], np.int64)
        return self.encode_words(texts)

    def encode_words(self, texts) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > self.most // 2:
            self.known, self.before = {}, self.known
        words, places, sizes = split_words(texts)
        found = list(map(self.known.get, words))
        if None in found:
            self.learn([w for w, x in zip(words, found, strict=True) if x is None])
            found = list(map(self.known.__getitem__, words))
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
        each = lengths[places]
        ends = np.cumsum(each)
        at = np.arange(ends[-1] if len(ends) else 0)
        at += np.repeat((np.cumsum(lengths) - lengths)[places] - (ends - each), each)
        before = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)])]
        return np.frombuffer(b"".join(found), "<u4")[at], np.diff(before)


def drops_white_space(file: dict) -> bool:
    """Whether a tokenizers file cuts texts at white space, drops it, and joins nothing across it."""
    steps = file.get("pre_tokenizer") or {}
    first = (steps.get("pretokenizers") or [steps])[0]
    pattern = (first.get("pattern") or {}).get("Regex", "")
    dropped = first.get("type") == "Split" and first.get("invert") and first.get("behavior") == "Removed" and r"[^\s" in pattern and r"\s" not in pattern.replace(r"[^\s", "")
    whole = not any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"]) for t in file.get("added_tokens", []))
    return bool(dropped and whole and file.get("post_processor") is None and file["model"].get("end_of_word_suffix") == "</w>")


@cache
def encoder(path: str) -> Encoder:
    """A worker's encoder; workers go from task to task, and so do the words they know."""
    return Encoder(path)


class _Pack:
    """A pack being written: chunks gathered into frames."""

    def __init__(self, folder: str, number: int, level: int = LEVEL):
        self.level = level
        self.fs, self.root = filesystem(f"{folder}/packs")
        self.fs.create_dir(self.root, recursive=True)
        self.final, self.temp = f"{self.root}/part-{number:06d}.ids", f"{self.root}/.writing-{number:06d}-{TaskContext.get().taskAttemptId()}"
        self.sink = self.fs.open_output_stream(self.temp)
        self.number, self.at, self.held, self.n, self.waiting = number, 0, [], 0, []

    def add(self, ids: np.ndarray, key: bytes, done: dict) -> None:
        """``done`` gets the chunk's place once its frame is written."""
        self.held.append(ids)
        self.waiting.append((key, self.n, len(ids)))
        self.n += len(ids)
        if self.n >= FRAME_IDS:
            self.flush(done)

    def flush(self, done: dict) -> None:
        if self.held:
            ids = np.concatenate(self.held)
            width = 2 if ids.max() < 1 << 16 else 4
            raw = zstandard.compress(ids.astype(f"<u{width}").tobytes(), self.level)
            self.sink.write(HEADER.pack(len(raw), width) + raw)
            for key, first, n in self.waiting:
                done[key] = (self.at, HEADER.size + len(raw), first, n)
            self.at, self.held, self.n, self.waiting = self.at + HEADER.size + len(raw), [], 0, []

    def close(self) -> None:
        self.sink.close()
        self.fs.move(self.temp, self.final)


def pack(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Encode docs (doc_id, text), in ascending order within and across partitions, into packs; returns their chunks.

    (doc_id, pack, row, seq, ids, digest) for each chunk; ``row`` is the document's number in its pack.
    """
    schema = "doc_id long, pack int, row long, seq int, ids int, digest binary"

    def run(batches) -> Iterator:
        import pyarrow as pa

        words, out, stored, row, done = encoder(tokenizer), None, set(), 0, {}
        number = TaskContext.get().partitionId()
        for batch in batches:
            for low, high in text_slices(batch.column(1), SLICE):
                ids, sizes = words.encode(batch.column(1).slice(low, high - low))
                ids = np.insert(ids, np.cumsum(sizes), np.uint32(end_id))
                hits, sizes = hits_of(ids), sizes + 1
                out, begin = out or _Pack(f"{folder}/draft", number, DRAFT_LEVEL), 0
                lengths, digests, counts = [], [], []
                raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                for n in sizes.tolist():
                    ends = cuts(n, hits, begin)
                    for end in ends:
                        key = digest(raw[4 * begin : 4 * end])
                        if key not in stored:
                            stored.add(key)
                            out.add(ids[begin:end], key, done)
                        lengths.append(end - begin)
                        digests.append(key)
                        begin = end
                    counts.append(len(ends))
                done.clear()  # places are taken when the pack is final
                counts = np.array(counts)
                seq = np.arange(len(lengths)) - np.repeat(np.cumsum(counts) - counts, counts)
                of = np.repeat(np.arange(len(counts)), counts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low).take(pa.array(of)), pa.array(np.full(len(of), number), pa.int32()), pa.array(row + of, pa.int64()), pa.array(seq, pa.int32()), pa.array(lengths, pa.int32()), pa.array(digests, pa.binary())],
                    ["doc_id", "pack", "row", "seq", "ids", "digest"],
                )
                row += high - low
        if out is not None:
            out.flush(done)
            out.close()

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def frame_ids(raw: bytes) -> np.ndarray:
    """The ids of a frame with its header."""
    size, width = HEADER.unpack_from(raw)
    return np.frombuffer(zstandard.decompress(raw[HEADER.size : HEADER.size + size]), f"<u{width}").astype("<u4")


def read_frames(fs, path: str) -> Iterator[np.ndarray]:
    """The ids of each frame of a pack, one frame in memory at a time."""
    with fs.open_input_stream(path) as f:
        while head := f.read(HEADER.size):
            yield frame_ids(head + f.read(HEADER.unpack(head)[0]))


def settle(held: DataFrame, folder: str) -> DataFrame:
    """Keep in each pack the chunks it owns; (digest, pack, at, bytes, first, ids) of every stored chunk.

    ``held`` (pack, ids, digest, own) has a row for each chunk of a draft, all of a pack in one partition, pack by pack
    in the order they were stored. Drafts stay as they are, so a task can be run again at any time.
    """
    schema = "digest binary, pack int, at long, bytes int, first int, ids int"

    def run(batches) -> Iterator:
        import pyarrow as pa

        out, number, done, draft = None, None, {}, iter(())
        frame, at = np.empty(0, np.uint32), 0

        def rows():
            cols = [list(done), [number] * len(done), *([x[k] for x in done.values()] for k in range(4))]
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)], ["digest", "pack", "at", "bytes", "first", "ids"])

        for batch in batches:
            for pack_of, n, key, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if pack_of != number:
                    if out is not None:
                        out.flush(done)
                        out.close()
                        yield rows()
                    number, out = pack_of, _Pack(folder, pack_of)
                    fs, root = filesystem(f"{folder}/draft/packs/part-{number:06d}.ids")
                    draft, frame, at = read_frames(fs, root), frame[:0], 0
                if at == len(frame):
                    frame, at = next(draft), 0
                if own:
                    out.add(frame[at : at + n], key, done)
                at += n
            if done:
                yield rows()
        if out is not None:
            out.flush(done)
            out.close()
            yield rows()

    return held.select("pack", "ids", "digest", "own").mapInArrow(run, schema)


def packs_of(docs: DataFrame, pack_bytes: int) -> int:
    """How many packs: of about ``pack_bytes`` of text, or smaller ones where that leaves cores idle."""
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return max(1, -(-size // pack_bytes), min(4 * cores, -(-size // (1 << 22))))


def write_store(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, pack_bytes: int = 128 << 20) -> None:
    """Write the store of docs (doc_id, text) under ``folder``, in packs of about ``pack_bytes`` of text."""
    spark, n = docs.sparkSession, packs_of(docs, pack_bytes)
    # The last key deals out rows that repeat a doc_id and text, which are the same in any order.
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("nth"))
    ordered = keyed.repartitionByRange(n, "doc_id", "hash", "nth").sortWithinPartitions("doc_id", "hash")
    chunks = written(pack(ordered, folder, tokenizer, end_id), "chunks")
    # The owner of a digest is its first place in document order; only digests and numbers are shuffled, once for each pack.
    here = chunks.groupBy("digest", "pack").agg(F.min(F.struct("row", "seq", "ids")).alias("at"))
    owners = here.groupBy("digest").agg(F.min("pack").alias("owner"))
    held = written(here.join(owners, "digest").select("pack", "at.row", "at.seq", "at.ids", "digest", "owner"), "held")
    drafts = held.withColumn("own", F.col("pack") == F.col("owner")).repartition(n, "pack").sortWithinPartitions("pack", "row", "seq")
    places = written(settle(drafts, folder), "places")
    remove_folder(spark, f"{folder}/draft")
    sizes = chunks.groupBy("pack").agg(F.sum(F.col("ids").cast("long")).alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("pack").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row for each pack
    # A digest has a row for each of its packs here, not for each of its uses, so a chunk that many texts share is no hot key.
    found = held.select(F.col("pack").alias("part"), "digest").join(places, "digest")
    whole = chunks.select("doc_id", F.col("pack").alias("part"), "row", "seq", "digest").join(found, ["part", "digest"])
    recipes = whole.groupBy("part", "row", "doc_id").agg(F.sum(F.col("ids").cast("long")).alias("n_tokens"), F.array_sort(F.collect_list(F.struct("seq", "pack", "at", "bytes", "first", "ids", "digest"))).alias("c"))
    recipes = recipes.withColumn("places", F.transform("c", lambda c: F.struct(*[c[x].alias(x) for x in ("pack", "at", "bytes", "first", "ids", "digest")]))).drop("c")
    in_order = recipes.repartition(n, "part").withColumn("inside", F.sum("n_tokens").over(Window.partitionBy("part").orderBy("row")) - F.col("n_tokens"))
    placed = in_order.join(before.select(F.col("pack").alias("part"), "before"), "part").select("part", "row", "doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "places")
    rooted = placed.sortWithinPartitions("part", "row").mapInArrow(_add_root, f"part int, row long, doc_id long, start long, n_tokens long, places array<{PLACE}>, root binary")
    rooted.write.parquet(f"{folder}/recipes")
    manifest(spark.read.parquet(f"{folder}/recipes")).write.parquet(f"{folder}/manifest")


def _add_root(batches) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        places = batch.column(batch.schema.get_field_index("places"))
        flat, ends = places.flatten().field("digest").to_pylist(), np.cumsum([0, *places.value_lengths().to_pylist()])
        roots = [merkle(flat[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(roots, pa.binary())], [*batch.schema.names, "root"])


def manifest(recipes: DataFrame) -> DataFrame:
    """part, documents, n_tokens, start, root for each part of the recipes, which pass by in order and are not gathered."""
    schema = "part int, documents long, n_tokens long, start long, root binary"

    def run(batches):
        import pyarrow as pa

        def line():
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((part, documents, tokens, start, tree.root()), (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["part", "documents", "n_tokens", "start", "root"])

        part = None
        for batch in batches:
            for of, _, begin, n, root in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if of != part:
                    if part is not None:
                        yield line()
                    part, documents, tokens, start, tree = of, 0, 0, begin, Merkle()
                documents, tokens = documents + 1, tokens + n
                tree.add(root)
        if part is not None:
            yield line()

    return recipes.select("part", "row", "start", "n_tokens", "root").repartition("part").sortWithinPartitions("part", "row").mapInArrow(run, schema)


def check_manifest(spark, folder: str) -> None:
    """Raise unless the recipes give the manifest's lines and each part starts where the one before it ends."""
    kept = spark.read.parquet(f"{folder}/manifest")
    again = manifest(spark.read.parquet(f"{folder}/recipes")).select(*[F.col(x).alias(f"{x}_") for x in kept.columns])
    same = [F.col(x).eqNullSafe(F.col(f"{x}_")) for x in kept.columns]
    wrong = kept.join(again, kept["part"] == again["part_"], "full").where(~reduce(Column.__and__, same)).select(F.coalesce("part", "part_")).first()
    ends = kept.withColumn("ends", F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))  # a row for each pack
    wrong = wrong or ends.where(F.coalesce("ends", F.lit(0)) != F.col("start")).select("part").first()
    if wrong:
        raise ValueError(f"the recipes of part {wrong[0]} aren't what the manifest says")


def read_store(spark, folder: str) -> DataFrame:
    """doc_id, start, ids (little-endian unsigned 32-bit), root of every document, read from packs and verified."""
    check_manifest(spark, folder)
    recipes = spark.read.parquet(f"{folder}/recipes")

    def run(batches) -> Iterator:
        import pyarrow as pa

        fs, root_dir = filesystem(f"{folder}/packs")
        files, frames = OrderedDict(), OrderedDict()

        def frame(number: int, at: int, size: int) -> memoryview:
            if (number, at) not in frames:
                if number not in files:
                    if len(files) >= 32:
                        files.popitem(last=False)[1].close()
                    files[number] = fs.open_input_file(f"{root_dir}/part-{number:06d}.ids")
                files[number].seek(at)
                if len(frames) >= 64:
                    frames.popitem(last=False)
                frames[number, at] = memoryview(frame_ids(files[number].read(size)).view(np.uint8))
            return frames[number, at]

        for batch in batches:
            doc_ids, starts, counts, recipe, roots = batch.columns
            doc_ids, counts, roots = doc_ids.to_pylist(), counts.to_pylist(), roots.to_pylist()
            ends = np.cumsum([0, *recipe.value_lengths().to_pylist()]).tolist()
            places = list(zip(*(recipe.flatten().field(x).to_pylist() for x in ("pack", "at", "bytes", "first", "ids", "digest")), strict=True))
            low = 0
            while low < len(doc_ids):
                out, size, high = [], 0, low
                while high < len(doc_ids) and size < READ_BYTES:
                    pieces, tree = [], Merkle()
                    for number, at, held, first, ids, key in places[ends[high] : ends[high + 1]]:
                        raw = frame(number, at, held)[4 * first : 4 * (first + ids)]
                        if digest(raw) != key:
                            raise ValueError(f"a chunk of document {doc_ids[high]} isn't what was stored")
                        pieces.append(raw)
                        tree.add(key)
                    out.append(b"".join(pieces))
                    if len(out[-1]) != 4 * counts[high] or tree.root() != roots[high]:
                        raise ValueError(f"document {doc_ids[high]} can't be put together again")
                    size, high = size + len(out[-1]), high + 1
                rows = high - low
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, rows), starts.slice(low, rows), pa.array(out, pa.binary()), batch.column(4).slice(low, rows)], ["doc_id", "start", "ids", "root"])
                low = high

    return recipes.select("doc_id", "start", "n_tokens", "places", "root").mapInArrow(run, "doc_id long, start long, ids binary, root binary")


def word_tokenizer() -> str:
    """The tokenizer file that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def stored(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of docs (doc_id, text), by way of a store in the shared folder."""
    folder = new_folder(docs.sparkSession, "tokens")
    write_store(docs, folder, tokenizer or word_tokenizer())
    read = read_store(docs.sparkSession, folder)
    return read.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def query(spark, sf_dir: str) -> DataFrame:
    return stored(table(spark, sf_dir, "documents").select("doc_id", "text"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as token ids in the store, a row for each."""
    return stored(docs.select("doc_id", "text"))
