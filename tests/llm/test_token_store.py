"""The token store against the tokenizer itself, and what its manifest must notice."""

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import token_store
from millrace.llm.common import new_folder, split_words, text_slices
from tests.llm.conftest import sentence


def encoded(encoder, texts):
    ids, sizes = encoder.encode(pa.array(texts))
    return [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]


def test_words_are_encoded_as_the_tokenizer_does():
    """Alone, together, and beside texts with separators that send them to the plain tokenizer."""
    import random

    encoder, rng = token_store.Encoder(token_store.word_tokenizer()), random.Random(5)
    assert encoder.by_words
    texts = ["x<|ENDOFTEXT|>y.", "x<|endoftext|>y. a <|endoftext|> b", "", "  ", "İstanbul. İ' İ! ΟΔΟΣ. Σ, dont's, it's. 's 'S x'S. a²! ½? é. é!", "ড়! གྷ+ ≮<", "don't!! 'll, <|startoftext|>."]
    texts += ["say <|endoftext|> now", "hello.<|endoftext|>", '<|endoftext|>"', "a<|endoftext|>, b", "é<|EndOfText|>!", "<|endoftext|>", "<|endoftext|><|startoftext|>.", "<|endoftext |>"]
    signs = list("aAbBzéÉß'\"<|>.,;:!?#%&*_-=+1½ΣσςİıǅŒ中あ한  \t\n") + ["<|endoftext|>", "the ", "ড়"]
    texts += ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    odd = ["a\x1cb c.", "\x1f", "x <|endoftext|>\x1d."]
    want = {t: e.ids for t, e in zip([*texts, *odd], encoder.tokenizer.encode_batch([*texts, *odd], add_special_tokens=False), strict=True)}
    assert encoded(encoder, texts) == [want[t] for t in texts]
    mixed = [x for k, t in enumerate(texts) for x in ([t, odd[k % 3]] if k % 7 == 0 else [t])]
    assert encoded(token_store.Encoder(token_store.word_tokenizer()), mixed) == [want[t] for t in mixed]
    alone = token_store.Encoder(token_store.word_tokenizer())
    assert all(encoded(alone, [t]) == [want[t]] for t in [*texts[:60], *odd])
    assert want["say <|endoftext|> now"] == [1451, 49407, 692]


def test_a_file_that_keeps_white_space_encodes_whole_texts():
    import public_tokenizers

    encoder = token_store.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert not encoder.by_words
    ids, sizes = encoder.encode(pa.array(["two  words here", None]))
    assert ids.tolist() == encoder.tokenizer.encode("two  words here", add_special_tokens=False).ids and sizes.tolist() == [len(ids), 0]


def test_words_and_slices():
    words, places, sizes = split_words(pa.array(["  a b a ", None, "", "b c"]))
    assert [words[i] for i in places] == ["a", "b", "a", "b", "c"] and sizes.tolist() == [3, 0, 0, 2]
    words, places, sizes = split_words(pa.array(["b c\x0b d"]), ascii_only=True)
    assert [words[i] for i in places] == ["b c".encode(), b"d"] and sizes.tolist() == [2]
    texts = pa.array(["aaaa", None, "a" * 50, "b", "c"])
    assert [x for lo, hi in text_slices(texts, 5) for x in range(lo, hi)] == list(range(5))
    assert list(text_slices(pa.array([], pa.string()), 5)) == []


def test_the_root_is_that_of_levels_hashed_in_pairs():
    def levels(digests):
        level = [token_store.digest(b"\0" + d) for d in digests] or [token_store.digest(b"")]
        while len(level) > 1:
            level = [token_store.digest(b"\1" + level[i] + level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0]

    for n in range(20):
        leaves = [bytes([i]) * 16 for i in range(n)]
        assert token_store.merkle(leaves) == levels(leaves)


@pytest.fixture
def several(spark):
    """A store of several packs: a null and a repeated id hold a third of the rows each, and a passage is in many texts."""
    shared = " ".join(sentence(k, 300) for k in range(8))
    rows = [(None, sentence(i)) for i in range(60)] + [(7, sentence(1)) for _ in range(40)] + [(7, sentence(i, 30)) for i in range(20)]
    rows += [(100 + i, sentence(i, 200) + " " + shared + " " + sentence(i + 1, 90)) for i in range(50)] + [(300 + i, "") for i in range(10)]
    folder = new_folder(spark, "tokens")
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    token_store.write_store(docs, folder, token_store.word_tokenizer(), pack_bytes=100_000)
    return rows, folder


def test_several_packs_round_trip(spark, several):
    rows, folder = several
    plain = token_store.Encoder(token_store.word_tokenizer()).tokenizer
    want = Counter((i, zlib.crc32(np.array([*plain.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes())) for i, t in rows)
    got = sorted(token_store.read_store(spark, folder).collect(), key=lambda r: r.start)
    assert Counter((r.doc_id, zlib.crc32(bytes(r.ids))) for r in got) == want
    assert [r.doc_id or -1 for r in got] == sorted(r.doc_id or -1 for r in got)
    assert all(a.start + len(a.ids) // 4 == b.start for a, b in zip(got, got[1:], strict=False))
    recipes = spark.read.parquet(f"{folder}/recipes")
    parts = [r["count"] for r in recipes.groupBy("part").count().collect()]
    assert len(parts) >= 6 and max(parts) < 100  # the hot ids don't stay together
    places = recipes.selectExpr("explode(places) as p").select("p.*").distinct()
    assert places.count() == places.select("digest").distinct().count()  # one place for each chunk
    assert not list(__import__("pathlib").Path(folder.removeprefix("file://")).glob("draft/*"))


def test_the_manifest_notices_recipes_that_were_changed(spark, several):
    _, folder = several
    recipes = spark.read.parquet(f"{folder}/recipes").cache()
    some = recipes.where("row = 1").orderBy("part").first()
    for wrong in (recipes.where(f"not (part = {some.part} and row = 1)"), recipes.union(recipes.where(f"part = {some.part} and row = 1")), recipes.where(f"part <> {some.part}")):
        other = new_folder(spark, "tokens")
        wrong.write.parquet(f"{other}/recipes")
        spark.read.parquet(f"{folder}/manifest").write.parquet(f"{other}/manifest")
        with pytest.raises(ValueError):
            token_store.read_store(spark, other)
