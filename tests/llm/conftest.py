import pytest

WORDS = "the of and to in a is that for it was on are as with his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know".split()


def sentence(k: int, n: int = 60) -> str:
    """Different but plain words for each k."""
    return " ".join(WORDS[(k * 31 + i * i * 7 + i * (k % 13 + 1)) % len(WORDS)] + ("." if i % 11 == 10 else "") for i in range(n))


DE, FR = "der die und ist nicht ein zu den mit auf für dem sich des eine als auch es an werden", "le la les et des est une que dans pour qui sur pas avec plus ne se au ce il"


def other(words: str, k: int, n: int = 60) -> str:
    w = words.split()
    return " ".join(w[(k * 7 + i * i + i * (k % 5 + 1)) % len(w)] for i in range(n))


def rows():
    """Documents with what can go wrong: nulls, empty and very long texts, copies, repeated ids, odd characters."""
    item = sentence(900, 36)
    docs = [(i, sentence(i), "en", f"src{i % 3}") for i in range(30)]
    docs += [(30 + i, other(DE, i), "de", "src0") for i in range(12)] + [(45 + i, other(FR, i), "fr", "src0") for i in range(12)]
    docs += [(60, None, "en", "src1"), (61, "", None, None), (62, "   \n\t ", "en", "src1"), (63, "one two", "en", None), (64, "!!! ??? 123", "de", "src2")]
    docs += [(70, sentence(1), "en", "src1"), (71, sentence(1), "en", "src1"), (72, sentence(1) + " more", "en", "src2"), (5, sentence(5), "en", "src2"), (5, sentence(5), "en", "src2")]
    docs += [(80, " ".join(sentence(k, 300) for k in range(40)), "en", "src1"), (81, sentence(40) + " " + item + " " + sentence(41), "en", "src0"), (82, "a\x1cb\x00c ퟿ é́   end", "en", "src0"), (None, sentence(77), "en", "src0")]
    return docs, item


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    """A folder of tables with odd rows, and columns whose names clash with those the operators make."""
    from pyspark.sql import functions as F

    folder = str(tmp_path_factory.mktemp("odd"))
    docs, item = rows()
    extra = {c: F.lit(7) for c in ("id", "expected_grade", "p_top", "copies", "rate", "class_id", "start", "row", "word", "root", "n_tokens", "bucket")}
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long")).withColumns(extra).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, 0) for i in range(24)] + [(i, 1, 0) for i in range(30, 40)] + [(60, 0, 0), (61, 0, None), (62, None, 0), (63, 0, 1), (24, 0, 0), (25, 0, 1), (26, 1, 1), (None, 1, 0), (999, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumns({"id": F.lit(1), "grade": F.lit("x")}).write.parquet(f"{folder}/labels.parquet")
    page = "<html><body><nav><a href='/'>home</a></nav><article><h1>Title</h1><p>{}</p></article><footer>&copy; x</footer></body></html>"
    pages = [(i, f"http://x/{i}", page.format(sentence(i))) for i in range(8)] + [(20, "http://x/ ä\n", page.format(sentence(1))), (21, None, page.format(sentence(1))), (22, "u", None), (23, "u", ""), (24, "u", "<p>broken <b>mark"), (None, "u", page.format(sentence(2))), (1, "http://x/1", page.format(sentence(1)))]
    spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({"text": F.lit("t"), "n_chars": F.lit(0), "payload": F.lit(1), "digest": F.lit("d")}).write.parquet(f"{folder}/pages.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "tiny item"), (1, item)], "item_id long, text string").withColumns({"question": F.lit("q"), "answer": F.lit("a")}).write.parquet(f"{folder}/benchmark.parquet")
    vectors = [(i, [float((i * 7 + k * 3) % 11) - 5.2 for k in range(4)]) for i in range(130)] + [(200, None), (300, [0.0] * 4), (400, [1.0, None, 2.0, 3.0]), (500, [float("nan"), 1.0, 1.0, 1.0]), (600, [1.0, 2.0]), (700, [float("inf"), 0.0, 0.0, 1.0]), (100, [float((100 * 7 + k * 3) % 11) - 5.2 for k in range(4)]), (None, [1.0] * 4), (800, [0.3, 0.1, 0.2, 0.5])]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumns({"id": F.lit(1), "vector": F.lit("v"), "label": F.lit(0)}).write.parquet(f"{folder}/embeddings.parquet")
    return folder


@pytest.fixture(scope="session")
def empty(spark, odd, tmp_path_factory):
    """The same tables without rows."""
    folder = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "labels", "pages", "benchmark", "embeddings"):
        spark.read.parquet(f"{odd}/{name}.parquet").limit(0).write.parquet(f"{folder}/{name}.parquet")
    return folder
