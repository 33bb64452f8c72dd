"""Sources, sinks, the stream, the command line and the driver's entry."""

import csv
import io
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from millrace.__main__ import main
from millrace.functions import text as T
from millrace.functions.tokens import WordPiece
from millrace.operators import chunks as C, claims as K
from millrace.plans import registry
from millrace.sources import derived, reports, sinks
from millrace.streaming import claim_stream

CLAIM = "We reduced landfill waste to 640 tonnes last year."


def parse(raw: bytes) -> reports.Parsed:
    """A made-up format: a JSON object of pages, spans and tables."""
    if raw == b"locked":
        raise RuntimeError("encrypted")
    d = json.loads(raw)
    return reports.Parsed([tuple(p) for p in d["pages"]], [tuple(s[:6]) + (tuple(s[6]),) for s in d.get("spans", [])], [(p, g, b) for p, g, b in d.get("tables", [])])


@pytest.fixture
def folder(tmp_path):
    d = {"pages": [[CLAIM, 792.0, None], ["", 792.0, "broken"]], "spans": [[1, 0, 0, 0, "Big ", 20.0, [72, 100, 540, 120]], [1, 0, 0, 1, "title", 10.0, [72, 100, 540, 120]], [1, 0, 1, 0, "  ", 30.0, [72, 100, 540, 120]], [1, 1, 0, 0, " ", 9.0, [0, 0, 1, 1]]], "tables": [[1, [["a", None]], None], [1, [[" "]], [0, 0, 1, 1]]]}
    (tmp_path / "B.PDF").write_text(json.dumps(d))
    (tmp_path / "a.pdf").write_bytes(b"locked")
    (tmp_path / "note.txt").write_text("no")
    return str(tmp_path)


def test_report_source(spark, folder):
    reports.register(spark, parse)
    read = lambda part: spark.read.format("report").option("part", part).load(folder)
    pages = {(Path(r.path).name, r.page_number): (r.status, r.error) for r in read("pages").collect()}
    assert pages == {("B.PDF", 1): ("ok", None), ("B.PDF", 2): ("failed", "broken"), ("a.pdf", None): ("failed", "encrypted")}
    blocks = reports.blocks(read("spans").withColumn("doc_id", sinks.stem(F.col("path")))).collect()
    assert [(r.doc_id, r.text, r.max_font, r.median_font) for r in blocks] == [("B", "Big title", 30.0, 20.0)]
    assert [(r.data, r.x0) for r in read("tables").collect()] == [([["a", None]], None)]
    with pytest.raises(Exception, match="encrypted"):
        spark.read.format("report").option("strict", "true").load(folder).collect()
    with pytest.raises(Exception, match="nowhere"):
        spark.read.format("report").load("/nowhere/at/all").collect()


def test_default_parser_says_what_is_missing():
    with pytest.raises(RuntimeError, match="PyMuPDF"):
        reports.parse_pdf(b"%PDF")


def test_tsv_is_what_a_csv_module_writes(spark, tmp_path):
    rows = [("a", 'say "x"', " lead", ""), ("b\tc", "two \"\" lines", "back\\slash", "é")]
    df = spark.createDataFrame(rows, "w string, x string, y string, z string").coalesce(1)
    sinks.write_tsv(df, str(tmp_path / "out"))
    want = io.StringIO()
    csv.writer(want, delimiter="\t").writerows([("w", "x", "y", "z"), *rows])
    assert next((tmp_path / "out").glob("part-*")).read_bytes().decode() == want.getvalue()


def test_json_keeps_nulls(spark, tmp_path):
    df = spark.createDataFrame([(1, None, "ü")], "doc_id long, a string, b string")
    sinks.write_json(df, str(tmp_path / "out"))
    assert json.loads("".join(p.read_text("utf-8") for p in (tmp_path / "out").glob("part-*"))) == {"a": None, "b": "ü"}


def test_names_and_page_text(spark, tmp_path):
    got = spark.createDataFrame([("x.TSV",), ("y",), ("z.pdf",)], "n string").select(sinks.output_name(F.col("n"))).collect()
    assert [r[0] for r in got] == ["x.tsv", "y.tsv", "z.pdf.tsv"]
    assert spark.range(1).select(sinks.stem(F.lit("/a/b.c.pdf"))).first()[0] == "b.c"
    pages = spark.createDataFrame([(1, 2, "two  \n"), (1, 1, "one")], "doc_id long, page_number int, text string")
    sinks.write_page_text(pages, str(tmp_path / "t"), folders=True)
    text = "".join(p.read_text() for p in sorted((tmp_path / "t" / "doc_id=1").glob("part-*")))
    assert text == "========== PAGE 1 ==========\none\n\n========== PAGE 2 ==========\ntwo\n\n"
    sinks.write_page_text(pages, str(tmp_path / "u"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "u").glob("part-*")))
    assert text == "========== 1 PAGE 1 ==========\none\n\n========== 1 PAGE 2 ==========\ntwo\n\n"


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    pages = derived.claim_pages(spark, "/root/testdata/sf0.001").where("doc_id < 40")
    pages.repartition(3, "doc_id").write.parquet(str(tmp_path / "in"))
    stream = claim_stream.pages(spark, str(tmp_path / "in"), files_at_once=1)
    claim_stream.write_claims(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got, want = spark.read.parquet(str(tmp_path / "out")).drop("batch"), K.claims(pages)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and want.count() > 0


def test_command_line(spark, tmp_path, capsys):
    spark.createDataFrame([(1, 1, CLAIM)], "doc_id long, page_number int, text string").write.parquet(str(tmp_path / "pages"))
    assert main(["claims", str(tmp_path / "pages"), str(tmp_path / "out"), "--pages-table", "--company", "X"]) == 0
    assert "Strong: 1" in capsys.readouterr().out
    derived.layout_blocks(spark, "/root/testdata/sf0.001").where("doc_id = 3").write.parquet(str(tmp_path / "layout/blocks"))
    derived.layout_tables(spark, "/root/testdata/sf0.001").where("doc_id = 3").write.parquet(str(tmp_path / "layout/tables"))
    assert main(["chunks", str(tmp_path / "layout"), str(tmp_path / "json"), "--layout-tables", "--year", "2024"]) == 0
    report = json.loads("".join(p.read_text() for p in (tmp_path / "json").glob("part-*")))
    assert report["report_metadata"]["year"] == 2024 and report["chunks"][0]["chunk_id"] == "chunk_0001"


@pytest.fixture
def pieces(tmp_path):
    (tmp_path / "vocab.txt").write_text("\n".join(["[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]", "un", "##able", "to", "w", "##x", ".", "|", "-", "head", "r"]))
    return WordPiece(str(tmp_path / "vocab.txt"))


def test_word_pieces(spark, pieces):
    got = spark.createDataFrame([("Unable to",), ("",), (None,)], "t string").select(pieces.count(F.col("t")).alias("n")).collect()
    assert [r.n for r in got] == [3, 0, 0]


def test_word_pieces_pack_and_split(spark, pieces):
    """Every word counts two: what fits 480 signs has 960 subwords; windows are parts of the text as it was."""
    text = "Wx " * 199 + "wx. " + "Wx " * 99 + "wx. " + "WX  " * 300 + "wx. Unable to."
    one = spark.createDataFrame([(text,), ("wx to.",), ("",)], "t string").select(C.packed(F.col("t"), pieces).alias("p")).collect()
    assert one[1].p == ["wx to."] and one[2].p == []
    got = one[0].p
    assert got[0] == "Wx " * 199 + "wx." and got[1] == "Wx " * 99 + "wx." and got[-1] == "Unable to."
    assert len(got) == 5 and all(x in text for x in got) and got[2].startswith("WX  WX") and got[3].endswith("wx.")
    rows = [["head", "head"], *[[f"wx", "wx wx"] for _ in range(100)]]
    cut = spark.createDataFrame([(rows,)], "g array<array<string>>").select(C.split_table(F.col("g"), pieces).alias("p")).first().p
    size = lambda t: len(pieces._tokenizer().encode(t, add_special_tokens=False).ids)
    assert all(size(p.text) <= 480 < size(p.text + "\n| wx | wx wx |") for p in cut[:-1])
    assert sum(p.text.count("wx") for p in cut) == 300


def test_word_pieces_in_chunks(spark, pieces):
    b, t = (f(spark, "/root/testdata/sf0.001").where("doc_id < 12") for f in (derived.layout_blocks, derived.layout_tables))
    items = C.ordered_items(b, t).cache()
    rows = C.chunks(items, pieces).collect()
    assert rows and all(r.token_count <= 480 or r.oversize for r in rows)
    told = C.warnings(items, b, counter=pieces)
    assert told.where("message not like '%exceeded 480 tokens%'").isEmpty()


def test_another_sentence_splitter(spark):
    def make():
        import re

        known = re.compile(r"(?<!\bapprox)(?<=[.!?]) +")
        return known.split

    pages = spark.createDataFrame([(1, 1, "We cut approx. 5 tonnes. Then we rested."), (2, 1, None)], "doc_id long, page_number int, text string")
    plain = [r.raw for r in K.sentences(pages).orderBy("sent_idx").collect()]
    assert plain == ["We cut approx.", "5 tonnes.", "Then we rested."]
    split = lambda text: T.splitter(lambda: lambda s: s.replace("approx. ", "approx.~").replace(". ", ".|").replace("~", " ").split("|"))(text)
    assert [r.raw for r in K.sentences(pages, split).orderBy("sent_idx").collect()] == ["We cut approx. 5 tonnes.", "Then we rested."]


class _Page:
    """A stand-in for a page of the PDF libraries."""

    def __init__(self, text, blocks=(), fails=False, tables=()):
        self.text, self.blocks, self.fails, self.tables = text, list(blocks), fails, tables
        self.rect = type("Rect", (), {"height": 792.0})

    def get_text(self, kind):
        if self.fails:
            raise ValueError("bad page")
        return self.text if kind == "text" else {"blocks": self.blocks}

    def find_tables(self):
        if self.fails:
            raise ValueError("bad page")
        return self.tables


class _Table:
    def __init__(self, grid, bbox=None, fails=False):
        self.grid, self.fails = grid, fails
        if bbox:
            self.bbox = bbox

    def extract(self):
        if self.fails:
            raise ValueError("bad table")
        return self.grid


def test_default_parser_on_stand_ins(monkeypatch):
    import sys
    import types

    span = lambda t, s: {"text": t, "size": s}
    text_block = {"type": 0, "bbox": (1, 2, 3, 4), "lines": [{"spans": [span("Big ", 20.0), span("title", 10.0)]}, {"spans": [span("two", 9.0)]}]}
    pages = [_Page("one", [{"type": 1, "bbox": (0, 0, 1, 1)}, text_block], tables=[_Table([["a"]], (1, 1, 2, 2)), _Table([], None), _Table([["x"]], fails=True), _Table([["b"]])]), _Page("", fails=True), _Page("three", tables=[_Table([["c"]])])]

    class Doc(list):
        needs_pass, closed = True, False

        def authenticate(self, password):
            return password == "" and self.opens

        def close(self):
            self.closed = True

    doc = Doc(pages)
    doc.opens = True
    monkeypatch.setitem(sys.modules, "fitz", types.SimpleNamespace(open=lambda stream, filetype: doc))
    plumber = types.SimpleNamespace(pages=pages, __enter__=lambda self: self)

    class Opened:
        def __enter__(self):
            return plumber

        def __exit__(self, *_):
            return False

    monkeypatch.setitem(sys.modules, "pdfplumber", types.SimpleNamespace(open=lambda raw: Opened()))
    got = reports.parse_pdf(b"%PDF")
    assert got.pages == [("one", 792.0, None), ("", 792.0, "bad page"), ("three", 792.0, None)]
    assert got.spans == [(1, 0, 0, 0, "Big ", 20.0, (1, 2, 3, 4)), (1, 0, 0, 1, "title", 10.0, (1, 2, 3, 4)), (1, 0, 1, 0, "two", 9.0, (1, 2, 3, 4))]
    assert got.tables == [(1, [["a"]], (1, 1, 2, 2)), (1, [["b"]], None), (3, [["c"]], None)]  # beyond the bad page and the bad table
    doc.opens = False
    with pytest.raises(RuntimeError, match="encrypted"):
        reports.parse_pdf(b"%PDF")
    assert doc.closed


def test_command_line_on_reports(spark, tmp_path, capsys, monkeypatch):
    """One good report, one scanned, one locked: the good one comes out, the others are told of, and each is parsed once a part."""
    folder = tmp_path / "in"
    folder.mkdir()
    spans = [[1, 0, 0, 0, CLAIM, 10.0, [72, 300, 540, 320]]]
    (folder / "good.pdf").write_text(json.dumps({"pages": [[CLAIM, 792.0, None]], "spans": spans, "tables": [[1, [["a"], ["b"]], None]]}))
    (folder / "scan.pdf").write_text(json.dumps({"pages": [["", 792.0, None], ["x", 792.0, None]], "spans": spans}))
    (folder / "locked.pdf").write_bytes(b"locked")
    register = reports.register
    monkeypatch.setattr(reports, "register", lambda s: register(s, parse))
    assert main(["chunks", str(folder), str(tmp_path / "json"), "--company", "X"]) == 0
    err = capsys.readouterr().err
    assert "locked.pdf: encrypted" in err and "scan.pdf: the report appears to be scanned" in err
    found = [json.loads(line) for p in (tmp_path / "json").glob("part-*") for line in p.read_text().splitlines()]
    assert [r["report_metadata"]["source_pdf"] for r in found] == [str(folder / "good.pdf")]
    assert [(c["content_type"], c["text"]) for c in found[0]["chunks"]] == [("table", "| a |\n| --- |\n| b |"), ("paragraph", CLAIM)]
    assert main(["claims", str(folder), str(tmp_path / "claims")]) == 0
    assert "Strong: 1" in capsys.readouterr().out
    text = "".join(p.read_text() for p in (tmp_path / "claims/text").glob("part-*"))
    assert f"========== good PAGE 1 ==========\n{CLAIM}\n\n" in text
    (folder / "good.pdf").unlink()
    assert main(["chunks", str(folder), str(tmp_path / "none")]) == 2


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(registry.queries()) == set(registry.oracle_sql())
    assert set(registry.queries()) <= set(entry.queries())
