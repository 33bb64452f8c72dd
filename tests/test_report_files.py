"""A file for each report, all or none of a run; reports packed into partitions, and taken up as they come."""

import json
import os
import pickle
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.__main__ import main
from millrace.plans import registry
from millrace.sources import derived, report_files, reports, sinks
from tests.test_io import CLAIM, parse


def files(folder):
    return {p.name: p.read_bytes() for p in Path(folder).rglob("*") if p.is_file()}


def rows(spark, data, parts=3):
    return spark.createDataFrame(data, "name string, content string").repartition(parts)


def test_json_files_are_laid_out_as_a_json_module_does(spark, tmp_path):
    data = [(f"r{i}", json.dumps({"b": None, "a": [1, {"ü": "x"}], "n": i})) for i in range(20)]
    sinks.write_report_files(rows(spark, data), str(tmp_path), ".json", indent=2)
    want = {f"{n}.json": json.dumps(json.loads(c), indent=2, ensure_ascii=False).encode() for n, c in data}
    assert files(tmp_path) == want | {"_SUCCESS": b""} and os.listdir(tmp_path).__len__() == 21


def test_a_run_again_replaces_files_and_overwriting_drops_others(spark, tmp_path):
    out = str(tmp_path / "new" / "folder")
    sinks.write_report_files(rows(spark, [("a", "one"), ("b", "two"), ("c", None)]), out, ".txt")
    (Path(out) / "other.json").write_text("kept")
    sinks.write_report_files(rows(spark, [("a", "1")]), out, ".txt")
    assert files(out) == {"a.txt": b"1", "b.txt": b"two", "c.txt": b"", "other.json": b"kept", "_SUCCESS": b""}
    sinks.write_report_files(rows(spark, [("d", "4")]), out, ".txt", mode="overwrite")
    assert files(out) == {"d.txt": b"4", "other.json": b"kept", "_SUCCESS": b""}
    sinks.write_report_files(rows(spark, []), out, ".txt")
    assert files(out).keys() == {"d.txt", "other.json", "_SUCCESS"}


@pytest.mark.parametrize(
    ("data", "message"),
    [([*[(f"r{i}", "{}") for i in range(9)], ("bad", "{")], "Expecting"), ([("a/b", "{}")], "not a report's name"), ([(None, "{}")], "not a report's name"), ([("a", "{}"), ("a", "{}")], "two objects|two tasks")],
)
def test_a_failed_run_leaves_what_was_there(spark, tmp_path, data, message):
    sinks.write_report_files(rows(spark, [("r1", '{"old": 1}')]), str(tmp_path), ".json", indent=2)
    before = files(tmp_path)
    with pytest.raises(Exception, match=message):
        sinks.write_report_files(rows(spark, data), str(tmp_path), ".json", indent=2)
    assert files(tmp_path) == before and sorted(os.listdir(tmp_path)) == ["_SUCCESS", "r1.json"]


def test_one_report_written_by_two_tasks_fails(spark, tmp_path):
    two = spark.range(0, 2, 1, 2).select(F.lit("a").alias("name"), F.col("id").cast("string").alias("content"))
    with pytest.raises(Exception, match="two tasks"):
        sinks.write_report_files(two, str(tmp_path), ".txt")
    assert os.listdir(tmp_path) == []


def test_other_columns_are_refused(spark, tmp_path):
    with pytest.raises(Exception, match="name and content"):
        sinks.write_report_files(spark.createDataFrame([("a", "b")], "name string, text string"), str(tmp_path), ".txt")


def test_page_files_are_in_page_order(spark, tmp_path):
    pages = spark.createDataFrame([(d, p, f"page {p} of {d}  \n") for d in range(5) for p in (3, 1, 10, 2)], "doc_id long, page_number int, text string").repartition(7)
    sinks.write_page_files(pages, str(tmp_path))
    got = files(tmp_path)
    assert got["3.txt"].decode() == "".join(f"========== PAGE {p} ==========\npage {p} of 3\n\n" for p in (1, 2, 3, 10)) and len(got) == 6


def test_report_files_come_back(spark, tmp_path):
    nested = registry.nested_reports(spark, "/root/testdata/sf0.001").where("doc_id < 12")
    sinks.write_json_files(nested, str(tmp_path))
    assert {p.name for p in tmp_path.glob("*.json")} == {f"doc-{i}.json" for i in range(12)}
    one = json.loads((tmp_path / "doc-3.json").read_text("utf-8"))
    assert list(one) == ["report_metadata", "chunks", "extraction_warnings"] and one["report_metadata"]["report_type"] is None
    back = sinks.read_json_files(spark, str(tmp_path), nested.drop("doc_id").schema)
    assert back.select(F.sum(F.size("chunks"))).first() == nested.select(F.sum(F.size("chunks"))).first()


@pytest.mark.parametrize("alike", [False, True])
def test_the_driver_gets_no_names(tmp_path, monkeypatch, alike):
    """What a task sends back doesn't grow with its files; names whose hashes meet are still told apart."""
    monkeypatch.setattr(report_files, "FILES", 10)
    if alike:
        monkeypatch.setattr(report_files, "_hashes", lambda names: np.zeros(len(list(names)), np.uint64))
    made = lambda names: iter([pa.RecordBatch.from_pydict({"name": names, "content": [f"of {n}" for n in names]})])
    names, others = [f"report {i}" for i in range(95)], [f"other {i}" for i in range(10)]
    writer = report_files._Writer({"path": str(tmp_path), "suffix": ".txt"}, ["name", "content"], False)
    told = [writer.write(made(names)), None, writer.write(made(others)), writer.write(made([]))]
    assert max(len(pickle.dumps(m)) for m in told) < 300
    writer.commit(told)
    assert files(tmp_path) == {f"{n}.txt": f"of {n}".encode() for n in names + others} | {"_SUCCESS": b""} and len(os.listdir(tmp_path)) == 106
    again = report_files._Writer({"path": str(tmp_path), "suffix": ".txt"}, ["name", "content"], False)
    with pytest.raises(ValueError, match="two tasks: report 3$"):
        again.commit([again.write(made(["report 3", "new"])), again.write(made(["report 3"]))])
    assert len(os.listdir(tmp_path)) == 106


def test_files_are_read_back_without_a_list_on_the_driver(spark, tmp_path):
    data = [("a b%20", "one\n\ntwo\n"), ("ü.x", "é"), ("_c", ""), ("d", None)]
    sinks.write_report_files(rows(spark, data), str(tmp_path), ".txt")
    (tmp_path / "other.json").write_text("{}")
    (tmp_path / "folder.txt").mkdir()
    found = sinks.read_page_files(spark, str(tmp_path))
    assert {(r.name, r.text) for r in found.collect()} == {(n, t or "") for n, t in data} and found.inputFiles() == []
    assert sinks.read_json_files(spark, str(tmp_path), spark.createDataFrame([], "x int").schema).collect() == [(None,)]
    assert report_files.texts(spark, str(tmp_path), ".none").collect() == []
    assert registry.queries()["s07_page_files"](spark, "/root/testdata/sf0.001").inputFiles() == []


def test_command_line_writes_report_files(spark, tmp_path):
    derived.claim_pages(spark, "/root/testdata/sf0.001").where("doc_id < 4").write.parquet(str(tmp_path / "pages"))
    assert main(["claims", str(tmp_path / "pages"), str(tmp_path / "out"), "--pages-table", "--report-files", "--learn-sentences"]) == 0
    assert {p.name for p in (tmp_path / "out" / "text").glob("*.txt")} == {f"{i}.txt" for i in range(4)}
    for name, df in (("blocks", derived.layout_blocks(spark, "/root/testdata/sf0.001")), ("tables", derived.layout_tables(spark, "/root/testdata/sf0.001"))):
        df.where("doc_id < 4").write.parquet(str(tmp_path / "layout" / name))
    assert main(["chunks", str(tmp_path / "layout"), str(tmp_path / "json"), "--layout-tables", "--report-files"]) == 0
    assert {p.name for p in (tmp_path / "json").glob("*.json")} == {f"{i}.json" for i in range(4)}


def test_files_are_packed_by_their_bytes():
    small = [(f"{i:06d}.pdf", 10_000) for i in range(100_000)]
    parts = reports.packed(small, 32 << 20, 256 << 10)
    assert [p for x in parts for p in x.paths] == [p for p, _ in small] and 300 < len(parts) < 1500
    mixed = reports.packed([("a", 1), ("b", 100), ("c", 1), ("d", 1)], 10, 2)
    assert [x.paths for x in mixed] == [["a"], ["b"], ["c", "d"]] and reports.packed([], 10, 2) == []


def put(folder, name, *pages):
    """A report put in place whole."""
    Path(folder, f".{name}").write_text(json.dumps({"pages": [[p, 792.0, None] for p in pages]}))
    os.rename(Path(folder, f".{name}"), Path(folder, name))


def test_one_task_reads_many_files_and_a_bad_one_is_one_row(spark, tmp_path):
    for i in range(30):
        put(tmp_path, f"r{i:02d}.pdf", CLAIM, "two")
    (tmp_path / "r07.pdf").write_bytes(b"locked")
    reports.register(spark, parse)
    df = spark.read.format("report").load(str(tmp_path))
    got = df.collect()
    assert df.rdd.getNumPartitions() == 1 and len(got) == 29 * 2 + 1 and [r.error for r in got if r.status == "failed"] == ["encrypted"]
    assert spark.read.format("report").option("partitionBytes", "1").load(str(tmp_path)).rdd.getNumPartitions() == 30


def test_reports_are_taken_up_once_as_they_come(spark, tmp_path):
    """Three runs of a stream with a restart after each, one of them with its log ahead of its checkpoint."""
    (folder := tmp_path / "in").mkdir()
    reports.register(spark, parse)

    def run():
        stream = spark.readStream.format("report").option("log", str(tmp_path / "log")).load(str(folder))
        query = stream.select(sinks.stem(F.col("path")).alias("doc_id"), "page_number", "text").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted((r.doc_id, r.page_number) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    put(folder, "a.pdf", "x", "y")
    put(folder, "b.PDF", "z")
    put(folder, "c.txt", "not a report")
    assert run() == [("a", 1), ("a", 2), ("b", 1)]
    put(folder, "a0.pdf", "sorts first")
    assert run() == [("a", 1), ("a", 2), ("a0", 1), ("b", 1)]
    put(folder, "d.pdf", "listed before the driver died")
    reader = reports._StreamReader({"path": str(folder), "log": str(tmp_path / "log")}, parse)
    assert reader.latestOffset() == {"listing": 3} and reader.latestOffset() == {"listing": 3}
    assert run() == run() == [("a", 1), ("a", 2), ("a0", 1), ("b", 1), ("d", 1)]
    with pytest.raises(Exception, match="option log"):
        spark.readStream.format("report").load(str(folder)).writeStream.format("noop").trigger(availableNow=True).start().awaitTermination()
