from millrace.sources import derived, reports, sinks

FOLDER = "/root/testdata/sf0.001"


def test_rows_of_no_document_are_never_gathered(spark):
    plan = derived.layout_tables(spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("LeftSemi")  # the join lies below


def test_stand_ins_are_written_in_one_run(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(sinks, "write_report_files", lambda rows, folder, suffix: calls.append(rows))
    derived.write_stand_ins(spark, FOLDER, "nowhere")
    assert len(calls) == 1
    names = {r.name for r in calls[0].select("name").collect()}
    want = {r.doc_id for r in derived.table(spark, FOLDER, "documents").select("doc_id").collect()}
    assert names == {f"doc-{k}" + (".txt" if k % 7 == 0 else ".PDF" if k % 2 else ".pdf") for k in want}


def test_many_reports_make_no_more_partitions_than_tasks_can_start(monkeypatch):
    monkeypatch.setattr(reports, "listed", lambda folder: [(f"{k}.pdf", 3000) for k in range(1_000_000)])
    parts = reports._Reader({"path": "any"}, reports.parse_pdf).partitions()
    assert sum(len(p.paths) for p in parts) == 1_000_000 and len(parts) <= reports.MOST_PARTITIONS + 1
