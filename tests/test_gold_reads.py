from millrace.operators import evaluate


def test_claims_are_made_once(spark, tmp_path):
    spark.createDataFrame([(1, "waste fell by half in two years", "E"), (1, "staff were trained", "S"), (2, "waste fell", "E")], "doc_id long, text string, topic string").write.parquet(str(tmp_path / "claims"))
    gold = spark.createDataFrame([(1, 0, "Waste fell by half in two"), (1, 1, "nobody knows"), (2, 0, "waste fell")], "doc_id long, gold_id int, text string")
    found = evaluate.found_gold(gold, spark.read.parquet(str(tmp_path / "claims")), ["doc_id"])
    assert str(tmp_path / "claims") not in found._jdf.queryExecution().executedPlan().toString()  # but what was made of them
    assert sorted((r.doc_id, r.gold_id, r.found, r.as_topic) for r in found.collect()) == [(1, 0, True, "E"), (1, 1, False, None), (2, 0, True, "E")]
