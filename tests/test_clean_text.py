"""Cleaned texts: what goes to Python, and in which portions."""

from rankforge.functions import features


def test_only_other_texts_go_to_python_in_small_batches(spark, monkeypatch):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "10000")
    try:
        rows = spark.createDataFrame([(1, "Plain  text\t"), (2, "ﬁne　Ｗide"), (3, None), (4, ""), (5, "é \x07")], "id int, text string")
        out = features.clean_text(rows, "text", "id")
        assert {r.id: r.clean for r in out.collect()} == {1: "plain text", 2: "fine wide", 3: "missing data", 4: "", 5: "é"}
        assert int(spark.conf.get(key)) <= 500
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "compatible(CASE WHEN" in plan or "compatible(if" in plan
    finally:
        spark.conf.set(key, before)
