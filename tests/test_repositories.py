"""Repositories on small tables: what is refused, what a fallback lends, nulls and empty tables."""

import pytest
from pyspark.sql import functions as F

from rankforge.operators import repository

SCHEMA = "dataset string, fold int, framework string, metric_error double, time_train_s double, time_infer_s double, metric string, problem_type string"


@pytest.fixture(scope="module")
def configs(spark):
    rows = [("a", 0, "X", 0.1), ("a", 1, "X", 0.2), ("b", 0, "X", 0.3), ("a", 0, "Y", 0.4), ("b", 0, "Z", None)]
    return spark.createDataFrame([(*r, 1.0, 2.0, "rmse", "regression") for r in rows], SCHEMA).withColumn("aux_metric", F.lit("mae"))


@pytest.fixture(scope="module")
def baselines(spark):
    rows = [("a", 0, "B", 0.5), ("c", 0, "B", 0.6)]
    return spark.createDataFrame([(*r, 3.0, 4.0, "rmse", "regression") for r in rows], SCHEMA)


def keyed(rows):
    return {(r.dataset, r.fold, r.framework): r for r in rows.collect()}


def test_assembled(spark, configs, baselines):
    got = keyed(repository.assemble_metrics(configs, baselines, validation=True))
    assert set(got) == {("a", 0, "X"), ("a", 1, "X"), ("b", 0, "X"), ("a", 0, "Y"), ("b", 0, "Z"), ("a", 0, "B")}, "baselines on datasets without configs go"
    assert got["a", 0, "B"].metric_error_val is None and got["a", 0, "B"].aux_metric is None and got["a", 0, "X"].aux_metric == "mae"
    named = keyed(repository.assemble_metrics(configs, baselines, datasets=["c", "b"], config_names=["Z"]))
    assert set(named) == {("b", 0, "Z"), ("c", 0, "B")}
    sizes = spark.createDataFrame([("a", 50)], "dataset string, NumberOfInstances long")
    batch = keyed(repository.assemble_metrics(configs, metadata=sizes))
    assert batch["a", 0, "X"].time_infer_s == 10.0 and batch["b", 0, "X"].time_infer_s is None
    with pytest.raises(ValueError, match="no baselines"):
        repository.assemble_metrics(configs, baseline_names=["B"])
    assert repository.assemble_metrics(configs.limit(0), baselines.limit(0), fallback="X").count() == 0


def test_external_results_stay_as_they_are(spark, configs):
    other = spark.createDataFrame([("z", 7, "E", 0.9, 1.0, 2.0, "rmse", "regression", "mine")], f"{SCHEMA}, note string")
    assert "note" not in repository.assemble_metrics(configs, external=other, datasets=["a"]).columns
    got = keyed(repository.assemble_metrics(configs, external=other, datasets=["a"], extra=True))
    assert got["z", 7, "E"].note == "mine" and got["a", 0, "X"].note is None and ("b", 0, "X") not in got


def test_fallback(configs, baselines):
    got = keyed(repository.assemble_metrics(configs, baselines, fallback="X"))
    assert len(got) == 4 * 3
    assert got["b", 0, "Z"].metric_error is None and not got["b", 0, "Z"].imputed, "a row with a null error is there"
    lent = got["a", 1, "B"]
    assert (lent.metric_error, lent.time_train_s, lent.imputed, lent.impute_method, lent.aux_metric) == (0.2, 1.0, True, "X", "mae")
    assert not got["a", 0, "B"].imputed and got["a", 0, "B"].impute_method is None


def test_fallback_keeps_identities(configs):
    typed = configs.withColumn("config_type", F.lower("framework"))
    got = keyed(repository.with_fallback(typed, typed.where("framework = 'X'"), "X"))
    assert got["a", 1, "Y"].config_type == "y" and got["a", 1, "Y"].metric_error == 0.2
    with pytest.raises(ValueError, match="several values of config_type"):
        repository.with_fallback(typed.withColumn("config_type", F.concat("framework", "dataset")), typed.where("framework = 'X'"), "X")
    with pytest.raises(ValueError, match="several rows"):
        repository.with_fallback(typed, typed.where("framework = 'X'").union(typed.where("framework = 'X'")), "X")


def test_datasets_and_ids(spark, configs, baselines):
    assert {tuple(r) for r in repository.dataset_info(configs, baselines).collect()} == {(x, "rmse", "regression") for x in "abc"}
    with pytest.raises(ValueError, match="several problem types"):
        repository.dataset_info(configs, baselines.withColumn("problem_type", F.lit("binary")))
    assert {tuple(r) for r in repository.dataset_ids(configs, baselines).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    numbered = spark.createDataFrame([("a", 31), ("b", 37), ("c", 3)], "dataset string, tid long")
    assert {tuple(r) for r in repository.dataset_ids(configs, baselines, numbered).collect()} == {("a", 31), ("b", 37), ("c", 3)}
    own = configs.withColumn("tid", F.when(F.col("dataset") == "a", 31).otherwise(38).cast("long"))
    with pytest.raises(ValueError, match="metadata"):
        repository.dataset_ids(own, None, numbered)
    with pytest.raises(ValueError, match="either all"):
        repository.dataset_ids(own, baselines)
    with pytest.raises(ValueError, match="several values of tid"):
        repository.dataset_ids(own.withColumn("tid", F.col("fold").cast("long") + F.length("framework")))
    with pytest.raises(ValueError, match="several values of dataset"):
        repository.dataset_ids(own.withColumn("tid", F.lit(1).cast("long")))


def test_report_keeps_rows_that_tell_nothing(spark):
    rows = spark.createDataFrame([("m", None, None), ("n", "best", None), ("o", "x", "GBM"), ("p", "x", "RF")], "method string, method_subtype string, config_type string")
    assert {r.method for r in repository.reported(rows, keep_best=False, banned_types=["GBM"]).collect()} == {"m", "p"}
    assert repository.reported(rows).count() == 4 and repository.reported(rows, methods=[]).count() == 0


def test_routes(spark):
    schema = "dataset string, fold int, config string, pred double"
    one = spark.createDataFrame([("a", 0, "X", 0.1), ("a", 0, "Y", 0.2)], schema)
    two = spark.createDataFrame([("a", 0, "Z", 0.3), ("b", 0, "X", 0.4), ("a", 0, "Y", 0.9)], schema)
    tasks = spark.createDataFrame([("a", 0), ("b", 0), ("a", 0)], "dataset string, fold int")
    with pytest.raises(ValueError, match="several repositories"):
        repository.routes([one, two], tasks, ["X"])
    with pytest.raises(ValueError, match="no repository"):
        repository.routes([one, two], tasks, ["X", "Y"], overlap="first")
    for overlap, y in (("first", 0.2), ("last", 0.9)):
        got = repository.routed_predictions([one, two], tasks, ["Z", "Y", "X"], "X", overlap).orderBy("dataset", "place").collect()
        assert [(r.dataset, r.place, r.config, r.lender, r.pred) for r in got] == [("a", 0, "Z", "Z", 0.3), ("a", 1, "Y", "Y", y), ("a", 2, "X", "X", 0.1), ("b", 0, "Z", "X", 0.4), ("b", 1, "Y", "X", 0.4), ("b", 2, "X", "X", 0.4)]


def test_labels(spark):
    schema = "dataset string, fold int, row long, y int"
    one = spark.createDataFrame([("a", 0, 1, 0), ("a", 0, 2, 0), ("a", 1, 1, 0)], schema)
    two = spark.createDataFrame([("a", 0, 1, 1), ("b", 0, 1, 1)], schema)
    assert sorted(map(tuple, repository.merged_labels([one, two]).select("dataset", "fold", "row", "y").collect())) == [("a", 0, 1, 1), ("a", 1, 1, 0), ("b", 0, 1, 1)], "a task is taken whole"


def test_family_weights(spark):
    types = spark.createDataFrame([("g1", "GBM"), ("g2", "GBM"), ("r", "RF"), ("k", "K.NN")], "config string, config_type string")
    rows = [("a", 0, "E", '{"g1": 0.25, "g2": 0.25, "r": 0.5}'), ("a", 1, "E", '{"r": 1.0, "g1": null}'), ("b", 0, "E", "{}"), ("a", 0, "F", '{"k": 1}')]
    results = spark.createDataFrame(rows, "dataset string, fold int, method string, ensemble_weight string")
    got = repository.family_weights(results, types, "E")
    assert got.columns == ["dataset", "fold", "RF", "GBM", "K.NN"]
    assert sorted(map(tuple, got.collect())) == [("a", 0, 0.5, 0.5, 0.0), ("a", 1, 1.0, 0.0, 0.0), ("b", 0, 0.0, 0.0, 0.0)]
    assert sorted(map(tuple, repository.family_weights(results, types, "E", ["GBM"], by_dataset=True).collect())) == [("a", 0.75, 0.0), ("b", 0.0, 0.0)]
    with pytest.raises(ValueError, match="unknown type"):
        repository.family_weights(results, types.where("config <> 'r'"), "E")
