"""Task sources, the older form of metadata, and statistical text embeddings against brute force."""

import numpy as np
import pytest

from rankforge.functions import text_statistics
from rankforge.sources import task_sources

COLUMNS = "dataset string, tid long, problem_type string, n_folds int, n_repeats int, n_features int, n_classes int, NumberOfInstances long, n_samples_train_per_fold double, n_samples_test_per_fold double"


def test_older_metadata_round_trip(spark):
    rows = [("a", 7, "binary", 3, 2, 4, 2, 100, 66.5, 33.5), ("b", 8, "regression", 1, 1, 5, 0, 50, 40.0, 10.0), ("none", 9, "binary", 0, 2, 1, 2, 5, 1.0, 1.0)]
    splits = task_sources.splits_of_datasets(spark.createDataFrame(rows, COLUMNS))
    got = {(r.dataset, r.repeat, r.fold): r for r in splits.collect()}
    assert set(got) == {("a", i, j) for i in range(2) for j in range(3)} | {("b", 0, 0)}
    assert got["a", 1, 2].num_instances_train == 66.5 and got["a", 0, 0].eval_metric == "roc_auc" and got["a", 0, 0].task_id_str == "7"
    assert got["b", 0, 0].num_classes == -1 and not got["b", 0, 0].is_classification and got["b", 0, 0].target_name is None
    back = {r.dataset: r for r in task_sources.datasets_of_splits(splits).collect()}
    assert (back["a"].n_folds, back["a"].n_repeats, back["a"].n_samples_train_per_fold, back["a"].n_samples_test_per_fold, back["a"].n_features) == (3, 2, 66.5, 33.5, 4)
    assert set(back) == {"a", "b"} and back["b"].tid == "8" and back["b"].NumberOfInstances == 50


def test_older_metadata_errors(spark):
    rows = spark.createDataFrame([("a", 7, "ranking", 3, 2, 4, 2, 100, 66.5, 33.5)], COLUMNS)
    with pytest.raises(ValueError, match="tid"):
        task_sources.splits_of_datasets(rows.drop("tid"))
    with pytest.raises(ValueError, match="neither"):
        task_sources.splits_of_datasets(rows.drop("dataset"))
    with pytest.raises(Exception, match="ranking"):
        task_sources.splits_of_datasets(rows).collect()
    assert task_sources.splits_of_datasets(rows.limit(0)).count() == 0


def test_sources(spark, tmp_path):
    rows = [{"dataset": "a", "n": 1}, {"dataset": "b", "n": 2}]
    frame = task_sources.resolve_source(spark, rows)
    assert task_sources.resolve_source(spark, frame) is frame and frame.count() == 2
    frame.write.parquet(f"{tmp_path}/tasks.parquet")
    frame.write.csv(f"{tmp_path}/tasks.csv", header=True)
    task_sources.register_suite("two", lambda spark: spark.createDataFrame(rows))
    for source in (f"{tmp_path}/tasks.parquet", f"{tmp_path}/tasks.csv", "two"):
        assert sorted((r.dataset, r.n) for r in task_sources.resolve_source(spark, source).collect()) == [("a", 1), ("b", 2)]
    with pytest.raises(ValueError, match="already"):
        task_sources.register_suite("two", lambda spark: frame)
    for source in ("three", []):
        with pytest.raises(ValueError):
            task_sources.resolve_source(spark, source)


def test_results_without_metadata(spark):
    results = spark.createDataFrame([("m", "a", 0.1), ("m", "x", 0.2), ("m", None, 0.3)], "method string, dataset string, metric_error double")
    tasks = spark.createDataFrame([("a",), ("a",)], "dataset string")
    assert [r.dataset for r in task_sources.with_metadata(results, tasks).collect()] == ["a"]
    with pytest.raises(ValueError, match="x"):
        task_sources.with_metadata(results, tasks, require=True)
    assert task_sources.with_metadata(results.where("dataset = 'a'"), tasks, require=True).count() == 1


def test_lite(spark):
    def names(xs, **options):
        return sorted(r.subset for r in task_sources.without_lite(spark.createDataFrame([(x,) for x in xs], "subset string"), **options).collect())

    assert names(["all&lite", "lite", "lite&small"]) == ["all", "lite", "small"]
    assert names(["all", "small&lite"]) == ["all", "small&lite"]
    assert names(["all", "small&lite"], strip=True) == ["all", "small"]
    assert names(["all&lite"], strip=False) == ["all&lite"]
    with pytest.raises(ValueError, match="all"):
        names(["all", "all&lite"], strip=True)


def dense(texts):
    """Weights of character n-grams by the plain definition, a row a text."""
    counts = []
    for text in texts:
        row = {}
        for word in (text if text is not None else "NA").lower().split():
            padded = f" {word} "
            for n in (3, 4):
                for i in range(len(padded) - n + 1):
                    row[padded[i : i + n]] = row.get(padded[i : i + n], 0) + 1
        counts.append(row)
    terms = sorted({t for row in counts for t in row})
    tf = np.array([[row.get(t, 0) for t in terms] for row in counts], float)
    weights = tf * (np.log((1 + len(texts)) / (1 + (tf > 0).sum(axis=0))) + 1)
    return weights / np.maximum(np.linalg.norm(weights, axis=1, keepdims=True), 1e-300)


def test_text_embedding(spark):
    rng = np.random.default_rng(1)
    words = ["spark", "shuffle", "join", "a", "go", "partition", "skew", "Broadcast", "naïve"]
    texts = [" ".join(rng.choice(words[i % 3 :], size=int(rng.integers(1, 9)))) for i in range(60)] + [None, "", "a", "a"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(3)
    matrix = dense(texts)
    counts = text_statistics.term_counts(rows, ["id"], "text")
    weights = text_statistics.term_weights(counts, text_statistics.inverse_frequencies(counts, ["id"], len(texts)), ["id"])
    sums = {r.id: r.s for r in weights.groupBy("id").agg({"weight": "sum"}).withColumnRenamed("sum(weight)", "s").collect()}
    assert all(sums.get(i, 0) == pytest.approx(matrix[i].sum()) for i in range(len(texts)))
    fit = text_statistics.fit_text_statistics(rows, ["id"], "text", dimensions=5)
    u, s, _ = np.linalg.svd(matrix, full_matrices=False)
    assert fit.singular == pytest.approx(s[:5], rel=1e-4)
    out = {r.id: r.v for r in fit.transform(rows, ["id"], "text").collect()}
    got = np.array([out[i] for i in range(len(texts))])
    want = u[:, :5] * s[:5]
    want *= np.where((want**3).sum(axis=0) < 0, -1, 1)
    want /= np.sqrt(want.var(axis=0).sum())
    assert np.abs(got[:, :3] - want[:, :3]).max() < 1e-2
    assert np.abs(got @ got.T - want @ want.T).max() < 2e-2
    assert not got[61].any() and (got[62] == got[63]).all()


def test_text_embedding_edges(spark):
    rows = spark.createDataFrame([(1, "one"), (2, "one"), (None, "two")], "id int, text string")
    fit = text_statistics.fit_text_statistics(rows, ["id"], "text")
    assert len(fit.singular) == 1 and [len(r.v) for r in fit.transform(rows, ["id"], "text").collect()] == [1, 1, 1]
    none = text_statistics.fit_text_statistics(rows.limit(0), ["id"], "text")
    assert none.singular == () and none.transform(rows, ["id"], "text").where("size(v) = 0").count() == 3
