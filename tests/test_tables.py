"""Edge cases of task metadata, stored predictions, removals, boards and features."""

import math

import pytest
from pyspark.sql import functions as F

from rankforge.functions import features
from rankforge.operators import metadata, removal
from rankforge.operators.predictions import Predictions, log_loss, true_class


@pytest.fixture
def splits(spark):
    rows = [("a", "binary", "r0f0", 0, 50, ["numerical"]), ("a", "binary", "r0f1", 1, 150, ["numerical"]), ("b", "regression", "r0f0", 0, 1000, ["numerical", "text"]), ("c", None, "r1f0", 3, None, [])]
    return spark.createDataFrame(rows, "dataset string, problem_type string, split_index string, split int, n_train long, dtypes array<string>")


def names(df):
    return sorted((r.dataset, r.split_index) for r in df.collect())


def test_select_splits(splits):
    assert names(metadata.select_splits(splits)) == [("a", "r0f0"), ("a", "r0f1"), ("b", "r0f0"), ("c", "r1f0")]
    assert names(metadata.select_splits(splits, split_indices="lite")) == [("a", "r0f0"), ("b", "r0f0")]
    assert names(metadata.select_splits(splits, train_rows=(50, 1000))) == [("a", "r0f1"), ("b", "r0f0")]
    assert names(metadata.select_splits(splits, forbidden_dtypes=["text"], problem_types=["binary", "regression"])) == [("a", "r0f0"), ("a", "r0f1")]
    assert names(metadata.select_splits(splits, expressions=["!regression", "!lite"])) == [("a", "r0f1"), ("c", "r1f0")]
    with pytest.raises(ValueError):
        metadata.select_splits(splits, split_indices=["f0r0"])
    with pytest.raises(ValueError):
        metadata.select_splits(splits, datasets=["a", "none"])
    assert metadata.select_splits(splits.limit(0), split_indices="lite").count() == 0


def test_per_dataset_and_stats(spark, splits):
    got = {r.dataset: (r.problem_type, r.max_train_rows, r.n_splits) for r in metadata.per_dataset(splits, "problem_type").collect()}
    assert got == {"a": ("binary", 150, 2), "b": ("regression", 1000, 1), "c": (None, None, 1)}
    rows = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (None, "x", 3), (None, None, None)], "g int, t string, v int")
    assert tuple(metadata.dataset_stats(rows, "t", True, ["g"]).first()) == (4, 2, 2, 2)
    assert tuple(metadata.dataset_stats(rows, "v", False).first()) == (4, 2, -1, 4)
    assert sorted(r.column for r in metadata.binary_columns(rows).collect()) == ["t"]
    assert metadata.binary_columns(rows.limit(0)).count() == 0


def test_predictions(spark, tmp_path):
    rows = [("d", f, s, c, i, i / 10) for f in (0, 1) for s in ("val", "test") for c in ("x", "y") for i in range(3) if (f, c) != (1, "y")]
    preds = spark.createDataFrame(rows, "dataset string, fold int, split string, config string, row long, pred double")
    labels = preds.where("config = 'x'").select("dataset", "fold", "split", "row", (F.col("row") % 2).alias("y"))
    Predictions(preds, labels).save(str(tmp_path))
    stored = Predictions.load(spark, str(tmp_path))
    assert stored.predict("val", "d", 0, ["x", "y"]).count() == 6
    assert "PartitionFilters: [isnotnull(dataset" in stored.predict("val", "d", 0, ["x"])._jdf.queryExecution().toString()
    with pytest.raises(ValueError):
        stored.predict("val", "d", 1, ["y"])
    lent = stored.predict("val", "d", 1, ["x", "y"], "x")
    assert sorted((r.config, r.pred) for r in lent.collect()) == sorted((c, i / 10) for c in "xy" for i in range(3))
    assert {(r.config, r.density) for r in stored.density().collect()} == {("x", 1.0), ("y", 0.5)}
    assert {r.config for r in stored.dense().predictions.collect()} == {"x"}
    assert stored.restricted(["y"]).predictions.count() == 6
    assert sorted(r.y for r in stored.labels_of("test", "d", 1).collect()) == [0, 0, 1]


def test_log_loss(spark):
    rows = spark.createDataFrame([([0.2, 0.8], 1), ([1.0, 0.0], 1), ([0.5, 0.5], 0)], "p array<double>, y int")
    got = rows.agg(log_loss(true_class(F.col("p"), F.col("y"))).alias("l")).first().l
    assert got == pytest.approx(-(math.log(0.8) + math.log(1e-15) + math.log(0.5)) / 3)


def brute_removals(results, method):
    """Removes, step by step, the method whose absence leaves the lowest mean rank."""

    def mean_rank(left):
        by = {}
        for (m, d, f), e in results.items():
            if m == method:
                others = [x for (n, dd, ff), x in results.items() if (dd, ff) == (d, f) and n in left and n != method]
                by.setdefault(d, []).append(1 + sum(x < e for x in others) + sum(x == e for x in others) / 2)
        return sum(sum(v) / len(v) for v in by.values()) / len(by)

    left, out = {m for m, _, _ in results}, []
    while len(left) > 1:
        score, name = min((round(mean_rank(left - {m}), 9), m) for m in left if m != method)
        left.discard(name)
        out.append((name, score))
    return out


def test_removals(spark):
    results = {(m, d, f): ((7 * i + 3 * j + 5 * f + i * j) % 6) / 10 for i, m in enumerate("abcde") for j, d in enumerate("xyz") for f in range(2) if (m, d, f) != ("b", "x", 1)}
    df = spark.createDataFrame([(*k, v) for k, v in results.items()], "method string, dataset string, fold int, metric_error double")
    rows = removal.removal_orders(df).collect()
    for m in "abcde":
        got = sorted((r.step, r.method_2, r.score) for r in rows if r.method_1 == m)
        want = brute_removals(results, m)
        assert [x[1] for x in got] == [x[0] for x in want]
        assert [x[2] for x in got] == pytest.approx([x[1] for x in want], abs=1e-6)
    assert removal.removal_orders(df, 100.0).count() == 0
    assert removal.removal_orders(df.limit(0)).count() == 0


def test_boards(spark):
    board = spark.createDataFrame([("A (default)", 1), ("A (tuned)", 2), ("A (tuned + ensembled)", 3), ("B (tuned)", 4), ("B (default)", 5), ("C", 6)], "method string, rank int")
    assert sorted(tuple(r) for r in removal.collapsed_variants(board).collect()) == [("A (T+E)", 3), ("B", 5), ("B (tuned)", 4), ("C", 6)]
    dated = spark.createDataFrame([("2024-01-01", 3.0, "m"), ("2024-01-01", 5.0, "n"), ("2024-01-02", 5.0, "o"), ("2024-01-03", 6.0, "p"), ("2024-01-04", None, "q")], "day string, v double, method string")
    assert [r.method for r in removal.date_front(dated, "day", "v", True).orderBy("day").collect()] == ["n", "p"]
    assert [r.method for r in removal.date_front(dated, "day", "v", False).orderBy("day").collect()] == ["m"]
    rated = spark.createDataFrame([("a", 1010.04, 1012.0, 1100.0), ("b", 990.0, 900.0, 1000.26)], "method string, elo double, elo_low double, elo_high double")
    got = {r.method: (r.elo, r.elo_plus, r.elo_minus) for r in removal.elo_board(rated, "b", 1000.0).collect()}
    assert got == {"a": (1020.0, 90.0, 0.0), "b": (1000.0, 10.3, 90.0)}
    with pytest.raises(ValueError):
        removal.elo_board(rated, "none")


def test_features(spark):
    texts = spark.createDataFrame([(1, " A  B\tc\x07 "), (2, None), (3, ""), (4, "ﬁ Ａ")], "k int, text string")
    got = {r.k: r.clean for r in features.clean_text(texts, "text", "k").collect()}
    assert got == {1: "a b c", 2: "missing data", 3: "", 4: "fi a"}
    times = spark.createDataFrame([(1, "2024-01-01 06:00:00"), (2, None)], "k int, t string").withColumn("t", F.col("t").cast("timestamp_ntz"))
    one, two = features.circular_calendar(times, "t", "k").orderBy("k").collect()
    assert one.hour_0 == pytest.approx(1) and one.hour_1 == pytest.approx(0) and one.weekday_0 == pytest.approx(math.sin(2 * math.pi / 7))
    assert two.year is None and two.month_0 is None
