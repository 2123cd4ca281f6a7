"""Operators on small fixtures with known answers, and their edge cases."""

import numpy as np
import pytest

from rankforge.operators import aggregate, elo, metrics, pertask, portfolio, stability, subset

CELLS = {"t1": (0.1, 0.2, 0.4), "t2": (0.1, 0.3, 0.5), "t3": (0.2, 0.3, 0.6)}


@pytest.fixture()
def results(spark):
    rows = [(m, t, 0, e) for t, es in CELLS.items() for m, e in zip("ABC", es, strict=True)]
    return spark.createDataFrame(rows, "method string, dataset string, fold int, metric_error double")


def by(df, key="method"):
    return {r[key]: r.asDict() for r in df.collect()}


def test_leaderboard(results):
    board = by(aggregate.leaderboard(results))
    assert [board[m]["rank"] for m in "ABC"] == [1, 2, 3]
    assert [board[m]["winrate"] for m in "ABC"] == [1, 0.5, 0]
    assert [board[m]["mrr"] for m in "ABC"] == pytest.approx([1, 1 / 2, 1 / 3])
    assert all(sum(board[m][f"rank_{k}"] for k in (1, 2, 3, "more")) == pytest.approx(3) for m in "ABC")


def test_measures(results):
    rows = {(r.method, r.dataset): r for r in pertask.per_task(results).collect()}
    assert rows["C", "t1"].improvability == pytest.approx(0.75)
    assert rows["B", "t3"].improvability == pytest.approx(1 - 0.2 / 0.3)
    assert rows["B", "t1"].loss_rescaled == pytest.approx(0.1 / 0.3)
    assert rows["A", "t1"].frontier_advantage == pytest.approx(0.5)


def test_ties_zero_and_single(spark):
    rows = [("A", "t", 0, 0.1), ("B", "t", 0, 0.1), ("C", "t", 0, 0.3), ("A", "u", 0, 0.0), ("B", "u", 0, 0.0), ("A", "v", 0, 0.4)]
    got = {(r.method, r.dataset): r for r in pertask.per_task(spark.createDataFrame(rows, "method string, dataset string, fold int, metric_error double")).collect()}
    assert [got[m, "t"]["rank"] for m in "ABC"] == [1.5, 1.5, 3]
    assert got["A", "u"].improvability == got["A", "u"].loss_rescaled == got["A", "u"].frontier_advantage == 0
    assert got["A", "v"].frontier_advantage == 0


def test_perfect_baseline(spark):
    rows = [("A", "t", 0, 0.0), ("B", "t", 0, 0.1)]
    got = by(pertask.against_baseline(spark.createDataFrame(rows, "method string, dataset string, fold int, metric_error double"), "A"))
    assert got["A"]["relative_error"] == 1 and got["B"]["relative_error"] == float("inf")


def test_winrate_identity(spark):
    rng = np.random.default_rng(3)
    rows = [(f"m{m}", f"d{d}", 0, float(round(rng.random(), 1))) for m in range(6) for d in range(7)]
    df = spark.createDataFrame(rows, "method string, dataset string, fold int, metric_error double")
    slow, fast = by(aggregate.winrate(df)), by(aggregate.winrate_from_ranks(pertask.per_task(df)))
    assert {m: r["winrate"] for m, r in slow.items()} == pytest.approx({m: r["winrate"] for m, r in fast.items()})


def test_elo_orders_and_centres(results, spark):
    got = by(elo.elo(aggregate.battles(results)))
    assert got["A"]["elo"] > got["B"]["elo"] > got["C"]["elo"]
    assert sum(r["elo"] for r in got.values()) / 3 == pytest.approx(1000)
    even = spark.createDataFrame([("x", "y", "d", 0, "tie", 1.0)], "method_1 string, method_2 string, dataset string, fold int, winner string, weight double")
    assert [r.elo for r in elo.elo(even).collect()] == pytest.approx([1000, 1000])
    spread = by(elo.elo_bootstrap(aggregate.battles(results), rounds=10))
    assert all(r["elo_low"] <= r["elo_high"] for r in spread.values())


def test_elo_is_the_maximum():
    rng = np.random.default_rng(0)
    wins = rng.integers(1, 9, (5, 5)).astype(float)
    np.fill_diagonal(wins, 0)
    r = elo.ratings(wins)

    def likelihood(x):
        return -sum(wins[i, j] * np.log1p(10 ** ((x[j] - x[i]) / 400)) for i in range(5) for j in range(5))

    assert all(likelihood(r) >= likelihood(r + rng.normal(0, 5, 5)) - 1e-6 for _ in range(50))


def test_impute_and_dense(spark):
    rows = [("a", "d1", 0, 0.1), ("a", "d1", 1, 0.2), ("b", "d1", 0, 0.5)]
    df = spark.createDataFrame(rows, "method string, dataset string, fold int, metric_error double")
    filled = {(r.method, r.fold): (r.metric_error, r.imputed) for r in subset.impute(df).collect()}
    assert filled["b", 1] == (0.2, True) and len(filled) == 4
    assert {r.fold for r in subset.tasks_with_all_methods(df).collect()} == {0}
    assert {r.method for r in subset.methods_with_all_tasks(df).collect()} == {"a"}
    assert {r.method for r in subset.full_coverage(df).collect()} == {"a"}


def test_expressions(spark):
    tasks = spark.createDataFrame([("x", "binary", 100, 5), ("y", "regression", 20000, 90), ("z", None, None, None)], "dataset string, problem_type string, n_train long, n_features long")
    assert {r.dataset for r in subset.subset(tasks, "binary | medium").collect()} == {"x", "y"}
    assert {r.dataset for r in subset.subset(tasks, ["!binary", "!regression"]).collect()} == {"z"}
    for wrong in ("", "!", "nope", "binary|"):
        with pytest.raises(ValueError):
            subset.condition(wrong)


def test_auc_and_pareto(spark):
    rows = [("k", 1, 0.9), ("k", 0, 0.9), ("k", 0, 0.1), ("k", 1, 0.8), ("one", 1, 0.3)]
    got = by(metrics.auc(spark.createDataFrame(rows, "key string, y int, score double"), "key"), "key")
    assert got["k"]["auc"] == pytest.approx((0.5 + 1 + 0 + 1) / 4) and got["one"]["auc"] is None
    points = spark.createDataFrame([("a", 1.0, 1.0), ("b", 2.0, 1.0), ("c", 2.0, 0.5), ("d", 3.0, 2.0), ("e", 4.0, 1.5)], "method string, t double, s double")
    assert {r.method for r in metrics.pareto(points, "t", "s").collect()} == {"a", "b", "d"}


def test_amex_perfect(spark):
    rows = [("k", i, int(i < 5), 1.0 - i / 100) for i in range(100)]
    got = metrics.capture_and_gini(spark.createDataFrame(rows, "key string, id int, y int, score double"), "key", "id").first()
    assert got.amex == pytest.approx(1.0)


def test_portfolio(spark):
    table = [[0.1, 0.2, 0, 1, 0.2], [0, 0.2, 1, 1, 0.2], [0.1, 0.2, 1, 0, 0.2]]
    rows = [(str(c), f"t{t}", 0, float(e)) for t, row in enumerate(table) for c, e in enumerate(row)]
    packed = portfolio.packed_table(spark.createDataFrame(rows, "method string, dataset string, fold int, metric_error double"))
    assert portfolio.forward(packed, 3) == ["0", "2", "3"]


def test_ensemble(spark):
    rows = [("k", r, c, p, y) for r, y in enumerate((0.0, 1.0, 0.0, 1.0)) for c, p in (("good", y), ("bad", 1 - y))]
    got = {r.config: r.weight for r in portfolio.greedy_ensemble(spark.createDataFrame(rows, "key string, row_id int, config string, p double, y double"), 4).collect()}
    assert got == {"good": 1.0}


def test_stability_constant(spark):
    rows = [(m, "d", f, 0.5) for m in "ab" for f in (0, 1)]
    df = spark.createDataFrame(rows, "method string, dataset string, fold int, metric_error double")
    assert stability.fold_similarity(df, "metric_error").first().similarity is None
    assert stability.split_agreement(df, "half").first().agreement == 0.5
    assert stability.split_agreement(df, "ignore").first().agreement is None
    assert stability.split_agreement(df, "disagree").first().agreement == 0


def test_empty(spark):
    df = spark.createDataFrame([], "method string, dataset string, fold int, metric_error double")
    assert aggregate.leaderboard(df).count() == 0 and subset.impute(df).count() == 0
    assert elo.elo(aggregate.battles(df)).count() == 0
