from itertools import product

import numpy as np
import pytest

from rankforge.operators import jobs, metrics, pertask, portfolio, scoring, subset

SCHEMA = "method string, dataset string, fold int, metric_error double"


def test_places_with_partial_credit(spark):
    refs = spark.createDataFrame([(f"r{k}", "task1", 0, float(k)) for k in (1, 2, 3)], SCHEMA)
    asked = [0.0, 0.8, 1.0, 1.5, 2.0, 4.0, 8.0]
    got = scoring.place_among(spark.createDataFrame([(str(e), "task1", 0, e) for e in asked], SCHEMA), refs)
    want = [0, 0.4, 0.5, 1.25, 1.5, 3 + 1 / 6, 3.5]
    assert {float(r.method): r.place for r in got.collect()} == pytest.approx(dict(zip(asked, want, strict=True)))


def test_removal_is_a_recount(spark):
    rng = np.random.default_rng(2)
    rows = [(f"m{m}", f"d{d}", f, float(round(rng.random(), 1))) for m in range(5) for d in range(3) for f in range(2)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.removed: r["rank"] for r in scoring.rank_without_each(pertask.per_task(df), "m0").collect()}
    for gone in ("m1", "m4"):
        left = pertask.per_task(df.where(f"method <> '{gone}'")).where("method = 'm0'").toPandas()
        assert got[gone] == pytest.approx(left.groupby("dataset")["rank"].mean().mean())


def test_wilcoxon():
    d = np.array([1.0, -2.0, 3.0, 4.0, -0.5, 6.0])
    ranks = np.array([2, 3, 4, 5, 1, 6.0])
    w = ranks[d > 0].sum()
    sums = [sum(r for r, s in zip(ranks, signs, strict=True) if s) for signs in product((0, 1), repeat=6)]
    assert scoring.wilcoxon(d) == pytest.approx(min(1, 2 * min(np.mean(np.array(sums) <= w), np.mean(np.array(sums) >= w))))
    assert scoring.wilcoxon(np.zeros(4)) == 1 and scoring.wilcoxon(np.ones(40)) < 1e-6


def test_temperature_and_hill_climbing(spark):
    rng = np.random.default_rng(5)
    z = rng.normal(size=4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-z))).astype(float)
    rows = [("k", float(1 / (1 + np.exp(-2 * a))), float(b)) for a, b in zip(z, y, strict=True)]
    got = scoring.temperature(spark.createDataFrame(rows, "key string, p double, y double"), "key").first().temperature
    assert got == pytest.approx(0.5, abs=0.06)
    p = [("k", i, c, v, t) for i, t in enumerate((0.0, 1.0, 0.0, 1.0)) for c, v in (("a", t * 0.8), ("b", 0.2 + t * 0.8))]
    weights = {r.config: r.weight for r in scoring.hill_climb(spark.createDataFrame(p, "key string, row_id int, config string, p double, y double")).collect()}
    assert weights == pytest.approx({"a": 0.5, "b": 0.5})


def brute_weights(p, y, iterations=40):
    """Both searches over the rows themselves: greedy selection and hill climbing."""
    total, used, best = np.zeros(len(p)), [], (np.inf, 0)
    for k in range(1, iterations + 1):
        errors = (((total[:, None] + p) / k - y[:, None]) ** 2).mean(axis=0)
        used.append(int(errors.argmin()))
        total = total + p[:, used[-1]]
        if errors.min() < best[0] - 1e-15:
            best = (errors.min(), k)
    greedy = np.bincount(used[: best[1]], minlength=p.shape[1]) / best[1]
    w = np.eye(p.shape[1])[int(((p - y[:, None]) ** 2).mean(axis=0).argmin())]
    for _ in range(100):
        shares = [*np.arange(1, 21) * 0.05, 1 / ((w > 0).sum() + 1)]
        error, s, j = min((((((1 - s) * (p @ w) + s * p[:, j]) - y) ** 2).mean(), s, j) for s in shares for j in range(p.shape[1]))
        if error >= ((p @ w - y) ** 2).mean() - 1e-15:
            break
        w = (1 - s) * w + s * np.eye(p.shape[1])[j]
    return greedy, w


def test_blends_of_one_hot_key(spark):
    """Nearly all rows have one key; a search sees pairs of configs only, and configs or rows that lack a value do no harm."""
    rng = np.random.default_rng(7)
    y = (rng.random(600) < 0.4).astype(float)
    p = np.clip(y[:, None] * rng.random(4) * 0.6 + rng.random((600, 4)) * 0.7, 0, 1)
    rows = [("hot", i, f"c{j}", float(p[i, j]), float(y[i])) for i in range(600) for j in range(4)]
    rows += [("hot", 1, "part", 1.0, float(y[1])), ("hot", 700, "c0", 0.5, None), ("cold", 1, "c0", 0.5, 1.0), (None, 1, "c1", 0.5, 1.0)]
    df = spark.createDataFrame(rows, "key string, row_id int, config string, p double, y double").repartition(8)
    products = portfolio.residual_products(df).where("key = 'hot'").collect()
    assert len(products) == 10 and {r.n for r in products} == {600}
    for got, want in zip((portfolio.greedy_ensemble(df), scoring.hill_climb(df)), brute_weights(p, y), strict=True):
        weights = {(r.key, r.config): r.weight for r in got.collect()}
        assert weights == pytest.approx({("cold", "c0"): 1.0, (None, "c1"): 1.0} | {("hot", f"c{j}"): w for j, w in enumerate(want) if w > 1e-12})


def test_temperature_by_counts(spark):
    """As a bisection over the rows; no task holds the rows of a key."""
    rng = np.random.default_rng(8)
    p = rng.random(500).round(2)
    y = (rng.random(500) < p**2).astype(float)
    got = scoring.temperature(spark.createDataFrame([("k", float(a), float(b)) for a, b in zip(p, y, strict=True)] + [("k", None, 1.0), (None, 0.5, 1.0)], "key string, p double, y double"), "key")
    c = np.clip(p, 1e-12, 1 - 1e-12)
    z, low, high = np.log(c) - np.log1p(-c), -16.0, 16.0
    for _ in range(30):
        u = (low + high) / 2
        low, high = (low, u) if ((1 / (1 + np.exp(-np.clip(np.exp(u) * z, -500, 500))) - y) * z).sum() > 0 else (u, high)
    assert "FlatMapGroups" not in got._jdf.queryExecution().toString()
    assert {r.key: r.temperature for r in got.collect()} == pytest.approx({"k": np.exp((low + high) / 2), None: np.exp(16.0)})


def test_amex_of_one_hot_key(spark):
    """As a running sum over all rows in order, though a key is dealt to several tasks; ties of a score are cut, too."""
    rng = np.random.default_rng(9)
    rows = [("hot", i, int(rng.random() < 0.3), float(rng.integers(0, 4))) for i in range(2000)] + [("cold", i, i % 2, 0.5) for i in range(10)]
    df = spark.createDataFrame(rows, "key string, id int, y int, score double")
    got = metrics.capture_and_gini(df, "key", "id")
    assert "hashpartitioning(_k#" in (plan := got._jdf.queryExecution().toString()) and ", _r#" in plan

    def gini(some):
        y = np.array([r[2] for r in some], float)
        w = np.where(y == 1, 1.0, 20.0)
        return ((y.cumsum() / y.sum() - w.cumsum() / w.sum()) * w).sum(), y[w.cumsum() <= np.floor(0.04 * w.sum())].sum() / y.sum()

    for r in got.collect():
        mine = [x for x in rows if x[0] == r.key]
        (g, top), (b, _) = gini(sorted(mine, key=lambda x: (-x[3], x[1]))), gini(sorted(mine, key=lambda x: (-x[2], x[1])))
        assert r.amex == pytest.approx((g / b + top) / 2)


def test_folds(spark):
    rows = spark.range(103).selectExpr("id", "cast(id % 3 = 0 as int) as y", "id div 7 as g")
    counts = {(r.y, r.fold): r["count"] for r in jobs.stratified_folds(rows, "id", "y", 4).groupBy("y", "fold").count().collect()}
    for y in (0, 1):
        each = [counts[y, f] for f in range(4)]
        assert max(each) - min(each) <= 1
    spread = jobs.group_folds(rows, "g", 4).groupBy("g").agg({"fold": "min", "id": "max"}).count()
    assert spread == jobs.group_folds(rows, "g", 4).select("g", "fold").distinct().count()


def test_unions(spark):
    a = spark.createDataFrame([("m", "d", 0, 1.0), ("n", "d", 0, 2.0)], SCHEMA)
    b = spark.createDataFrame([("m", "d", 0, 9.0), ("m", "e", 0, 3.0)], SCHEMA)
    assert {r.metric_error for r in subset.overlay(a, b).collect()} == {1.0, 2.0, 3.0}
    assert {r.metric_error for r in subset.overlay(a, b, "last").collect()} == {9.0, 2.0, 3.0}
    assert [r.method for r in subset.methods_of_all_datasets(a.union(b)).collect()] == ["m"]
    tagged = spark.createDataFrame([("x", ["a"]), ("y", ["a", "b"]), ("z", None)], "method string, tags array<string>")
    assert {r.method for r in subset.admitted(tagged, ["a"]).collect()} == {"x", "z"}


def test_portfolio_leaves_one_out(spark):
    rows = [(m, f"d{d}", 0, float(e)) for d in range(3) for m, e in (("good", 1), ("bad", 2))]
    got = portfolio.leave_one_dataset_out(spark.createDataFrame(rows, SCHEMA), 1).collect()
    assert {(r.dataset, r.method) for r in got} == {(f"d{d}", "good") for d in range(3)}


def test_repository(spark, tmp_path):
    from rankforge.sources.catalog import Repository, metric_name

    results = spark.createDataFrame([("m", "d", 0, 1.0), ("n", "e", 0, 2.0)], SCHEMA)
    tasks = spark.createDataFrame([("d", "binary", 5), ("e", "regression", 7)], "dataset string, problem_type string, n_train long")
    repo = Repository(results, tasks)
    repo.save(str(tmp_path))
    Repository(results.where("dataset = 'd'").selectExpr("method", "dataset", "fold", "metric_error + 1 as metric_error"), tasks).replace_datasets(str(tmp_path))
    back = Repository.load(spark, str(tmp_path))
    assert {(r.method, r.metric_error) for r in back.results.collect()} == {("m", 2.0), ("n", 2.0)}
    assert [r.method for r in back.subset(expressions="binary").results.collect()] == ["m"] and back.subset(datasets=["e"]).results.count() == 1
    with pytest.raises(ValueError):
        repo.join(repo)
    assert repo.join(repo, "first").results.count() == 2
    names = spark.createDataFrame([("auc",), ("other",)], "metric string").select(metric_name("metric").alias("m"))
    assert [r.m for r in names.collect()] == ["roc_auc", "other"]
