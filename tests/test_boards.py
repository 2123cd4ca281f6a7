"""Grids of leaderboards, resampled curves, portfolios and arena boards against brute force."""

import dataclasses
import hashlib
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankforge.functions import distributions
from rankforge.operators import arena, board, curves, elo, grid, naming, packed, portfolio, scoring
from rankforge.operators.aggregate import battles

SCHEMA = "method string, dataset string, fold int, metric_error double"


def random_results(methods=6, datasets=5, folds=3, seed=0, values=9):
    rng = np.random.default_rng(seed)
    return [(f"m{m}", f"d{d}", f, float(rng.integers(1, values)) / 10) for m in range(methods) for d in range(datasets) for f in range(folds)]


def test_pools(spark):
    rows = [("model", []), ("model", ["with_llm"]), ("system", []), ("system", None), ("system", ["with_llm"]), ("system", ["with_llm", "closed_source_api"]), (None, ["x"]), ("system", ["x"])]
    df = spark.createDataFrame(rows, "c string, t array<string>")
    for pool, some in grid.POOLS.items():
        allowed = {grid.CATEGORIES[c] for c in some} - {None}
        want = [c != "system" or (bool(t) and set(t) <= allowed) or (not t and "open" in some) for c, t in rows]
        assert [r[0] for r in df.select(grid.admits(pool, F.col("c"), F.col("t"))).collect()] == want, pool
    every = grid.cells(spark).collect()
    assert len(every) == len({r.path for r in every}) == 480
    assert "website_data/entrants_open_llm/imputation_yes/splits_lite/tasks_binary/datasets_small" in {r.path for r in every}


def test_grid_of_empty_and_partial_cells(spark):
    """A cell without datasets has no rows, a method with a gap leaves the cells without imputation, one with gaps only leaves all."""
    rows = [("a", "d", 0, 0.1, False), ("a", "d", 1, 0.1, False), ("b", "d", 0, 0.2, False), ("b", "d", 1, 0.3, True), ("c", "d", 0, 0.3, True), ("c", "d", 1, 0.3, True)]
    results = spark.createDataFrame(rows, SCHEMA + ", imputed boolean")
    tasks = spark.createDataFrame([("d", "binary", 500)], "dataset string, problem_type string, n_train long")
    methods = spark.createDataFrame([("a", "model", [])], "method string, method_class string, tags array<string>")
    got = {(r.path.removeprefix("website_data/entrants_models/"), r.method): r for r in grid.grid_leaderboards(results, tasks, methods).collect() if "entrants_models/" in r.path}
    assert {m for p, m in got if p == "imputation_no/splits_all/tasks_all/datasets_all"} == {"a"}
    assert {m for p, m in got if p == "imputation_no/splits_lite/tasks_binary/datasets_small"} == {"a", "b"}
    assert {m for p, m in got if p == "imputation_yes/splits_all/tasks_classification/datasets_all"} == {"a", "b"}
    assert not [p for p, _ in got if "regression" in p or "medium" in p or "multiclass" in p]
    assert got["imputation_yes/splits_all/tasks_all/datasets_all", "b"].rank == 2 and got["imputation_no/splits_all/tasks_all/datasets_all", "a"].winrate == 0.5


def hashed(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:8], 16)


def test_jitter(spark):
    rng = np.random.default_rng(1)
    ranks = {f"m{m}": rng.integers(1, 5, 4).astype(float) for m in range(3)}
    rows = [("d", f, m, float(r)) for m, own in ranks.items() for f, r in enumerate(own)] + [("d", 0, "gap", 1.0), ("lone", 0, "m0", 1.0)]
    got = {r.k: r for r in curves.jitter_curve(spark.createDataFrame(rows, "dataset string, fold int, method string, rank double"), rounds=20, seed=7).collect()}
    assert set(got) == {1, 2, 3, 4} and {r.n_methods for r in got.values()} == {3}
    scores = 1 - (np.array([ranks[m] for m in sorted(ranks)]) - 1) / 2
    for k, r in got.items():
        jit = [np.abs(scores[:, [hashed(7, 4, k, b, j) % 4 for j in range(1, k + 1)]].mean(1) - scores.mean(1)).mean() for b in range(20)]
        assert [r.jitter_mean, r.jitter_p50, r.jitter_p025, r.jitter_p975] == pytest.approx([np.mean(jit), *np.quantile(jit, [0.5, 0.025, 0.975])])
    with pytest.raises(ValueError):
        curves.jitter_curve(spark.createDataFrame(rows, "dataset string, fold int, method string, rank double"), metric="nope")


def test_trajectories_end_alike(spark):
    """After all configs every order has the same best, so the spread is 0 there."""
    rows = [(d, f, "fam", f"c{c}", float((c * 7 + f) % 5), float((c * 3 + f) % 4 + 1)) for d in "xy" for f in range(2) for c in range(5)]
    got = curves.resampled_trajectories(spark.createDataFrame(rows, "dataset string, fold int, family string, config string, metric_error_val double, metric_error double"), seeds=6)
    got = {r.n_configs: r for r in got.collect()}
    assert set(got) == {1, 2, 3, 4, 5} and got[5].metric_error_std == pytest.approx(0) and got[1].metric_error_std > 0
    best = [min((v, c, e) for d, g, _, c, v, e in rows if d == "x" and g == f)[2] for f in range(2)]
    assert got[5].metric_error == pytest.approx(np.mean(best))


def score(ranks, chosen):
    return float(np.mean([min(r[m] for m in chosen) for r in ranks]))


def test_pruned_portfolio(spark):
    for seed, threshold in itertools.product(range(3), (0.0, 0.4, 9.0)):
        rows = random_results(seed=seed)
        packed = portfolio.packed_table(spark.createDataFrame(rows, SCHEMA))
        ranks = [{x["method"]: x["rank"] for x in r["ranks"]} for r in packed.collect()]
        chosen = portfolio.forward(packed, 5)
        for k in range(len(chosen)):
            rest = sorted(set(ranks[0]) - set(chosen[:k]))
            assert chosen[k] == min(rest, key=lambda m: (score(ranks, [*chosen[:k], m]), m))
        want, best = list(chosen), score(ranks, chosen)
        while len(want) > 1:
            goes = None
            for m in want:
                s = score(ranks, [x for x in want if x != m])
                if s <= (best + threshold if goes is None else best):
                    best, goes = s, m
            if goes is None:
                break
            want.remove(goes)
        assert portfolio.pruned(packed, chosen, threshold) == want


def test_weighted_portfolio_and_gaps(spark):
    """The golden case of three tasks and five configs, then a weight that turns the choice, then a method that misses tasks."""
    table = [[0.1, 0.2, 0, 1, 0.2], [0, 0.2, 1, 1, 0.2], [0.1, 0.2, 1, 0, 0.2]]
    rows = [(str(c), f"t{t}", 0, float(e)) for t, row in enumerate(table) for c, e in enumerate(row)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [r.method for r in portfolio.greedy_portfolio(df, 4).orderBy("place").collect()] == ["0", "2", "3"]
    assert portfolio.greedy_portfolio(df, 1, {"t0": 50.0}).first().method == "2"
    lone = spark.createDataFrame([("z", "t0", 0, -1.0), *rows], SCHEMA)
    assert portfolio.greedy_portfolio(lone, 1).first().method == "z"


def test_rank_confidence(spark):
    rows = [("a", 5.0, 4.0, 6.0), ("b", 4.5, 3.0, 5.0), ("c", 3.0, 2.0, 3.9), ("d", 2.5, 1.0, 3.5), ("e", 1.0, 0.0, 1.9), ("aa", 5.0, 3.9, 6.0)]
    got = {r.method: r.arena_rank for r in arena.rank_confidence(spark.createDataFrame(rows, "method string, rating double, lower double, upper double")).collect()}
    assert got == {"a": 1, "aa": 1, "b": 1, "c": 4, "d": 4, "e": 6}


def test_arena_board(spark):
    bars = spark.createDataFrame([("x", 1100.4, 1000.0, 1206.5), ("y", 1100.2, 997.0, 1150.0)], "method string, rating double, lower double, upper double")
    fights = spark.createDataFrame([("x", "y", w) for w in ("1", "tie", "2", "1")], "method_1 string, method_2 string, winner string")
    got = {r.method: r for r in arena.arena_board(bars, fights).collect()}
    assert (got["x"].interval, got["x"].elo, got["x"].battles, got["x"].wins, got["x"].winrate) == ("+106/-100", 1100, 4, 2, 0.5)
    assert got["y"].rank_simple == got["x"].rank_simple == 1 and got["y"].wins == 2


def test_dataset_contributions(spark):
    fights = battles(spark.createDataFrame(random_results(methods=4, datasets=3, seed=3), SCHEMA))
    whole = {r.method: r.elo for r in elo.elo(fights).collect()}
    got = arena.dataset_contributions(fights).collect()
    assert len(got) == 12
    for d in ("d0", "d1", "d2"):
        rest = {r.method: r.elo for r in elo.elo(fights.where(F.col("dataset") != d)).collect()}
        for r in got:
            if r.dataset == d:
                assert (r.elo, r.elo_without) == pytest.approx((whole[r.method], rest[r.method]), abs=1e-4)
    assert arena.dataset_contributions(fights.where("dataset = 'd0'")).count() == 0


def test_names(spark):
    def one(c):
        return spark.range(1).select(c).first()[0]

    for s, want in ((1800, " (30m)"), (5400, " (1.50h)"), (0, ""), (None, ""), (3600, " (1h)"), (14400, " (4h)"), (90, " (1.50m)"), (4050, " (1.12h)"), (3661.5, f" ({3661.5 / 3600:0.2f}h)"), (5400000, " (1500h)"), (5400036, f" ({5400036 / 3600:0.2f}h)")):
        assert one(naming.time_suffix(F.lit(s))) == want, s
    for x, digits, want in ((123456.0, 3, 123456.0), (123456.7, 3, 123457.0), (0.00012345, 3, 0.000123), (-1.2345, 3, -1.23), (0.0, 3, 0.0), (float("inf"), 3, None), (None, 3, None), (99.96, 3, 100.0)):
        assert one(naming.significant(F.lit(x).cast("double"), digits)) == (None if want is None else pytest.approx(want))
    configs = [("t", "X_c1_BAG_L1", 0), ("t", "X_r1", 1), ("u", "b_c1_BB", 0), ("u", "a_c1_BB", 1), ("u", "c_c1_B", 2), ("v", "z_r1_B", 3), ("v", "a_r1", 4), ("w", "none", 0), ("s", "p_c1_B", 0), ("s", "q_c1", 1)]
    df = spark.createDataFrame(configs, "type string, config string, place int")
    assert {r.type: r.config for r in naming.default_configs(df).collect()} == {"t": "X_c1_BAG_L1", "u": "c_c1_B", "v": "z_r1_B", "s": "q_c1"}
    assert {r.type: r.config for r in naming.default_configs(df, first_if_missing=True).collect()}["w"] == "none"
    board = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3), ("c", 4)], "method string, place int")
    assert sorted(r.method for r in naming.top_methods(board, "place", 2).collect()) == ["a", "a", "b"]
    assert naming.top_methods(board, "place", 0).count() == 4


def test_distributions(spark):
    """Tabulated quantiles, and numeric integrals of the densities."""
    def one(c):
        return spark.range(1).select(c.cast("double")).first()[0]

    for t, df, p in ((1.0, 1, 0.5), (2.228138852, 10, 0.05), (12.70620474, 1, 0.05), (-1.959963985, 1e7, 0.05), (0.0, 5, 1.0), (30.0, 4, 7.334e-06)):
        assert one(distributions.t_two_sided(F.lit(t), F.lit(float(df)))) == pytest.approx(p, rel=1e-3, abs=1e-7)
    for x, df in ((5.991464547, 2), (36.4150285, 24), (0.1, 6), (80.0, 24), (3.0, 4), (2.5, 24)):
        # An even number of degrees has a closed form.
        p = math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(df // 2))
        assert one(distributions.chi_squared_tail(F.lit(x), F.lit(float(df)))) == pytest.approx(p, rel=1e-9)
    assert one(distributions.chi_squared_tail(F.lit(3.841458821), F.lit(1.0))) == pytest.approx(0.05, rel=1e-7)
    assert one(distributions.chi_squared_tail(F.lit(0.0), F.lit(3.0))) == 1
    xs = (np.arange(400_000) + 0.5) / 400_000
    for a, b in ((2.5, 0.5), (0.5, 7.0), (30.0, 20.0)):
        density = xs ** (a - 1) * (1 - xs) ** (b - 1)
        for x in (0.1, 0.6, 0.95):
            assert one(distributions.incomplete_beta(F.lit(x), F.lit(a), F.lit(b))) == pytest.approx(density[xs < x].sum() / density.sum(), abs=2e-3)


def test_significance_edges(spark):
    rows = [("best", "d", f, e) for f, e in enumerate((0.1, 0.2, -0.3))] + [("same", "d", f, e) for f, e in enumerate((0.1, 0.2, 0.0))]
    rows += [("shifted", "d", f, e) for f, e in enumerate((0.6, 0.7, 0.5))] + [("short", "d", 0, 0.9), ("alone", "e", 0, 0.5)]
    got = {(r.dataset, r.method): r for r in scoring.significance_by_dataset(spark.createDataFrame([(m, d, f, float(e)) for m, d, f, e in rows], SCHEMA)).collect()}
    assert set(got) == {(r[1], r[0]) for r in rows}
    assert got["e", "alone"].p_ttest == got["d", "best"].p_kruskal == 1
    assert got["d", "same"].p_ttest == got["d", "same"].p_tabred == 2
    assert got["d", "shifted"].p_ttest == pytest.approx(0, abs=1e-12) and got["d", "shifted"].p_tabred == 0
    assert got["d", "shifted"].p_kruskal == pytest.approx(0.0495346, abs=1e-6)
    assert got["d", "short"].p_ttest is None and got["d", "short"].p_kruskal is not None


def test_packed(spark):
    rows = [("d", 0, "val", c, r, float(10 * i + r)) for i, c in enumerate("cab") for r in range(7)] + [("d", 0, "test", "a", 3, 1.5), ("e", 1, "val", "a", 0, 2.5)]
    schema = "dataset string, fold int, split string, config string, row long, pred double"
    df = spark.createDataFrame(rows, schema)
    blocks = packed.packed(df, 3)
    assert blocks.count() == 5 and {tuple(r.configs) for r in blocks.where("split = 'val' and dataset = 'd'").collect()} == {("a", "b", "c")}
    assert sorted(packed.unpacked(blocks).collect()) == sorted(df.select(*packed.TASK, "config", "row", "pred").collect())
    val = blocks.where("dataset = 'd' and split = 'val'")
    assert sorted((r.row, r.pred) for r in packed.model_predictions(val, "b").collect()) == [(r, 20.0 + r) for r in range(7)]
    assert sorted((r.row, r.pred) for r in packed.blended(val, {"b": 0.5, "c": 2.0}).collect()) == [(r, 10 + 2.5 * r) for r in range(7)]
    some = packed.subset_models(val, ["c", "a"])
    assert {tuple(r.configs) for r in some.collect()} == {("a", "c")} and packed.subset_models(val, []).count() == 0
    assert sorted((r.row, r.pred) for r in packed.model_predictions(some, "c").collect()) == [(r, float(r)) for r in range(7)]
    for wrong in (lambda: packed.subset_models(blocks, ["b"]), lambda: packed.packed(df.where("not (config = 'a' and row = 2)")), lambda: packed.packed(df.union(df.limit(1)))):
        with pytest.raises(Exception, match="no predictions of|configs differ"):
            wrong().collect()
    assert packed.packed(df.where("false")).count() == 0
    many = spark.createDataFrame([("d", 0, "val", c, 0, [p, 1 - p]) for c, p in (("x", 0.25), ("y", 0.5))], schema.replace("pred double", "pred array<double>"))
    assert packed.model_predictions(packed.packed(many), "y").first().pred == [0.5, 0.5]
    bag = packed.from_children(many.withColumnRenamed("config", "child"), "dataset", "fold", "split").first()
    assert bag.pred == [0.375, 0.625]


def test_leaderboard_metrics(spark):
    rows = [(m, d, f, e, 1.0 + f, 2.0) for m, d, f, e in random_results(methods=4, datasets=3)]
    df = spark.createDataFrame(rows, SCHEMA + ", time_train_s double, time_infer_s double")
    plain = board.leaderboard(df, ["winrate", "skill_score"])
    assert plain.columns[:3] == ["method", "rank", "winrate"] and "skill_score" not in plain.columns and "metric_error" not in plain.columns
    assert [r["rank"] for r in plain.collect()] == sorted(r["rank"] for r in plain.collect())
    full = board.leaderboard(df, list(board.METRICS), baseline="m1", elo_rounds=5, average_folds=True, include_rescaled_loss=True, sort_by="method")
    got = {r.method: r for r in full.collect()}
    assert got["m1"].skill_score == pytest.approx(0) and got["m1"].baseline_advantage == 0 and got["m1"].relative_error == pytest.approx(1)
    assert list(got) == sorted(got) and sum(r.elo for r in got.values()) / 4 == pytest.approx(1000, abs=0.1)
    anchored = {r.method: r for r in board.leaderboard(df, ["elo"], elo_anchor="m2", elo_rounds=5).collect()}
    assert anchored["m2"].elo == 1000

    def own(columns):
        return board.Metric("own", lambda c: c.per_task.groupBy("method").agg(*[F.max("rank").alias(x) for x in columns]))

    assert board.leaderboard(df, ["mrr", own(["worst"])]).columns[:4] == ["method", "rank", "mrr", "worst"]
    foreign = board.Metric("own", lambda c: c.per_task.select(F.lit("zz").alias("method"), F.lit(1).alias("x")).limit(1))
    twice = board.Metric("own", lambda c: c.per_task.select("method", F.lit(1).alias("x")))
    bare = board.Metric("own", lambda c: c.per_task.select("dataset", F.lit(1).alias("x")))
    for wrong in ([own(["mrr"]), "mrr"], [own(["a", "a"])], [foreign], [twice], [bare], ["nope"], [own(["a"]), own(["b"])], [board.Metric("elo", lambda c: c.per_task)]):
        with pytest.raises(ValueError):
            board.leaderboard(df, wrong).collect()
    needs = board.Metric("own", lambda c: c.per_task.select("method").distinct().withColumn("b", F.lit(c.baseline)), requires_baseline=True)
    assert "b" not in board.leaderboard(df, [needs]).columns and {r.b for r in board.leaderboard(df, [needs], baseline="m0").collect()} == {"m0"}


def brute_score(rows, name, method):
    """Mean rank, win rate or improvability of a method over rows as they are."""
    out = {}
    for d in {r[1] for r in rows}:
        per_fold = []
        for f in {r[2] for r in rows if r[1] == d}:
            task = {r[0]: r[3] for r in rows if r[1] == d and r[2] == f}
            e = task[method]
            rank = 1 + sum(x < e for x in task.values()) + (sum(x == e for x in task.values()) - 1) / 2
            per_fold.append({"rank": rank, "winrate": 1 - (rank - 1) / (len(task) - 1) if len(task) > 1 else 0.5, "improvability": 0.0 if e == 0 else 1 - min(task.values()) / e}[name])
        out[d] = np.mean(per_fold)
    return float(np.mean(list(out.values())))


@pytest.mark.parametrize("name", ["rank", "winrate", "improvability"])
def test_what_if(spark, name):
    rows = random_results(methods=5, datasets=3, folds=2, seed=5)
    df, spec = spark.createDataFrame(rows, SCHEMA), board.SPECS[name]
    got = {r.removed: r.score for r in board.scores_if_removed(df, spec, "m3").collect()}
    assert got.pop("m3") is None
    assert got == pytest.approx({m: brute_score([r for r in rows if r[0] != m], name, "m3") for m in ("m0", "m1", "m2", "m4")})
    left, want, sign = rows, [], 1 if spec.direction == "min" else -1
    while len({r[0] for r in left}) > 1:
        scores = {m: brute_score([r for r in left if r[0] != m], name, "m3") for m in sorted({r[0] for r in left} - {"m3"})}
        m = min(scores, key=lambda m: (round(sign * scores[m], 9), m))
        want.append((m, scores[m]))
        left = [r for r in left if r[0] != m]
    removed = board.greedy_removals(df, spec, "m3").orderBy("place").collect()
    assert [r.score for r in removed] == pytest.approx([s for _, s in want])
    assert [r.removed for r in removed][:2] == [m for m, _ in want][:2]
    assert board.greedy_removals(df, spec, "m3", stop_at=brute_score(rows, name, "m3")).count() == 0


def test_what_if_elo(spark):
    df = spark.createDataFrame(random_results(methods=4, datasets=3, seed=8), SCHEMA)
    spec = board.SPECS["elo"]
    got = {r.removed: r.score for r in board.scores_if_removed(df, spec, "m0").collect()}
    for m in ("m1", "m2", "m3"):
        want = {r.method: r.elo for r in elo.elo(battles(df.where(F.col("method") != m))).collect()}
        assert got[m] == pytest.approx(want["m0"], abs=1e-4)
    kept = dataclasses.replace(spec, required=frozenset({"m1", "m2"}))
    assert [r.removed for r in board.greedy_removals(df, kept, "m0").collect()] == ["m3"]
