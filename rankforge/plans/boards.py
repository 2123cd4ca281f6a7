"""Leaderboards over grids of cells, resampled curves, portfolios and arena boards, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rankforge.operators import aggregate, arena, board, curves, elo, grid, packed, pertask, portfolio, scoring, subset
from rankforge.plans.registry import BASELINE, MATRIX_SQL, PAIRS_SQL, RANKED_SQL, RIVAL_SQL, configs, query
from rankforge.plans.tables import PREDS_SQL, stored
from rankforge.sources.derived import RESULTS_SQL, SCORES_SQL, TASKS_SQL, WIDE_SQL, results, tasks

#: Results with gaps in some methods only, filled with the worst error of the task.
FILLED_SQL = """gappy AS (SELECT * FROM wide WHERE NOT (method < 'Brand#23' AND n % 11 = 0)),
  worst AS (SELECT dataset, fold, max(metric_error) AS e FROM gappy GROUP BY 1, 2),
  filled AS (SELECT m.method, t.dataset, t.fold, coalesce(x.metric_error, t.e) AS metric_error, x.method IS NULL AS imputed
    FROM (SELECT DISTINCT method FROM gappy) m CROSS JOIN worst t LEFT JOIN gappy x ON x.method = m.method AND x.dataset = t.dataset AND x.fold = t.fold),
  kinds AS (SELECT DISTINCT method, CASE WHEN method[8:8] IN ('3', '4', '5') THEN 'system' ELSE 'model' END AS method_class,
    CASE method[8:8] WHEN '3' THEN ['with_llm'] WHEN '4' THEN ['with_llm', 'closed_source_api'] ELSE [] END AS tags FROM wide)"""


def filled(spark, d):
    return subset.impute(results(spark, d, wide=True).where("not (method < 'Brand#23' and n % 11 = 0)"))


def kinds(spark, d):
    last = F.substring("method", 8, 1)
    tags = F.when(last == "3", F.array(F.lit("with_llm"))).when(last == "4", F.array(F.lit("with_llm"), F.lit("closed_source_api"))).otherwise(F.array().cast("array<string>"))
    return results(spark, d, wide=True).select("method").distinct().select("method", F.when(last.isin("3", "4", "5"), "system").otherwise("model").alias("method_class"), tags.alias("tags"))


GRID_SQL = """pools AS (SELECT * FROM (VALUES ('models', [], false), ('open', [], true), ('llm', ['with_llm'], false), ('api', ['closed_source_api'], false),
    ('open_llm', ['with_llm'], true), ('open_api', ['closed_source_api'], true), ('llm_api', ['with_llm', 'closed_source_api'], false),
    ('open_llm_api', ['with_llm', 'closed_source_api'], true)) p(entrants, allowed, plain)),
  grid AS (SELECT *, 'website_data/entrants_' || entrants || '/imputation_' || imputation || '/splits_' || splits || '/tasks_' || kind || '/datasets_' || size AS path
    FROM pools, (SELECT unnest(['no', 'yes']) AS imputation), (SELECT unnest(['all', 'lite']) AS splits),
      (SELECT unnest(['all', 'classification', 'regression', 'binary', 'multiclass']) AS kind), (SELECT unnest(['all', 'small', 'medium']) AS size)),
  rows_ AS (SELECT g.path, g.imputation, f.method, f.dataset, f.fold, f.metric_error, f.imputed
    FROM grid g, filled f JOIN tasks t USING (dataset) JOIN kinds k USING (method)
    WHERE (g.splits = 'all' OR f.fold = 0)
      AND (g.kind = 'all' OR g.kind = t.problem_type OR g.kind = 'classification' AND t.problem_type <> 'regression')
      AND (g.size = 'all' OR g.size = 'small' AND t.n_train <= 10000 OR g.size = 'medium' AND t.n_train > 10000 AND t.n_train <= 100000)
      AND (k.method_class = 'model' OR len(k.tags) = 0 AND g.plain OR len(k.tags) > 0 AND len(list_filter(k.tags, lambda x: NOT list_contains(g.allowed, x))) = 0)),
  playing AS (SELECT * FROM (SELECT *, avg(imputed::INT) OVER (PARTITION BY path, method) AS share FROM rows_) WHERE CASE imputation WHEN 'no' THEN share = 0 ELSE share < 1 END),
  placed AS (SELECT *, rank() OVER (PARTITION BY path, dataset, fold ORDER BY metric_error) + (count(*) OVER (PARTITION BY path, dataset, fold, metric_error) - 1) / 2.0::DOUBLE AS rank,
      count(*) OVER (PARTITION BY path, dataset, fold) AS m, min(metric_error) OVER (PARTITION BY path, dataset, fold) AS lo FROM playing),
  inner_ AS (SELECT path, method, dataset, max(m) AS m, avg(rank) AS rank, avg(CASE WHEN m > 1 THEN 1 - (rank - 1) / (m - 1) ELSE 0.5 END) AS winrate,
      avg(CASE WHEN metric_error = 0 THEN 0.0::DOUBLE ELSE 1 - lo / metric_error END) AS improvability, avg(1 / rank) AS mrr, avg(metric_error) AS e FROM placed GROUP BY ALL)"""


@query("SELECT path, method, max(m)::BIGINT AS n_methods, count(*)::BIGINT AS n_datasets, round(avg(rank), 9) AS rank, round(avg(winrate), 9) AS winrate, round(avg(improvability), 9) AS improvability, round(avg(mrr), 9) AS mrr, round(avg(e), 9) AS metric_error FROM inner_ GROUP BY 1, 2", WIDE_SQL, TASKS_SQL, FILLED_SQL, GRID_SQL)
def subset_grid_leaderboards(spark, d):
    return grid.grid_leaderboards(filled(spark, d), tasks(spark, d), kinds(spark, d))



DRAWN = "('0x' || md5({})[1:8])::BIGINT"

TRAJECTORY_SQL = f"""configs AS (SELECT dataset, fold, method AS config, method[1:7] AS family, metric_error, time_infer_s AS metric_error_val FROM results),
  ordered AS (SELECT *, row_number() OVER w AS n_configs FROM configs, range(20) s(seed) WINDOW w AS (PARTITION BY seed, dataset, fold, family ORDER BY {DRAWN.format("seed || ':' || config")}, config)),
  steps AS (SELECT a.seed, a.dataset, a.fold, a.family, a.n_configs, arg_min(b.metric_error, (b.metric_error_val, b.config)) AS e
    FROM ordered a JOIN ordered b ON a.seed = b.seed AND a.dataset = b.dataset AND a.fold = b.fold AND a.family = b.family AND b.n_configs <= a.n_configs GROUP BY ALL),
  scored AS (SELECT *, CASE WHEN e = 0 THEN 0.0::DOUBLE ELSE 100 * (1 - min(e) OVER (PARTITION BY dataset, fold) / e) END AS i FROM steps),
  seeds AS (SELECT seed, family, n_configs, avg(e) AS e, avg(i) AS i FROM (SELECT seed, family, n_configs, dataset, avg(e) AS e, avg(i) AS i FROM scored GROUP BY ALL) GROUP BY ALL)"""


@query("SELECT family, n_configs::INT AS n_configs, round(avg(e), 9) AS metric_error, round(stddev_samp(e), 9) AS metric_error_std, round(avg(i), 9) AS improvability, round(stddev_samp(i), 9) AS improvability_std FROM seeds GROUP BY 1, 2", RESULTS_SQL, TRAJECTORY_SQL)
def tuning_trajectory_resampled(spark, d):
    return curves.resampled_trajectories(configs(spark, d))


JITTER_SQL = f"""complete AS (SELECT dataset, method FROM ranked GROUP BY 1, 2 HAVING count(DISTINCT fold) = (SELECT count(DISTINCT fold) FROM ranked r WHERE r.dataset = ranked.dataset)),
  shape AS (SELECT dataset, count(DISTINCT fold) AS f, count(DISTINCT method) AS n FROM ranked SEMI JOIN complete USING (dataset, method) GROUP BY 1),
  scores AS (SELECT dataset, method, dense_rank() OVER (PARTITION BY dataset ORDER BY fold) - 1 AS slot, 1 - (rank - 1) / (shape.n - 1) AS s FROM ranked SEMI JOIN complete USING (dataset, method) JOIN shape USING (dataset)),
  draws AS (SELECT dataset, f, k, r, {DRAWN.format("'0:' || f || ':' || k || ':' || r || ':' || j")} % f AS slot FROM shape, range(1, 101) ks(k), range(100) rs(r), range(1, 101) js(j) WHERE k <= f AND j <= k),
  hats AS (SELECT dataset, k, r, method, avg(s) AS hat FROM draws JOIN scores USING (dataset, slot) GROUP BY ALL),
  jitters AS (SELECT dataset, k, r, avg(abs(hat - mean)) AS j FROM hats JOIN (SELECT dataset, method, avg(s) AS mean FROM scores GROUP BY 1, 2) USING (dataset, method) GROUP BY ALL)"""


@query("SELECT dataset, k::INT AS k, any_value(f) AS n_folds, any_value(n) AS n_methods, round(avg(j), 9) AS jitter_mean, round(quantile_cont(j, 0.5), 9) AS jitter_p50, round(quantile_cont(j, 0.025), 9) AS jitter_p025, round(quantile_cont(j, 0.975), 9) AS jitter_p975 FROM jitters JOIN shape USING (dataset) GROUP BY 1, 2", RESULTS_SQL, RANKED_SQL, JITTER_SQL)
def jitter_bootstrap_curve(spark, d):
    return curves.jitter_curve(pertask.per_task(results(spark, d)))


def rounds_sql(spread: str, size: int) -> str:
    """Greedy rounds over `spread` (held, dataset, fold, method, rank), unrolled: m the means, c the choices."""
    views = [f"spread AS ({spread})", "m1 AS (SELECT held, method, avg(rank) AS mean FROM spread GROUP BY 1, 2)", "c1 AS (SELECT held, arg_min(method, (mean, method)) AS method, min(mean) AS mean FROM m1 GROUP BY 1)"]
    for k in range(2, size + 1):
        chosen = " UNION ALL ".join(f"SELECT held, method FROM c{i}" for i in range(1, k))
        views += [
            f"p{k} AS ({chosen})",
            f"h{k} AS (SELECT held, dataset, fold, min(rank) AS h FROM spread SEMI JOIN p{k} USING (held, method) GROUP BY 1, 2, 3)",
            f"m{k} AS (SELECT held, method, avg(least(rank, h)) AS mean FROM spread LEFT JOIN h{k} USING (held, dataset, fold) ANTI JOIN p{k} USING (held, method) GROUP BY 1, 2)",
            f"c{k} AS (SELECT x.* FROM (SELECT held, arg_min(method, (mean, method)) AS method, min(mean) AS mean FROM m{k} GROUP BY 1) x JOIN c{k - 1} USING (held) WHERE x.mean <> c{k - 1}.mean)",
        ]
    return ", ".join([*views, "picks AS (" + " UNION ALL ".join(f"SELECT held, {k} AS place, method FROM c{k}" for k in range(1, size + 1)) + ")"])


@query("SELECT place, method FROM picks", RESULTS_SQL, RANKED_SQL, rounds_sql("SELECT 0 AS held, dataset, fold, method, rank FROM ranked", 5))
def greedy_portfolio(spark, d):
    return portfolio.greedy_portfolio(results(spark, d))


WEIGHTS = {"AFRICA": 4.0, "ASIA": 0.5}


@query("SELECT place, method FROM picks", RESULTS_SQL, RANKED_SQL, rounds_sql("SELECT 0 AS held, dataset, fold, method, rank * CASE dataset WHEN 'AFRICA' THEN 4 WHEN 'ASIA' THEN 0.5::DOUBLE ELSE 1 END AS rank FROM ranked", 5))
def greedy_portfolio_weighted(spark, d):
    return portfolio.greedy_portfolio(results(spark, d), weights=WEIGHTS)


@query()
def greedy_portfolio_pruned(spark, d):
    return portfolio.pruned_portfolio(results(spark, d), size=8, threshold=0.5)


@query("SELECT held AS dataset, place, method FROM picks", WIDE_SQL, RANKED_SQL.replace("FROM results", "FROM wide"), rounds_sql("SELECT d.dataset AS held, r.dataset, fold, method, rank FROM ranked r JOIN (SELECT DISTINCT dataset FROM ranked) d ON d.dataset <> r.dataset", 5))
def portfolio_leave_one_out(spark, d):
    return portfolio.leave_one_dataset_out(results(spark, d, wide=True))


BARS_SQL = """bars AS (SELECT method, round(1000 - 1000 * avg(e), 6) AS rating, round(1000 - 1000 * avg(e) - 400 * stddev_samp(e) / sqrt(count(*)), 6) AS lower, round(1000 - 1000 * avg(e) + 400 * stddev_samp(e) / sqrt(count(*)), 6) AS upper
    FROM (SELECT method, dataset, avg(metric_error) AS e FROM wide GROUP BY 1, 2) GROUP BY 1),
  placed AS (SELECT *, row_number() OVER (ORDER BY rating DESC, method) AS i FROM bars)"""


@query("SELECT * FROM (WITH RECURSIVE scan AS (SELECT i, method, rating, lower, upper, 1::BIGINT AS arena_rank, lower AS anchor FROM placed WHERE i = 1 UNION ALL SELECT p.i, p.method, p.rating, p.lower, p.upper, CASE WHEN p.upper < s.anchor THEN p.i ELSE s.arena_rank END, CASE WHEN p.upper < s.anchor THEN p.lower ELSE s.anchor END FROM scan s JOIN placed p ON p.i = s.i + 1) SELECT method, rating, lower, upper, arena_rank::INT AS arena_rank FROM scan)", WIDE_SQL, BARS_SQL)
def rank_confidence(spark, d):
    inner = results(spark, d, wide=True).groupBy("method", "dataset").agg(F.avg("metric_error").alias("e"))
    half = 400 * F.stddev_samp("e") / F.sqrt(F.count("e"))
    rating = 1000 - 1000 * F.avg("e")
    return arena.rank_confidence(inner.groupBy("method").agg(F.round(rating, 6).alias("rating"), F.round(rating - half, 6).alias("lower"), F.round(rating + half, 6).alias("upper")))


@query()
def arena_board(spark, d):
    fights = aggregate.battles(results(spark, d, wide=True))
    bars = elo.elo_bootstrap(fights).select("method", F.col("elo").alias("rating"), F.col("elo_low").alias("lower"), F.col("elo_high").alias("upper"))
    return arena.arena_board(bars, fights)


@query()
def elo_dataset_contributions(spark, d):
    return arena.dataset_contributions(aggregate.battles(results(spark, d)))


def t_sql(t: str, df: str) -> str:
    """Two-sided tail of Student's distribution in SQL: Simpson's rule over the angle whose tangent is t / sqrt(df)."""
    angle = f"atan(abs({t}) / sqrt({df}))"
    area = f"list_sum(list_transform(range(0, 2001), lambda i: CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * pow(cos({angle} * i / 2000.0::DOUBLE), {df} - 1))) * {angle} / 6000.0::DOUBLE"
    return f"(1 - 2 * gamma(({df} + 1) / 2) / (sqrt(pi()) * gamma({df} / 2)) * {area})"


NORMAL_SQL = "(1 - sqrt(2 / pi()) * list_sum(list_transform(range(0, 2001), lambda i: CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-z * z * i * i / 8000000.0::DOUBLE))) * z / 6000.0::DOUBLE)"
SIGNIFICANCE_SQL = f"""complete AS (SELECT * FROM results QUALIFY count(*) OVER (PARTITION BY dataset, method) = 3),
  lead_ AS (SELECT dataset, arg_min(method, (m, method)) AS best FROM (SELECT dataset, method, avg(metric_error) AS m FROM complete GROUP BY 1, 2) GROUP BY 1),
  both_ AS (SELECT a.dataset, a.method, a.fold, a.metric_error AS e, b.metric_error AS b FROM complete a JOIN lead_ l ON a.dataset = l.dataset AND a.method <> l.best JOIN complete b ON b.dataset = a.dataset AND b.method = l.best AND b.fold = a.fold),
  pooled AS (SELECT dataset, method, 0 AS side, e AS x FROM both_ UNION ALL SELECT dataset, method, 1, b FROM both_),
  ranks AS (SELECT dataset, method, sum(r) FILTER (WHERE side = 0) AS re, sum(r) FILTER (WHERE side = 1) AS rb, sum(c * c - 1)::DOUBLE AS tied FROM (
    SELECT dataset, method, side, count(*) OVER (PARTITION BY dataset, method, x) AS c, rank() OVER (PARTITION BY dataset, method ORDER BY x) + (count(*) OVER (PARTITION BY dataset, method, x) - 1) / 2.0::DOUBLE AS r FROM pooled) GROUP BY 1, 2),
  moments AS (SELECT dataset, method, count(*)::DOUBLE AS n, avg(e) AS me, avg(b) AS mb, avg(e - b) AS md, stddev_samp(e - b) AS sd, min(e - b) = max(e - b) AS flat, var_samp(e) AS ve, var_samp(b) AS vb, stddev_pop(b) AS sb FROM both_ GROUP BY 1, 2),
  stats AS (SELECT *, md / (sd / sqrt(n)) AS t, n - 1 AS df, sqrt((n / 2 * (me - mb) * (me - mb)) / ((ve + vb) / 2)) AS f, 2 * n - 2 AS df2,
    sqrt((12 / (2 * n * (2 * n + 1)) * (re * re / n + rb * rb / n) - 3 * (2 * n + 1)) / (1 - tied / (8 * n * n * n - 2 * n))) AS z FROM moments JOIN ranks USING (dataset, method)),
  tested AS (SELECT dataset, method, CASE WHEN mb >= me THEN 2 WHEN flat THEN 0 ELSE {t_sql("t", "df")} END AS p_ttest, CASE WHEN mb >= me THEN 2 ELSE {NORMAL_SQL} END AS p_kruskal,
    CASE WHEN mb >= me THEN 2 ELSE {t_sql("f", "df2")} END AS p_ftest, CASE WHEN mb >= me OR me < mb + sb THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END AS p_tabred FROM stats UNION ALL SELECT dataset, best, 1.0::DOUBLE, 1.0::DOUBLE, 1.0::DOUBLE, 1.0::DOUBLE FROM lead_)"""


@query("SELECT dataset, method, round(p_ttest, 9) AS p_ttest, round(p_kruskal, 9) AS p_kruskal, round(p_ftest, 9) AS p_ftest, p_tabred FROM tested", RESULTS_SQL, SIGNIFICANCE_SQL)
def significance_per_dataset(spark, d):
    # Gaps would shorten the samples of single methods, which the SQL does not follow.
    folds = F.count("fold").over(Window.partitionBy("dataset", "method"))
    return scoring.significance_by_dataset(results(spark, d).withColumn("k", folds).where("k = 3"))


def blocks(spark, d):
    """Stored predictions in blocks of 256 rows."""
    return packed.packed(stored(spark, d).predictions, 256)


@query("SELECT dataset, fold, split, \"row\", round(pred, 9) AS pred FROM preds WHERE config = 'other'", SCORES_SQL, PREDS_SQL)
def packed_model_slice(spark, d):
    return packed.model_predictions(blocks(spark, d), "other")


@query("SELECT dataset, fold, split, config, \"row\", round(pred, 9) AS pred FROM preds WHERE config IN ('score', 'third') AND fold < 2", SCORES_SQL, PREDS_SQL)
def packed_subset(spark, d):
    return packed.unpacked(packed.subset_models(blocks(spark, d).where("fold < 2"), ["third", "score"]))


@query("SELECT dataset, fold, split, round(sqrt(avg((b - y) * (b - y))), 9) AS rmse FROM (SELECT dataset, fold, split, \"row\", any_value(y) AS y, sum(pred * CASE config WHEN 'score' THEN 0.75::DOUBLE ELSE 0.25::DOUBLE END) AS b FROM preds WHERE config IN ('score', 'other') GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3", SCORES_SQL, PREDS_SQL)
def packed_blend(spark, d):
    mixed = packed.blended(blocks(spark, d), {"score": 0.75, "other": 0.25})
    labelled = mixed.join(stored(spark, d).labels, ["dataset", "fold", "split", "row"])
    return labelled.groupBy("dataset", "fold", "split").agg(F.sqrt(F.avg((F.col("pred") - F.col("y")) * (F.col("pred") - F.col("y")))).alias("rmse"))


@query("SELECT dataset, fold, split, \"row\", round(avg(pred)::FLOAT, 6)::DOUBLE AS pred FROM (SELECT * FROM preds WHERE split = 'test' OR (\"row\" // 2 + CASE config WHEN 'score' THEN 0 WHEN 'other' THEN 1 ELSE 2 END) % 3 > 0) GROUP BY 1, 2, 3, 4", SCORES_SQL, PREDS_SQL)
def bag_predictions(spark, d):
    # Configs as the children of a bag: in validation each predicts the rows that it was not trained on.
    place = F.when(F.col("config") == "score", 0).when(F.col("config") == "other", 1).otherwise(2)
    children = stored(spark, d).predictions.where((F.col("split") == "test") | ((F.floor(F.col("row") / 2) + place) % 3 > 0)).withColumnRenamed("config", "child")
    return packed.from_children(children, "dataset", "fold", "split").withColumn("pred", F.round(F.col("pred"), 6).cast("double"))


def close_calls(context):
    """A metric of one's own: the share of tasks on which a method is within a tenth of the best."""
    return context.per_task.groupBy("method").agg(F.avg((F.col("improvability") <= 0.1).cast("int")).alias("close"))


BOARD_SQL = f"""advantage AS (SELECT method, avg(v) AS ba, exp(avg(ln(r))) AS gm FROM (SELECT r.method, r.dataset, avg(coalesce((b.e - r.metric_error) / nullif(greatest(b.e, r.metric_error), 0), 0.0::DOUBLE)) AS v, avg(r.metric_error / b.e) AS r
    FROM results r JOIN (SELECT dataset, fold, metric_error AS e FROM results WHERE method = '{BASELINE}') b USING (dataset, fold) GROUP BY 1, 2) GROUP BY 1),
  means AS (SELECT method, avg(rank) AS rank, avg(improvability) AS improvability, avg(fa) AS frontier_advantage, avg(mrr) AS mrr, avg(e) AS metric_error, avg(t) AS time_train_s, avg(i) AS time_infer_s, median(e) AS median_metric_error, median(t) AS median_time_train_s, median(i) AS median_time_infer_s
    FROM (SELECT method, dataset, avg(rank) AS rank, avg(improvability) AS improvability, avg(frontier_advantage) AS fa, avg(1 / rank) AS mrr, avg(metric_error) AS e, avg(time_train_s) AS t, avg(time_infer_s) AS i FROM ranked JOIN frontier USING (method, dataset, fold) GROUP BY 1, 2) GROUP BY 1)"""


@query("""SELECT method, round(rank, 9) AS rank, round(winrate, 9) AS winrate, round(improvability, 9) AS improvability, round(ba, 9) AS baseline_advantage, round(frontier_advantage, 9) AS frontier_advantage, round(mrr, 9) AS mrr,
    round(gm, 9) AS relative_error, round(1 - gm, 9) AS skill_score, round(close, 9) AS close, round(time_train_s, 9) AS time_train_s, round(time_infer_s, 9) AS time_infer_s, round(metric_error, 9) AS metric_error,
    round(median_time_train_s, 9) AS median_time_train_s, round(median_time_infer_s, 9) AS median_time_infer_s, round(median_metric_error, 9) AS median_metric_error
  FROM means JOIN advantage USING (method) JOIN (SELECT method_1 AS method, avg(winrate) AS winrate FROM matrix GROUP BY 1) USING (method) JOIN (SELECT method, avg((improvability <= 0.1)::INT) AS close FROM ranked GROUP BY 1) USING (method)""", RESULTS_SQL, RANKED_SQL, RIVAL_SQL, PAIRS_SQL, MATRIX_SQL, BOARD_SQL)
def leaderboard_whole(spark, d):
    keys = ["winrate", "improvability", "baseline_advantage", "frontier_advantage", "mrr", "relative_error", "skill_score"]
    return board.leaderboard(results(spark, d), [*keys, board.Metric("close", close_calls)], baseline=BASELINE, include_error=True)


@query()
def leaderboard_with_elo(spark, d):
    return board.leaderboard(results(spark, d, wide=True), ["elo", "winrate", "improvability", "rank_counts"], elo_anchor=BASELINE)


@query(f"""SELECT removed, round(avg(v), 9) AS score FROM (SELECT removed, dataset, avg(i) AS v FROM (SELECT m.removed, r.dataset, r.method, CASE WHEN metric_error = 0 THEN 0.0::DOUBLE ELSE 1 - min(metric_error) OVER (PARTITION BY m.removed, r.dataset, r.fold) / metric_error END AS i
    FROM results r JOIN (SELECT DISTINCT method AS removed FROM results) m ON m.removed <> r.method) WHERE method = '{BASELINE}' GROUP BY 1, 2) GROUP BY 1 UNION ALL SELECT '{BASELINE}', NULL""", RESULTS_SQL)
def improvability_if_removed(spark, d):
    return board.scores_if_removed(results(spark, d), board.SPECS["improvability"], BASELINE)


@query(f"""SELECT removed, round(avg(v), 9) AS score FROM (SELECT removed, dataset, avg(w) AS v FROM (SELECT removed, dataset, method, 1 - (rank() OVER w - 1 + (count(*) OVER (PARTITION BY removed, dataset, fold, metric_error) - 1) / 2.0::DOUBLE) / (count(*) OVER (PARTITION BY removed, dataset, fold) - 1) AS w
    FROM (SELECT m.removed, r.* FROM results r JOIN (SELECT DISTINCT method AS removed FROM results) m ON m.removed <> r.method) WINDOW w AS (PARTITION BY removed, dataset, fold ORDER BY metric_error)) WHERE method = '{BASELINE}' GROUP BY 1, 2) GROUP BY 1 UNION ALL SELECT '{BASELINE}', NULL""", RESULTS_SQL)
def winrate_if_removed(spark, d):
    return board.scores_if_removed(results(spark, d), board.SPECS["winrate"], BASELINE)


@query()
def elo_greedy_removals(spark, d):
    # The board's last method: removals go on until it has gained twenty points.
    rows = results(spark, d)
    rated = elo.elo(aggregate.battles(rows)).orderBy("elo", "method").first()
    return board.greedy_removals(rows, board.SPECS["elo"], rated["method"], stop_at=rated["elo"] + 20)
