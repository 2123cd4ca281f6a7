"""Every query of the library by name, with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankforge.functions import features
from rankforge.operators import aggregate, elo, jobs, metrics, pertask, portfolio, scoring, stability, subset
from rankforge.sources.catalog import Repository
from rankforge.sources.derived import RESULTS_SQL, SCORES_SQL, TASKS_SQL, WIDE_SQL, results, scores, table, tasks
from rankforge.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
#: Methods that comparisons are made against.
BASELINE, RIVAL = "Brand#11", "Brand#22"


def rounded(df: DataFrame) -> DataFrame:
    """Floats to nine places: sums of floats differ in the last bits by their order."""
    return df.select(*[F.round(c, 9).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def query(sql: str | None = None, *views: str) -> Callable[[Query], Query]:
    """Registers a query under its name; `sql` is a SELECT over the named views."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = f"WITH {', '.join(views)} {sql}" if views else sql
        return f

    return register


RANKED_SQL = """base AS (SELECT *, min(metric_error) OVER t AS lo, max(metric_error) OVER t AS hi, count(*) OVER (PARTITION BY dataset, fold, metric_error) AS ties,
    rank() OVER (PARTITION BY dataset, fold ORDER BY metric_error) AS r FROM results WINDOW t AS (PARTITION BY dataset, fold)),
  ranked AS (SELECT *, r + (ties - 1) / 2.0::DOUBLE AS rank, CASE WHEN metric_error = 0 THEN 0.0::DOUBLE ELSE 1 - lo / metric_error END AS improvability,
    coalesce((metric_error - lo) / nullif(hi - lo, 0), 0.0::DOUBLE) AS loss_rescaled FROM base)"""
RIVAL_SQL = """rivals AS (SELECT a.method, a.dataset, a.fold, a.metric_error AS e, min(b.metric_error) AS o FROM results a LEFT JOIN results b ON a.dataset = b.dataset AND a.fold = b.fold AND a.method <> b.method GROUP BY ALL),
  frontier AS (SELECT method, dataset, fold, coalesce((o - e) / nullif(greatest(o, e), 0), 0.0::DOUBLE) AS frontier_advantage FROM rivals)"""
PAIRS_SQL = "pairs AS (SELECT a.dataset, a.fold, a.method AS method_1, b.method AS method_2, a.metric_error AS e1, b.metric_error AS e2 FROM results a JOIN results b USING (dataset, fold) WHERE a.method <> b.method)"
MATRIX_SQL = """inner_ AS (SELECT p.dataset, method_1, method_2, sum(CASE WHEN e1 < e2 THEN 1.0::DOUBLE WHEN e1 = e2 THEN 0.5::DOUBLE ELSE 0 END) / max(k) AS won, count(*)::DOUBLE / max(k) AS n
    FROM pairs p JOIN (SELECT dataset, count(DISTINCT fold) AS k FROM results GROUP BY 1) USING (dataset) GROUP BY 1, 2, 3),
  matrix AS (SELECT method_1, method_2, sum(won) / sum(n) AS winrate FROM inner_ GROUP BY 1, 2)"""
BATTLES_SQL = """battles AS (SELECT method_1, method_2, dataset, fold, CASE WHEN e1 < e2 THEN '1' WHEN e1 > e2 THEN '2' ELSE 'tie' END AS winner, 1.0::DOUBLE / k AS weight
    FROM pairs JOIN (SELECT dataset, count(DISTINCT fold) AS k FROM results GROUP BY 1) USING (dataset) WHERE method_1 < method_2)"""


def mean_sql(value: str, source: str = "ranked", name: str = "") -> str:
    return f"SELECT method, round(avg(v), 9) AS {name or value} FROM (SELECT method, dataset, avg({value}) AS v FROM {source} GROUP BY 1, 2) GROUP BY 1"


# --- sources and validation ---------------------------------------------------------------------------------------


@query("SELECT method, dataset, fold, round(metric_error, 9) AS metric_error, round(time_train_s, 9) AS time_train_s, round(time_infer_s, 9) AS time_infer_s, n FROM results", RESULTS_SQL)
def results_view(spark, d):
    return results(spark, d)


@query("SELECT dataset, problem_type, n_train, n_features FROM tasks", TASKS_SQL)
def task_grid(spark, d):
    return tasks(spark, d)


@query("SELECT count(*) AS n_rows, count(DISTINCT method) AS n_methods, count(DISTINCT dataset) AS n_datasets, count(*) FILTER (WHERE metric_error IS NULL) AS null_errors, count(*) FILTER (WHERE metric_error < 0) AS negative_errors, count(*) - count(DISTINCT (method, dataset, fold)) AS repeated FROM results", RESULTS_SQL)
def validate_summary(spark, d):
    e = F.col("metric_error")
    return results(spark, d).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("method").alias("n_methods"), F.count_distinct("dataset").alias("n_datasets"), F.count_if(e.isNull()).alias("null_errors"), F.count_if(e < 0).alias("negative_errors"), (F.count(F.lit(1)) - F.count_distinct(F.struct("method", "dataset", "fold"))).alias("repeated"))


def thinned(spark, d):
    """Results without some cells, for what deals with gaps."""
    return results(spark, d).where("n % 7 <> 0")


THIN_SQL = "full_ AS (SELECT * FROM results), thin AS (SELECT * FROM full_ WHERE n % 7 <> 0)"
GAPS_SQL = "gaps AS (SELECT m.method, t.dataset, t.fold FROM (SELECT DISTINCT method FROM thin) m CROSS JOIN (SELECT DISTINCT dataset, fold FROM thin) t ANTI JOIN thin x ON x.method = m.method AND x.dataset = t.dataset AND x.fold = t.fold)"


@query("SELECT method, dataset, fold FROM gaps", RESULTS_SQL, THIN_SQL, GAPS_SQL)
def missing_cells(spark, d):
    return subset.missing_cells(thinned(spark, d))


@query("SELECT method, dataset, fold, round(metric_error, 9) AS metric_error, false AS imputed FROM thin UNION ALL SELECT g.method, g.dataset, g.fold, round(w.e, 9), true FROM gaps g JOIN (SELECT dataset, fold, max(metric_error) AS e FROM thin GROUP BY 1, 2) w USING (dataset, fold)", RESULTS_SQL, THIN_SQL, GAPS_SQL)
def impute_worst(spark, d):
    return subset.impute(thinned(spark, d))


@query(f"SELECT method, dataset, fold, round(metric_error, 9) AS metric_error, false AS imputed FROM thin UNION ALL SELECT g.method, g.dataset, g.fold, round(w.e, 9), true FROM gaps g JOIN (SELECT dataset, fold, max(metric_error) FILTER (WHERE method = '{BASELINE}') AS e FROM thin GROUP BY 1, 2) w USING (dataset, fold)", RESULTS_SQL, THIN_SQL, GAPS_SQL)
def impute_named(spark, d):
    return subset.impute(thinned(spark, d), BASELINE)


@query("SELECT dataset, count(*) AS imputed_methods FROM (SELECT DISTINCT dataset, method FROM gaps) GROUP BY 1", RESULTS_SQL, THIN_SQL, GAPS_SQL)
def imputed_counts(spark, d):
    return subset.missing_cells(thinned(spark, d)).groupBy("dataset").agg(F.count_distinct("method").alias("imputed_methods"))


# --- measures within a task -----------------------------------------------------------------------------------------


@query("SELECT method, dataset, fold, round(rank, 9) AS rank, round(improvability, 9) AS improvability, round(loss_rescaled, 9) AS loss_rescaled, round(frontier_advantage, 9) AS frontier_advantage FROM ranked JOIN frontier USING (method, dataset, fold)", RESULTS_SQL, RANKED_SQL, RIVAL_SQL)
def per_task_measures(spark, d):
    return pertask.per_task(results(spark, d)).select("method", "dataset", "fold", "rank", "improvability", "loss_rescaled", "frontier_advantage")


BASE_SQL = f"against AS (SELECT r.*, b.e AS b FROM results r JOIN (SELECT dataset, fold, metric_error AS e FROM results WHERE method = '{BASELINE}') b USING (dataset, fold))"


@query(mean_sql("coalesce((b - metric_error) / nullif(greatest(b, metric_error), 0), 0.0::DOUBLE)", "against", "baseline_advantage"), RESULTS_SQL, BASE_SQL)
def baseline_advantage(spark, d):
    return aggregate.equal_task_mean(pertask.against_baseline(results(spark, d), BASELINE), "baseline_advantage")


@query("SELECT method, round(avg(r), 9) AS relative_error_mean, round(exp(avg(ln(r))), 9) AS relative_error_gmean, round(1 - exp(avg(ln(r))), 9) AS skill_score FROM (SELECT method, dataset, avg(metric_error / b) AS r FROM against GROUP BY 1, 2) GROUP BY 1", RESULTS_SQL, BASE_SQL)
def relative_error_and_skill(spark, d):
    return aggregate.skill_score(pertask.against_baseline(results(spark, d), BASELINE))


@query("SELECT method, round(sum(a), 9) AS rank_1, round(sum(b), 9) AS rank_2, round(sum(c), 9) AS rank_3, round(sum(1 - a - b - c), 9) AS rank_more FROM (SELECT method, dataset, avg(CASE WHEN r <= 1 AND r + ties > 1 THEN 1.0::DOUBLE / ties ELSE 0 END) AS a, avg(CASE WHEN r <= 2 AND r + ties > 2 THEN 1.0::DOUBLE / ties ELSE 0 END) AS b, avg(CASE WHEN r <= 3 AND r + ties > 3 THEN 1.0::DOUBLE / ties ELSE 0 END) AS c FROM ranked GROUP BY 1, 2) GROUP BY 1", RESULTS_SQL, RANKED_SQL)
def rank_counts(spark, d):
    return pertask.rank_counts(pertask.per_task(results(spark, d)))


@query(mean_sql("1.0::DOUBLE / rank", "ranked", "mrr"), RESULTS_SQL, RANKED_SQL)
def mrr(spark, d):
    return aggregate.equal_task_mean(pertask.per_task(results(spark, d)).withColumn("mrr", F.lit(1.0) / F.col("rank")), "mrr")


@query("SELECT method, dataset, fold, round(least(greatest((metric_error - lo) / greatest(mid - lo, 1e-5::DOUBLE), 0), 1), 9) AS normalized_error FROM results JOIN (SELECT dataset, fold, min(metric_error) AS lo, median(metric_error) AS mid FROM results GROUP BY 1, 2) USING (dataset, fold)", RESULTS_SQL)
def normalized_error(spark, d):
    return pertask.normalised_error(results(spark, d)).select("method", "dataset", "fold", "normalized_error")


@query("SELECT dataset, method, round(avg(rank), 9) AS rank, round(avg(improvability) * 100, 9) AS improvability_percent FROM ranked GROUP BY 1, 2", RESULTS_SQL, RANKED_SQL)
def per_dataset_points(spark, d):
    return pertask.per_task(results(spark, d)).groupBy("dataset", "method").agg(F.avg("rank").alias("rank"), (F.avg("improvability") * 100).alias("improvability_percent"))


# --- aggregates, win rates, leaderboards ----------------------------------------------------------------------------


@query("SELECT method, round(avg(e), 9) AS metric_error, round(avg(t), 9) AS time_train_s, round(median(e), 9) AS median_metric_error, round(median(t), 9) AS median_time_train_s FROM (SELECT method, dataset, avg(metric_error) AS e, avg(time_train_s) AS t FROM results GROUP BY 1, 2) GROUP BY 1", RESULTS_SQL)
def aggregate_mean_median(spark, d):
    return aggregate.mean_and_median(results(spark, d), "metric_error", "time_train_s")


@query("SELECT method_1, method_2, round(winrate, 9) AS winrate FROM matrix", RESULTS_SQL, PAIRS_SQL, MATRIX_SQL)
def winrate_matrix(spark, d):
    return aggregate.winrate_matrix(results(spark, d))


@query("SELECT method_1 AS method, round(avg(winrate), 9) AS winrate FROM matrix GROUP BY 1", RESULTS_SQL, PAIRS_SQL, MATRIX_SQL)
def winrate(spark, d):
    return aggregate.winrate(results(spark, d))


@query("SELECT method_1 AS method, round(avg(winrate), 9) AS winrate FROM matrix GROUP BY 1", RESULTS_SQL, PAIRS_SQL, MATRIX_SQL)
def winrate_fast(spark, d):
    return aggregate.winrate_from_ranks(pertask.per_task(results(spark, d)))


@query("SELECT method_1, method_2, dataset, fold, winner, round(weight, 9) AS weight FROM battles", RESULTS_SQL, PAIRS_SQL, BATTLES_SQL)
def battles(spark, d):
    return aggregate.battles(results(spark, d))


@query("SELECT method, count(*) AS battles, round(avg(w), 9) AS winrate FROM (SELECT method_1 AS method, CASE winner WHEN '1' THEN 1.0::DOUBLE WHEN 'tie' THEN 0.5 ELSE 0 END AS w FROM battles UNION ALL SELECT method_2, CASE winner WHEN '2' THEN 1.0::DOUBLE WHEN 'tie' THEN 0.5 ELSE 0 END FROM battles) GROUP BY 1", RESULTS_SQL, PAIRS_SQL, BATTLES_SQL)
def battle_winrate(spark, d):
    return aggregate.battle_winrate(aggregate.battles(results(spark, d)))


@query("SELECT method_1, method_2, round(sum(CASE winner WHEN '1' THEN weight WHEN 'tie' THEN weight / 2 ELSE 0 END), 9) AS s1, round(sum(CASE winner WHEN '2' THEN weight WHEN 'tie' THEN weight / 2 ELSE 0 END), 9) AS s2 FROM battles GROUP BY 1, 2", RESULTS_SQL, PAIRS_SQL, BATTLES_SQL)
def pair_sufficient_stats(spark, d):
    return aggregate.pair_statistics(aggregate.battles(results(spark, d)))


@query()
def elo_ratings(spark, d):
    return elo.elo(aggregate.battles(results(spark, d)))


@query()
def elo_bootstrap(spark, d):
    return elo.elo_bootstrap(aggregate.battles(results(spark, d, wide=True)))


@query("""SELECT a.method, round(a.rank, 9) AS rank, round(a.improvability, 9) AS improvability, round(a.loss_rescaled, 9) AS loss_rescaled, round(a.fa, 9) AS frontier_advantage, round(a.mrr, 9) AS mrr, round(a.metric_error, 9) AS metric_error, round(w.winrate, 9) AS winrate, round(c.r1, 9) AS rank_1, round(c.r2, 9) AS rank_2, round(c.r3, 9) AS rank_3, round(c.rm, 9) AS rank_more
  FROM (SELECT method, avg(rank) AS rank, avg(improvability) AS improvability, avg(loss_rescaled) AS loss_rescaled, avg(fa) AS fa, avg(mrr) AS mrr, avg(metric_error) AS metric_error FROM (SELECT method, dataset, avg(rank) AS rank, avg(improvability) AS improvability, avg(loss_rescaled) AS loss_rescaled, avg(frontier_advantage) AS fa, avg(1.0::DOUBLE / rank) AS mrr, avg(metric_error) AS metric_error FROM ranked JOIN frontier USING (method, dataset, fold) GROUP BY 1, 2) GROUP BY 1) a
  JOIN (SELECT method_1 AS method, avg(winrate) AS winrate FROM matrix GROUP BY 1) w USING (method)
  JOIN (SELECT method, sum(a) AS r1, sum(b) AS r2, sum(c) AS r3, sum(1 - a - b - c) AS rm FROM (SELECT method, dataset, avg(CASE WHEN r <= 1 AND r + ties > 1 THEN 1.0::DOUBLE / ties ELSE 0 END) AS a, avg(CASE WHEN r <= 2 AND r + ties > 2 THEN 1.0::DOUBLE / ties ELSE 0 END) AS b, avg(CASE WHEN r <= 3 AND r + ties > 3 THEN 1.0::DOUBLE / ties ELSE 0 END) AS c FROM ranked GROUP BY 1, 2) GROUP BY 1) c USING (method)""", RESULTS_SQL, RANKED_SQL, RIVAL_SQL, PAIRS_SQL, MATRIX_SQL)
def leaderboard_full(spark, d):
    return aggregate.leaderboard(results(spark, d))


# --- subsets, dense tables, unions ----------------------------------------------------------------------------------


@query("SELECT method, dataset, fold, round(metric_error, 9) AS metric_error FROM wide WHERE dataset IN (SELECT dataset FROM tasks WHERE (problem_type = 'binary' OR n_train <= 2000) AND NOT (n_features > 500))", WIDE_SQL, TASKS_SQL)
def subset_semijoin(spark, d):
    return subset.subset_results(results(spark, d, wide=True), tasks(spark, d), ["binary|tiny", "!high_features"]).select("method", "dataset", "fold", "metric_error")


@query("SELECT dataset FROM tasks WHERE problem_type <> 'regression' OR n_train > 10000 AND n_train <= 100000", TASKS_SQL)
def subset_union_negate(spark, d):
    return subset.subset(tasks(spark, d), "!regression|medium").select("dataset")


@query("SELECT dataset, array_to_string(list_sort(list_filter([CASE WHEN true THEN 'all' END, CASE WHEN problem_type = 'binary' THEN 'binary' END, CASE WHEN problem_type IN ('binary', 'multiclass') THEN 'classification' END, CASE WHEN n_features > 500 THEN 'high_features' END, CASE WHEN n_features <= 500 THEN 'low_features' END, CASE WHEN n_train > 10000 AND n_train <= 100000 THEN 'medium' END, CASE WHEN problem_type = 'multiclass' THEN 'multiclass' END, CASE WHEN problem_type = 'regression' THEN 'regression' END, CASE WHEN n_train <= 10000 THEN 'small' END, CASE WHEN n_train <= 2000 THEN 'tiny' END], lambda x: x IS NOT NULL)), ',') AS subsets FROM tasks", TASKS_SQL)
def subsets_per_dataset(spark, d):
    return subset.predicates_per_dataset(tasks(spark, d))


@query("SELECT method, dataset, fold FROM thin JOIN (SELECT method, dataset, count(DISTINCT fold) AS k FROM thin GROUP BY 1, 2) USING (method, dataset) JOIN (SELECT dataset, count(DISTINCT fold) AS k FROM thin GROUP BY 1) USING (dataset, k)", RESULTS_SQL, THIN_SQL)
def full_fold_coverage(spark, d):
    return subset.full_coverage(thinned(spark, d)).select("method", "dataset", "fold")


@query("SELECT method, dataset, fold FROM thin WHERE (dataset, fold) IN (SELECT (dataset, fold) FROM thin GROUP BY dataset, fold HAVING count(DISTINCT method) = (SELECT count(DISTINCT method) FROM thin))", RESULTS_SQL, "full_ AS (SELECT * FROM results), thin AS (SELECT * FROM full_ WHERE n % 97 <> 0)")
def densify_tasks(spark, d):
    return subset.tasks_with_all_methods(results(spark, d).where("n % 97 <> 0")).select("method", "dataset", "fold")


@query("SELECT method, dataset, fold FROM thin WHERE method IN (SELECT method FROM thin GROUP BY method HAVING count(*) = (SELECT count(DISTINCT (dataset, fold)) FROM thin))", RESULTS_SQL, "full_ AS (SELECT * FROM results), thin AS (SELECT * FROM full_ WHERE n % 31 <> 0)")
def densify_methods(spark, d):
    return subset.methods_with_all_tasks(results(spark, d).where("n % 31 <> 0")).select("method", "dataset", "fold")


def _overlap(spark, d, keep):
    r = results(spark, d).select("method", "dataset", "fold", "metric_error")
    return subset.overlay(r.where("fold < 2"), r.where("fold > 0").withColumn("metric_error", F.col("metric_error") + 1), keep)


@query("SELECT method, dataset, fold, round(CASE WHEN fold < 2 THEN metric_error ELSE metric_error + 1 END, 9) AS metric_error FROM results", RESULTS_SQL)
def overlap_first(spark, d):
    return _overlap(spark, d, "first")


@query("SELECT method, dataset, fold, round(CASE WHEN fold > 0 THEN metric_error + 1 ELSE metric_error END, 9) AS metric_error FROM results", RESULTS_SQL)
def overlap_last(spark, d):
    return _overlap(spark, d, "last")


@query("SELECT coalesce(a.dataset, b.dataset) AS dataset, coalesce(a.problem_type, b.problem_type) AS problem_type, a.n_train, b.n_features FROM (SELECT dataset, CASE WHEN n_features % 2 = 0 THEN problem_type END AS problem_type, n_train FROM tasks WHERE n_train % 3 <> 0) a FULL JOIN (SELECT dataset, problem_type, n_features FROM tasks WHERE n_train % 3 <> 1) b ON a.dataset = b.dataset", TASKS_SQL)
def metadata_coalesce(spark, d):
    t = tasks(spark, d)
    left = t.where("n_train % 3 <> 0").select("dataset", F.when(F.col("n_features") % 2 == 0, F.col("problem_type")).alias("problem_type"), "n_train")
    return subset.coalesced(left, t.where("n_train % 3 <> 1").select("dataset", "problem_type", "n_features"), "dataset").select("dataset", "problem_type", "n_train", "n_features")


# --- stability ------------------------------------------------------------------------------------------------------


@query("SELECT a.dataset, a.fold AS fold_1, b.fold AS fold_2, round(corr(a.metric_error, b.metric_error), 6) AS similarity FROM results a JOIN results b ON a.dataset = b.dataset AND a.method = b.method AND a.fold < b.fold GROUP BY 1, 2, 3", RESULTS_SQL)
def fold_similarity_pearson(spark, d):
    return stability.fold_similarity(results(spark, d), "metric_error").withColumn("similarity", F.round("similarity", 6))


@query("SELECT a.dataset, a.fold AS fold_1, b.fold AS fold_2, round(corr(a.rank, b.rank), 6) AS similarity FROM ranked a JOIN ranked b ON a.dataset = b.dataset AND a.method = b.method AND a.fold < b.fold GROUP BY 1, 2, 3", RESULTS_SQL, RANKED_SQL)
def fold_similarity_spearman(spark, d):
    return stability.fold_similarity(results(spark, d), "metric_error", spearman=True).withColumn("similarity", F.round("similarity", 6))


@query("SELECT dataset, round(rho, 6) AS rho, k AS folds, round(k * greatest(rho, 0.01::DOUBLE) / (1 + (k - 1) * greatest(rho, 0.01::DOUBLE)), 6) AS reliability, least(greatest(ceil(0.95::DOUBLE * (1 - greatest(rho, 0.01::DOUBLE)) / (greatest(rho, 0.01::DOUBLE) * (1 - 0.95::DOUBLE))), 1), 200)::BIGINT AS folds_needed FROM (SELECT dataset, avg(s) AS rho FROM (SELECT a.dataset, a.fold, b.fold, corr(a.rank, b.rank) AS s FROM ranked a JOIN ranked b ON a.dataset = b.dataset AND a.method = b.method AND a.fold < b.fold GROUP BY 1, 2, 3) GROUP BY 1) JOIN (SELECT dataset, count(DISTINCT fold) AS k FROM results GROUP BY 1) USING (dataset)", RESULTS_SQL, RANKED_SQL)
def fold_stability(spark, d):
    r = results(spark, d)
    out = stability.fold_stability(stability.fold_similarity(r, "metric_error", spearman=True), r)
    return out.withColumn("rho", F.round("rho", 6)).withColumn("reliability", F.round("reliability", 6))


WHOLE_SQL = "whole AS (SELECT dataset, method, count(*) OVER (PARTITION BY dataset) AS m FROM (SELECT dataset, method, count(DISTINCT fold) AS k FROM results GROUP BY 1, 2) JOIN (SELECT dataset, count(DISTINCT fold) AS k FROM results GROUP BY 1) USING (dataset, k))"


@query("SELECT dataset, round(avg(abs(s - a)), 9) AS jitter FROM (SELECT dataset, s, avg(s) OVER (PARTITION BY dataset, method) AS a FROM (SELECT dataset, method, 1 - (rank - 1) / (m - 1) AS s FROM ranked JOIN whole USING (dataset, method))) GROUP BY 1", RESULTS_SQL, RANKED_SQL, WHOLE_SQL)
def dataset_jitter(spark, d):
    return stability.jitter(pertask.per_task(results(spark, d)))


@query("SELECT dataset, round(corr(x, y), 6) AS representativeness FROM (SELECT dataset, x, (sum(x) OVER (PARTITION BY method) - x) / (count(*) OVER (PARTITION BY method) - 1) AS y FROM (SELECT dataset, method, avg(metric_error) AS x FROM wide GROUP BY 1, 2)) GROUP BY 1", WIDE_SQL)
def dataset_representativeness(spark, d):
    return stability.representativeness(results(spark, d, wide=True), "metric_error").withColumn("representativeness", F.round("representativeness", 6))


AGREE_SQL = "sums AS (SELECT dataset, method_1, method_2, sum((e1 < e2)::INT)::DOUBLE AS w, sum((e1 = e2)::INT)::DOUBLE AS t, count(*) AS n FROM pairs WHERE method_1 < method_2 GROUP BY 1, 2, 3)"


@query("SELECT dataset, round(avg(greatest((w + t / 2) / n, 1 - (w + t / 2) / n)), 9) AS agreement FROM sums GROUP BY 1", RESULTS_SQL, PAIRS_SQL, AGREE_SQL)
def split_agreement_half(spark, d):
    return stability.split_agreement(results(spark, d), "half")


@query("SELECT dataset, round(avg(CASE WHEN n > t THEN greatest(w / (n - t), 1 - w / (n - t)) END), 9) AS agreement FROM sums GROUP BY 1", RESULTS_SQL, PAIRS_SQL, AGREE_SQL)
def split_agreement_ignore(spark, d):
    return stability.split_agreement(results(spark, d), "ignore")


@query(f"SELECT dataset, count(*) AS folds, round(avg(a - b), 9) AS mean_difference, sum((a < b)::INT)::BIGINT AS wins_first, sum((a > b)::INT)::BIGINT AS wins_second, round(CASE WHEN stddev_samp(a - b) > 1e-12 THEN avg(a - b) * sqrt(count(*)) / stddev_samp(a - b) END, 6) AS z FROM (SELECT x.dataset, x.metric_error AS a, y.metric_error AS b FROM results x JOIN results y USING (dataset, fold) WHERE x.method = '{BASELINE}' AND y.method = '{RIVAL}') GROUP BY 1", RESULTS_SQL)
def method_pair_comparison(spark, d):
    return stability.compare_methods(results(spark, d), BASELINE, RIVAL).withColumn("z", F.round("z", 6))


# --- metrics, ensembles, portfolios ---------------------------------------------------------------------------------


@query("SELECT lang, round(CASE WHEN p * n > 0 THEN (s - p * (p + 1) / 2.0::DOUBLE) / (p * n) END, 9) AS auc FROM (SELECT lang, sum(y) AS p, sum(1 - y) AS n, sum(CASE WHEN y = 1 THEN r END) AS s FROM (SELECT lang, y, rank() OVER (PARTITION BY lang ORDER BY score) + (count(*) OVER (PARTITION BY lang, score) - 1) / 2.0::DOUBLE AS r FROM scores) GROUP BY 1)", SCORES_SQL)
def auc(spark, d):
    return metrics.auc(scores(spark, d), "lang")


@query("SELECT lang, round(-avg(CASE WHEN y = 1 THEN ln(q) ELSE ln(1 - q) END), 9) AS log_loss, round(sqrt(avg((y - score) * (y - score))), 9) AS rmse FROM (SELECT *, least(greatest(score, 1e-15::DOUBLE), 1 - 1e-15::DOUBLE) AS q FROM scores) GROUP BY 1", SCORES_SQL)
def log_loss_and_rmse(spark, d):
    return scores(spark, d).groupBy("lang").agg(metrics.log_loss("y", "score").alias("log_loss"), metrics.rmse("y", "score").alias("rmse"))


@query("""SELECT lang, round(0.5 * (g / nullif(b, 0) + top / nullif(ty, 0)), 9) AS amex FROM (
    SELECT lang, sum((cy / nullif(ty, 0) - cw / tw) * w) AS g, max(ty) AS ty, sum(CASE WHEN y = 1 AND cw <= floor(0.04::DOUBLE * tw) THEN 1.0::DOUBLE ELSE 0 END) AS top FROM weighed GROUP BY 1)
  JOIN (SELECT lang, sum((by_ / nullif(ty, 0) - bw / tw) * w) AS b FROM weighed GROUP BY 1) USING (lang)""", SCORES_SQL, """weighed AS (SELECT lang, y, w, sum(w) OVER (PARTITION BY lang) AS tw, sum(y) OVER (PARTITION BY lang) AS ty,
    sum(w) OVER (PARTITION BY lang ORDER BY score DESC, doc_id) AS cw, sum(y) OVER (PARTITION BY lang ORDER BY score DESC, doc_id) AS cy,
    sum(w) OVER (PARTITION BY lang ORDER BY y DESC, doc_id) AS bw, sum(y) OVER (PARTITION BY lang ORDER BY y DESC, doc_id) AS by_ FROM (SELECT *, CASE WHEN y = 1 THEN 1.0::DOUBLE ELSE 20.0::DOUBLE END AS w FROM scores))""")
def amex(spark, d):
    return metrics.capture_and_gini(scores(spark, d), "lang", "doc_id")


@query("SELECT lang, round(sqrt(avg((y - (0.5 * score + 0.3 * other + 0.2 * third)::DOUBLE) * (y - (0.5 * score + 0.3 * other + 0.2 * third)::DOUBLE))), 9) AS rmse FROM scores GROUP BY 1", SCORES_SQL)
def fixed_weight_ensemble(spark, d):
    mixed = scores(spark, d).withColumn("p", 0.5 * F.col("score") + 0.3 * F.col("other") + 0.2 * F.col("third"))
    return mixed.groupBy("lang").agg(metrics.rmse("y", "p").alias("rmse"))


@query()
def greedy_ensemble(spark, d):
    return portfolio.greedy_ensemble(portfolio.long_scores(scores(spark, d), "score", "other", "third"))


CONFIGS_SQL = "configs AS (SELECT dataset, fold, method AS config, method[1:7] AS family, metric_error, time_infer_s AS metric_error_val, time_train_s FROM results)"


def configs(spark, d):
    """Results as hyperparameter configurations: brands that share their first digit are a family."""
    return results(spark, d).select("dataset", "fold", F.col("method").alias("config"), F.substring("method", 1, 7).alias("family"), "metric_error", F.col("time_infer_s").alias("metric_error_val"), "time_train_s")


@query("SELECT dataset, fold, config, round(metric_error, 9) AS metric_error FROM configs QUALIFY row_number() OVER (PARTITION BY dataset, fold ORDER BY metric_error_val, config) = 1", RESULTS_SQL, CONFIGS_SQL)
def single_best_by_val(spark, d):
    return metrics.single_best(configs(spark, d))


@query("SELECT dataset, fold, config, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY dataset, fold ORDER BY metric_error_val, config) AS place FROM (SELECT * FROM configs QUALIFY row_number() OVER (PARTITION BY dataset, fold, family ORDER BY metric_error_val, config) <= 2)) WHERE place <= 6", RESULTS_SQL, CONFIGS_SQL)
def top_configs_per_type(spark, d):
    return metrics.top_per_family(configs(spark, d), 2, 6)


@query("SELECT dataset, fold, config, round(c, 9) AS cumulative_time FROM (SELECT *, sum(time_train_s) OVER (PARTITION BY dataset, fold ORDER BY config) AS c FROM configs) WHERE c < 20000", RESULTS_SQL, CONFIGS_SQL)
def runtime_prefix_filter(spark, d):
    return metrics.within_runtime(configs(spark, d), 20000)


@query("SELECT config, round(quantile_cont(t, 0.95), 9) AS runtime FROM (SELECT config, dataset, avg(time_train_s) AS t FROM configs GROUP BY 1, 2) GROUP BY 1", RESULTS_SQL, CONFIGS_SQL)
def runtime_quantile_filter(spark, d):
    return metrics.runtime_quantile(configs(spark, d), 0.95)


@query("SELECT method, round(t, 9) AS t, round(s, 9) AS s FROM points p WHERE NOT EXISTS (SELECT 1 FROM points q WHERE q.t <= p.t AND q.s > p.s)", RESULTS_SQL, "points AS (SELECT method, avg(time_train_s) AS t, round(-avg(metric_error), 9) AS s FROM results GROUP BY 1)")
def pareto_frontier(spark, d):
    points = results(spark, d).groupBy("method").agg(F.avg("time_train_s").alias("t"), F.round(-F.avg("metric_error"), 9).alias("s"))
    return metrics.pareto(points, "t", "s")


# --- features -------------------------------------------------------------------------------------------------------


@query("SELECT user_id, round(avg(value), 9) AS value_mean, round(stddev_samp(value), 9) AS value_std, round(min(value), 9) AS value_min, round(max(value), 9) AS value_max, round(max_by(value, (ts, value)), 9) AS value_last, count(event_type) AS event_type_count, count(DISTINCT event_type) AS event_type_nunique FROM events GROUP BY 1")
def group_agg_features(spark, d):
    out = features.group_features(table(spark, d, "events"), "user_id", "value", "event_type", "ts")
    return out.select("user_id", *[F.round(c, 9).alias(c) for c in out.columns if c.startswith("value_")], "event_type_count", "event_type_nunique")


@query("SELECT event_id, year(ts)::INT AS year, month(ts)::INT AS month, day(ts)::INT AS day, (isodow(ts) - 1)::INT AS weekday, hour(ts)::INT AS hour, minute(ts)::INT AS minute FROM events")
def datetime_features(spark, d):
    return features.calendar(table(spark, d, "events"), "ts", "event_id")


@query("SELECT floor(coalesce(c, 0) * 5 / t)::INT AS interval, CAST(min(day) AS VARCHAR) AS first, CAST(max(day) AS VARCHAR) AS last, sum(n)::BIGINT AS rows FROM (SELECT day, n, sum(n) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c, sum(n) OVER () AS t FROM (SELECT ts::DATE AS day, count(*) AS n FROM events GROUP BY 1)) GROUP BY 1")
def temporal_intervals(spark, d):
    out = features.time_intervals(table(spark, d, "events"), "ts", 5)
    return out.withColumn("first", F.col("first").cast("string")).withColumn("last", F.col("last").cast("string"))


# --- places, removals, significance ---------------------------------------------------------------------------------


@query("""SELECT method, dataset, fold, round(less + same / 2.0::DOUBLE + CASE WHEN same > 0 OR e <= 0 THEN 0 WHEN nxt IS NOT NULL THEN least(0.5::DOUBLE, (e - coalesce(prv, 0)) / (nxt - coalesce(prv, 0)) / 2) ELSE least(coalesce((e - worst) / nullif(worst, 0), 1), 1) / 2 END, 9) AS place
  FROM (SELECT c.method, c.dataset, c.fold, c.metric_error AS e, count(*) FILTER (WHERE r.metric_error < c.metric_error) AS less, count(*) FILTER (WHERE r.metric_error = c.metric_error) AS same, max(r.metric_error) FILTER (WHERE r.metric_error < c.metric_error) AS prv, min(r.metric_error) FILTER (WHERE r.metric_error > c.metric_error) AS nxt, max(r.metric_error) AS worst
  FROM results c JOIN results r USING (dataset, fold) WHERE c.method >= 'Brand#3' AND r.method < 'Brand#3' GROUP BY ALL)""", RESULTS_SQL)
def rank_scorer_partial(spark, d):
    r = results(spark, d).select("method", "dataset", "fold", "metric_error")
    return scoring.place_among(r.where("method >= 'Brand#3'"), r.where("method < 'Brand#3'"))


@query(f"SELECT removed, round(avg(r), 9) AS rank FROM (SELECT m.removed, o.dataset, avg(o.rank - CASE WHEN x.metric_error IS NULL THEN 0 WHEN x.metric_error < o.metric_error THEN 1.0::DOUBLE WHEN x.metric_error = o.metric_error THEN 0.5 ELSE 0 END) AS r FROM (SELECT * FROM ranked WHERE method = '{BASELINE}') o CROSS JOIN (SELECT DISTINCT method AS removed FROM results WHERE method <> '{BASELINE}') m LEFT JOIN results x ON x.method = m.removed AND x.dataset = o.dataset AND x.fold = o.fold GROUP BY 1, 2) GROUP BY 1", RESULTS_SQL, RANKED_SQL)
def rank_if_removed(spark, d):
    return scoring.rank_without_each(pertask.per_task(results(spark, d)), BASELINE)


@query()
def significance_vs_best(spark, d):
    return scoring.significance(results(spark, d, wide=True))


@query("SELECT method, round(p, 9) AS p_value, round(least(1.0::DOUBLE, p * (count(*) OVER () - row_number() OVER (ORDER BY p, method) + 1)), 9) AS p_holm FROM (SELECT method, avg(metric_error) AS p FROM results GROUP BY 1)", RESULTS_SQL)
def holm_correction(spark, d):
    return scoring.holm(results(spark, d).groupBy("method").agg(F.avg("metric_error").alias("p_value")))


@query()
def temperature_calibration(spark, d):
    return scoring.temperature(scores(spark, d).withColumn("p", F.col("score")), "lang")


@query()
def hill_climbing_ensemble(spark, d):
    return scoring.hill_climb(portfolio.long_scores(scores(spark, d), "score", "other", "third"))


@query("SELECT method_1, method_2, round((sum((winner = '1')::INT) + sum((winner = 'tie')::INT) / 2.0::DOUBLE) / count(*), 9) AS win_fraction FROM battles GROUP BY 1, 2", RESULTS_SQL, PAIRS_SQL, BATTLES_SQL)
def pairwise_win_fraction(spark, d):
    fights = aggregate.battles(results(spark, d))
    won = F.when(F.col("winner") == "1", 1.0).when(F.col("winner") == "tie", 0.5).otherwise(0.0)
    return fights.groupBy("method_1", "method_2").agg(F.avg(won).alias("win_fraction"))


@query("SELECT a.method AS method_1, b.method AS method_2, round(1 / (1 + pow(10.0::DOUBLE, (b.e - a.e) / 400)), 9) AS expected FROM (SELECT method, 1400 - 4000 * avg(metric_error) AS e FROM results GROUP BY 1) a JOIN (SELECT method, 1400 - 4000 * avg(metric_error) AS e FROM results GROUP BY 1) b ON a.method <> b.method", RESULTS_SQL)
def elo_expected_matrix(spark, d):
    rated = results(spark, d).groupBy("method").agg((1400 - 4000 * F.avg("metric_error")).alias("elo"))
    return elo.expected(rated)


# --- jobs, splits, tuning -------------------------------------------------------------------------------------------


@query("SELECT dataset, (s // 3)::INT AS repeat, (s % 3)::INT AS fold, s::INT AS split, 'r' || (s // 3) || 'f' || (s % 3) AS label FROM tasks CROSS JOIN range(0, 6) t(s)", TASKS_SQL)
def task_grid_explode(spark, d):
    return jobs.split_grid(tasks(spark, d), 3, 2)


@query("SELECT experiment, dataset FROM tasks CROSS JOIN (VALUES ('small', 28000, NULL, false), ('wide', NULL, 60, true), ('any', NULL, NULL, true)) e(experiment, max_rows, max_features, regression) WHERE n_train <= coalesce(max_rows, n_train) AND n_features <= coalesce(max_features, n_features) AND (regression OR problem_type <> 'regression')", TASKS_SQL)
def job_grid_constraints(spark, d):
    e = spark.createDataFrame([("small", 28000, None, False), ("wide", None, 60, True), ("any", None, None, True)], "experiment string, max_rows long, max_features long, regression boolean")
    return jobs.jobs(e, tasks(spark, d))


@query("SELECT doc_id, y, ((row_number() OVER (PARTITION BY y ORDER BY md5(doc_id::VARCHAR)) - 1) % 5)::INT AS fold FROM scores", SCORES_SQL)
def stratified_folds(spark, d):
    return jobs.stratified_folds(scores(spark, d).select("doc_id", "y"), "doc_id", "y", 5)


@query("SELECT event_id, user_id, (('0x' || md5(user_id::VARCHAR)[1:8])::BIGINT % 5)::INT AS fold FROM events")
def group_disjoint_folds(spark, d):
    return jobs.group_folds(table(spark, d, "events").select("event_id", "user_id"), "user_id", 5)


@query("SELECT event_id, later <= 0.2::DOUBLE * total AS held_out FROM events JOIN (SELECT day, sum(n) OVER (ORDER BY day DESC) AS later, sum(n) OVER () AS total FROM (SELECT ts::DATE AS day, count(*) AS n FROM events GROUP BY 1)) ON ts::DATE = day")
def temporal_holdout(spark, d):
    return jobs.temporal_holdout(table(spark, d, "events").select("event_id", "ts"), "ts").select("event_id", "held_out")


@query("SELECT n_configs, family, round(avg(e), 9) AS metric_error FROM (SELECT n_configs, family, dataset, avg(e) AS e FROM (SELECT s.n_configs, family, dataset, fold, arg_min(metric_error, (metric_error_val, config)) AS e FROM (SELECT *, row_number() OVER (PARTITION BY dataset, fold, family ORDER BY config) AS n FROM configs) c JOIN (VALUES (1), (2), (5)) s(n_configs) ON n <= s.n_configs GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3) GROUP BY 1, 2", RESULTS_SQL, CONFIGS_SQL)
def tuning_trajectory(spark, d):
    return jobs.tuning_trajectory(configs(spark, d), [1, 2, 5])


LONG_SQL = "longs AS (SELECT lang AS key, doc_id AS row_id, y::DOUBLE AS y, unnest(['score', 'other', 'third']) AS config, unnest([score, other, third]) AS p FROM scores)"


@query("SELECT key, round(sqrt(avg((m - y) * (m - y))), 9) AS rmse FROM (SELECT key, row_id, avg(p) AS m, any_value(y) AS y FROM longs JOIN (SELECT key, config FROM (SELECT key, config, avg((p - y) * (p - y)) AS e FROM longs GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY key ORDER BY e, config) <= 2) USING (key, config) GROUP BY 1, 2) GROUP BY 1", SCORES_SQL, LONG_SQL)
def topk_ensemble(spark, d):
    return jobs.top_k_average(portfolio.long_scores(scores(spark, d), "score", "other", "third"), 2)


@query("SELECT config, round(median(t), 9) AS runtime FROM (SELECT config, dataset, avg(time_train_s) AS t FROM configs GROUP BY 1, 2) GROUP BY 1", RESULTS_SQL, CONFIGS_SQL)
def sort_by_runtime(spark, d):
    return metrics.runtime_quantile(configs(spark, d), 0.5).orderBy("runtime")


@query("SELECT DISTINCT method FROM thin", RESULTS_SQL, THIN_SQL)
def configs_union(spark, d):
    return thinned(spark, d).select("method").distinct()


@query("SELECT method FROM thin GROUP BY 1 HAVING count(DISTINCT dataset) = (SELECT count(DISTINCT dataset) FROM thin)", RESULTS_SQL, "full_ AS (SELECT * FROM results), thin AS (SELECT * FROM full_ WHERE n % 7 > 2)")
def configs_intersection(spark, d):
    return subset.methods_of_all_datasets(results(spark, d).where("n % 7 > 2"))


@query("SELECT problem_type, CASE WHEN n_train <= 28000 THEN 'small' ELSE 'large' END AS size, count(*) AS n FROM tasks GROUP BY ROLLUP (1, 2)", TASKS_SQL)
def subset_grid_counts(spark, d):
    sized = tasks(spark, d).withColumn("size", F.when(F.col("n_train") <= 28000, "small").otherwise("large"))
    return sized.rollup("problem_type", "size").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT method, round(avg(CASE WHEN k = 'binary' THEN r END), 9) AS rank_binary, round(avg(CASE WHEN k = 'multiclass' THEN r END), 9) AS rank_multiclass, round(avg(CASE WHEN k = 'regression' THEN r END), 9) AS rank_regression FROM (SELECT method, dataset, any_value(problem_type) AS k, avg(rank) AS r FROM ranked JOIN tasks USING (dataset) GROUP BY 1, 2) GROUP BY 1", WIDE_SQL, "results AS (SELECT * FROM wide)", RANKED_SQL, TASKS_SQL)
def composite_leaderboard(spark, d):
    ranked = pertask.per_task(results(spark, d, wide=True)).join(tasks(spark, d).select("dataset", "problem_type"), "dataset")
    inner = ranked.groupBy("method", "dataset", "problem_type").agg(F.avg("rank").alias("r"))
    kinds = ["binary", "multiclass", "regression"]
    wide = inner.groupBy("method").pivot("problem_type", kinds).agg(F.avg("r"))
    return wide.select("method", *[F.col(k).alias(f"rank_{k}") for k in kinds])


@query("SELECT method FROM (SELECT p_brand AS method, list_distinct(list(p_type)) AS tags FROM part WHERE p_size < 6 GROUP BY 1) WHERE len(list_filter(tags, lambda t: t NOT IN ('ECONOMY', 'STANDARD', 'PROMO', 'SMALL'))) = 0")
def entrant_pool(spark, d):
    tagged = table(spark, d, "part").where("p_size < 6").groupBy(F.col("p_brand").alias("method")).agg(F.collect_set("p_type").alias("tags"))
    return subset.admitted(tagged, ["ECONOMY", "STANDARD", "PROMO", "SMALL"]).select("method")


@query("SELECT family, config, round(sum(t) OVER (PARTITION BY family ORDER BY t, config), 9) AS cumulative FROM (SELECT family, config, sum(time_train_s) AS t FROM configs GROUP BY 1, 2)", RESULTS_SQL, CONFIGS_SQL)
def cumulative_runtime(spark, d):
    from pyspark.sql import Window

    total = configs(spark, d).groupBy("family", "config").agg(F.sum("time_train_s").alias("t"))
    w = Window.partitionBy("family").orderBy("t", "config").rowsBetween(Window.unboundedPreceding, 0)
    return total.select("family", "config", F.sum("t").over(w).alias("cumulative"))


@query("SELECT event_type, sum(json_extract(props, '$.k')::BIGINT)::BIGINT AS total FROM events GROUP BY 1")
def json_properties(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("total"))


@query("SELECT CAST(CAST(ts::DATE AS TIMESTAMP) AS VARCHAR) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_daily_counts(spark, d):
    stream = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parquet*")
    daily = incremental.windowed_counts(stream.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type", "1 day")
    return incremental.drained(daily, "daily").withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query("SELECT method, dataset, fold, round(metric_error, 9) AS metric_error FROM wide WHERE fold = 0 AND dataset IN (SELECT dataset FROM tasks WHERE problem_type = 'binary')", WIDE_SQL, TASKS_SQL)
def repository_roundtrip(spark, d):
    import uuid

    path = f"{incremental.shared_folder(spark)}/repository-{uuid.uuid4().hex}"
    Repository(results(spark, d, wide=True), tasks(spark, d)).save(path)
    return Repository.load(spark, path).subset(folds=[0], expressions="binary").results.select("method", "dataset", "fold", "metric_error")


# Further queries register themselves here.
from rankforge.plans import boards, fitted, names, repositories, sourced, tables  # noqa: E402, F401
