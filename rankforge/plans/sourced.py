"""Task metadata in its two forms, results that have it, and texts as numbers, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankforge.functions import text_statistics
from rankforge.functions.features import clean_text
from rankforge.plans.registry import query
from rankforge.sources import task_sources
from rankforge.sources.derived import RESULTS_SQL, TASKS_SQL, WIDE_SQL, results, table, tasks
from rankforge.sources.stored import stored

LEGACY_SQL = """legacy AS (SELECT *, CASE problem_type WHEN 'binary' THEN 2 WHEN 'multiclass' THEN 5 ELSE 0 END AS n_classes, 3 AS n_folds, 1 + n_features % 3 AS n_repeats FROM tasks)"""
SPLITS_SQL = """splits AS (SELECT dataset, n_train::VARCHAR AS task_id_str, problem_type, CASE problem_type WHEN 'binary' THEN 'roc_auc' WHEN 'multiclass' THEN 'log_loss' ELSE 'rmse' END AS eval_metric, problem_type <> 'regression' AS is_classification,
    CASE problem_type WHEN 'regression' THEN -1 ELSE n_classes END AS num_classes, n_features::INT AS num_features, n_train AS num_instances, n_train * 2 / 3.0::DOUBLE AS num_instances_train, n_train / 3.0::DOUBLE AS num_instances_test, repeat::INT AS repeat, fold::INT AS fold
  FROM legacy, range(n_repeats) r(repeat), range(n_folds) f(fold))"""


def legacy(spark, d):
    """The tasks of the star schema in the older form: three folds, one to three repeats."""
    kinds = F.when(F.col("problem_type") == "binary", 2).when(F.col("problem_type") == "multiclass", 5).otherwise(0)
    rows = tasks(spark, d).withColumnRenamed("n_train", "NumberOfInstances").withColumn("n_classes", kinds).withColumn("tid", F.col("NumberOfInstances"))
    n = F.col("NumberOfInstances")
    return rows.withColumns({"n_folds": F.lit(3), "n_repeats": 1 + F.col("n_features") % 3, "n_samples_train_per_fold": n * 2 / F.lit(3.0), "n_samples_test_per_fold": n / F.lit(3.0)})


@query("SELECT dataset, task_id_str, problem_type, eval_metric, is_classification, num_classes, num_features, num_instances, round(num_instances_train, 9) AS num_instances_train, round(num_instances_test, 9) AS num_instances_test, repeat, fold FROM splits", TASKS_SQL, LEGACY_SQL, SPLITS_SQL)
def splits_of_legacy_tasks(spark, d):
    return task_sources.splits_of_datasets(task_sources.resolve_source(spark, legacy(spark, d))).drop("target_name")


@query("""SELECT dataset, count(DISTINCT fold) AS n_folds, count(DISTINCT repeat) AS n_repeats, round(avg(num_instances_train), 6) AS n_samples_train_per_fold, round(avg(num_instances_test), 6) AS n_samples_test_per_fold,
    any_value(num_features) AS n_features, any_value(num_classes) AS n_classes, any_value(eval_metric) AS eval_metric FROM splits WHERE NOT (repeat = 0 AND fold = 1) GROUP BY 1""", TASKS_SQL, LEGACY_SQL, SPLITS_SQL)
def legacy_tasks_of_splits(spark, d):
    splits = task_sources.splits_of_datasets(legacy(spark, d)).where("not (repeat = 0 and fold = 1)")
    out = task_sources.datasets_of_splits(splits)
    return out.select("dataset", "n_folds", "n_repeats", *[F.round(c, 6).alias(c) for c in ("n_samples_train_per_fold", "n_samples_test_per_fold")], "n_features", "n_classes", "eval_metric")


@query("SELECT method, dataset, fold, round(metric_error, 9) AS metric_error FROM wide WHERE dataset IN (SELECT dataset FROM tasks WHERE problem_type <> 'regression')", WIDE_SQL, TASKS_SQL)
def results_with_metadata(spark, d):
    return task_sources.with_metadata(results(spark, d, wide=True), tasks(spark, d).where("problem_type <> 'regression'")).select("method", "dataset", "fold", "metric_error")


@query("SELECT subset, method, round(avg(metric_error), 9) AS metric_error FROM (SELECT CASE fold WHEN 0 THEN 'all' WHEN 1 THEN 'small&tabular' ELSE 'lite' END AS subset, method, metric_error FROM results) GROUP BY 1, 2", RESULTS_SQL)
def boards_without_lite(spark, d):
    named = results(spark, d).withColumn("subset", F.when(F.col("fold") == 0, "all&lite").when(F.col("fold") == 1, "small&lite&tabular").otherwise("lite"))
    return task_sources.without_lite(named).groupBy("subset", "method").agg(F.avg("metric_error").alias("metric_error"))


TURN = ["conv_id", "turn"]


@query("SELECT conv_id, turn, term, round(n * idf / sqrt(sum(n * idf * n * idf) OVER (PARTITION BY conv_id, turn)), 9) AS weight FROM counts JOIN idfs USING (term)",
       r"""words AS (SELECT conv_id, turn, unnest(string_split_regex(lower(coalesce(text, 'NA')), '\s+')) AS w FROM conversations),
  counts AS (SELECT conv_id, turn, term, count(*) AS n FROM (SELECT conv_id, turn, substr(' ' || w || ' ', unnest(range(1, length(w) + 1)), 3) AS term FROM words WHERE w <> ''
    UNION ALL SELECT conv_id, turn, substr(' ' || w || ' ', unnest(range(1, length(w))), 4) FROM words WHERE w <> '') GROUP BY ALL),
  idfs AS (SELECT term, ln((1.0::DOUBLE + (SELECT count(*) FROM (SELECT DISTINCT conv_id, turn FROM conversations))) / (1 + count(*))) + 1 AS idf FROM counts GROUP BY 1)""")  # fmt: skip
def text_term_weights(spark, d):
    rows = table(spark, d, "conversations")
    bags, texts = text_statistics.tallies(rows, TURN, "text")
    frequencies = text_statistics.inverse_frequencies(text_statistics.counts_of(bags, TURN), TURN, texts)
    return text_statistics.bag_weights(bags, stored(frequencies, "inverse-frequencies"), TURN)


@query()
def text_embeddings(spark, d):
    rows = table(spark, d, "conversations").select(F.concat_ws("-", *TURN).alias("id"), "text")
    clean = stored(clean_text(rows, "text", "id", "NA"), "clean-texts")
    return text_statistics.fit_text_statistics(clean, ["id"], "clean").transform(clean, ["id"], "clean")
