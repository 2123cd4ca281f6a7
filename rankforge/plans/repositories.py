"""Catalogues, assembled metrics, merged labels and routed predictions of repositories, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankforge.operators import repository
from rankforge.plans.registry import query
from rankforge.plans.tables import PREDS_SQL
from rankforge.plans.tables import stored as stored_predictions
from rankforge.sources.derived import RESULTS_SQL, SCORES_SQL, TASKS_SQL, WIDE_SQL, results, table, tasks
from rankforge.sources.stored import stored

#: Results on nations with gaps in all methods but one: brands up to 35 are configurations, those from 51 baselines, the others external.
CELLS_SQL = """cells AS (SELECT w.method AS framework, w.dataset, w.fold, w.metric_error, w.time_train_s, w.time_infer_s,
    CASE t.problem_type WHEN 'binary' THEN 'roc_auc' WHEN 'multiclass' THEN 'log_loss' ELSE 'rmse' END AS metric, t.problem_type, t.n_train
  FROM wide w JOIN tasks t USING (dataset) WHERE w.method = 'Brand#11' OR w.n % 11 <> 0)"""
CONFIGS, BASELINES, EXTERNAL = "framework < 'Brand#41'", "framework >= 'Brand#51'", "framework between 'Brand#41' and 'Brand#45'"


def cells(spark, d):
    kind = F.col("problem_type")
    metric = F.when(kind == "binary", "roc_auc").when(kind == "multiclass", "log_loss").otherwise("rmse")
    rows = results(spark, d, wide=True).where("method = 'Brand#11' or n % 11 <> 0").join(tasks(spark, d).select("dataset", "problem_type"), "dataset")
    rows = rows.select("dataset", "fold", F.col("method").alias("framework"), "metric_error", "time_train_s", "time_infer_s", metric.alias("metric"), "problem_type")
    return stored(rows, "cells")


ASSEMBLED_SQL = f"""own AS (SELECT framework, dataset, fold, metric_error, time_train_s, CASE WHEN {EXTERNAL} THEN time_infer_s ELSE time_infer_s * n_train * 0.1::DOUBLE END AS time_infer_s, metric, problem_type
    FROM cells WHERE {EXTERNAL} OR fold = 0 AND ({CONFIGS} OR framework IN ('Brand#51', 'Brand#52') AND dataset IN (SELECT dataset FROM cells WHERE {CONFIGS}))),
  lent AS (SELECT * FROM own WHERE framework = 'Brand#11'),
  filled AS (SELECT *, false AS imputed, NULL::VARCHAR AS impute_method FROM own UNION ALL
    SELECT f.framework, l.dataset, l.fold, l.metric_error, l.time_train_s, l.time_infer_s, l.metric, l.problem_type, true, 'Brand#11' FROM (SELECT DISTINCT framework FROM own) f, lent l
    WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.framework = f.framework AND o.dataset = l.dataset AND o.fold = l.fold))"""


@query("SELECT framework, dataset, fold, round(metric_error, 9) AS metric_error, round(time_train_s, 9) AS time_train_s, round(time_infer_s, 9) AS time_infer_s, metric, problem_type, imputed, impute_method FROM filled", WIDE_SQL, TASKS_SQL, CELLS_SQL, ASSEMBLED_SQL)
def metrics_assembled(spark, d):
    rows, sizes = cells(spark, d), tasks(spark, d).select("dataset", F.col("n_train").alias("NumberOfInstances"))
    return repository.assemble_metrics(rows.where(CONFIGS), rows.where(BASELINES), rows.where(EXTERNAL), folds=[0], baseline_names=["Brand#51", "Brand#52"], fallback="Brand#11", metadata=sizes)


@query("SELECT dataset, any_value(metric) AS metric, any_value(problem_type) AS problem_type FROM cells GROUP BY 1", WIDE_SQL, TASKS_SQL, CELLS_SQL)
def datasets_info(spark, d):
    rows = cells(spark, d)
    return repository.dataset_info(rows.where(CONFIGS), rows.where(BASELINES))


@query("SELECT tid FROM (SELECT dataset, any_value(problem_type) AS problem_type, row_number() OVER (ORDER BY dataset) - 1 AS tid FROM cells GROUP BY 1) WHERE problem_type = 'multiclass'", WIDE_SQL, TASKS_SQL, CELLS_SQL)
def tids_of_problem_type(spark, d):
    rows = cells(spark, d)
    ids = repository.dataset_ids(rows.where(CONFIGS), rows.where("not (framework < 'Brand#41')"))
    return repository.ids_of(ids, repository.dataset_info(rows), "multiclass")


def specs(spark, d):
    """Brands as configs: their sizes are hyperparameters, and brands that end in 5 have none."""
    parts = table(spark, d, "part").groupBy(F.col("p_brand").alias("config")).agg(F.min("p_size").alias("least"), F.max("p_size").alias("most"))
    hyper = F.when(~F.col("config").endswith("5"), F.struct("least", "most", F.struct(F.lit("_r1").alias("name_suffix")).alias("ag_args")))
    return parts.select("config", F.to_json(F.struct(F.substring("config", 1, 7).alias("model_type"), hyper.alias("hyperparameters"))).alias("spec"))


@query("""SELECT config, config[1:7] AS config_type, key, value FROM (SELECT p_brand AS config, min(p_size) AS lo, max(p_size) AS hi FROM part GROUP BY 1),
    LATERAL (SELECT unnest(['least', 'most']) AS key, unnest([lo::VARCHAR, hi::VARCHAR]) AS value) WHERE config NOT LIKE '%5' UNION ALL SELECT DISTINCT p_brand, p_brand[1:7], NULL, NULL FROM part WHERE p_brand LIKE '%5'""")  # fmt: skip
def config_hyperparameters(spark, d):
    rows = specs(spark, d)
    named = repository.config_types(rows).join(repository.hyperparameters(rows, with_ag_args=False), "config")
    return named.select("config", "config_type", F.explode_outer("hyperparameters").alias("key", "value"))


@query("SELECT method, dataset, fold, round(metric_error, 9) AS metric_error FROM marked WHERE fold IN (0, 1) AND method_subtype IS DISTINCT FROM 'best' AND (config_type IS NULL OR config_type <> 'Brand#1')",
       WIDE_SQL, "marked AS (SELECT *, CASE n % 3 WHEN 1 THEN 'best' WHEN 2 THEN 'default' END AS method_subtype, CASE n % 2 WHEN 1 THEN method[1:7] END AS config_type FROM wide)")
def results_of_report(spark, d):
    subtype = F.when(F.col("n") % 3 == 1, "best").when(F.col("n") % 3 == 2, "default")
    marked = results(spark, d, wide=True).withColumns({"method_subtype": subtype, "config_type": F.when(F.col("n") % 2 == 1, F.substring("method", 1, 7))})
    return repository.reported(marked, folds=[0, 1], keep_best=False, banned_types=["Brand#1"]).select("method", "dataset", "fold", "metric_error")


@query("SELECT dataset, fold, split, \"row\", CASE fold WHEN 0 THEN y ELSE 1 - y END AS y FROM preds WHERE config = 'score'", SCORES_SQL, PREDS_SQL)
def labels_merged(spark, d):
    labels = stored_predictions(spark, d).labels.withColumn("fold", F.col("fold").cast("long"))
    return repository.merged_labels([labels.where("fold < 2"), labels.where("fold > 0").withColumn("y", 1 - F.col("y"))])


ROUTED_SQL = """have AS (SELECT *, CASE WHEN config = 'third' OR fold = 2 THEN 1 ELSE 0 END AS source FROM preds WHERE config IN ('score', 'third') OR fold < 2),
  want AS (SELECT DISTINCT dataset, fold, place, c.config FROM preds, (VALUES (0, 'third'), (1, 'score'), (2, 'other')) c(place, config)),
  routed AS (SELECT *, CASE WHEN EXISTS (SELECT 1 FROM have h WHERE h.dataset = want.dataset AND h.fold = want.fold AND h.config = want.config) THEN config ELSE 'score' END AS lender FROM want)"""


@query("SELECT r.dataset, r.fold, r.place, r.config, r.lender, h.source, h.split, h.\"row\", round(h.pred, 9) AS pred FROM routed r JOIN have h ON h.dataset = r.dataset AND h.fold = r.fold AND h.config = r.lender", SCORES_SQL, PREDS_SQL, ROUTED_SQL)
def predictions_routed(spark, d):
    rows = stored_predictions(spark, d).predictions.withColumn("fold", F.col("fold").cast("long"))
    first, second = rows.where("config in ('score', 'other') and fold < 2"), rows.where("config = 'third' or config = 'score' and fold = 2")
    return repository.routed_predictions([first, second], rows, ["third", "score", "other"], fallback="score")


@query("""SELECT dataset, round(avg(f0), 9) AS F0, round(avg(f1), 9) AS F1, round(avg(f2), 9) AS F2 FROM (SELECT dataset, fold, """
       + ", ".join(f"coalesce(sum(n) FILTER (WHERE method[7:7]::INT % 4 = {k}), 0) / 1000::DOUBLE AS f{k}" for k in range(3)) + " FROM results GROUP BY 1, 2) GROUP BY 1", RESULTS_SQL)
def ensemble_family_weights(spark, d):
    rows = stored(results(spark, d), "results")
    weights = F.to_json(F.map_from_entries(F.collect_list(F.struct("method", F.col("n") / F.lit(1000.0)))))
    ensembles = rows.groupBy("dataset", "fold").agg(weights.alias("ensemble_weight")).withColumn("method", F.lit("ensemble"))
    types = rows.select(F.col("method").alias("config"), F.concat(F.lit("F"), F.substring("method", 7, 1).cast("int") % 4).alias("config_type")).distinct()
    return repository.family_weights(ensembles, types, "ensemble", excluded=["F3"], by_dataset=True)
