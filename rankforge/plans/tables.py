"""Queries over task metadata, stored predictions, removals and boards, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from rankforge.functions import features
from rankforge.operators import aggregate, elo, metadata, removal
from rankforge.operators.predictions import Predictions, log_loss, true_class
from rankforge.plans.registry import query
from rankforge.sources.derived import RESULTS_SQL, SCORES_SQL, TASKS_SQL, results, scores, table, tasks
from rankforge.streaming import incremental

# --- task metadata --------------------------------------------------------------------------------------------------

SPLITS_SQL = """splits AS (SELECT dataset, problem_type, n_features, f.range AS fold, r.range AS repeat, 'r' || r.range || 'f' || f.range AS split_index, 3 * r.range + f.range AS split,
    n_train + 100 * f.range AS n_train, n_features % 2 = 0 AS categorical, n_features % 3 = 0 AS has_text FROM tasks, range(3) f, range(2) r)"""


def splits(spark, d):
    n = F.col("n_features")
    grid = tasks(spark, d).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(2)).cast("array<long>"))).withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(1)).cast("array<long>")))
    kinds = F.array_compact(F.array(F.lit("numerical"), F.when(n % 2 == 0, "categorical"), F.when(n % 3 == 0, "text")))
    index = F.concat(F.lit("r"), "repeat", F.lit("f"), "fold")
    return grid.withColumns({"split_index": index, "split": 3 * F.col("repeat") + F.col("fold"), "n_train": F.col("n_train") + 100 * F.col("fold"), "dtypes": kinds})


def described(spark, d):
    n = F.col("n_features")
    grid = splits(spark, d)
    largest = metadata.per_dataset(grid).select("dataset", "max_train_rows")
    temporal, grouped = F.when(n % 5 == 0, "t"), F.when(n % 5 == 1, "g")
    extra = {
        "task_type": metadata.task_type(temporal, grouped), "group_labels": F.when(n % 2 == 0, "per_group").otherwise("per_sample"), "num_cols_after_preprocessing": 8 * n,
        "num_text_cols": (n % 3 == 0).cast("int"), "num_high_cardinality_cats": n % 4, "has_categorical": n % 2 == 0, "has_datetime": n % 7 == 0, "folds_to_use": 1 + n % 6,
    }
    return grid.join(largest, "dataset").withColumns(extra)


DESCRIBED_SQL = """described AS (SELECT *, max(n_train) OVER (PARTITION BY dataset) AS max_train_rows, CASE n_features % 5 WHEN 0 THEN 'temporal' WHEN 1 THEN 'grouped' ELSE 'random' END AS task_type FROM splits)"""


@query("SELECT dataset, split_index FROM splits WHERE split_index = 'r0f0'", TASKS_SQL, SPLITS_SQL)
def splits_lite(spark, d):
    return metadata.select_splits(splits(spark, d), split_indices="lite").select("dataset", "split_index")


@query("SELECT dataset, split_index, n_train FROM splits WHERE problem_type IN ('binary', 'regression') AND split_index IN ('r0f1', 'r1f2') AND categorical AND NOT has_text", TASKS_SQL, SPLITS_SQL)
def splits_by_dtype(spark, d):
    out = metadata.select_splits(splits(spark, d), ["binary", "regression"], ["r0f1", "r1f2"], required_dtypes=["categorical"], forbidden_dtypes=["text"])
    return out.select("dataset", "split_index", "n_train")


@query("SELECT dataset, split_index, n_train FROM splits WHERE n_train > 3000 AND n_train <= 30100", TASKS_SQL, SPLITS_SQL)
def splits_by_size(spark, d):
    return metadata.select_splits(splits(spark, d), train_rows=(3000, 30100)).select("dataset", "split_index", "n_train")


@query("SELECT dataset, split_index FROM splits WHERE dataset IN ('NATION_1', 'NATION_2')", TASKS_SQL, SPLITS_SQL)
def splits_by_name(spark, d):
    return metadata.select_splits(splits(spark, d), datasets=["NATION_1", "NATION_2"]).select("dataset", "split_index")


@query("SELECT dataset, problem_type, max(n_train) AS max_train_rows, count(*) AS n_splits FROM splits GROUP BY 1, 2", TASKS_SQL, SPLITS_SQL)
def per_dataset_frame(spark, d):
    return metadata.per_dataset(splits(spark, d), "problem_type")


@query("SELECT dataset, split_index FROM described WHERE (max_train_rows BETWEEN 1001 AND 10000 OR task_type = 'temporal') AND NOT has_text AND split < 1 + n_features % 6", TASKS_SQL, SPLITS_SQL, DESCRIBED_SQL)
def split_predicates(spark, d):
    return metadata.select_splits(described(spark, d), expressions=["small|temporal", "!text", "core"]).select("dataset", "split_index")


@query("SELECT dataset, split_index FROM described WHERE split < 1 + n_features % 6 AND split = 0 AND n_features % 4 > 0 AND NOT max_train_rows BETWEEN 100001 AND 1000350", TASKS_SQL, SPLITS_SQL, DESCRIBED_SQL)
def split_shortcuts(spark, d):
    return metadata.select_splits(described(spark, d), expressions="hc_nolarge_lite").select("dataset", "split_index")


#: What each predicate says of a described split, in terms of the numbers that the view is made from.
EVERY_PREDICATE = {
    "all": "true", "binary": "problem_type = 'binary'", "multiclass": "problem_type = 'multiclass'", "classification": "problem_type <> 'regression'", "regression": "problem_type = 'regression'",
    "large": "max_train_rows > 100000 AND max_train_rows <= 1000350", "medium": "max_train_rows > 10000 AND max_train_rows <= 100000", "small": "max_train_rows > 1000 AND max_train_rows <= 10000", "tiny": "max_train_rows > 100 AND max_train_rows <= 1000",
    "iid": "n_features % 5 > 1", "random": "n_features % 5 > 1", "temporal": "n_features % 5 = 0", "grouped": "n_features % 5 = 1", "grouped_lpg": "n_features % 5 = 1 AND n_features % 2 = 0", "grouped_lps": "n_features % 5 = 1 AND n_features % 2 = 1",
    "low-dim": "8 * n_features <= 100", "high-dim": "8 * n_features > 100", "dim_above_500": "8 * n_features > 500", "text": "n_features % 3 = 0", "high-cardinality": "n_features % 4 > 0",
    "numerical": "n_features % 2 = 1 AND n_features % 7 > 0 AND n_features % 3 > 0", "lite": "split = 0", "core": "split < 1 + n_features % 6",
}
EVERY_SHORTCUT = {
    "large": ["core", "large"], "high_dim": ["core", "high-dim"], "low_dim": ["core", "low-dim"], "high_cardinality": ["core", "high-cardinality"], "grouped": ["core", "grouped"], "temporal": ["core", "temporal"], "iid": ["core", "iid"],
    "random": ["core", "random"], "text": ["core", "text"], "numerical": ["core", "numerical"], "hc_nolarge": ["core", "high-cardinality", "small_or_less"], "hc_nolarge_lite": ["core", "lite", "high-cardinality", "small_or_less"],
}


def shortcut_sql(names: list[str]) -> str:
    return " AND ".join("NOT (max_train_rows > 100000 AND max_train_rows <= 1000350)" if n == "small_or_less" else f"({EVERY_PREDICATE[n]})" for n in names)


@query(" UNION ALL ".join([f"SELECT 'predicate' AS kind, '{n}' AS name, dataset, split_index FROM described WHERE {c}" for n, c in EVERY_PREDICATE.items()] + [f"SELECT 'shortcut', '{n}', dataset, split_index FROM described WHERE {shortcut_sql(c)}" for n, c in EVERY_SHORTCUT.items()]), TASKS_SQL, SPLITS_SQL, DESCRIBED_SQL)
def splits_of_every_predicate(spark, d):
    """All predicates and shortcuts in one pass: a row for each that a split meets."""
    marks = [(kind, name, metadata.holds(expressions)) for kind, table_ in (("predicate", {n: [n] for n in metadata.SPLIT_PREDICATES}), ("shortcut", metadata.SHORTCUTS)) for name, expressions in table_.items()]
    met = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(k).alias("kind"), F.lit(n).alias("name"))) for k, n, c in marks]))
    return described(spark, d).select("dataset", "split_index", F.inline(met)).select("kind", "name", "dataset", "split_index")


@query("SELECT count(*) AS num_instances, 8::BIGINT AS num_features, count(DISTINCT l_returnflag) AS num_classes, (SELECT count(*) FROM (SELECT DISTINCT l_suppkey, l_linenumber FROM lineitem)) AS num_instance_groups FROM lineitem")
def dataset_stats(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_shipdate")
    return metadata.dataset_stats(rows, "l_returnflag", True, ["l_suppkey", "l_linenumber"])


@query("SELECT * FROM (SELECT 'quality' AS \"column\" FROM labels HAVING count(DISTINCT quality) = 2 UNION ALL SELECT 'toxic' FROM labels HAVING count(DISTINCT toxic) = 2 UNION ALL SELECT 'odd' FROM labels HAVING count(DISTINCT CASE WHEN doc_id % 3 > 0 THEN doc_id % 3 END) = 2)")
def binary_columns(spark, d):
    rows = table(spark, d, "labels")
    return metadata.binary_columns(rows.withColumns({"odd": F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") % 3), "three": F.col("doc_id") % 3, "one": F.lit(1)}))


# --- stored predictions ---------------------------------------------------------------------------------------------

PREDS_SQL = """preds AS (SELECT coalesce(lang, 'none') AS dataset, (doc_id // 4) % 3 AS fold, CASE doc_id % 2 WHEN 0 THEN 'val' ELSE 'test' END AS split, doc_id AS "row", y, config, pred
    FROM (SELECT doc_id, lang, y, unnest(['score', 'other', 'third']) AS config, unnest([score, other, third]) AS pred FROM scores) WHERE NOT (config = 'third' AND (doc_id // 4) % 3 = 2))"""


def stored(spark, d) -> Predictions:
    """Three scores of documents as configs, the languages being datasets, written and read back; the third lacks fold 2."""
    i = F.col("doc_id")
    rows = scores(spark, d).select(F.coalesce("lang", F.lit("none")).alias("dataset"), (F.floor(i / 4) % 3).alias("fold"), F.when(i % 2 == 0, "val").otherwise("test").alias("split"), i.alias("row"), "y", "score", "other", "third")
    long = rows.unpivot(["dataset", "fold", "split", "row"], ["score", "other", "third"], "config", "pred").where("not (config = 'third' and fold = 2)")
    path = f"{incremental.shared_folder(spark)}/predictions-{uuid.uuid4().hex}"
    Predictions(long, rows.select("dataset", "fold", "split", "row", "y")).save(path)
    return Predictions.load(spark, path)


@query("SELECT config, \"row\", round(pred, 9) AS pred FROM preds WHERE dataset = 'en' AND fold = 1 AND split = 'test' AND config IN ('score', 'third')", SCORES_SQL, PREDS_SQL)
def predictions_of_task(spark, d):
    return stored(spark, d).predict("test", "en", 1, ["score", "third"]).select("config", "row", "pred")


@query("SELECT CASE n WHEN 1 THEN 'third' ELSE config END AS config, \"row\", round(pred, 9) AS pred FROM preds, range(2) t(n) WHERE dataset = 'en' AND fold = 2 AND split = 'val' AND config = 'score'", SCORES_SQL, PREDS_SQL)
def predictions_with_fallback(spark, d):
    return stored(spark, d).predict("val", "en", 2, ["score", "third"], "score").select("config", "row", "pred")


@query("SELECT \"row\", y FROM preds WHERE dataset = 'en' AND fold = 0 AND split = 'val' AND config = 'score'", SCORES_SQL, PREDS_SQL)
def labels_of_task(spark, d):
    return stored(spark, d).labels_of("val", "en", 0)


@query("SELECT dataset, fold, config FROM preds GROUP BY 1, 2, 3 HAVING count(DISTINCT split) = 2", SCORES_SQL, PREDS_SQL)
def predictions_available(spark, d):
    return stored(spark, d).available().select("dataset", F.col("fold").cast("long").alias("fold"), "config")


@query("SELECT config, count(*) AS rows FROM preds WHERE config IN ('score', 'other') GROUP BY 1", SCORES_SQL, PREDS_SQL)
def predictions_dense(spark, d):
    return stored(spark, d).dense().predictions.groupBy("config").agg(F.count(F.lit(1)).alias("rows"))


@query("SELECT config, round(count(*)::DOUBLE / any_value(tasks), 9) AS density FROM here, (SELECT count(*) AS tasks FROM (SELECT DISTINCT dataset, fold FROM here)) GROUP BY 1", SCORES_SQL, PREDS_SQL, "here AS (SELECT dataset, fold, config FROM preds GROUP BY 1, 2, 3 HAVING count(DISTINCT split) = 2)")
def prediction_density(spark, d):
    return stored(spark, d).density()


CLASSES_SQL = """classes AS (SELECT vec_id, label, w, list_sum(w) AS total FROM (SELECT vec_id, label, [abs(trunc(x::DOUBLE * 1000)) + 1 FOR x IN embedding[1:10]] AS w FROM embeddings))"""


def classes(spark, d):
    w = F.transform(F.slice("embedding", 1, 10), lambda x: F.floor(F.abs(x.cast("double") * 1000)).cast("double") + 1)
    rows = table(spark, d, "embeddings").select("vec_id", "label", w.alias("w"))
    return rows.withColumn("p", F.transform("w", lambda x: x / F.aggregate("w", F.lit(0.0), lambda a, b: a + b)))


@query("SELECT vec_id, round(w[label + 1] / total, 9) AS p FROM classes", CLASSES_SQL)
def true_class_probability(spark, d):
    return classes(spark, d).select("vec_id", true_class(F.col("p"), F.col("label")).alias("p"))


@query("SELECT label, round(avg(-ln(greatest(least(w[label + 1] / total, 1 - 1e-15::DOUBLE), 1e-15::DOUBLE))), 9) AS log_loss FROM classes GROUP BY 1", CLASSES_SQL)
def log_loss_multiclass(spark, d):
    return classes(spark, d).groupBy("label").agg(log_loss(true_class(F.col("p"), F.col("label"))).alias("log_loss"))


# --- removals and boards --------------------------------------------------------------------------------------------

LOSSES_SQL = """losses AS (SELECT method_1, method_2, round(sum(lost / folds) / any_value(datasets), 9) AS lost FROM (
    SELECT a.dataset, a.method AS method_1, b.method AS method_2, sum(CASE WHEN b.metric_error < a.metric_error THEN 1.0::DOUBLE WHEN b.metric_error = a.metric_error THEN 0.5 ELSE 0 END) AS lost
    FROM results a JOIN results b ON a.dataset = b.dataset AND a.fold = b.fold AND a.method <> b.method GROUP BY 1, 2, 3)
  JOIN (SELECT dataset, method AS method_1, count(*) AS folds FROM results GROUP BY 1, 2) USING (dataset, method_1)
  JOIN (SELECT method AS method_1, count(DISTINCT dataset) AS datasets FROM results GROUP BY 1) USING (method_1) GROUP BY 1, 2),
 orders_ AS (SELECT method_1, row_number() OVER w::INT AS step, method_2, 1 + coalesce(sum(lost) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS score, lost FROM losses WINDOW w AS (PARTITION BY method_1 ORDER BY lost DESC, method_2))"""


@query("SELECT method_1, step, method_2, round(score, 8) AS score FROM orders_", RESULTS_SQL, LOSSES_SQL)
def removal_score_matrix(spark, d):
    return removal.removal_orders(results(spark, d)).withColumn("score", F.round("score", 8))


@query("SELECT step, method_2, round(score, 8) AS score FROM orders_ WHERE method_1 = 'Brand#11' AND score + lost > 5", RESULTS_SQL, LOSSES_SQL)
def removals_until(spark, d):
    return removal.removal_orders(results(spark, d), 5.0).where("method_1 = 'Brand#11'").select("step", "method_2", F.round("score", 8).alias("score"))


@query("""SELECT p_type AS subset, CASE WHEN suffix = 2 THEN p_brand || ' (T+E)' WHEN suffix = 1 THEN p_brand || ' (tuned)' ELSE p_brand END AS method, rows
  FROM (SELECT *, bool_or(suffix = 2) OVER (PARTITION BY p_type, p_brand) AS best FROM (SELECT p_type, p_brand, p_size % 4 AS suffix, count(*) AS rows FROM part WHERE p_size % 4 < 3 GROUP BY 1, 2, 3))
  WHERE NOT (best AND suffix < 2)""")
def collapsed_variants(spark, d):
    k = F.col("p_size") % 4
    suffix = F.when(k == 0, removal.DEFAULT).when(k == 1, removal.TUNED).otherwise(removal.ENSEMBLED)
    board = table(spark, d, "part").where(k < 3).groupBy(F.col("p_type").alias("subset"), F.concat("p_brand", suffix).alias("method")).agg(F.count(F.lit(1)).alias("rows"))
    return removal.collapsed_variants(board, "subset")


@query("SELECT day, total FROM (SELECT *, max(total) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (SELECT CAST(ts AS DATE) AS day, max(event_id * 7919 % 1009 % (100 + 30 * day(ts))) AS total FROM events GROUP BY 1)) WHERE before IS NULL OR total > before")
def best_over_time(spark, d):
    rows = table(spark, d, "events").select(F.to_date("ts").alias("day"), (F.col("event_id") * 7919 % 1009 % (100 + 30 * F.dayofmonth("ts"))).alias("total"))
    return removal.date_front(rows, "day", "total", higher=True)


@query()
def elo_board(spark, d):
    return removal.elo_board(elo.elo_bootstrap(aggregate.battles(results(spark, d))), "Brand#11")


# --- features -------------------------------------------------------------------------------------------------------


@query()
def text_sanitize(spark, d):
    return features.clean_text(table(spark, d, "documents"), "text", "doc_id")


@query("SELECT event_id, year(ts)::INT AS year, epoch_us(ts) / 1e6::DOUBLE AS total_seconds, " + ", ".join(f"round({f}(2 * pi() * {x} / {n}.0::DOUBLE), 9) + 0.0::DOUBLE AS {c}_{i}" for c, x, n in (("month", "month(ts)", 12), ("day", "day(ts)", 30), ("weekday", "isodow(ts)", 7), ("hour", "hour(ts)", 24)) for i, f in enumerate(("sin", "cos"))) + " FROM events")
def datetime_circular(spark, d):
    return features.circular_calendar(table(spark, d, "events"), "ts", "event_id")
