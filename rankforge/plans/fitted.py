"""Fitted features and calibration, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankforge.functions import grouping
from rankforge.operators import calibration
from rankforge.plans.registry import query
from rankforge.sources.derived import SCORES_SQL, scores, table

LINES_SQL = """lines AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey || '_' || l_returnflag AS g, l_quantity AS quantity, l_extendedprice AS price, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_discount END AS discount, l_linestatus AS status,
    (l_shipdate, l_orderkey, l_linenumber, l_partkey) AS o FROM lineitem),
  groups AS (SELECT g, count(*) AS n, avg(quantity) AS quantity_mean, stddev_samp(quantity) AS quantity_std, min(quantity) AS quantity_min, max(quantity) AS quantity_max, arg_max(quantity, o) AS quantity_last,
    avg(price) AS price_mean, stddev_samp(price) AS price_std, min(price) AS price_min, max(price) AS price_max, arg_max(price, o) AS price_last,
    avg(discount) AS discount_mean, stddev_samp(discount) AS discount_std, min(discount) AS discount_min, max(discount) AS discount_max, arg_max(discount, o) FILTER (WHERE discount IS NOT NULL) AS discount_last,
    count(status)::DOUBLE AS status_count, arg_max(status, o) AS status_word, count(DISTINCT status)::DOUBLE AS status_nunique FROM lines GROUP BY 1),
  coded AS (SELECT *, (dense_rank() OVER (ORDER BY status_word) - 1)::DOUBLE AS status_last FROM groups),
  feats AS (UNPIVOT (SELECT * EXCLUDE (status_word) FROM coded) ON COLUMNS(* EXCLUDE (g, n)) INTO NAME feature VALUE x),
  spread AS (SELECT feature, var_samp(x) AS variance FROM feats JOIN lines USING (g) GROUP BY 1)"""


def lines(spark, d):
    discount = F.when(F.col("l_linenumber") != 3, F.col("l_discount"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_shipdate", F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), discount.alias("discount"), F.col("l_linestatus").alias("status"))


KEYS = ["l_orderkey", "l_linenumber", "l_partkey"]


def fitted(rows, most):
    return grouping.fit_group_features(rows, ["l_suppkey", "l_returnflag"], ["l_shipdate", *KEYS], most, ignore=[*KEYS, "l_shipdate"])


@query("SELECT feature, round(variance, 4) AS variance FROM spread", LINES_SQL)
def group_feature_variances(spark, d):
    found = fitted(lines(spark, d), 50).variances
    return spark.createDataFrame(list(found.items()), "feature string, variance double").withColumn("variance", F.round("variance", 4))


@query("SELECT l_orderkey, l_linenumber, l_partkey, feature, round(x, 4) AS x FROM lines JOIN feats USING (g) WHERE feature IN (SELECT feature FROM spread ORDER BY variance DESC, feature LIMIT 7)", LINES_SQL)
def group_features_joined(spark, d):
    rows = lines(spark, d)
    found = fitted(rows, 7)
    out = found.transform(rows).select(*KEYS, *[F.col(c).cast("double").alias(c) for c in found.selected])
    return out.unpivot(KEYS, list(found.selected), "feature", "x").where("x is not null").withColumn("x", F.round("x", 4))


SPLIT_SQL = "sides AS (SELECT lang, doc_id, y, score, other, third, doc_id % 2 AS test FROM scores)"


def triples(spark, d):
    """Three scores as probabilities of three classes, which the number of characters picks."""
    total = F.col("score") + F.col("other") + F.col("third") + 0.3
    return scores(spark, d).select("lang", "doc_id", F.array(*[(F.col(c) + 0.1) / total for c in ("score", "other", "third")]).alias("p"), (F.floor(F.col("score") * 97) % 3).cast("int").alias("y"))


TRIPLES_SQL = """triples AS (SELECT lang, doc_id, [ln((score + 0.1) / t + 1e-10::DOUBLE), ln((other + 0.1) / t + 1e-10::DOUBLE), ln((third + 0.1) / t + 1e-10::DOUBLE)] AS z, floor(score * 97)::INT % 3 AS y
    FROM (SELECT *, score + other + third + 0.3 AS t FROM scores))"""


def slope_sql(at: str) -> str:
    """The gradient of the cross-entropy at an inverse temperature."""
    return f"avg(list_dot_product(z, list_transform(z, lambda x: exp({at} * x))) / list_sum(list_transform(z, lambda x: exp({at} * x))) - z[y + 1])"


@query("""SELECT lang, round(exp(low + 16.0::DOUBLE / pow(2, 30)), 9) AS invtemp FROM (WITH RECURSIVE b AS (SELECT lang, -16.0::DOUBLE AS low, 0 AS k FROM triples GROUP BY 1
    UNION ALL SELECT b.lang, CASE WHEN """ + slope_sql("exp(b.low + 16.0::DOUBLE / pow(2, b.k))") + """ <= 0 THEN b.low + 16.0::DOUBLE / pow(2, b.k) ELSE b.low END, b.k + 1 FROM b JOIN triples t ON t.lang = b.lang WHERE b.k < 30 GROUP BY b.lang, b.low, b.k)
  SELECT * FROM b WHERE k = 30)""", SCORES_SQL, TRIPLES_SQL)
def temperature_multiclass(spark, d):
    return calibration.temperatures(triples(spark, d), "lang")


@query("""SELECT lang, doc_id, i::INT AS class, round(exp(u * z[i + 1]) / list_sum(list_transform(z, lambda x: exp(u * x))), 9) AS p FROM triples JOIN (SELECT lang, 0.5::DOUBLE + count(*) % 3 AS u FROM triples WHERE lang <> 'de' GROUP BY 1) USING (lang), range(3) r(i)
  UNION ALL SELECT lang, doc_id, i::INT, round(exp(z[i + 1]) - 1e-10::DOUBLE, 9) FROM triples, range(3) r(i) WHERE lang = 'de'""", SCORES_SQL, TRIPLES_SQL)
def calibrated_probabilities(spark, d):
    rows = triples(spark, d)
    fits = rows.where("lang <> 'de'").groupBy("lang").agg((F.lit(0.5) + F.count(F.lit(1)) % 3).alias("invtemp"))
    return calibration.calibrated(rows, fits, "lang").select("lang", "doc_id", F.posexplode("p").alias("class", "p"))


def threshold_sql(value: str) -> str:
    return f"""SELECT lang, threshold, round(1 - ({value.replace("tp", "e.tp").replace("tn", "e.tn").replace("fp", "e.fp").replace("fn", "e.fn")}), 9) AS metric_error FROM (
      SELECT lang, score AS threshold, v FROM (SELECT lang, score, round({value}, 12) AS v FROM (SELECT lang, a.score, count(*) FILTER (WHERE s.score >= a.score AND y = 1) AS tp, count(*) FILTER (WHERE s.score >= a.score AND y <> 1) AS fp, count(*) FILTER (WHERE s.score < a.score AND y = 1) AS fn, count(*) FILTER (WHERE s.score < a.score AND y <> 1) AS tn
        FROM sides s JOIN (SELECT DISTINCT lang, score FROM sides WHERE test = 0) a USING (lang) WHERE test = 0 GROUP BY 1, 2)) QUALIFY row_number() OVER (PARTITION BY lang ORDER BY v DESC, abs(score - 0.5), score) = 1) b
    JOIN LATERAL (SELECT count(*) FILTER (WHERE s.score >= threshold AND y = 1) AS tp, count(*) FILTER (WHERE s.score >= threshold AND y <> 1) AS fp, count(*) FILTER (WHERE s.score < threshold AND y = 1) AS fn, count(*) FILTER (WHERE s.score < threshold AND y <> 1) AS tn FROM sides s WHERE s.lang = b.lang AND test = 1) e ON true"""


def at_best_threshold(spark, d, metric):
    rows = scores(spark, d)
    best = calibration.decision_thresholds(rows.where("doc_id % 2 = 0"), "lang", metric)
    return calibration.class_metric_at(rows.where("doc_id % 2 = 1"), best, "lang", metric).join(best.select("lang", "threshold"), "lang")


@query(threshold_sql("coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0)"), SCORES_SQL, SPLIT_SQL)
def threshold_f1(spark, d):
    return at_best_threshold(spark, d, "f1")


@query(threshold_sql("(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) + coalesce(tn::DOUBLE / nullif(tn + fp, 0), 0)) / 2"), SCORES_SQL, SPLIT_SQL)
def threshold_balanced_accuracy(spark, d):
    return at_best_threshold(spark, d, "balanced_accuracy")
