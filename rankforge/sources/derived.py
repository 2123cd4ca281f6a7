"""Views over the star schema that have the shape of benchmark results, task metadata, labels and predictions.

Errors are ratios of integer sums, so that ties are the same on any engine and in any order of summation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESULTS_SQL = """results AS (
  SELECT p_brand AS method, r_name AS dataset, CAST(l_linenumber % 3 AS INT) AS fold,
    CAST(sum(CAST(round(l_discount * 100) AS BIGINT) + CAST(round(l_tax * 100) AS BIGINT)) AS DOUBLE) / (100 * count(*)) AS metric_error,
    CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS time_train_s,
    CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / (100000 * count(*)) AS time_infer_s, count(*) AS n
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3)"""

WIDE_SQL = RESULTS_SQL.replace("results AS", "wide AS").replace("r_name AS dataset", "n_name AS dataset").replace("l_linenumber % 3", "l_linenumber % 2").replace(" JOIN region ON n_regionkey = r_regionkey", "")

TASKS_SQL = """tasks AS (
  SELECT n_name AS dataset, CASE n_regionkey % 3 WHEN 0 THEN 'binary' WHEN 1 THEN 'multiclass' ELSE 'regression' END AS problem_type,
    count(*) * 500 AS n_train, CAST(count(*) AS BIGINT) AS n_features
  FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2)"""

SCORES_SQL = """scores AS (
  SELECT doc_id, lang, quality AS y, CAST(n_chars % 97 AS DOUBLE) / 97 AS score, CAST(doc_id % 89 AS DOUBLE) / 89 AS other,
    CAST((n_chars + doc_id) % 83 AS DOUBLE) / 83 AS third FROM labels JOIN documents USING (doc_id))"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def results(spark: SparkSession, sf_dir: str, wide: bool = False) -> DataFrame:
    """(method, dataset, fold, metric_error, time_train_s, time_infer_s, n): brands on regions (or nations) as methods on datasets."""
    suppliers = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    name = "n_name"
    if not wide:
        suppliers = suppliers.join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        name = "r_name"
    lines = table(spark, sf_dir, "lineitem").select(
        "l_partkey", "l_suppkey", (F.col("l_linenumber") % (2 if wide else 3)).cast("int").alias("fold"),
        (F.round(F.col("l_discount") * 100).cast("long") + F.round(F.col("l_tax") * 100).cast("long")).alias("e"),
        F.col("l_quantity").cast("long").alias("q"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("p"),
    )
    # The fact table is summed by its own keys first: what the joins see is a row a (part, supplier, fold).
    summed = lines.groupBy("l_partkey", "l_suppkey", "fold").agg(F.sum("e").alias("e"), F.sum("q").alias("q"), F.sum("p").alias("p"), F.count(F.lit(1)).alias("n"))
    joined = summed.join(suppliers.select("s_suppkey", F.col(name).alias("dataset")), F.col("l_suppkey") == F.col("s_suppkey"))
    joined = joined.join(table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("method")), F.col("l_partkey") == F.col("p_partkey"))
    totals = joined.groupBy("method", "dataset", "fold").agg(*[F.sum(c).alias(c) for c in "eqpn"])
    return totals.select("method", "dataset", "fold", (F.col("e").cast("double") / (100 * F.col("n"))).alias("metric_error"), F.col("q").cast("double").alias("time_train_s"), (F.col("p").cast("double") / (100000 * F.col("n"))).alias("time_infer_s"), "n")


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dataset, problem_type, n_train, n_features): nations as datasets."""
    customers = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n_features"))
    nations = table(spark, sf_dir, "nation").join(customers, F.col("c_nationkey") == F.col("n_nationkey"))
    kind = F.when(F.col("n_regionkey") % 3 == 0, "binary").when(F.col("n_regionkey") % 3 == 1, "multiclass").otherwise("regression")
    return nations.select(F.col("n_name").alias("dataset"), kind.alias("problem_type"), (F.col("n_features") * 500).alias("n_train"), "n_features")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, y, score, other, third): quality labels and three deterministic scores as models' predictions."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    rows = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y")).join(docs, "doc_id")
    n, i = F.col("n_chars"), F.col("doc_id")
    return rows.select("doc_id", "lang", "y", ((n % 97).cast("double") / 97).alias("score"), ((i % 89).cast("double") / 89).alias("other"), (((n + i) % 83).cast("double") / 83).alias("third"))
