"""Task grids, jobs, splits of rows, and simulated tuning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def split_grid(tasks: DataFrame, folds: int, repeats: int) -> DataFrame:
    """(dataset, repeat, fold, split, label): every split of every dataset; split = folds * repeat + fold, label r<repeat>f<fold>."""
    grid = tasks.select("dataset", F.explode(F.sequence(F.lit(0), F.lit(folds * repeats - 1))).alias("split"))
    grid = grid.withColumn("repeat", F.floor(F.col("split") / folds).cast("int")).withColumn("fold", F.col("split") % folds)
    return grid.select("dataset", "repeat", "fold", "split", F.concat(F.lit("r"), "repeat", F.lit("f"), "fold").alias("label"))


def jobs(experiments: DataFrame, tasks: DataFrame) -> DataFrame:
    """(experiment, dataset) of all pairs whose constraints hold: most rows, most features, and support of regression.

    experiments is a configuration, as small as its author wrote it.
    """
    e = F.broadcast(experiments)
    fits = (F.col("n_train") <= F.coalesce("max_rows", "n_train")) & (F.col("n_features") <= F.coalesce("max_features", "n_features")) & (F.col("regression") | (F.col("problem_type") != "regression"))
    return tasks.join(e, fits).select("experiment", "dataset")


def ranked_in_class(rows: DataFrame, key: str, label: str) -> DataFrame:
    """Adds place: the row's number from 0 within its class in the order of the md5 of its key.

    Places are counted in 256 parts of the order and then added up, so that a large class is many tasks' work.
    """
    digest = F.md5(F.col(key).cast("string"))
    parts = rows.withColumn("_d", digest).withColumn("_b", F.substring("_d", 1, 2))
    before = Window.partitionBy(label).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.groupBy(label, "_b").agg(F.count(F.lit(1)).alias("_n")).withColumn("_o", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    numbered = parts.withColumn("_r", F.row_number().over(Window.partitionBy(label, "_b").orderBy("_d")) - 1)
    return numbered.join(offsets, [label, "_b"]).withColumn("place", F.col("_r") + F.col("_o")).select(*rows.columns, "place")


def stratified_folds(rows: DataFrame, key: str, label: str, folds: int) -> DataFrame:
    """Adds fold: each class is dealt evenly."""
    return ranked_in_class(rows, key, label).withColumn("fold", (F.col("place") % folds).cast("int")).drop("place")


def group_folds(rows: DataFrame, group: str, folds: int) -> DataFrame:
    """Adds fold: rows of a group stay together."""
    return rows.withColumn("fold", (F.conv(F.substring(F.md5(F.col(group).cast("string")), 1, 8), 16, 10).cast("long") % folds).cast("int"))


def temporal_holdout(rows: DataFrame, ts: str, share: float = 0.2) -> DataFrame:
    """Adds held_out: the last days that hold at most this share of all rows."""
    days = rows.groupBy(F.to_date(ts).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    # A row a day.
    later = F.sum("n").over(Window.orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, 0))
    late = days.withColumn("later", later).withColumn("total", F.sum("n").over(Window.partitionBy(F.lit(0)))).select("day", (F.col("later") <= share * F.col("total")).alias("held_out"))
    return rows.withColumn("day", F.to_date(ts)).join(late, "day").drop("day")


def tuning_trajectory(configs: DataFrame, sizes: list[int]) -> DataFrame:
    """(n_configs, family, metric_error): the mean test error of the config of the lowest validation error among the first n of a family."""
    order = Window.partitionBy("dataset", "fold", "family").orderBy("config")
    placed = configs.withColumn("_n", F.row_number().over(order))
    some = placed.withColumn("n_configs", F.explode(F.array(*map(F.lit, sizes)))).where("_n <= n_configs")
    best = some.groupBy("n_configs", "family", "dataset", "fold").agg(F.min(F.struct("metric_error_val", "config", "metric_error")).getField("metric_error").alias("e"))
    return best.groupBy("n_configs", "family", "dataset").agg(F.avg("e").alias("e")).groupBy("n_configs", "family").agg(F.avg("e").alias("metric_error"))


def top_k_average(predictions: DataFrame, k: int) -> DataFrame:
    """(key, rmse) of the mean prediction of the k configs of the lowest squared error. predictions: key, row_id, config, p, y."""
    d = F.col("p") - F.col("y")
    errors = predictions.groupBy("key", "config").agg(F.avg(d * d).alias("_e"))
    chosen = errors.withColumn("_n", F.row_number().over(Window.partitionBy("key").orderBy("_e", "config"))).where(F.col("_n") <= k).select("key", "config")
    mixed = predictions.join(chosen, ["key", "config"]).groupBy("key", "row_id").agg(F.avg("p").alias("p"), F.first("y").alias("y"))
    return mixed.groupBy("key").agg(F.sqrt(F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y")))).alias("rmse"))
