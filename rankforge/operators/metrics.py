"""Prediction metrics as aggregates, and ensembles by lookup of stored predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankforge.sources.stored import stored


def auc(rows: DataFrame, key: str, y: str = "y", score: str = "score") -> DataFrame:
    """(key, auc) from rank sums; ties share ranks; null where one class is missing.

    Scores are counted per value before they are ranked, so a window sees distinct scores only.
    """
    counts = rows.groupBy(key, score).agg(F.sum(y).alias("p"), F.sum(1 - F.col(y)).alias("n"))
    below = F.coalesce(F.sum("n").over(Window.partitionBy(key).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pairs = counts.select(key, "p", "n", (F.col("p") * (below + F.col("n") / F.lit(2.0))).alias("won"))
    return pairs.groupBy(key).agg(F.try_divide(F.sum("won"), F.when(F.sum("p") * F.sum("n") > 0, (F.sum("p") * F.sum("n")).cast("double"))).alias("auc"))


def log_loss(y: str, p: str, clip: float = 1e-15) -> Column:
    """Mean binary log loss, with probabilities kept off 0 and 1."""
    q = F.least(F.greatest(F.col(p), F.lit(clip)), F.lit(1 - clip))
    return -F.avg(F.when(F.col(y) == 1, F.log(q)).otherwise(F.log(1 - q)))


def rmse(y: str, p: str) -> Column:
    return F.sqrt(F.avg((F.col(y) - F.col(p)) * (F.col(y) - F.col(p))))


def capture_and_gini(rows: DataFrame, key: str, tie: str, y: str = "y", score: str = "score") -> DataFrame:
    """(key, amex): half the share of positives in the top 4 % of weight plus half the normalised weighted Gini; negatives weigh 20.

    Rows are dealt to ranges of (key, score, tie), written to the shared folder so that both readings see the same ones. Running sums start
    anew in each range, and a range is offset by the totals of those before it; no task holds a key whole. The best order, all
    positives first, needs their counts only.
    """
    order = [F.desc("_s"), F.col("_t")]
    weight = F.when(F.col(y) == 1, 1.0).otherwise(20.0)
    ranged = rows.select(F.col(key).alias("_k"), F.col(score).alias("_s"), F.col(tie).alias("_t"), F.col(y).cast("double").alias("_y"), weight.alias("_w"))
    ranged = ranged.repartitionByRange("_k", *order).withColumn("_r", F.spark_partition_id())
    ranged = stored(ranged, "ranges")
    sums = ranged.groupBy("_k", "_r").agg(F.sum("_w").alias("_rw"), F.coalesce(F.sum("_y"), F.lit(0.0)).alias("_ry"), F.count_if(F.col("_y") == 1).alias("_rp"), F.count(F.lit(1)).alias("_rn"))
    before, whole = Window.partitionBy("_k").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("_k")
    totals = {"_tw": "_rw", "_ty": "_ry", "_p": "_rp", "_n": "_rn"}
    offsets = sums.select("_k", "_r", *[F.coalesce(F.sum(c).over(before), F.lit(0.0)).alias(n) for n, c in (("_bw", "_rw"), ("_by", "_ry"))], *[F.sum(c).over(whole).alias(n) for n, c in totals.items()])
    w = Window.partitionBy("_k", "_r").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.select("_k", "_r", "_y", "_w", F.sum("_w").over(w).alias("_lw"), F.coalesce(F.sum("_y").over(w), F.lit(0.0)).alias("_ly"))
    r = local.join(F.broadcast(offsets), ["_k", "_r"]).select("*", (F.col("_bw") + F.col("_lw")).alias("_cw"), (F.col("_by") + F.col("_ly")).alias("_cy"))
    lorentz = F.try_divide(F.col("_cy"), F.when(F.col("_ty") > 0, F.col("_ty")))
    top = F.sum(F.when((F.col("_cw") <= F.floor(0.04 * F.col("_tw"))) & (F.col("_y") == 1), 1.0).otherwise(0.0))
    ours = r.groupBy("_k").agg(F.sum((lorentz - F.col("_cw") / F.col("_tw")) * F.col("_w")).alias("_g"), top.alias("_top"), *[F.first(c).alias(c) for c in totals])
    # Over the best order: positives, of weight 1, then negatives, of weight 20, after which the share of positives is 1.
    p, n, tw = F.col("_p").cast("double"), (F.col("_n") - F.col("_p")).cast("double"), F.col("_tw")
    best = F.when(p > 0, p * (p + 1) / 2 * (1 / p - 1 / tw) + 20 * (n - (p * n + 10 * n * (n + 1)) / tw))
    share = F.try_divide(F.col("_top"), F.when(F.col("_ty") > 0, F.col("_ty")))
    return ours.where("_k is not null").select(F.col("_k").alias(key), (F.lit(0.5) * (F.try_divide(F.col("_g"), F.when(best != 0, best)) + share)).alias("amex"))


def single_best(configs: DataFrame) -> DataFrame:
    """(dataset, fold, config, metric_error): the config of the lowest validation error, the first name among equals."""
    w = Window.partitionBy("dataset", "fold").orderBy("metric_error_val", "config")
    return configs.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("dataset", "fold", "config", "metric_error")


def top_per_family(configs: DataFrame, each: int, total: int) -> DataFrame:
    """(dataset, fold, config, place): at most `each` configs of a family and `total` of a task, by validation error and name."""
    order = ["metric_error_val", "config"]
    some = configs.withColumn("_n", F.row_number().over(Window.partitionBy("dataset", "fold", "family").orderBy(*order))).where(F.col("_n") <= each)
    placed = some.withColumn("place", F.row_number().over(Window.partitionBy("dataset", "fold").orderBy(*order)))
    return placed.where(F.col("place") <= total).select("dataset", "fold", "config", "place")


def within_runtime(configs: DataFrame, budget: float) -> DataFrame:
    """The first configs of each task, by name, whose summed training time stays under the budget."""
    w = Window.partitionBy("dataset", "fold").orderBy("config").rowsBetween(Window.unboundedPreceding, 0)
    return configs.withColumn("cumulative_time", F.sum("time_train_s").over(w)).where(F.col("cumulative_time") < budget).select("dataset", "fold", "config", "cumulative_time")


def runtime_quantile(configs: DataFrame, q: float) -> DataFrame:
    """(config, runtime): a quantile over datasets of the mean training time."""
    return configs.groupBy("config", "dataset").agg(F.avg("time_train_s").alias("t")).groupBy("config").agg(F.percentile("t", q).alias("runtime"))


def pareto(points: DataFrame, x: str, y: str) -> DataFrame:
    """Points that no cheaper point (smaller x) beats in y (higher is better); ties stay.

    Only the best y of each x can be on the frontier, so the running maximum sees one row a distinct x.
    """
    best = points.groupBy(x).agg(F.max(y).alias("_best"))
    before = F.max("_best").over(Window.orderBy(x).rowsBetween(Window.unboundedPreceding, -1))
    front = best.withColumn("_before", before).where("_before is null or _best >= _before")
    return points.join(front.select(x, F.col("_best").alias(y)), [x, y], "left_semi").select(*points.columns)
