"""Means over tasks, win rates, battles and leaderboards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankforge.operators import pertask
from rankforge.sources.stored import stored


def equal_task_mean(rows: DataFrame, *values: str, by: str = "method") -> DataFrame:
    """Mean of values over folds within a dataset, then over datasets, so that each dataset counts the same."""
    inner = rows.groupBy(by, "dataset").agg(*[F.avg(v).alias(v) for v in values])
    return inner.groupBy(by).agg(*[F.avg(v).alias(v) for v in values])


def mean_and_median(rows: DataFrame, *values: str) -> DataFrame:
    """Mean and median over datasets of the means over folds."""
    inner = rows.groupBy("method", "dataset").agg(*[F.avg(v).alias(v) for v in values])
    return inner.groupBy("method").agg(*[F.avg(v).alias(v) for v in values], *[F.median(v).alias(f"median_{v}") for v in values])


def skill_score(rows: DataFrame) -> DataFrame:
    """(method, relative_error_mean, relative_error_gmean, skill_score) of rows with relative_error, datasets equal.

    A dataset of relative error 0 makes the geometric mean 0, an infinite one infinite.
    """
    means = rows.groupBy("method", "dataset").agg(F.avg("relative_error").alias("r"))
    gmean = F.when(F.min("r") == 0, 0.0).otherwise(F.exp(F.avg(F.log(F.when(F.col("r") > 0, F.col("r"))))))
    out = means.groupBy("method").agg(F.avg("r").alias("relative_error_mean"), gmean.alias("relative_error_gmean"))
    return out.withColumn("skill_score", 1 - F.col("relative_error_gmean"))


def winrate_matrix(results: DataFrame) -> DataFrame:
    """(method_1, method_2, winrate): share of tasks that method_1 wins, ties half, folds averaged within a dataset.

    The join is by task; a task has as many pairs as the square of its methods, as the matrix itself has.
    """
    a = results.select("dataset", "fold", F.col("method").alias("method_1"), F.col("metric_error").alias("e1"))
    b = results.select("dataset", "fold", F.col("method").alias("method_2"), F.col("metric_error").alias("e2"))
    pairs = a.join(b, ["dataset", "fold"]).where("method_1 <> method_2")
    won = F.when(F.col("e1") < F.col("e2"), 1.0).when(F.col("e1") == F.col("e2"), 0.5).otherwise(0.0)
    folds = results.groupBy("dataset").agg(F.count_distinct("fold").alias("folds"))
    inner = pairs.groupBy("dataset", "method_1", "method_2").agg(F.sum(won).alias("won"), F.count(F.lit(1)).alias("n")).join(folds, "dataset")
    return inner.groupBy("method_1", "method_2").agg((F.sum(F.col("won") / F.col("folds")) / F.sum(F.col("n") / F.col("folds"))).alias("winrate"))


def winrate(results: DataFrame) -> DataFrame:
    """(method, winrate): mean of a method's row of the matrix."""
    return winrate_matrix(results).groupBy(F.col("method_1").alias("method")).agg(F.avg("winrate").alias("winrate"))


def dense(results: DataFrame) -> bool:
    """Whether every method has every task: as many rows as methods times tasks, none of them twice."""
    n, methods, tasks, cells = results.agg(F.count(F.lit(1)), F.count_distinct("method"), F.count_distinct("dataset", "fold"), F.count_distinct("method", "dataset", "fold")).first()
    return n == cells == methods * tasks


def winrate_from_ranks(ranked: DataFrame) -> DataFrame:
    """The same without any pair, 1 - (mean rank - 1) / (methods - 1), which holds on dense results; others go by pairs."""
    ranked = stored(ranked.select("method", "dataset", "fold", "metric_error", "rank"), "ranked")
    if not dense(ranked):
        return winrate(ranked)
    sizes = ranked.groupBy("dataset", "fold").agg(F.count(F.lit(1)).alias("m"))
    share = ranked.join(sizes, ["dataset", "fold"]).select("method", "dataset", F.coalesce(F.try_divide(F.col("rank") - 1, F.col("m") - 1), F.lit(0.5)).alias("lost"))
    return equal_task_mean(share, "lost").select("method", (1 - F.col("lost")).alias("winrate"))


def battles(results: DataFrame) -> DataFrame:
    """(method_1, method_2, dataset, fold, winner, weight) of each pair on each task; a dataset's battles weigh 1 together."""
    a = results.select("dataset", "fold", F.col("method").alias("method_1"), F.col("metric_error").alias("e1"))
    b = results.select("dataset", "fold", F.col("method").alias("method_2"), F.col("metric_error").alias("e2"))
    folds = results.groupBy("dataset").agg(F.count_distinct("fold").alias("folds"))
    pairs = a.join(b, ["dataset", "fold"]).where("method_1 < method_2").join(folds, "dataset")
    winner = F.when(F.col("e1") < F.col("e2"), "1").when(F.col("e1") > F.col("e2"), "2").otherwise("tie")
    return pairs.select("method_1", "method_2", "dataset", "fold", winner.alias("winner"), (F.lit(1.0) / F.col("folds")).alias("weight"))


def battle_winrate(fights: DataFrame) -> DataFrame:
    """(method, battles, winrate): share of battles won, ties half."""
    half = F.when(F.col("winner") == "tie", 0.5)
    sides = fights.select(F.col("method_1").alias("method"), half.when(F.col("winner") == "1", 1.0).otherwise(0.0).alias("w"))
    sides = sides.unionByName(fights.select(F.col("method_2").alias("method"), half.when(F.col("winner") == "2", 1.0).otherwise(0.0).alias("w")))
    return sides.groupBy("method").agg(F.count(F.lit(1)).alias("battles"), F.avg("w").alias("winrate"))


def pair_statistics(fights: DataFrame, *keys: str) -> DataFrame:
    """(keys, method_1, method_2, s1, s2): weighted wins of either side, ties half each."""
    first = F.when(F.col("winner") == "1", F.col("weight")).when(F.col("winner") == "tie", F.col("weight") / 2).otherwise(0.0)
    second = F.when(F.col("winner") == "2", F.col("weight")).when(F.col("winner") == "tie", F.col("weight") / 2).otherwise(0.0)
    return fights.groupBy(*keys, "method_1", "method_2").agg(F.sum(first).alias("s1"), F.sum(second).alias("s2"))


def leaderboard(results: DataFrame) -> DataFrame:
    """One row a method: mean rank, win rate, improvability, MRR, rescaled loss, frontier advantage and the places it takes."""
    results = stored(results, "results")
    ranked = pertask.per_task(results).withColumn("mrr", F.lit(1.0) / F.col("rank"))
    means = equal_task_mean(ranked, "rank", "improvability", "loss_rescaled", "frontier_advantage", "mrr", "metric_error")
    return means.join(winrate(results), "method").join(pertask.rank_counts(ranked), "method")
