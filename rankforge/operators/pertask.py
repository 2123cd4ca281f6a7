"""Measures of each method within a task (dataset, fold): ranks, regret and margins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TASK = ("dataset", "fold")


def over(*keys: str) -> Window:
    return Window.partitionBy(*keys)


def average_rank(error: Column, keys: tuple[str, ...] = TASK) -> Column:
    """Rank of an error within a task, ascending; ties share the mean of their places."""
    return F.rank().over(over(*keys).orderBy(error)) + (F.count(F.lit(1)).over(over(*keys, "metric_error")) - 1) / F.lit(2.0)


def ratio(top: Column, bottom: Column, empty: float = 0.0) -> Column:
    """top / bottom, and `empty` where bottom is 0."""
    return F.coalesce(F.try_divide(top, F.when(bottom != 0, bottom)), F.lit(empty))


def per_task(results: DataFrame, keys: tuple[str, ...] = TASK) -> DataFrame:
    """Adds rank, improvability, loss_rescaled and frontier_advantage.

    improvability: 1 - best/error. loss_rescaled: (error - best) / (worst - best). frontier_advantage: signed margin over the best of
    the others, as a share of the larger error. Each is 0 where its denominator is 0, the last also where there are no others.
    """
    e, w = F.col("metric_error"), over(*keys)
    # The best error of the others is the best of all, but for a single best method, whose rival is the second.
    with_best = results.withColumn("_low", F.min(e).over(w)).withColumn("_high", F.max(e).over(w))
    with_best = with_best.withColumn("_second", F.min(F.when(e > F.col("_low"), e)).over(w)).withColumn("_lows", F.sum((e == F.col("_low")).cast("int")).over(w))
    rival = F.when((e == F.col("_low")) & (F.col("_lows") == 1), F.col("_second")).otherwise(F.col("_low"))
    return with_best.select(
        *results.columns,
        average_rank(e, keys).alias("rank"),
        F.when(e == 0, 0.0).otherwise(1 - ratio(F.col("_low"), e)).alias("improvability"),
        ratio(e - F.col("_low"), F.col("_high") - F.col("_low")).alias("loss_rescaled"),
        F.coalesce(ratio(rival - e, F.greatest(rival, e)), F.lit(0.0)).alias("frontier_advantage"),
    )


def against_baseline(results: DataFrame, baseline: str, keys: tuple[str, ...] = TASK) -> DataFrame:
    """Adds relative_error (error / baseline's; infinite where only that is 0, 1 where both are) and baseline_advantage."""
    e = F.col("metric_error")
    b = F.max(F.when(F.col("method") == baseline, e)).over(over(*keys))
    relative = F.when((e == 0) & (F.col("_b") == 0), 1.0).when(F.col("_b") == 0, F.lit(float("inf"))).otherwise(F.try_divide(e, F.when(F.col("_b") != 0, F.col("_b"))))
    return results.withColumn("_b", b).select(*results.columns, relative.alias("relative_error"), ratio(F.col("_b") - e, F.greatest(F.col("_b"), e)).alias("baseline_advantage"))


def rank_counts(ranked: DataFrame) -> DataFrame:
    """(method, rank_1, rank_2, rank_3, rank_more): how often a method takes each place; a tie over places splits one unit."""
    w = Window.partitionBy(*TASK).orderBy("rank")
    low = F.rank().over(w)
    ties = F.count(F.lit(1)).over(over(*TASK, "rank"))
    rows = ranked.select("method", *TASK, low.alias("low"), ties.alias("ties"))
    share = [F.when((F.col("low") <= k) & (F.col("low") + F.col("ties") - 1 >= k), F.lit(1.0) / F.col("ties")).otherwise(0.0) for k in (1, 2, 3)]
    rows = rows.select("method", *TASK, *[s.alias(f"rank_{k}") for k, s in enumerate(share, 1)])
    rows = rows.withColumn("rank_more", 1 - F.col("rank_1") - F.col("rank_2") - F.col("rank_3"))
    names = ["rank_1", "rank_2", "rank_3", "rank_more"]
    mean = rows.groupBy("method", "dataset").agg(*[F.avg(c).alias(c) for c in names])
    return mean.groupBy("method").agg(*[F.sum(c).alias(c) for c in names])


def normalised_error(results: DataFrame, keys: tuple[str, ...] = TASK) -> DataFrame:
    """Adds normalized_error: (error - best) / (median - best) of the task, within 0 and 1."""
    e = F.col("metric_error")
    bounds = results.groupBy(*keys).agg(F.min(e).alias("_low"), F.median(e).alias("_mid"))
    span = F.greatest(F.col("_mid") - F.col("_low"), F.lit(1e-5))
    return results.join(bounds, list(keys)).select(*results.columns, F.least(F.greatest((e - F.col("_low")) / span, F.lit(0.0)), F.lit(1.0)).alias("normalized_error"))
