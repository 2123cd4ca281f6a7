"""Curves over resampled orders and folds. Draws are hashes of a seed and their place, the same on any engine and after a lost task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankforge.sources.stored import stored


def drawn(*parts: Column) -> Column:
    """A whole number below 2^32 for these parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long")


def resampled_trajectories(configs: DataFrame, seeds: int = 20) -> DataFrame:
    """(family, n_configs, metric_error, metric_error_std, improvability, improvability_std): tuning over random orders of configs.

    configs (dataset, fold, family, config, metric_error_val, metric_error). A seed orders the configs of a family, the same in all
    tasks. After n of them the one of the lowest validation error is in use, the first name among equals. Improvability is the
    percentage by which the best error that any trajectory has on the task lies below. Errors are averaged over folds, then over the
    datasets in which the family has n configs; means and sample deviations are over seeds.
    """
    each = configs.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))))
    order = Window.partitionBy("seed", "dataset", "fold", "family").orderBy(drawn(F.col("seed"), F.col("config")), "config")
    best = F.min(F.struct("metric_error_val", "config", "metric_error")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    steps = each.select("seed", "dataset", "fold", "family", F.row_number().over(order).alias("n_configs"), best.getField("metric_error").alias("e"))
    low = F.min("e").over(Window.partitionBy("dataset", "fold"))
    steps = steps.withColumn("i", F.when(F.col("e") == 0, 0.0).otherwise(100 * (1 - F.try_divide(low, F.col("e")))))
    inner = steps.groupBy("seed", "family", "n_configs", "dataset").agg(F.avg("e").alias("e"), F.avg("i").alias("i"))
    outer = inner.groupBy("seed", "family", "n_configs").agg(F.avg("e").alias("e"), F.avg("i").alias("i"))
    return outer.groupBy("family", "n_configs").agg(F.avg("e").alias("metric_error"), F.stddev_samp("e").alias("metric_error_std"), F.avg("i").alias("improvability"), F.stddev_samp("i").alias("improvability_std"))


def jitter_curve(ranked: DataFrame, rounds: int = 100, seed: int = 0, metric: str = "winrate") -> DataFrame:
    """(dataset, k, n_folds, n_methods, jitter_mean, jitter_p50, jitter_p025, jitter_p975): how far means over k drawn folds stray.

    ranked (dataset, fold, method, rank). Methods that miss a fold are left out; datasets with fewer than two others have no rows. A
    round draws k folds with replacement and averages, over methods, the distance of their mean score from that of all folds; k goes
    from 1 to the number of folds. `winrate` scores 1 - (rank - 1) / (methods - 1), `rank` the rank itself. A dataset is one row with
    its folds x methods matrix, which the benchmark fixes; draws are exploded beside it, so nothing is joined.
    """
    if metric not in ("winrate", "rank"):
        raise ValueError(f"metric must be 'winrate' or 'rank', not {metric!r}")
    ranked = stored(ranked.select("dataset", "fold", "method", "rank"), "ranked")
    folds = ranked.groupBy("dataset").agg(F.sort_array(F.collect_set("fold")).alias("folds"))
    by_method = ranked.groupBy("dataset", "method").agg(F.sort_array(F.collect_list(F.struct("fold", "rank"))).alias("r"), F.count_distinct("fold").alias("own"))
    whole = by_method.join(folds, "dataset").where(F.col("own") == F.size("folds"))
    packed = whole.groupBy("dataset").agg(F.sort_array(F.collect_list(F.struct("method", F.transform("r", lambda x: x["rank"]).alias("s")))).alias("m"), F.size(F.first("folds")).alias("f"))
    packed = packed.where(F.size("m") > 1).withColumn("n", F.size("m"))

    def score(rank: Column) -> Column:
        return 1 - (rank - 1) / (F.col("n") - 1) if metric == "winrate" else rank

    def mean(scores: Column, size: Column) -> Column:
        return F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / size

    packed = packed.select("dataset", "f", "n", F.transform("m", lambda m: F.transform(m["s"], score)).alias("scores"))
    packed = packed.withColumn("means", F.transform("scores", lambda s: mean(s, F.col("f"))))
    draws = packed.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("f")))).withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    picks = F.transform(F.sequence(F.lit(1), F.col("k")), lambda j: (drawn(F.lit(seed), F.col("f"), F.col("k"), F.col("round"), j) % F.col("f")).cast("int"))
    draws = draws.withColumn("picks", picks)
    far = F.zip_with("scores", "means", lambda s, m: F.abs(mean(F.transform("picks", lambda p: F.get(s, p)), F.col("k")) - m))
    jitter = draws.select("dataset", "k", "f", "n", mean(far, F.col("n")).alias("j"))
    return jitter.groupBy("dataset", "k").agg(
        F.first("f").cast("long").alias("n_folds"), F.first("n").cast("long").alias("n_methods"), F.avg("j").alias("jitter_mean"),
        *[F.percentile("j", q).alias(f"jitter_{name}") for name, q in (("p50", 0.5), ("p025", 0.025), ("p975", 0.975))],
    )
