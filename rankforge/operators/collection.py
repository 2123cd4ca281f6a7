"""Sets of datasets, folds and methods, merges that check, and sums over them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shared_datasets(results: DataFrame, methods: Sequence[str], union: bool) -> DataFrame:
    """(dataset) that any of the methods has (union), or that all of them have."""
    rows = results.where(F.col("method").isin(list(methods)))
    have = rows.groupBy("dataset").agg(F.count_distinct("method").alias("k"))
    return have.where(F.lit(union) | (F.col("k") == len(set(methods)))).select("dataset")


def folds_of(results: DataFrame) -> DataFrame:
    """(dataset, folds): the folds of each dataset in order."""
    return results.groupBy("dataset").agg(F.sort_array(F.collect_set("fold")).alias("folds"))


def common_tasks(*frames: DataFrame) -> DataFrame:
    """(dataset, fold) that all frames have."""
    out = frames[0].select("dataset", "fold").distinct()
    for other in frames[1:]:
        out = out.intersect(other.select("dataset", "fold"))
    return out


def in_frame(results: DataFrame, tasks: DataFrame) -> DataFrame:
    """Results with `valid`: whether (dataset, fold) is among the tasks."""
    known = tasks.select("dataset", "fold").distinct().withColumn("_known", F.lit(True))
    return results.join(known, ["dataset", "fold"], "left").withColumn("valid", F.coalesce("_known", F.lit(False))).drop("_known")


def strict_merge(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """left with the columns of right; raises where columns of both differ for a key. Null equals null, right has one row a key."""
    shared = sorted(set(left.columns) & set(right.columns) - set(on))
    if shared:
        other = right.select(*on, *[F.col(c).alias(f"_{c}") for c in shared])
        differs = left.join(other, list(on)).agg(*[F.max((~F.col(c).eqNullSafe(F.col(f"_{c}"))).cast("int")).alias(c) for c in shared]).first()
        wrong = [c for c in shared if differs[c]]
        if wrong:
            raise ValueError(f"columns of both sides differ: {', '.join(wrong)}")
    return left.join(right.drop(*shared), list(on), "left")


def method_info(results: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(method, columns): the one value of each column that a method has, nulls aside; raises where a method has several."""
    rows = results.groupBy("method").agg(*[F.min(c).alias(c) for c in columns], *[F.count_distinct(c).alias(f"_{c}") for c in columns])
    most = rows.agg(*[F.max(f"_{c}").alias(c) for c in columns]).first()
    several = [c for c in columns if (most[c] or 0) > 1]
    if several:
        raise ValueError(f"methods have several values of {', '.join(several)}")
    return rows.select("method", *columns)


def weighted_mean(values: DataFrame, draws: DataFrame, value: str) -> DataFrame:
    """(round, method, mean): mean of a value over drawn datasets; draws: round, dataset, times. Undrawn datasets count nothing."""
    sizes = draws.groupBy("round").agg(F.sum("times").alias("_n"))
    rows = values.join(draws, "dataset").join(sizes, "round")
    return rows.groupBy("round", "method").agg(F.sum(F.col(value) * F.col("times") / F.col("_n")).alias("mean"))


def spread(results: DataFrame, value: str) -> DataFrame:
    """(method, mean, median, std) of a value."""
    return results.groupBy("method").agg(F.avg(value).alias("mean"), F.median(value).alias("median"), F.stddev_samp(value).alias("std"))


def per_thousand(results: DataFrame, sizes: DataFrame) -> DataFrame:
    """results with time_infer_s_per_1k: the time of a thousand rows of a dataset, sizes (dataset, n_test) being its test rows."""
    return results.join(sizes.select("dataset", "n_test"), "dataset").withColumn("time_infer_s_per_1k", F.try_divide(F.col("time_infer_s") * 1000, F.col("n_test"))).drop("n_test")


def pairwise_jitter(ranked: DataFrame) -> DataFrame:
    """(dataset, jitter): mean absolute change of a method's rank between two folds, over pairs of folds and methods with all folds."""
    folds = ranked.groupBy("dataset").agg(F.count_distinct("fold").alias("k"))
    whole = ranked.groupBy("dataset", "method").agg(F.count_distinct("fold").alias("k")).join(folds, ["dataset", "k"]).select("dataset", "method")
    rows = ranked.select("dataset", "method", "fold", "rank").join(whole, ["dataset", "method"], "left_semi")
    one, two = rows.withColumnsRenamed({"fold": "f1", "rank": "r1"}), rows.withColumnsRenamed({"fold": "f2", "rank": "r2"})
    return one.join(two, ["dataset", "method"]).where("f1 < f2").groupBy("dataset").agg(F.avg(F.abs(F.col("r1") - F.col("r2"))).alias("jitter"))


def similarity_order(stable: DataFrame) -> DataFrame:
    """Rows of fold_stability() with their place by rho, the most stable first; a row a dataset."""
    from pyspark.sql import Window

    return stable.withColumn("place", F.row_number().over(Window.orderBy(F.desc_nulls_last("rho"), "dataset")))
