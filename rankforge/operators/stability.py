"""How stable orderings are over folds and datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def correlation(x: str, y: str) -> Column:
    """Pearson correlation from sums; null where either side is constant."""
    n, a, b = F.count(F.lit(1)), F.col(x), F.col(y)
    cov = n * F.sum(a * b) - F.sum(a) * F.sum(b)
    va, vb = n * F.sum(a * a) - F.sum(a) * F.sum(a), n * F.sum(b * b) - F.sum(b) * F.sum(b)
    spread = F.sqrt(F.when((va > 1e-12) & (vb > 1e-12), va * vb))
    return F.try_divide(cov, spread)


def fold_similarity(rows: DataFrame, value: str, spearman: bool = False) -> DataFrame:
    """(dataset, fold_1, fold_2, similarity): correlation over methods of a value in two folds, or of its ranks."""
    v = F.col(value)
    if spearman:
        w = Window.partitionBy("dataset", "fold")
        v = F.rank().over(w.orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy("dataset", "fold", value)) - 1) / F.lit(2.0)
    one = rows.select("dataset", "method", F.col("fold").alias("fold_1"), v.alias("x"))
    two = one.select("dataset", "method", F.col("fold_1").alias("fold_2"), F.col("x").alias("y"))
    return one.join(two, ["dataset", "method"]).where("fold_1 < fold_2").groupBy("dataset", "fold_1", "fold_2").agg(correlation("x", "y").alias("similarity"))


def fold_stability(similar: DataFrame, folds: DataFrame, target: float = 0.95, cap: int = 200) -> DataFrame:
    """(dataset, rho, folds, reliability, folds_needed) by the Spearman-Brown formula from the mean correlation of two folds."""
    rho = F.greatest(F.col("rho"), F.lit(0.01))
    rows = similar.groupBy("dataset").agg(F.avg("similarity").alias("rho")).join(folds.groupBy("dataset").agg(F.count_distinct("fold").alias("folds")), "dataset")
    reliability = F.col("folds") * rho / (1 + (F.col("folds") - 1) * rho)
    needed = F.ceil(F.try_divide(target * (1 - rho), rho * (1 - target)))
    return rows.select("dataset", "rho", "folds", reliability.alias("reliability"), F.least(F.greatest(needed, F.lit(1)), F.lit(cap)).cast("long").alias("folds_needed"))


def jitter(ranked: DataFrame) -> DataFrame:
    """(dataset, jitter): mean absolute deviation of a method's fold score, 1 - (rank - 1) / (methods - 1), from its mean.

    Methods that lack a fold of a dataset are dropped first; methods counts those that are left.
    """
    rows = ranked.select("dataset", "fold", "method", "rank")
    folds = rows.groupBy("dataset").agg(F.count_distinct("fold").alias("k"))
    whole = rows.groupBy("dataset", "method").agg(F.count_distinct("fold").alias("k")).join(folds, ["dataset", "k"]).select("dataset", "method")
    sizes = whole.groupBy("dataset").agg(F.count(F.lit(1)).alias("m"))
    scored = rows.join(whole, ["dataset", "method"]).join(sizes, "dataset").withColumn("s", 1 - F.try_divide(F.col("rank") - 1, F.col("m") - 1))
    spread = scored.withColumn("d", F.abs(F.col("s") - F.avg("s").over(Window.partitionBy("dataset", "method"))))
    return spread.groupBy("dataset").agg(F.avg("d").alias("jitter"))


def representativeness(rows: DataFrame, value: str) -> DataFrame:
    """(dataset, representativeness): correlation of a dataset's values with the methods' means over the other datasets."""
    by = rows.groupBy("dataset", "method").agg(F.avg(value).alias("x"))
    w = Window.partitionBy("method")
    others = by.select("dataset", "x", F.try_divide(F.sum("x").over(w) - F.col("x"), F.count(F.lit(1)).over(w) - 1).alias("y"))
    return others.where("y is not null").groupBy("dataset").agg(correlation("x", "y").alias("representativeness"))


def split_agreement(results: DataFrame, ties: str = "half") -> DataFrame:
    """(dataset, agreement): mean over pairs of methods of max(p, 1 - p), p the share of folds that the first wins.

    ties: "half" counts one as half a win, "ignore" leaves it out, "disagree" counts it for neither side.
    """
    a = results.select("dataset", "fold", F.col("method").alias("m1"), F.col("metric_error").alias("e1"))
    b = results.select("dataset", "fold", F.col("method").alias("m2"), F.col("metric_error").alias("e2"))
    pairs = a.join(b, ["dataset", "fold"]).where("m1 < m2")
    won, tied = (F.col("e1") < F.col("e2")).cast("double"), (F.col("e1") == F.col("e2")).cast("double")
    sums = pairs.groupBy("dataset", "m1", "m2").agg(F.sum(won).alias("w"), F.sum(tied).alias("t"), F.count(F.lit(1)).alias("n"))
    if ties == "disagree":
        best = F.greatest("w", F.col("n") - F.col("w") - F.col("t")) / F.col("n")
    else:
        p = F.try_divide(F.col("w"), F.col("n") - F.col("t")) if ties == "ignore" else (F.col("w") + F.col("t") / 2) / F.col("n")
        best = F.greatest(p, 1 - p)
    return sums.select("dataset", best.alias("p")).groupBy("dataset").agg(F.avg("p").alias("agreement"))


def compare_methods(results: DataFrame, first: str, second: str) -> DataFrame:
    """(dataset, folds, mean_difference, wins_first, wins_second, z): paired by fold; z is null for one fold or equal differences."""
    e = F.col("metric_error")
    paired = results.groupBy("dataset", "fold").agg(F.max(F.when(F.col("method") == first, e)).alias("a"), F.max(F.when(F.col("method") == second, e)).alias("b")).where("a is not null and b is not null")
    d = F.col("a") - F.col("b")
    out = paired.groupBy("dataset").agg(F.count(F.lit(1)).alias("folds"), F.avg(d).alias("mean_difference"), F.sum((d < 0).cast("long")).alias("wins_first"), F.sum((d > 0).cast("long")).alias("wins_second"), F.stddev_samp(d).alias("_sd"))
    z = F.try_divide(F.col("mean_difference") * F.sqrt(F.col("folds").cast("double")), F.when(F.col("_sd") > 1e-12, F.col("_sd")))
    return out.select("dataset", "folds", "mean_difference", "wins_first", "wins_second", z.alias("z"))
