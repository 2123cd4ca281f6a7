"""Places of errors among reference errors, what-if removals, significance and calibration."""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankforge.functions.distributions import chi_squared_tail, t_two_sided
from rankforge.operators.portfolio import first_least, products_matrix, residual_products
from rankforge.sources.stored import stored


def place_among(candidates: DataFrame, reference: DataFrame) -> DataFrame:
    """(method, dataset, fold, place): where an error falls among a task's reference errors, ties half, with partial credit.

    Between two reference errors up to half a place is added in proportion; beyond the worst, half of the relative excess.
    """
    refs = reference.select("dataset", "fold", F.col("metric_error").alias("r"))
    e = F.col("metric_error")
    joined = candidates.join(refs, ["dataset", "fold"]).groupBy("method", "dataset", "fold", "metric_error").agg(
        F.count_if(F.col("r") < e).alias("less"), F.count_if(F.col("r") == e).alias("same"), F.max(F.when(F.col("r") < e, F.col("r"))).alias("before"),
        F.min(F.when(F.col("r") > e, F.col("r"))).alias("after"), F.max("r").alias("worst"),
    )
    before = F.coalesce("before", F.lit(0.0))
    between = F.least(F.lit(0.5), F.try_divide(e - before, (F.col("after") - before) * 2))
    beyond = F.least(F.coalesce(F.try_divide(e - F.col("worst"), F.when(F.col("worst") > 0, F.col("worst"))), F.lit(1.0)), F.lit(1.0)) / 2
    credit = F.when((F.col("same") > 0) | (e <= 0), 0.0).when(F.col("after").isNotNull(), between).otherwise(beyond)
    return joined.select("method", "dataset", "fold", (F.col("less") + F.col("same") / F.lit(2.0) + credit).alias("place"))


def rank_without_each(ranked: DataFrame, method: str) -> DataFrame:
    """(removed, rank): the method's equal-task mean rank if another one were not there, from its rank and one comparison a task."""
    own = ranked.where(F.col("method") == method).select("dataset", "fold", F.col("metric_error").alias("e"), F.col("rank").alias("own"))
    per = own.groupBy("dataset").agg(F.avg("own").alias("own"), F.count(F.lit(1)).alias("folds"))
    whole = per.agg(F.avg("own").alias("whole"), F.count(F.lit(1)).alias("datasets"))
    others = ranked.where(F.col("method") != method).select("dataset", "fold", F.col("method").alias("removed"), F.col("metric_error").alias("r"))
    less = F.when(F.col("r") < F.col("e"), 1.0).when(F.col("r") == F.col("e"), 0.5).otherwise(0.0)
    met = others.join(own, ["dataset", "fold"]).groupBy("removed", "dataset").agg(F.sum(less).alias("less"))
    lost = met.join(per, "dataset").groupBy("removed").agg(F.sum(F.col("less") / F.col("folds")).alias("lost"))
    # One row of totals; methods that share no task with this one change nothing and have no row.
    return lost.join(F.broadcast(whole)).select("removed", (F.col("whole") - F.col("lost") / F.col("datasets")).alias("rank"))


def wilcoxon(differences: np.ndarray) -> float:
    """Two-sided p-value of the signed-rank test; exact up to 12 non-zero differences, else by the normal approximation."""
    d = differences[differences != 0]
    n = len(d)
    if n == 0:
        return 1.0
    ranks = pd.Series(np.abs(d)).rank().to_numpy()
    w = ranks[d > 0].sum()
    if n <= 12:
        sums = np.array(list(product((0, 1), repeat=n))) @ ranks
        return float(min(1.0, 2 * min((sums <= w + 1e-9).mean(), (sums >= w - 1e-9).mean())))
    mean, spread = ranks.sum() / 2, np.sqrt((ranks**2).sum() / 4)
    from math import erfc

    return float(erfc(abs(w - mean) / spread / np.sqrt(2)))


def significance(results: DataFrame) -> DataFrame:
    """(method, tasks, p_value, p_holm): each method against the one of the lowest mean error, over the tasks both have.

    p_holm is p times the number of hypotheses left at its place, at most 1. A task a method: groups are as long as there are tasks.
    """
    e = F.col("metric_error")
    best = results.groupBy("method").agg(F.avg(e).alias("m")).orderBy("m", "method").limit(1).select(F.col("method").alias("best"))
    top = results.join(F.broadcast(best), F.col("method") == F.col("best")).select("dataset", "fold", e.alias("b"), "best")
    pairs = results.join(top, ["dataset", "fold"]).where("method <> best").select("method", (e - F.col("b")).alias("d"))

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"method": [pdf["method"].iloc[0]], "tasks": [len(pdf)], "p_value": [wilcoxon(pdf["d"].to_numpy(float))]})

    tested = pairs.groupBy("method").applyInPandas(test, "method string, tasks long, p_value double")
    return holm(tested)


def holm(tested: DataFrame) -> DataFrame:
    """Adds p_holm to (method, p_value): a row a method, so one ordered window is small."""
    place = F.row_number().over(Window.orderBy("p_value", "method"))
    total = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    return tested.withColumn("p_holm", F.least(F.lit(1.0), F.col("p_value") * (total - place + 1)))


def temperature(rows: DataFrame, key: str, steps: int = 30) -> DataFrame:
    """(key, temperature): the inverse temperature of binary scores p that minimises the log loss of y, by bisection on its log.

    Equal scores and labels of a key are counted once. A round sums the gradient at the inner points of 32 parts of the interval, which
    is five steps of the bisection; the rows stay where they are and a key has one row of sums. Rows without p or y count nothing.
    """
    p = F.least(F.greatest(F.nanvl(F.col("p").cast("double"), F.lit(None)), F.lit(1e-12)), F.lit(1 - 1e-12))
    z = F.when(F.col("p").isNotNull(), F.log(p) - F.log1p(-p))
    counts = rows.groupBy(F.col(key).cast("string").alias("key"), "p", "y").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select("key", z.alias("z"), F.nanvl(F.col("y").cast("double"), F.lit(None)).alias("y"), "n")
    found = counts.select("key").distinct().withColumn("low", F.lit(-16.0))
    width, done = 32.0, 0
    while done < steps:
        bits = min(5, steps - done)
        parts = 2**bits
        at = F.col("low") + F.col("i") * (width / parts)
        q = 1 / (1 + F.exp(-F.least(F.greatest(F.exp(at) * F.col("z"), F.lit(-500.0)), F.lit(500.0))))
        met = counts.alias("c").join(F.broadcast(found.alias("f")), F.col("c.key").eqNullSafe(F.col("f.key"))).select("c.key", "z", "y", "n", "low")
        slopes = met.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(parts - 1)))).groupBy("key", "low", "i").agg(F.sum((q - F.col("y")) * F.col("z") * F.col("n")).alias("slope"))
        # The gradient grows with the temperature, so the points where it isn't positive come first.
        passed = F.count_if(F.coalesce(F.col("slope") <= 0, F.lit(True)))
        found = slopes.groupBy("key", "low").agg(passed.alias("passed")).select("key", (F.col("low") + F.col("passed") * (width / parts)).alias("low"))
        width, done = width / parts, done + bits
    return found.select("key", F.exp(F.col("low") + width / 2).alias("temperature"))


def hill_climb(predictions: DataFrame, precision: float = 0.05, rounds: int = 100) -> DataFrame:
    """(key, config, weight): convex blending by the squared error: the best config and share are mixed in while the error drops.

    The search of a key runs in one task, on its matrix of configs x configs.
    """

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        names, e = products_matrix(pdf)
        weights = np.eye(len(names))[first_least(np.diag(e))]
        error = weights @ e @ weights
        for _ in range(rounds):
            shares = np.append(np.arange(1, round(1 / precision) + 1) * precision, 1 / ((weights > 0).sum() + 1))[:, None]
            errors = (1 - shares) ** 2 * (weights @ e @ weights) + 2 * shares * (1 - shares) * (e @ weights)[None, :] + shares**2 * np.diag(e)[None, :]
            k, j = np.unravel_index(first_least(errors), errors.shape)
            if errors[k, j] >= error - 1e-15:
                break
            weights, error = (1 - shares[k, 0]) * weights + shares[k, 0] * np.eye(len(names))[j], errors[k, j]
        keep = np.flatnonzero(weights > 1e-12)
        return pd.DataFrame({"key": pdf["key"].iloc[0], "config": [names[i] for i in keep], "weight": weights[keep] / weights[keep].sum()})

    return residual_products(predictions).groupBy("key").applyInPandas(fit, "key string, config string, weight double")


def significance_by_dataset(results: DataFrame) -> DataFrame:
    """(dataset, method, p_ttest, p_kruskal, p_ftest, p_tabred): each method against the best of a dataset, over folds.

    The best has the lowest mean error, the first name among equals; its own p is 1. Errors below 0 count as 0. A method whose mean is
    no worse has p 2. Tests: paired t; Kruskal-Wallis of both samples, ties corrected for; one-way analysis of variance; and 2 where
    the mean lies within a standard deviation of the best's, else 0. A test that both samples are too short for is null.
    """
    rows = stored(results.select("dataset", "fold", "method", F.greatest("metric_error", F.lit(0.0)).alias("e")), "errors")
    means = rows.groupBy("dataset", "method").agg(F.avg("e").alias("m"))
    best = means.groupBy("dataset").agg(F.min(F.struct("m", "method")).getField("method").alias("best"))
    marked = rows.join(best, "dataset")
    lead = marked.where("method = best").select("dataset", "fold", F.col("e").alias("b"))
    # A row a fold and method with both errors; a fold that one of them lacks has a null.
    own = marked.where("method <> best").select("dataset", "fold", "method", "e")
    every = own.select("dataset", "method").distinct().join(lead, "dataset")
    both = stored(every.join(own, ["dataset", "method", "fold"], "full_outer"), "samples")
    d = F.col("e") - F.col("b")
    sums = both.groupBy("dataset", "method").agg(
        *[F.count(c).cast("double").alias(f"n_{c}") for c in "eb"], *[F.avg(c).alias(f"m_{c}") for c in "eb"], F.var_samp("e").alias("v_e"), F.var_samp("b").alias("v_b"), F.stddev_pop("b").alias("s_b"),
        F.count(d).cast("double").alias("n"), F.avg(d).alias("m_d"), F.stddev_samp(d).alias("s_d"), F.min(d).alias("low"), F.max(d).alias("high"),
    )
    n_e, n_b, n = F.col("n_e"), F.col("n_b"), F.col("n")
    t = F.col("m_d") / (F.col("s_d") / F.sqrt(n))
    p_t = F.when(n > 1, F.when(F.col("low") == F.col("high"), 0.0).otherwise(t_two_sided(t, n - 1)))
    within = (n_e - 1) * F.coalesce("v_e", F.lit(0.0)) + (n_b - 1) * F.coalesce("v_b", F.lit(0.0))
    between = n_e * n_b / (n_e + n_b) * (F.col("m_e") - F.col("m_b")) * (F.col("m_e") - F.col("m_b"))
    df = n_e + n_b - 2
    p_f = F.when(df > 0, F.when(within == 0, 0.0).otherwise(t_two_sided(F.sqrt(between / (within / df)), df)))
    # Ranks of both samples together; a sample has as many rows as the dataset has folds.
    pooled = both.select("dataset", "method", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("e").alias("x")), F.struct(F.lit(1).alias("side"), F.col("b").alias("x")))).alias("y")).select("dataset", "method", "y.*").where("x is not null")
    pair = Window.partitionBy("dataset", "method")
    ties = F.count(F.lit(1)).over(Window.partitionBy("dataset", "method", "x")).cast("double")
    ranked = pooled.select("dataset", "method", "side", (F.rank().over(pair.orderBy("x")) + (ties - 1) / 2).alias("r"), ties.alias("ties"))
    ranks = ranked.groupBy("dataset", "method").agg(F.sum(F.when(F.col("side") == 0, F.col("r"))).alias("r_e"), F.sum(F.when(F.col("side") == 1, F.col("r"))).alias("r_b"), F.sum(F.col("ties") * F.col("ties") - 1).alias("tied"))
    k = n_e + n_b
    h = (12 / (k * (k + 1)) * (F.col("r_e") * F.col("r_e") / n_e + F.col("r_b") * F.col("r_b") / n_b) - 3 * (k + 1)) / F.when(F.col("tied") < k * k * k - k, 1 - F.col("tied") / (k * k * k - k))
    tests = {"p_ttest": p_t, "p_kruskal": chi_squared_tail(h, F.lit(1.0)), "p_ftest": p_f, "p_tabred": F.when(F.col("m_e") < F.col("m_b") + F.col("s_b"), 2.0).otherwise(0.0)}
    no_worse = F.col("m_b") >= F.col("m_e")
    out = sums.join(ranks, ["dataset", "method"]).select("dataset", "method", *[F.when(no_worse, 2.0).otherwise(p).alias(c) for c, p in tests.items()])
    return out.unionByName(best.select("dataset", F.col("best").alias("method"), *[F.lit(1.0).alias(c) for c in tests]))
