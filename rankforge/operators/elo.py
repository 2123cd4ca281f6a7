"""Elo ratings by maximum likelihood, and their bootstrap over tasks.

Spark reduces battles to one row a (task, pair); the solver sees only method x method matrices, whose size does not grow with data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankforge.operators.aggregate import pair_statistics

SCALE, BASE, START, PENALTY = 400.0, 10.0, 1000.0, 1e-6


def ratings(wins: np.ndarray) -> np.ndarray:
    """Ratings of mean START from wins[i, j] (weighted wins of i over j), by Newton's method on the penalised likelihood."""
    n, step_scale = len(wins), np.log(BASE)
    theta = np.zeros(n)
    total = wins + wins.T
    for _ in range(100):
        p = 1 / (1 + np.exp(-step_scale * (theta[:, None] - theta[None, :])))
        gradient = step_scale * (wins - total * p).sum(axis=1) - PENALTY * theta
        curve = step_scale**2 * total * p * (1 - p)
        hessian = np.diag(curve.sum(axis=1)) - curve + PENALTY * np.eye(n) + 1e-12 * np.ones((n, n))
        step = np.linalg.solve(hessian, gradient)
        step -= step.mean()
        theta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-10:
            break
    return SCALE * (theta - theta.mean()) + START


def matrix(pairs: pd.DataFrame, methods: list[str]) -> np.ndarray:
    place = {m: i for i, m in enumerate(methods)}
    wins = np.zeros((len(methods), len(methods)))
    i, j = pairs["method_1"].map(place).to_numpy(), pairs["method_2"].map(place).to_numpy()
    np.add.at(wins, (i, j), pairs["s1"].to_numpy())
    np.add.at(wins, (j, i), pairs["s2"].to_numpy())
    return wins


def elo(fights: DataFrame) -> DataFrame:
    """(method, elo). One row a pair of methods reaches the driver."""
    pairs = pair_statistics(fights).toPandas()
    methods = sorted(set(pairs["method_1"]) | set(pairs["method_2"]))
    values = ratings(matrix(pairs, methods)) if methods else []
    return fights.sparkSession.createDataFrame([(m, float(v)) for m, v in zip(methods, values, strict=True)], "method string, elo double")


def elo_bootstrap(fights: DataFrame, rounds: int = 100, seed: int = 0) -> DataFrame:
    """(method, elo, elo_low, elo_high): 2.5 and 97.5 % quantiles over resampled datasets; rounds are spread over tasks.

    Sums by (dataset, pair) are broadcast: datasets x pairs of methods, which the benchmark fixes, not the data.
    """
    spark = fights.sparkSession
    pairs = pair_statistics(fights, "dataset").toPandas().sort_values(["dataset", "method_1", "method_2"])
    methods, datasets = sorted(set(pairs["method_1"]) | set(pairs["method_2"])), sorted(set(pairs["dataset"]))
    if not methods:
        return spark.createDataFrame([], "method string, elo double, elo_low double, elo_high double")
    stack = spark.sparkContext.broadcast(np.array([matrix(pairs[pairs["dataset"] == d], methods) for d in datasets]))

    def resample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b["id"]:
                drawn = np.random.default_rng([seed, int(r)]).integers(0, len(datasets), len(datasets))
                times = np.bincount(drawn, minlength=len(datasets)) if r else np.ones(len(datasets))
                yield pd.DataFrame({"round": int(r), "method": methods, "elo": ratings(np.tensordot(times, stack.value, 1))})

    every = spark.range(rounds + 1).repartition(min(rounds + 1, 16)).mapInPandas(resample, "round long, method string, elo double")
    low, high = (F.percentile(F.when(F.col("round") > 0, F.col("elo")), q) for q in (0.025, 0.975))
    return every.groupBy("method").agg(F.max(F.when(F.col("round") == 0, F.col("elo"))).alias("elo"), low.alias("elo_low"), high.alias("elo_high"))


def expected(rated: DataFrame) -> DataFrame:
    """(method_1, method_2, expected): expected score of one method against another from their ratings; methods x methods rows."""
    a, b = rated.select(F.col("method").alias("method_1"), F.col("elo").alias("e1")), rated.select(F.col("method").alias("method_2"), F.col("elo").alias("e2"))
    return a.join(b, F.col("method_1") != F.col("method_2")).select("method_1", "method_2", (1 / (1 + F.pow(F.lit(BASE), (F.col("e2") - F.col("e1")) / SCALE))).alias("expected"))
