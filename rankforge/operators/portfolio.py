"""Greedy portfolios and greedy ensembles over stored errors and predictions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankforge.operators.pertask import per_task
from rankforge.sources.stored import stored


def packed_ranks(ranked: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(dataset, fold, ranks): a row a task with its (method, rank) structs, ranks multiplied by the weight of the dataset (1 if unnamed)."""
    rank = F.col("rank")
    if weights:
        rank = rank * F.coalesce(*[F.when(F.col("dataset") == d, F.lit(float(w))) for d, w in sorted(weights.items())], F.lit(1.0))
    return ranked.groupBy("dataset", "fold").agg(F.sort_array(F.collect_list(F.struct("method", rank.alias("rank")))).alias("ranks"))


def chosen_rank(chosen: Column) -> Column:
    """The best rank of the chosen methods in a row of packed_ranks; null where it has none of them."""
    return F.array_min(F.transform(F.filter("ranks", lambda x: F.array_contains(chosen, x["method"])), lambda x: x["rank"]))


def next_means(packed: DataFrame, chosen: Column, *keys: str) -> DataFrame:
    """(keys, method, mean): for each method not chosen yet the mean over tasks of the best rank once it is, tasks without it left out."""
    each = packed.select(*keys, chosen.alias("chosen"), chosen_rank(chosen).alias("so_far"), F.explode("ranks").alias("x")).where(~F.array_contains("chosen", F.col("x.method")))
    return each.groupBy(*keys, F.col("x.method").alias("method")).agg(F.avg(F.least("x.rank", "so_far")).alias("mean"))


def names_array(names: list[str]) -> Column:
    return F.array(*map(F.lit, names)).cast("array<string>")


def forward(packed: DataFrame, size: int) -> list[str]:
    """Methods chosen one by one for the lowest mean of the best rank so far, the first name among equals; ends when the mean stays
    the same. Each round is one aggregate over tasks, of which a row reaches the driver."""
    chosen, last = [], None
    for _ in range(size):
        row = next_means(packed, names_array(chosen)).orderBy("mean", "method").first()
        if row is None or row["mean"] == last:
            break
        chosen.append(row["method"])
        last = row["mean"]
    return chosen


def removal_scores(packed: DataFrame, chosen: list[str]) -> tuple[float, dict[str, float]]:
    """The mean best rank of the chosen methods, and that without each of them: per task the best or, without its owner, the second best."""
    own = F.sort_array(F.transform(F.filter("ranks", lambda x: F.array_contains(names_array(chosen), x["method"])), lambda x: F.struct(x["rank"].alias("rank"), x["method"].alias("method"))))
    tasks = packed.select(F.get(own, F.lit(0)).alias("first"), F.get(own, F.lit(1)).alias("second"))
    means = [F.avg(F.when(F.col("first.method") == m, F.col("second.rank")).otherwise(F.col("first.rank"))) for m in chosen]
    whole, *without = tasks.agg(F.avg("first.rank"), *means).first()
    return whole, dict(zip(chosen, without, strict=True))


def pruned(packed: DataFrame, chosen: list[str], threshold: float = 0.0) -> list[str]:
    """Chosen methods without those whose removal costs the mean best rank at most `threshold`, one by one; of several the last of the
    least cost goes. The last method always stays."""
    chosen = list(chosen)
    best = removal_scores(packed, chosen)[0] if chosen else None
    while len(chosen) > 1:
        goes = None
        for m, score in removal_scores(packed, chosen)[1].items():
            if score is not None and score <= (best if goes else best + threshold):
                best, goes = score, m
        if goes is None:
            break
        chosen.remove(goes)
    return chosen


def packed_table(results: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """packed_ranks of results, written to the shared folder, since every round reads them."""
    return stored(packed_ranks(per_task(results).select("dataset", "fold", "method", "rank"), weights), "ranks")


def listed(spark: SparkSession, chosen: list[str]) -> DataFrame:
    return spark.createDataFrame([(i + 1, m) for i, m in enumerate(chosen)], "place int, method string")


def greedy_portfolio(results: DataFrame, size: int = 5, weights: dict[str, float] | None = None) -> DataFrame:
    """(place, method) of the greedy portfolio by mean best rank, datasets weighted."""
    return listed(results.sparkSession, forward(packed_table(results, weights), size))


def pruned_portfolio(results: DataFrame, size: int = 5, threshold: float = 0.0, weights: dict[str, float] | None = None) -> DataFrame:
    """(place, method) of the greedy portfolio after methods that cost at most `threshold` have been removed again."""
    packed = packed_table(results, weights)
    return listed(results.sparkSession, pruned(packed, forward(packed, size), threshold))


def leave_one_dataset_out(results: DataFrame, size: int = 5) -> DataFrame:
    """(dataset, place, method): for each dataset the portfolio of all others, all datasets in the same rounds.

    A round averages over the tasks of the others, and its choices, a row a dataset, are joined to the next one; none of it leaves Spark
    but whether any choice was made.
    """
    packed = packed_table(results)
    names = packed.select(F.col("dataset").alias("held")).distinct()
    # The names of the datasets, one row.
    sets = packed.groupBy(F.lit(1).alias("one")).agg(F.sort_array(F.collect_set("dataset")).alias("every"))
    spread = packed.withColumn("one", F.lit(1)).join(F.broadcast(sets), "one").withColumn("held", F.explode(F.array_remove("every", F.col("dataset")))).drop("every", "one")
    state = names.select("held", names_array([]).alias("chosen"), F.lit(None).cast("double").alias("last"), F.lit(True).alias("going"))
    for _ in range(size):
        going = spread.join(state.where("going"), "held")
        best = next_means(going, F.col("chosen"), "held").groupBy("held").agg(F.min(F.struct("mean", "method")).alias("b"))
        more = F.col("going") & F.col("b").isNotNull() & ~F.col("b.mean").eqNullSafe(F.col("last"))
        state = state.join(best, "held", "left").select(
            "held", F.when(more, F.concat("chosen", F.array("b.method"))).otherwise(F.col("chosen")).alias("chosen"), F.when(more, F.col("b.mean")).otherwise(F.col("last")).alias("last"), more.alias("going")
        )
        state = stored(state, "portfolios")
        if state.where("going").isEmpty():
            break
    return state.select(F.col("held").alias("dataset"), F.posexplode("chosen").alias("place", "method")).withColumn("place", F.col("place") + 1)


def residual_products(predictions: DataFrame) -> DataFrame:
    """(key, a, b, e, n): for each two configs a <= b of a key the mean product of their residuals p - y, over its n rows.

    The squared error of any blend whose weights sum to 1 is a quadratic form of these. A row's predictions meet in one task, which sums
    the products of all its rows; a key then has as many rows as it has pairs of configs, whatever its length. Rows without y can't be
    measured, rows without a config can't be named; both are left out; configs that
    have no prediction of some row of their key are no candidates; a row with two predictions
    of a config is an error.
    """
    rows = predictions.where(F.col("config").isNotNull() & F.col("y").isNotNull() & ~F.isnan(F.col("y").cast("double")))
    p = F.col("p").cast("double") - F.col("y").cast("double")
    by_row = rows.groupBy("key", "row_id").agg(F.sort_array(F.collect_list(F.struct("config", p.alias("d")))).alias("r")).select(
        F.col("key").cast("string").alias("key"), F.transform("r", lambda x: x["config"].cast("string")).alias("configs"), F.transform("r", lambda x: x["d"]).alias("d")
    )

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            groups: dict = {}
            for k, configs, d in zip(batch["key"], batch["configs"], batch["d"], strict=True):
                groups.setdefault((k, tuple(configs)), []).append(d)
            for (k, configs), d in groups.items():
                if len(set(configs)) < len(configs):
                    raise ValueError(f"a row of {k} has two predictions of a config")
                x = np.array(d, float)
                i, j = np.triu_indices(len(configs))
                names = np.array(configs, object)
                yield pd.DataFrame({"key": k, "a": names[i], "b": names[j], "e": (x.T @ x)[i, j], "n": len(x)})

    sums = by_row.mapInPandas(partial, "key string, a string, b string, e double, n long").groupBy("key", "a", "b").agg(F.sum("e").alias("e"), F.sum("n").alias("n"))
    total = by_row.groupBy("key").agg(F.count(F.lit(1)).alias("total"))
    whole = sums.alias("s").join(total.alias("t"), F.col("s.key").eqNullSafe(F.col("t.key"))).where("n = total and not isnan(e)")
    return whole.select("s.key", "a", "b", (F.col("e") / F.col("n")).alias("e"), "n")


def products_matrix(pdf: pd.DataFrame) -> tuple[list[str], np.ndarray]:
    """Configs in order of their names and the symmetric matrix of their mean products, of those that are complete."""
    wide = pdf.pivot(index="a", columns="b", values="e")
    names = sorted(set(pdf.loc[pdf["a"] == pdf["b"], "a"]))
    upper = wide.reindex(index=names, columns=names).to_numpy(float)
    return names, np.where(np.isnan(upper), upper.T, upper)


def first_least(errors: np.ndarray) -> int:
    """Place of the first of the least errors; those that differ by less than sums of floats do count as equal."""
    return int(np.argmax(errors.ravel() <= errors.min() * (1 + 1e-12) + 1e-15))


def greedy_ensemble(predictions: DataFrame, iterations: int = 40) -> DataFrame:
    """(key, config, weight): forward selection with repeats of configs by the squared error of the mean prediction.

    predictions: key, row_id, config, p, y. The search of a key runs in one task, on its matrix of configs x configs.
    """

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        names, e = products_matrix(pdf)
        counts, used, best = np.zeros(len(names)), [], (np.inf, 0)
        for k in range(1, iterations + 1):
            errors = (counts @ e @ counts + 2 * (e @ counts) + np.diag(e)) / k**2
            j = first_least(errors)
            used.append(j)
            counts[j] += 1
            if errors[j] < best[0] - 1e-15:
                best = (errors[j], k)
        kept = np.bincount(used[: best[1]], minlength=len(names))
        keep = np.flatnonzero(kept)
        return pd.DataFrame({"key": pdf["key"].iloc[0], "config": [names[i] for i in keep], "weight": kept[keep] / best[1]})

    return residual_products(predictions).groupBy("key").applyInPandas(fit, "key string, config string, weight double")


def long_scores(scores: DataFrame, *configs: str) -> DataFrame:
    """(key, row_id, config, p, y) of wide scores, one row a config."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("config"), F.col(c).alias("p")) for c in configs])).alias("e")
    return scores.select(F.col("lang").alias("key"), F.col("doc_id").alias("row_id"), "y", each).select("key", "row_id", "e.config", "e.p", F.col("y").cast("double").alias("y"))
