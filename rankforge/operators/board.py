"""The whole leaderboard from a registry of metrics, and what-if removals for any metric.

The per-task view is written once; every metric reads it and gives its columns by method, and a caller's own metric does the same.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankforge.operators import aggregate, elo, pertask, removal
from rankforge.sources.stored import stored


@dataclass(frozen=True)
class Context:
    """What metrics are made from: per_task has the measures of each method and task; baseline may be None."""

    per_task: DataFrame
    baseline: str | None = None
    elo_rounds: int = 100
    elo_anchor: str | None = None


@dataclass(frozen=True)
class Metric:
    """produce(context) gives (method, columns...), one row a method of the board at most."""

    key: str
    produce: Callable[[Context], DataFrame]
    requires_baseline: bool = False


def _means(*values: str) -> Callable[[Context], DataFrame]:
    return lambda c: aggregate.equal_task_mean(c.per_task, *values)


def _elo(c: Context) -> DataFrame:
    return removal.elo_board(elo.elo_bootstrap(aggregate.battles(c.per_task), c.elo_rounds), c.elo_anchor)


def _against(c: Context) -> DataFrame:
    return pertask.against_baseline(c.per_task.select("method", "dataset", "fold", "metric_error"), c.baseline)


#: Metrics by their keys, in the order of their columns.
METRICS = {
    m.key: m
    for m in (
        Metric("elo", _elo),
        Metric("rank", _means("rank")),
        Metric("winrate", lambda c: aggregate.winrate_from_ranks(c.per_task)),
        Metric("improvability", _means("improvability")),
        Metric("baseline_advantage", lambda c: aggregate.equal_task_mean(_against(c), "baseline_advantage"), True),
        Metric("frontier_advantage", _means("frontier_advantage")),
        Metric("mrr", lambda c: aggregate.equal_task_mean(c.per_task.withColumn("mrr", 1 / F.col("rank")), "mrr")),
        Metric("relative_error", lambda c: aggregate.skill_score(_against(c)).select("method", F.col("relative_error_gmean").alias("relative_error")), True),
        Metric("skill_score", lambda c: aggregate.skill_score(_against(c)).select("method", "skill_score"), True),
        Metric("rank_counts", lambda c: pertask.rank_counts(c.per_task)),
    )
}
DEFAULT = ("elo", "winrate", "improvability")


def chosen(metrics: Sequence[str | Metric]) -> list[Metric]:
    """The metrics in the order of their columns: built-in ones by METRICS, rank always among them, then the caller's as passed."""
    keys = {m for m in metrics if isinstance(m, str)}
    unknown = keys - set(METRICS)
    if unknown:
        raise ValueError(f"no metric {', '.join(sorted(unknown))}; known: {', '.join(METRICS)}")
    own = [m for m in metrics if isinstance(m, Metric)]
    names = [m.key for m in own]
    clash = {k for k in names if names.count(k) > 1 or k in METRICS}
    if clash:
        raise ValueError(f"metrics of the same key: {', '.join(sorted(clash))}")
    return [m for k, m in METRICS.items() if k in keys or k == "rank"] + own


def validated(metric: Metric, produced: DataFrame, taken: set[str], methods: DataFrame) -> DataFrame:
    """produced, if it has a method column, columns that no other metric has, and only methods of the board, each once; else raises."""
    columns = [c for c in produced.columns if c != "method"]
    if "method" not in produced.columns or not columns:
        raise ValueError(f"metric {metric.key!r} must give the column method and columns of its own, not {produced.columns}")
    clash = taken & set(columns) | {c for c in columns if columns.count(c) > 1}
    if clash:
        raise ValueError(f"metric {metric.key!r} gives columns that are taken: {', '.join(sorted(clash))}")
    if metric.key not in METRICS:
        foreign = [r[0] for r in produced.join(methods, "method", "left_anti").select("method").orderBy("method").limit(5).collect()]
        if foreign:
            raise ValueError(f"metric {metric.key!r} has methods that the board lacks: {foreign}")
        if not produced.groupBy("method").count().where("count > 1").isEmpty():
            raise ValueError(f"metric {metric.key!r} has a method twice")
    return produced


def leaderboard(
    results: DataFrame, metrics: Sequence[str | Metric] = DEFAULT, baseline: str | None = None, average_folds: bool = False, include_error: bool = False, include_rescaled_loss: bool = False,
    sort_by: str | None = "rank", elo_rounds: int = 100, elo_anchor: str | None = None,
) -> DataFrame:
    """One row a method with the columns of the chosen metrics, then mean and median times, in ascending order of sort_by.

    results (method, dataset, fold, metric_error, time_train_s, time_infer_s). Metrics that need a baseline are left out without one; the
    anchor of Elo is the baseline where none is named. With average_folds errors are averaged over the folds of a dataset before tasks are
    ranked. Datasets count the same.
    """
    if average_folds:
        results = results.groupBy("method", "dataset").agg(F.lit(0).alias("fold"), *[F.avg(c).alias(c) for c in ("metric_error", "time_train_s", "time_infer_s")])
    context = Context(stored(pertask.per_task(results), "per-task"), baseline or elo_anchor, elo_rounds, elo_anchor)
    board = context.per_task.select("method").distinct()
    trailing = ["time_train_s", "time_infer_s"] + ["metric_error"] * include_error + ["loss_rescaled"] * include_rescaled_loss
    end = aggregate.mean_and_median(context.per_task, *trailing)
    taken, methods = set(end.columns) - {"method"}, board
    for metric in chosen(metrics):
        if metric.requires_baseline and context.baseline is None:
            continue
        produced = validated(metric, metric.produce(context), taken, methods)
        taken |= set(produced.columns) - {"method"}
        board = board.join(produced, "method", "left")
    board = board.join(end, "method")
    return board.orderBy(sort_by, "method") if sort_by else board


@dataclass(frozen=True)
class Spec:
    """A metric for what-if questions. scores(rows) gives (removed, method, score) for rows with a column removed: every table that a
    removal leaves, all in one plan. Required methods are never removed."""

    name: str
    direction: str
    scores: Callable[[DataFrame], DataFrame]
    required: frozenset[str] = field(default_factory=frozenset)


WHAT_IF = ("removed", "dataset", "fold")
#: The name of no method.
NOBODY = ""


def mean_by_removal(rows: DataFrame, value) -> DataFrame:
    inner = rows.groupBy("removed", "method", "dataset").agg(F.avg(value).alias("v"))
    return inner.groupBy("removed", "method").agg(F.avg("v").alias("score"))


def _winrates(rows: DataFrame) -> DataFrame:
    ranked = pertask.per_task(rows, WHAT_IF).withColumn("m", F.count(F.lit(1)).over(pertask.over(*WHAT_IF)))
    return mean_by_removal(ranked, 1 - F.coalesce(F.try_divide(F.col("rank") - 1, F.col("m") - 1), F.lit(0.5)))


def _ratings(rows: DataFrame) -> DataFrame:
    """Elo of each method; a fit sees the sums of pairs of one removal."""
    left = rows.select("removed", "dataset", "fold", F.col("method").alias("method_1"), F.col("metric_error").alias("e1"))
    right = rows.select("removed", "dataset", "fold", F.col("method").alias("method_2"), F.col("metric_error").alias("e2"))
    folds = rows.groupBy("removed", "dataset").agg(F.count_distinct("fold").alias("folds"))
    pairs = left.join(right, list(WHAT_IF)).where("method_1 < method_2").join(folds, ["removed", "dataset"])
    share = F.when(F.col("e1") < F.col("e2"), 1.0).when(F.col("e1") == F.col("e2"), 0.5).otherwise(0.0)
    sums = pairs.groupBy("removed", "method_1", "method_2").agg(F.sum(share / F.col("folds")).alias("s1"), F.sum((1 - share) / F.col("folds")).alias("s2"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        methods = sorted(set(pdf["method_1"]) | set(pdf["method_2"]))
        return pd.DataFrame({"removed": [pdf["removed"].iloc[0]] * len(methods), "method": methods, "score": elo.ratings(elo.matrix(pdf, methods))})

    return sums.groupBy("removed").applyInPandas(fit, "removed string, method string, score double")


SPECS = {
    s.name: s
    for s in (
        Spec("rank", "min", lambda rows: mean_by_removal(pertask.per_task(rows, WHAT_IF), F.col("rank"))),
        Spec("winrate", "max", _winrates),
        Spec("improvability", "min", lambda rows: mean_by_removal(pertask.per_task(rows, WHAT_IF), F.col("improvability"))),
        Spec("elo", "max", _ratings),
    )
}


def without_each(results: DataFrame, candidates: Sequence[str]) -> DataFrame:
    """The rows that each removal leaves, with the removed method; NOBODY stands for no removal."""
    return results.withColumn("removed", F.explode(F.array(*map(F.lit, candidates), F.lit(NOBODY)))).where(F.col("method") != F.col("removed"))


def names(results: DataFrame) -> list[str]:
    """The methods of a benchmark, which it fixes, in order."""
    return [r[0] for r in results.where("method is not null").select("method").distinct().orderBy("method").collect()]


def scores_if_removed(results: DataFrame, spec: Spec, method: str) -> DataFrame:
    """(removed, score): the method's score if each other one were removed; null where it is removed itself or has none."""
    results = stored(results, "results")
    candidates = [m for m in names(results) if m not in spec.required]
    scores = spec.scores(without_each(results, candidates)).where(F.col("method") == method).select("removed", "score")
    # A row a method.
    every = results.sparkSession.createDataFrame([(m,) for m in candidates], "removed string")
    return every.join(F.broadcast(scores), "removed", "left")


def greedy_removals(results: DataFrame, spec: Spec, method: str, stop_at: float | None = None) -> DataFrame:
    """(place, removed, score): the methods whose removal helps most, one by one, until the score stops at a bound or none is left.

    A round is one plan over all removals, of which a row reaches the driver; of equal scores the first name goes.
    """
    left, out = stored(results, "results"), []
    sign = 1 if spec.direction == "min" else -1
    rest = [m for m in names(left) if m != method and m not in spec.required]
    while rest:
        rows = spec.scores(without_each(left, rest)).where((F.col("method") == method) & F.col("score").isNotNull() & ~F.isnan("score"))
        best = rows.where(F.col("removed") != NOBODY).orderBy(sign * F.col("score"), "removed").select(F.lit(1).alias("k"), "removed", "score").limit(1)
        now = {r["k"]: r for r in rows.where(F.col("removed") == NOBODY).select(F.lit(0).alias("k"), "removed", "score").union(best).collect()}
        if 0 not in now or (stop_at is not None and sign * now[0]["score"] <= sign * stop_at) or 1 not in now:
            break
        out.append((len(out) + 1, now[1]["removed"], now[1]["score"]))
        rest.remove(now[1]["removed"])
        left = left.where(F.col("method") != now[1]["removed"])
    return results.sparkSession.createDataFrame(out, "place int, removed string, score double")
