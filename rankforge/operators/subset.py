"""Subsets of tasks by expressions, dense tables, imputation and unions of sources."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Predicates over task metadata.
PREDICATES: dict[str, Column | str] = {
    "all": "true",
    "binary": "problem_type = 'binary'",
    "multiclass": "problem_type = 'multiclass'",
    "classification": "problem_type in ('binary', 'multiclass')",
    "regression": "problem_type = 'regression'",
    "tiny": "n_train <= 2000",
    "small": "n_train <= 10000",
    "medium": "n_train > 10000 and n_train <= 100000",
    "low_features": "n_features <= 500",
    "high_features": "n_features > 500",
}


def condition(expression: str, predicates: Mapping[str, str] = PREDICATES) -> Column:
    """One expression: names joined by |, each negated by a leading !."""
    parts = []
    for atom in expression.split("|"):
        name = atom.strip()
        negated = name.startswith("!")
        name = name[1:].strip() if negated else name
        if name not in predicates:
            raise ValueError(f"no predicate {name!r} in {expression!r}; known: {', '.join(sorted(predicates))}")
        holds = F.coalesce(F.expr(predicates[name]), F.lit(False))
        parts.append(~holds if negated else holds)
    return reduce(lambda a, b: a | b, parts)


def subset(tasks: DataFrame, expressions: str | list[str]) -> DataFrame:
    """Tasks for which all expressions hold."""
    every = [expressions] if isinstance(expressions, str) else expressions
    return tasks.where(reduce(lambda a, b: a & b, map(condition, every), F.lit(True)))


def subset_results(results: DataFrame, tasks: DataFrame, expressions: str | list[str]) -> DataFrame:
    return results.join(subset(tasks, expressions).select("dataset"), "dataset", "left_semi")


def full_coverage(results: DataFrame) -> DataFrame:
    """Rows of methods that have every fold of a dataset that any method has."""
    have = results.groupBy("method", "dataset").agg(F.count_distinct("fold").alias("k"))
    want = results.groupBy("dataset").agg(F.count_distinct("fold").alias("k"))
    return results.join(have.join(want, ["dataset", "k"]).select("method", "dataset"), ["method", "dataset"], "left_semi").select(*results.columns)


def missing_cells(results: DataFrame) -> DataFrame:
    """(method, dataset, fold) that a dense table would have: the grid of methods and tasks, as the benchmark defines it."""
    grid = results.select("method").distinct().crossJoin(results.select("dataset", "fold").distinct())
    return grid.join(results.select("method", "dataset", "fold"), ["method", "dataset", "fold"], "left_anti")


def impute(results: DataFrame, filler: str | None = None) -> DataFrame:
    """(method, dataset, fold, metric_error, imputed) without missing cells: the worst error of the task, or a named method's."""
    e = F.col("metric_error")
    fill = results.groupBy("dataset", "fold").agg((F.max(e) if filler is None else F.max(F.when(F.col("method") == filler, e))).alias("_fill"))
    gaps = missing_cells(results).join(fill, ["dataset", "fold"]).select("method", "dataset", "fold", F.col("_fill").alias("metric_error"), F.lit(True).alias("imputed"))
    return results.select("method", "dataset", "fold", "metric_error", F.lit(False).alias("imputed")).unionByName(gaps)


def tasks_with_all_methods(results: DataFrame) -> DataFrame:
    """Rows of the tasks that every method has."""
    total = results.select(F.count_distinct("method").alias("m"))
    full = results.groupBy("dataset", "fold").agg(F.count_distinct("method").alias("m")).join(F.broadcast(total), "m").select("dataset", "fold")
    return results.join(full, ["dataset", "fold"], "left_semi").select(*results.columns)


def methods_with_all_tasks(results: DataFrame) -> DataFrame:
    """Rows of the methods that have every task."""
    total = results.select(F.count_distinct(F.struct("dataset", "fold")).alias("k"))
    full = results.groupBy("method").agg(F.count_distinct(F.struct("dataset", "fold")).alias("k")).join(F.broadcast(total), "k").select("method")
    return results.join(full, "method", "left_semi").select(*results.columns)


def overlay(first: DataFrame, second: DataFrame, keep: str = "first") -> DataFrame:
    """Union of two result tables; where both have a cell, the first or the last table's row stays."""
    both = first.withColumn("_at", F.lit(0)).unionByName(second.withColumn("_at", F.lit(1)))
    w = Window.partitionBy("method", "dataset", "fold").orderBy("_at" if keep == "first" else F.desc("_at"))
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_at")


def coalesced(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Full outer merge of metadata: a null on one side is filled from the other, the left value stays where both differ."""
    columns = [c for c in dict.fromkeys([*left.columns, *right.columns]) if c != key]
    a = left.select(key, *[F.col(c).alias(f"_l_{c}") for c in left.columns if c != key])
    b = right.select(key, *[F.col(c).alias(f"_r_{c}") for c in right.columns if c != key])
    sides = {c: [F.col(f"{s}{c}") for s, d in (("_l_", left), ("_r_", right)) if c in d.columns] for c in columns}
    return a.join(b, key, "full_outer").select(key, *[F.coalesce(*v).alias(c) for c, v in sides.items()])


def predicates_per_dataset(tasks: DataFrame) -> DataFrame:
    """(dataset, subsets): the names of all predicates that hold, sorted and joined by a comma."""
    names = [F.when(condition(p), F.lit(p)) for p in sorted(PREDICATES)]
    return tasks.select("dataset", F.array_join(F.array_compact(F.array(*names)), ",").alias("subsets"))


def admitted(methods: DataFrame, allowed: list[str]) -> DataFrame:
    """Methods whose tags are all allowed; untagged ones always are."""
    return methods.where(F.size(F.array_except(F.coalesce("tags", F.array().cast("array<string>")), F.array(*map(F.lit, allowed)))) == 0)


def methods_of_all_datasets(results: DataFrame) -> DataFrame:
    """(method) of the methods that occur in every dataset."""
    total = results.select(F.count_distinct("dataset").alias("k"))
    return results.groupBy("method").agg(F.count_distinct("dataset").alias("k")).join(F.broadcast(total), "k").select("method")
