"""Task metadata as a table of splits: subsets by split, kind, size and predicate, a row a dataset, and statistics of the data themselves."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankforge.operators.subset import condition

#: What the names of the split-level predicates mean.
SPLIT_PREDICATES = {
    "all": "true",
    "binary": "problem_type = 'binary'",
    "multiclass": "problem_type = 'multiclass'",
    "classification": "problem_type in ('binary', 'multiclass')",
    "regression": "problem_type = 'regression'",
    "large": "max_train_rows between 100001 and 1000350",
    "medium": "max_train_rows between 10001 and 100000",
    "small": "max_train_rows between 1001 and 10000",
    "tiny": "max_train_rows between 101 and 1000",
    "iid": "task_type = 'random'",
    "random": "task_type = 'random'",
    "temporal": "task_type = 'temporal'",
    "grouped": "task_type = 'grouped'",
    "grouped_lpg": "task_type = 'grouped' and group_labels = 'per_group'",
    "grouped_lps": "task_type = 'grouped' and group_labels = 'per_sample'",
    "low-dim": "num_cols_after_preprocessing <= 100",
    "high-dim": "num_cols_after_preprocessing > 100",
    "dim_above_500": "num_cols_after_preprocessing > 500",
    "text": "num_text_cols > 0",
    "high-cardinality": "num_high_cardinality_cats > 0",
    "numerical": "not has_categorical and not has_datetime and num_text_cols = 0",
    "lite": "split = 0",
    "core": "split < folds_to_use",
}
#: Names of expressions that hold together.
SHORTCUTS = {
    "large": ["core", "large"],
    "high_dim": ["core", "high-dim"],
    "low_dim": ["core", "low-dim"],
    "high_cardinality": ["core", "high-cardinality"],
    "grouped": ["core", "grouped"],
    "temporal": ["core", "temporal"],
    "iid": ["core", "iid"],
    "random": ["core", "random"],
    "text": ["core", "text"],
    "numerical": ["core", "numerical"],
    "hc_nolarge": ["core", "high-cardinality", "!large"],
    "hc_nolarge_lite": ["core", "lite", "high-cardinality", "!large"],
}


def holds(expressions: str | Sequence[str], predicates: Mapping[str, str] = SPLIT_PREDICATES) -> Column:
    """Whether all expressions hold, one alone being the name of a shortcut or an expression itself."""
    every = SHORTCUTS.get(expressions, [expressions]) if isinstance(expressions, str) else expressions
    return reduce(lambda a, b: a & b, [condition(e, predicates) for e in every], F.lit(True))


def known(splits: DataFrame, column: str, values: Sequence[str]) -> Column:
    """A filter on listed values; raises on those that the table doesn't have. The list is the caller's and short."""
    found = {r[0] for r in splits.where(F.col(column).isin(list(values))).select(column).distinct().collect()}
    missing = sorted(set(values) - found)
    if missing:
        raise ValueError(f"no {column} in the task metadata: {', '.join(map(str, missing))}")
    return F.col(column).isin(list(values))


def select_splits(
    splits: DataFrame,
    problem_types: Sequence[str] | None = None,
    split_indices: Sequence[str] | str | None = None,
    datasets: Sequence[str] | None = None,
    required_dtypes: Sequence[str] = (),
    forbidden_dtypes: Sequence[str] = (),
    train_rows: tuple[int | None, int | None] = (None, None),
    expressions: str | Sequence[str] = (),
) -> DataFrame:
    """The splits that pass all filters; a dataset without any left is gone. "lite" is the first split, train_rows is (above, up to].

    Names that no split has after the filters before them raise, as does a split index that is none.
    """
    out = splits
    if problem_types is not None:
        out = out.where(F.col("problem_type").isin(list(problem_types)))
    if split_indices is not None:
        wanted = ["r0f0"] if split_indices == "lite" else list(split_indices)
        wrong = [s for s in wanted if not re.fullmatch(r"r\d+f\d+", s)]
        if wrong:
            raise ValueError(f"no split indices: {', '.join(wrong)}")
        out = out.where(F.col("split_index").isin(wanted))
    if datasets is not None:
        out = out.where(known(out, "dataset", datasets))
    for kind in required_dtypes:
        out = out.where(F.array_contains("dtypes", kind))
    for kind in forbidden_dtypes:
        out = out.where(~F.array_contains("dtypes", kind))
    above, most = train_rows
    if above is not None:
        out = out.where(F.col("n_train") > above)
    if most is not None:
        out = out.where(F.col("n_train") <= most)
    return out.where(holds(expressions)) if expressions else out


def per_dataset(splits: DataFrame, *columns: str) -> DataFrame:
    """(dataset, columns, max_train_rows, n_splits): a row a dataset; columns are the same on all its splits."""
    return splits.groupBy("dataset").agg(*[F.first(c, ignorenulls=True).alias(c) for c in columns], F.max("n_train").alias("max_train_rows"), F.count(F.lit(1)).alias("n_splits"))


def task_type(time_on: Column, group_on: Column) -> Column:
    """temporal where there is a time column, else grouped where there is a group column, else random."""
    return F.when(time_on.isNotNull(), "temporal").when(group_on.isNotNull(), "grouped").otherwise("random")


def dataset_stats(rows: DataFrame, target: str, classification: bool, group_on: Sequence[str] = (), per_sample: bool = False) -> DataFrame:
    """One row (num_instances, num_features, num_classes, num_instance_groups) of a table with its target; num_classes is -1 in regression.

    Null is a group of its own, but no class. Labels a sample make each row its own group.
    """
    n, count = F.count(F.lit(1)), (F.count_distinct(target) if classification else F.lit(-1).cast("long"))
    out = rows.agg(n.alias("num_instances"), F.lit(len(rows.columns) - 1).cast("long").alias("num_features"), count.alias("num_classes"))
    if not group_on or per_sample:
        return out.withColumn("num_instance_groups", F.col("num_instances"))
    # One row each: the join is of two totals.
    return out.crossJoin(rows.select(*group_on).distinct().agg(n.alias("num_instance_groups")))


def binary_columns(rows: DataFrame) -> DataFrame:
    """(column) that has exactly two distinct values, nulls aside: those whose least and greatest differ and are all there is. One pass."""
    low_high = rows.agg(*[F.struct(F.min(c).alias("a"), F.max(c).alias("b")).alias(c) for c in rows.columns])
    bounds = low_high.first()
    inside = [F.max((~F.col(c).isin(bounds[c]["a"], bounds[c]["b"])).cast("int")).alias(c) for c in rows.columns if bounds[c]["a"] is not None and bounds[c]["a"] != bounds[c]["b"]]
    other = rows.agg(*inside).first().asDict() if inside else {}
    return rows.sparkSession.createDataFrame([(c,) for c, v in other.items() if not v], "column string")
