"""Task metadata from whatever names it: a frame, rows, a file, or a suite by name; and the older form of a row a dataset."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Suite = Callable[[SparkSession], DataFrame]
SUITES: dict[str, Suite] = {}

#: The metric of each problem type, and the columns that the older form must have.
METRICS = {"binary": "roc_auc", "multiclass": "log_loss", "regression": "rmse"}
LEGACY = ("problem_type", "n_folds", "n_repeats", "n_features", "n_classes", "NumberOfInstances", "tid", "n_samples_train_per_fold", "n_samples_test_per_fold")


def register_suite(name: str, suite: Suite) -> None:
    """Makes a suite known by its name; a name stands for one suite."""
    if name in SUITES:
        raise ValueError(f"There is a suite {name!r} already")
    SUITES[name] = suite


def resolve_source(spark: SparkSession, source: DataFrame | Sequence[dict] | str) -> DataFrame:
    """The task metadata that `source` is or names: a frame, a sequence of rows, the path of a CSV or Parquet table, or a suite's name."""
    if isinstance(source, DataFrame):
        return source
    if not isinstance(source, str):
        rows = list(source)
        if not rows:
            raise ValueError("No tasks are given")
        return spark.createDataFrame(rows)
    if source in SUITES:
        return SUITES[source](spark)
    if source.endswith(".csv"):
        return spark.read.csv(source, header=True, inferSchema=True)
    if source.endswith(".parquet"):
        return spark.read.parquet(source)
    raise ValueError(f"{source!r} is neither a CSV or Parquet table nor one of the suites {sorted(SUITES)}")


def splits_of_datasets(legacy: DataFrame) -> DataFrame:
    """A row a (dataset, repeat, fold) of older metadata, a row a dataset.

    Numbers of classes of regressions are -1, whatever they were; sizes a fold stay fractions. Columns that are missing, and problem types
    without a metric, are errors; an empty table gives no rows.
    """
    missing = [c for c in LEGACY if c not in legacy.columns]
    if missing:
        raise ValueError(f"Columns are missing: {missing}")
    names = [F.when(F.col(c) != "", F.col(c)) for c in ("dataset", "name") if c in legacy.columns]
    if not names:
        raise ValueError("There is neither a column dataset nor a column name")
    kind = F.col("problem_type")
    metric = F.coalesce(*[F.when(kind == k, F.lit(m)) for k, m in METRICS.items()], F.raise_error(F.concat(F.lit("No metric for the problem type "), F.coalesce(kind, F.lit("null")))))
    target = F.col("target_feature") if "target_feature" in legacy.columns else F.lit(None).cast("string")
    size = (F.col("n_folds") * F.col("n_repeats")).cast("int")
    grid = legacy.select(
        F.coalesce(*names).alias("dataset"), F.col("tid").cast("long").cast("string").alias("task_id_str"), "problem_type", metric.alias("eval_metric"), (kind != "regression").alias("is_classification"), target.alias("target_name"),
        F.when(kind == "regression", -1).otherwise(F.col("n_classes")).cast("int").alias("num_classes"), F.col("n_features").cast("int").alias("num_features"), F.col("NumberOfInstances").cast("long").alias("num_instances"),
        F.col("n_samples_train_per_fold").cast("double").alias("num_instances_train"), F.col("n_samples_test_per_fold").cast("double").alias("num_instances_test"),
        F.explode(F.when(size > 0, F.sequence(F.lit(0), size - 1))).alias("split"), F.col("n_folds").cast("int").alias("_folds"),
    )
    return grid.withColumn("repeat", F.floor(F.col("split") / F.col("_folds")).cast("int")).withColumn("fold", F.col("split") % F.col("_folds")).drop("_folds", "split")


def datasets_of_splits(splits: DataFrame) -> DataFrame:
    """The older form of metadata, a row a dataset: counts of distinct folds and repeats, mean sizes a fold, and what is the same for all splits.

    What differs between the splits of a dataset comes from its first repeat and fold.
    """
    same = [c for c in splits.columns if c not in ("dataset", "repeat", "fold", "num_instances_train", "num_instances_test")]
    first = F.min_by(F.struct(*same), F.struct("repeat", "fold")).alias("_same")
    rows = splits.groupBy("dataset").agg(F.count_distinct("fold").alias("n_folds"), F.count_distinct("repeat").alias("n_repeats"), F.avg("num_instances_train").alias("n_samples_train_per_fold"), F.avg("num_instances_test").alias("n_samples_test_per_fold"), first)
    renamed = {"num_features": "n_features", "num_classes": "n_classes", "num_instances": "NumberOfInstances", "task_id_str": "tid"}
    return rows.select("dataset", "n_folds", "n_repeats", "n_samples_train_per_fold", "n_samples_test_per_fold", *[F.col("_same")[c].alias(renamed.get(c, c)) for c in same])


def with_metadata(results: DataFrame, tasks: DataFrame, require: bool = False) -> DataFrame:
    """The results whose dataset has metadata; with `require`, results of other datasets are an error that names up to ten of them.

    Tasks may have any number of rows a dataset.
    """
    known = tasks.select("dataset").distinct()
    if require:
        unknown = results.select("dataset").distinct().join(known, "dataset", "left_anti").orderBy("dataset").limit(10).collect()
        if unknown:
            raise ValueError(f"Datasets without metadata: {[r['dataset'] for r in unknown]}")
    return results.join(known, "dataset", "left_semi")


def without_lite(boards: DataFrame, subset: str = "subset", strip: bool | None = None) -> DataFrame:
    """boards with `lite` taken out of the parts of subset names, which & joins; a name of nothing else stays `lite`.

    By itself this happens only if all names have the part. Two names that become the same are an error.
    """
    names = boards.select(subset).distinct()
    parts = F.split(F.col(subset), "&")
    if strip is None:
        strip = bool(names.agg(F.bool_and(F.array_contains(parts, "lite")).alias("all")).first()["all"])
    if not strip:
        return boards
    left = F.array_remove(parts, "lite")
    short = F.when(F.size(left) > 0, F.array_join(left, "&")).otherwise("lite")
    twice = names.groupBy(short.alias("name")).count().where("count > 1").orderBy("name").first()
    if twice:
        raise ValueError(f"Several subsets become {twice['name']!r} without lite")
    return boards.withColumn(subset, short)
