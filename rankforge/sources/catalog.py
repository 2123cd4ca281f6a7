"""A repository of results and task metadata as Parquet tables, with dataset-pruned reads, subsets and collections."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankforge.operators import subset

#: Spellings of metric names, fixed values.
METRICS = {"auc": "roc_auc", "neg_rmse": "rmse", "root_mean_squared_error": "rmse", "neg_logloss": "log_loss", "logloss": "log_loss"}


def metric_name(column: str):
    """One spelling of a metric; unknown names stay."""
    known = F.create_map(*[F.lit(x) for pair in METRICS.items() for x in pair])
    return F.coalesce(F.element_at(known, F.col(column)), F.col(column))


@dataclass(frozen=True)
class Repository:
    """Results (method, dataset, fold, metric_error, ...) and tasks (dataset, ...) that belong together."""

    results: DataFrame
    tasks: DataFrame

    def save(self, path: str) -> None:
        """Results are partitioned by dataset, so a read of some datasets touches only their files."""
        self.results.write.mode("overwrite").partitionBy("dataset").parquet(f"{path}/results")
        self.tasks.write.mode("overwrite").parquet(f"{path}/tasks")

    def replace_datasets(self, path: str) -> None:
        """Writes only the datasets at hand; others in the table stay."""
        self.results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset").parquet(f"{path}/results")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Repository:
        return Repository(spark.read.parquet(f"{path}/results"), spark.read.parquet(f"{path}/tasks"))

    def subset(self, datasets: list[str] | None = None, folds: list[int] | None = None, methods: list[str] | None = None, expressions: str | list[str] | None = None) -> Repository:
        """The part with these datasets, folds and methods, and the tasks for which the expressions hold. None keeps all."""
        tasks = self.tasks if expressions is None else subset.subset(self.tasks, expressions)
        results = self.results if expressions is None else self.results.join(tasks.select("dataset"), "dataset", "left_semi")
        if datasets is not None:
            tasks, results = tasks.where(F.col("dataset").isin(datasets)), results.where(F.col("dataset").isin(datasets))
        for name, values in (("fold", folds), ("method", methods)):
            if values is not None:
                results = results.where(F.col(name).isin(values))
        return replace(self, results=results, tasks=tasks)

    def dense(self) -> Repository:
        return replace(self, results=subset.tasks_with_all_methods(self.results))

    def join(self, other: Repository, overlap: str = "raise") -> Repository:
        """Both repositories as one; of a cell that both have the first's or the last's row stays, or the union is refused."""
        key = ["method", "dataset", "fold"]
        if overlap == "raise" and not self.results.join(other.results.select(*key), key, "left_semi").isEmpty():
            raise ValueError("both repositories have results of one method on one task")
        both = subset.overlay(self.results, other.results, "last" if overlap == "last" else "first")
        return Repository(both, subset.coalesced(self.tasks, other.tasks, "dataset"))
