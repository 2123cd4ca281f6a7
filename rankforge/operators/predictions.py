"""Stored predictions and labels: Parquet tables pruned by dataset and fold, and measures over them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Predictions:
    """predictions (dataset, fold, split, config, row, pred) and labels (dataset, fold, split, row, y); split is val or test."""

    predictions: DataFrame
    labels: DataFrame

    def save(self, path: str) -> None:
        """Both tables by dataset and fold, so that a task is read from its own files."""
        for name, rows in (("predictions", self.predictions), ("labels", self.labels)):
            rows.write.mode("overwrite").partitionBy("dataset", "fold").parquet(f"{path}/{name}")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Predictions:
        return Predictions(spark.read.parquet(f"{path}/predictions"), spark.read.parquet(f"{path}/labels"))

    def predict(self, split: str, dataset: str, fold: int, configs: Sequence[str], fallback: str | None = None) -> DataFrame:
        """(config, row, pred) of one task; a config without predictions there has those of the fallback, or raises without one."""
        task = self.predictions.where((F.col("dataset") == dataset) & (F.col("fold") == fold) & (F.col("split") == split)).drop("dataset", "fold", "split")
        have = {r[0] for r in task.where(F.col("config").isin(list(configs))).select("config").distinct().collect()}
        missing = [c for c in configs if c not in have]
        rows = task.where(F.col("config").isin(list(configs)))
        if missing:
            if fallback is None:
                raise ValueError(f"no predictions of {', '.join(missing)}")
            lent = task.where(F.col("config") == fallback).withColumn("config", F.explode(F.array(*map(F.lit, missing))))
            rows = rows.unionByName(lent)
        return rows

    def labels_of(self, split: str, dataset: str, fold: int) -> DataFrame:
        return self.labels.where((F.col("dataset") == dataset) & (F.col("fold") == fold) & (F.col("split") == split)).select("row", "y")

    def available(self) -> DataFrame:
        """(dataset, fold, config) that has predictions for both splits."""
        both = self.predictions.groupBy("dataset", "fold", "config").agg(F.count_distinct("split").alias("k"))
        return both.where("k = 2").drop("k")

    def restricted(self, configs: Sequence[str]) -> Predictions:
        return Predictions(self.predictions.where(F.col("config").isin(list(configs))), self.labels)

    def dense(self) -> Predictions:
        """Only configs that every task has."""
        here = self.available()
        tasks = here.select("dataset", "fold").distinct().count()
        whole = here.groupBy("config").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") == tasks)
        return Predictions(self.predictions.join(whole.select("config"), "config", "left_semi"), self.labels)

    def density(self) -> DataFrame:
        """(config, density): share of all tasks for which a config has predictions."""
        here = self.available()
        tasks = here.agg(F.count_distinct("dataset", "fold").alias("tasks"))
        return here.groupBy("config").agg(F.count(F.lit(1)).alias("k")).join(F.broadcast(tasks)).select("config", (F.col("k") / F.col("tasks")).alias("density"))


def true_class(probabilities: Column, y: Column) -> Column:
    """Probability of the true class: of class y in an array, or of a binary probability of class 1."""
    return F.try_element_at(probabilities, (y + 1).cast("int"))


def log_loss(true_probability: Column, eps: float = 1e-15) -> Column:
    """Aggregate: mean negative log of the true class's probability, held away from 0 and 1."""
    return F.avg(-F.log(F.greatest(F.least(true_probability, F.lit(1 - eps)), F.lit(eps))))
