"""Predictions of all configs of a task in arrays: a row a block of rows, sliced by the position of a config in its index of names."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TASK = ["dataset", "fold", "split"]
#: Rows of predictions that a block has, at most.
BLOCK_ROWS = 4096


def packed(predictions: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(dataset, fold, split, block, configs, rows, preds) of predictions (dataset, fold, split, config, row, pred).

    configs are the names in order, rows the rows of the block in order, and preds those of the first config, then of the second and so
    on; a prediction is a number or an array over classes. Rows are whole numbers; a block spans block_rows of them, so that the arrays
    stay small whatever the length of a task. A task whose configs don't all have the same rows, once each, is an error.
    """
    own = predictions.withColumn("block", F.floor(F.col("row") / block_rows))
    cells = F.sort_array(F.collect_list(F.struct("config", "row", "pred")))
    blocks = own.groupBy(*TASK, "block").agg(F.sort_array(F.collect_set("config")).alias("configs"), F.sort_array(F.collect_set("row")).alias("rows"), cells.alias("cells"), F.count_distinct("config", "row").alias("n"))
    names = predictions.groupBy(*TASK).agg(F.sort_array(F.collect_set("config")).alias("names"))
    whole = (F.size("configs") == F.size("names")) & (F.size("cells") == F.size("configs") * F.size("rows")) & (F.col("n") == F.size("cells"))
    checked = F.when(whole, F.transform("cells", lambda c: c["pred"])).otherwise(F.raise_error(F.concat(F.lit("configs differ in their rows in "), F.concat_ws("/", *TASK, "block"))))
    return blocks.join(names, TASK).select(*TASK, "block", "configs", "rows", checked.alias("preds"))


def position(config: str) -> Column:
    """Place of a config in the index of names, from 0; an error where it isn't there."""
    place = F.array_position("configs", config)
    return F.when(place > 0, place.cast("int") - 1).otherwise(F.raise_error(F.concat(F.lit(f"no predictions of {config} in "), F.concat_ws("/", *TASK))))


def slice_of(config: str) -> Column:
    """A config's predictions in a block, in the order of its rows."""
    return F.slice("preds", position(config) * F.size("rows") + 1, F.size("rows"))


def model_predictions(blocks: DataFrame, config: str) -> DataFrame:
    """(dataset, fold, split, row, pred) of one config."""
    return blocks.select(*TASK, F.inline(F.arrays_zip(F.col("rows").alias("row"), slice_of(config).alias("pred"))))


def subset_models(blocks: DataFrame, configs: Sequence[str]) -> DataFrame:
    """Blocks with these configs only, in the order of their names; without any configs no blocks, and a missing one is an error."""
    names = sorted(set(configs))
    if not names:
        return blocks.where("false")
    return blocks.select(*TASK, "block", F.array(*map(F.lit, names)).alias("configs"), "rows", F.flatten(F.array(*map(slice_of, names))).alias("preds"))


def blended(blocks: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """(dataset, fold, split, row, pred): weighted sums of the predictions, numbers only, as arrays are added within a block."""
    def plus(weight: float):
        return lambda total, p: total + F.lit(weight) * p

    total = F.transform("rows", lambda _: F.lit(0.0))
    for config in sorted(weights):
        total = F.zip_with(total, slice_of(config), plus(float(weights[config])))
    return blocks.select(*TASK, F.inline(F.arrays_zip(F.col("rows").alias("row"), total.alias("pred"))))


def unpacked(blocks: DataFrame) -> DataFrame:
    """The rows that packed() took."""
    each = blocks.select(*TASK, "rows", "preds", F.posexplode("configs").alias("at", "config"))
    mine = F.slice("preds", F.col("at") * F.size("rows") + 1, F.size("rows"))
    return each.select(*TASK, "config", F.inline(F.arrays_zip(F.col("rows").alias("row"), mine.alias("pred"))))


def from_children(children: DataFrame, *keys: str) -> DataFrame:
    """(keys, row, pred): the mean over the children of a bag that predict a row, numbers or arrays over classes, as floats.

    children (keys, child, row, pred). In validation a row is left out by one child a repeat, in testing all children have all rows.
    """
    if not dict(children.dtypes)["pred"].startswith("array"):
        return children.groupBy(*keys, "row").agg(F.avg("pred").cast("float").alias("pred"))
    classes = children.select(*keys, "row", F.posexplode("pred").alias("c", "p")).groupBy(*keys, "row", "c").agg(F.avg("p").cast("float").alias("p"))
    return classes.groupBy(*keys, "row").agg(F.transform(F.sort_array(F.collect_list(F.struct("c", "p"))), lambda x: x["p"]).alias("pred"))
