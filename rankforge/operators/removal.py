"""What a method would gain if others left, and how boards with variants, dates and sizes are told."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Suffixes of tuning variants, in display names.
ENSEMBLED, TUNED, DEFAULT = " (tuned + ensembled)", " (tuned)", " (default)"


def losses(results: DataFrame) -> DataFrame:
    """(method_1, method_2, lost): what method_2 adds to the mean rank of method_1, ties half, datasets equal.

    A task has as many pairs as the square of its methods, as the matrix of the result has.
    """
    a = results.select("dataset", "fold", F.col("method").alias("method_1"), F.col("metric_error").alias("e1"))
    b = results.select("dataset", "fold", F.col("method").alias("method_2"), F.col("metric_error").alias("e2"))
    folds = results.groupBy("dataset", F.col("method").alias("method_1")).agg(F.count(F.lit(1)).alias("folds"))
    datasets = results.groupBy(F.col("method").alias("method_1")).agg(F.count_distinct("dataset").alias("datasets"))
    lost = F.when(F.col("e2") < F.col("e1"), 1.0).when(F.col("e2") == F.col("e1"), 0.5).otherwise(0.0)
    pairs = a.join(b, ["dataset", "fold"]).where("method_1 <> method_2").groupBy("dataset", "method_1", "method_2").agg(F.sum(lost).alias("lost"))
    by_dataset = pairs.join(folds, ["dataset", "method_1"]).select("method_1", "method_2", (F.col("lost") / F.col("folds")).alias("lost"))
    sums = by_dataset.groupBy("method_1", "method_2").agg(F.sum("lost").alias("lost"))
    return sums.join(datasets, "method_1").select("method_1", "method_2", F.round(F.col("lost") / F.col("datasets"), 9).alias("lost"))


def removal_orders(results: DataFrame, stop_at: float | None = None) -> DataFrame:
    """(method_1, step, method_2, score): the order in which to remove others so that method_1's mean rank falls fastest, and that rank.

    A mean rank is 1 and the sum of what each other method adds to it, so the greedy order is that of the losses, ties by name; all
    methods are searched at once. With stop_at nothing more is removed once the rank is as low as that.
    """
    rows = losses(results)
    w = Window.partitionBy("method_1").orderBy(F.desc("lost"), "method_2")
    later = w.rowsBetween(1, Window.unboundedFollowing)
    out = rows.select("method_1", F.row_number().over(w).alias("step"), "method_2", (1 + F.coalesce(F.sum("lost").over(later), F.lit(0.0))).alias("score"), "lost")
    if stop_at is not None:
        out = out.where(F.col("score") + F.col("lost") > stop_at)
    return out.drop("lost")


def collapsed_variants(board: DataFrame, *keys: str) -> DataFrame:
    """Board with one row a tuned and ensembled method: its tuned and default rows go, its name ends in (T+E); (default) is cut off names left.

    keys: columns besides the method that tell boards apart.
    """
    name = F.col("method")
    base = F.coalesce(*[F.when(F.endswith(name, F.lit(s)), F.substr(name, F.lit(1), F.length(name) - len(s))) for s in (ENSEMBLED, TUNED, DEFAULT)], name)
    rows = board.withColumn("_base", base)
    best = rows.where(F.endswith(name, F.lit(ENSEMBLED))).select(*keys, "_base").distinct().withColumn("_best", F.lit(True))
    rows = rows.join(best, [*keys, "_base"], "left")
    lesser = F.endswith(name, F.lit(TUNED)) | F.endswith(name, F.lit(DEFAULT))
    rows = rows.where(~(F.coalesce("_best", F.lit(False)) & lesser))
    shown = F.when(F.endswith(name, F.lit(ENSEMBLED)), F.concat("_base", F.lit(" (T+E)"))).when(F.endswith(name, F.lit(DEFAULT)), F.col("_base")).otherwise(name)
    return rows.withColumn("method", shown).select(*board.columns)


def date_front(rows: DataFrame, date: str, value: str, higher: bool) -> DataFrame:
    """The rows that beat all rows of earlier dates and, of one date, the best; of several such the greatest row.

    Each date's best comes first, so the window sees dates, not rows.
    """
    v = F.col(value) if higher else -F.col(value)
    days = rows.where(v.isNotNull()).groupBy(date).agg(F.max(F.struct(v.alias("v"), F.struct(*rows.columns).alias("row"))).alias("best"))
    before = Window.orderBy(date).rowsBetween(Window.unboundedPreceding, -1)
    front = days.withColumn("_before", F.max("best.v").over(before)).where("_before is null or best.v > _before")
    return front.select("best.row.*")


def elo_board(rated: DataFrame, anchor: str | None = None, anchor_elo: float = 1000.0, places: int = 1) -> DataFrame:
    """(method, elo, elo_plus, elo_minus) from (method, elo, elo_low, elo_high): bars around the rating, never negative, rounded.

    With an anchor all ratings are shifted so that it has anchor_elo, which leaves the bars as they are; an unknown anchor raises.
    """
    shift = F.lit(0.0)
    if anchor is not None:
        at = rated.where(F.col("method") == anchor).select("elo").first()
        if at is None:
            raise ValueError(f"no rating of {anchor}")
        shift = F.lit(anchor_elo - at[0])
    plus, minus = (F.greatest(x, F.lit(0.0)) for x in (F.col("elo_high") - F.col("elo"), F.col("elo") - F.col("elo_low")))
    return rated.select("method", F.round(F.col("elo") + shift, places).alias("elo"), F.round(plus, places).alias("elo_plus"), F.round(minus, places).alias("elo_minus"))
