"""Arena boards from ratings with intervals, and what each dataset adds to a rating."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankforge.operators.aggregate import pair_statistics
from rankforge.operators.elo import matrix, ratings
from rankforge.sources.stored import stored


def rank_confidence(bars: DataFrame) -> DataFrame:
    """bars (method, rating, lower, upper, ...) with arena_rank, in the order of ratings, the first name among equals.

    A new rank, the place itself, opens only where an interval ends below the lower bound of the method that opened the rank before. The
    scan carries that bound along a sorted array of the methods, which the benchmark fixes.
    """
    bars = stored(bars, "bars")
    order = F.sort_array(F.collect_list(F.struct((-F.col("rating")).alias("at"), "method", "lower", "upper")))
    start = F.struct(F.lit(0).alias("place"), F.lit(0).alias("rank"), F.lit(None).cast("double").alias("anchor"), F.array().cast("array<struct<method:string,arena_rank:int>>").alias("out"))

    def step(s, x):
        opens = s["anchor"].isNull() | (x["upper"] < s["anchor"])
        rank = F.when(opens, s["place"] + 1).otherwise(s["rank"])
        return F.struct((s["place"] + 1).alias("place"), rank.alias("rank"), F.when(opens, x["lower"]).otherwise(s["anchor"]).alias("anchor"), F.concat(s["out"], F.array(F.struct(x["method"].alias("method"), rank.alias("arena_rank")))).alias("out"))

    scanned = bars.agg(F.aggregate(order, start, step, lambda s: s["out"]).alias("out")).select(F.inline("out"))
    return bars.join(F.broadcast(scanned), "method")


def arena_board(bars: DataFrame, fights: DataFrame) -> DataFrame:
    """(method, elo, interval, battles, wins, winrate, rank_simple, arena_rank) of bars (method, rating, lower, upper) and battles.

    Ratings are rounded to whole numbers, intervals written as +106/-103; wins count ties half and are rounded before the win rate is.
    Halves are rounded to even.
    """
    won = {"method_1": "1", "method_2": "2"}
    sides = [fights.select(F.col(m).alias("method"), F.when(F.col("winner") == w, 1.0).when(F.col("winner") == "tie", 0.5).otherwise(0.0).alias("w")) for m, w in won.items()]
    totals = sides[0].unionByName(sides[1]).groupBy("method").agg(F.count(F.lit(1)).alias("battles"), F.bround(F.sum("w")).cast("long").alias("wins"))

    def whole(c):
        return F.bround(c).cast("long")

    up, down = whole(F.col("upper") - F.col("rating")), whole(F.col("rating") - F.col("lower"))
    shown = bars.select("method", whole(F.col("rating")).alias("elo"), F.col("rating"), "lower", "upper", F.concat(F.lit("+"), up.cast("string"), F.lit("/-"), down.cast("string")).alias("interval"))
    placed = rank_confidence(shown.withColumn("rating", F.col("elo"))).join(totals, "method", "left")
    # A row a method.
    simple = F.rank().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("elo")))
    return placed.select("method", "elo", "interval", "battles", "wins", F.bround(F.col("wins") / F.col("battles"), 2).alias("winrate"), simple.alias("rank_simple"), "arena_rank")


def dataset_contributions(fights: DataFrame) -> DataFrame:
    """(dataset, method, elo, elo_without, contribution): a method's rating with all datasets less that without one of them.

    Sums of a pair over all datasets less those of one give the battles without it, so a fit needs methods^2 rows and all fits run side
    by side, a task each. A method that only fights in the one dataset has no rating without it.
    """
    pairs = stored(pair_statistics(fights, "dataset"), "pairs")
    total = pairs.groupBy("method_1", "method_2").agg(F.sum("s1").alias("t1"), F.sum("s2").alias("t2"), F.count(F.lit(1)).alias("sets"), F.collect_list(F.struct("dataset", "s1", "s2")).alias("own"))
    names = pairs.groupBy(F.lit(1).alias("one")).agg(F.sort_array(F.collect_set("dataset")).alias("names"))
    spread = total.withColumn("one", F.lit(1)).join(F.broadcast(names), "one").withColumn("dataset", F.explode(F.concat("names", F.array(F.lit(None).cast("string")))))
    mine = F.get(F.filter("own", lambda x: x["dataset"] == F.col("dataset")), F.lit(0))
    rest = spread.select("dataset", "method_1", "method_2", (F.col("sets") - mine.isNotNull().cast("int")).alias("left"), *[F.greatest(F.col(f"t{k}") - F.coalesce(mine[f"s{k}"], F.lit(0.0)), F.lit(0.0)).alias(f"s{k}") for k in (1, 2)])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        methods = sorted(set(pdf["method_1"]) | set(pdf["method_2"]))
        return pd.DataFrame({"dataset": [pdf["dataset"].iloc[0]] * len(methods), "method": methods, "elo": ratings(matrix(pdf, methods))})

    fits = rest.where("left > 0").groupBy("dataset").applyInPandas(fit, "dataset string, method string, elo double")
    # The fit of the null dataset leaves none out.
    base = fits.where("dataset is null").select("method", "elo")
    without = fits.where("dataset is not null").select("dataset", "method", F.col("elo").alias("elo_without"))
    return without.join(base, "method").select("dataset", "method", "elo", "elo_without", (F.col("elo") - F.col("elo_without")).alias("contribution"))
