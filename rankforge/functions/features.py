"""Feature tables: group aggregates, calendar parts, cleaned text and time intervals."""

from __future__ import annotations

import math
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from rankforge.sources.stored import bounded_batches


def group_features(rows: DataFrame, key: str, value: str, category: str, order: str) -> DataFrame:
    """(key, value_mean, value_std, value_min, value_max, value_last, category_count, category_nunique): one row a group.

    The last value is that of the highest (order, value).
    """
    v = F.col(value)
    return rows.groupBy(key).agg(
        F.avg(v).alias(f"{value}_mean"), F.stddev_samp(v).alias(f"{value}_std"), F.min(v).alias(f"{value}_min"), F.max(v).alias(f"{value}_max"),
        F.max(F.struct(order, value)).getField(value).alias(f"{value}_last"), F.count(category).alias(f"{category}_count"), F.count_distinct(category).alias(f"{category}_nunique"),
    )


def calendar(rows: DataFrame, ts: str, key: str) -> DataFrame:
    """(key, year, month, day, weekday, hour, minute): weekday 0 is Monday."""
    t = F.col(ts)
    return rows.select(key, *[f(t).cast("int").alias(n) for f, n in ((F.year, "year"), (F.month, "month"), (F.dayofmonth, "day"))], F.weekday(t).cast("int").alias("weekday"), F.hour(t).cast("int").alias("hour"), F.minute(t).cast("int").alias("minute"))


@F.arrow_udf(StringType())
def compatible(text: pa.Array) -> pa.Array:
    """Unicode normal form KC, which no built-in function gives; texts are taken one by one."""
    return pa.array((unicodedata.normalize("NFKC", x.as_py()) if x.is_valid else None for x in text), pa.string(), size=len(text))


def clean_text(rows: DataFrame, text: str, key: str, missing: str = "Missing Data") -> DataFrame:
    """(key, clean): form KC, no control characters, trimmed, runs of white space as one space, lower case; nulls are `missing`.

    Texts of ASCII are in form KC as they are; only others go to Python, a few hundred at a time.
    """
    bounded_batches(rows.sparkSession)
    t = F.coalesce(F.col(text), F.lit(missing))
    # A function of Python sees all rows whatever stands around it, so what needn't go there is null to it.
    whole = F.coalesce(compatible(F.when(t.rlike(r"[^\x00-\x7F]"), t)), t)
    plain = F.regexp_replace(whole, r"[\x00-\x08\x0e-\x1f\x7f]", "")
    spaced = F.regexp_replace(F.regexp_replace(plain, r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " ")
    return rows.select(key, F.lower(spaced).alias("clean"))


#: Calendar parts and how many units their circle has.
CIRCLES = {"month": 12, "day": 30, "weekday": 7, "hour": 24}


def circular_calendar(rows: DataFrame, ts: str, key: str) -> DataFrame:
    """(key, year, total_seconds, month, day, weekday and hour as points on circles): weekday 1 is Monday; nulls stay null."""
    t = F.col(ts)
    parts = {"month": F.month(t), "day": F.dayofmonth(t), "weekday": F.weekday(t) + 1, "hour": F.hour(t)}
    points = [f(2 * math.pi * parts[c] / F.lit(float(n))).alias(f"{c}_{i}") for c, n in CIRCLES.items() for i, f in enumerate((F.sin, F.cos))]
    return rows.select(key, F.year(t).cast("int").alias("year"), (F.unix_micros(t.cast("timestamp")) / F.lit(1e6)).alias("total_seconds"), *points)


def time_intervals(rows: DataFrame, ts: str, parts: int) -> DataFrame:
    """(interval, first, last, rows): contiguous intervals of about equal size; rows of one instant stay together.

    Counts a day come first, so the window sees days, not rows.
    """
    days = rows.groupBy(F.to_date(ts).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    placed = days.withColumn("interval", F.floor(F.coalesce(F.sum("n").over(w), F.lit(0)) * parts / total).cast("int"))
    return placed.groupBy("interval").agg(F.min("day").alias("first"), F.max("day").alias("last"), F.sum("n").alias("rows"))
