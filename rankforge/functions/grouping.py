"""Aggregates of groups as features of their rows: the most varied ones are chosen and joined back."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

from rankforge.sources.stored import stored

#: The aggregates of numeric columns and of others.
NUMERIC, OTHER = ("mean", "std", "min", "max", "last"), ("count", "last", "nunique")
#: Groups whose features are broadcast, at most.
MOST_GROUPS = 100_000


def codes(values: DataFrame, value: str) -> DataFrame:
    """(value, code): the place of each distinct value in order, from 0. Values are dealt to ranges and numbered behind the ranges before."""
    distinct = values.select(value).where(F.col(value).isNotNull()).distinct()
    ranges = stored(distinct.repartitionByRange(value).withColumn("part", F.spark_partition_id()), "codes")
    # A row a range.
    sizes = ranges.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    starts = sizes.select("part", F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(value)) - 1
    return ranges.withColumn("place", place).join(F.broadcast(starts), "part").select(value, (F.col("start") + F.col("place")).cast("double").alias("code"))


@dataclass(frozen=True)
class GroupFeatures:
    """Fitted features: `selected` names of the form column_aggregate, most varied first; `variances` of all of them."""

    group: tuple[str, ...]
    order: tuple[str, ...]
    selected: tuple[str, ...]
    variances: dict[str, float | None]

    def key(self) -> Column:
        return group_key(self.group)

    def transform(self, rows: DataFrame) -> DataFrame:
        """rows without the group columns, with the selected features of their groups; null for rows without a group.

        Only the aggregates that are needed are computed. Few groups are broadcast; many are joined by key, where adaptive execution
        splits hot ones.
        """
        out = rows.drop(*self.group)
        if not self.selected:
            return out
        features = stored(aggregates(rows, self.group, self.order, self.selected), "groups")
        small = features.limit(MOST_GROUPS + 1).count() <= MOST_GROUPS
        keyed = rows.withColumn("_key", self.key()).drop(*self.group)
        return keyed.join(F.broadcast(features) if small else features, "_key", "left").drop("_key")


def group_key(group: Sequence[str]) -> Column:
    """One column as it is, several joined by _ with nulls written as nan."""
    return F.col(group[0]) if len(group) == 1 else F.concat_ws("_", *[F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in group])


def aggregates(rows: DataFrame, group: Sequence[str], order: Sequence[str], names: Sequence[str]) -> DataFrame:
    """(_key, names): one row a group; the last value is the one that isn't null with the highest order. Rows without a group are left out."""
    def one(name: str) -> Column:
        column, kind = name.rsplit("_", 1)
        c = F.col(column)
        numeric = c.cast("double") if kind in ("mean", "std") else c
        return {
            "mean": F.avg(numeric), "std": F.stddev_samp(numeric), "min": F.min(c), "max": F.max(c), "count": F.count(c), "nunique": F.count_distinct(c),
            "last": F.max(F.when(c.isNotNull(), F.struct(*order, c.alias("_value")))).getField("_value"),
        }[kind]

    return rows.where(group_key(group).isNotNull()).groupBy(group_key(group).alias("_key")).agg(*[one(n).alias(n) for n in names])


def fit_group_features(rows: DataFrame, group: str | Sequence[str], order: str | Sequence[str], most: int = 50, ignore: Sequence[str] = ()) -> GroupFeatures:
    """Chooses the `most` aggregates of the highest variance over rows, ties by name; those without a variance come last.

    Numbers have a mean, deviation, least, greatest and last value; other columns a count, last value and number of distinct values.
    Values that aren't numbers count by their place among all values of their feature. group and ignore columns have no features.
    """
    group, order = ([x] if isinstance(x, str) else list(x) for x in (group, order))
    kinds = {f.name: isinstance(f.dataType, NumericType | BooleanType) for f in rows.schema if f.name not in {*group, *ignore}}
    flags = [f.name for f in rows.schema if isinstance(f.dataType, BooleanType) and f.name in kinds]
    rows = rows.withColumns({c: F.col(c).cast("int") for c in flags}) if flags else rows
    names = [f"{c}_{a}" for c, numeric in kinds.items() for a in (NUMERIC if numeric else OTHER)]
    if not names:
        return GroupFeatures(tuple(group), tuple(order), (), {})
    own = aggregates(rows.withColumn("_one", F.lit(1)), group, order, [*names, "_one_count"])
    groups = stored(own, "groups")
    for c, numeric in kinds.items():
        if not numeric:
            places = codes(groups, f"{c}_last")
            groups = groups.join(places, f"{c}_last", "left").drop(f"{c}_last").withColumnRenamed("code", f"{c}_last")
    n = F.col("_one_count").cast("double")
    values = {f: F.nanvl(F.col(f).cast("double"), F.lit(None)) for f in names}
    # The variance over rows from groups: means first, then squared distances, so that large values lose nothing.
    first = groups.agg(*[(F.sum(v * n) / F.sum(F.when(v.isNotNull(), n))).alias(f) for f, v in values.items()]).first()
    around = {f: (v - F.lit(first[f])) if first[f] is not None else F.lit(None).cast("double") for f, v in values.items()}
    spread = groups.agg(*[F.try_divide(F.sum(d * d * n), F.sum(F.when(d.isNotNull(), n)) - 1).alias(f) for f, d in around.items()]).first()
    variances = {f: spread[f] for f in names}
    ranked = sorted(names, key=lambda f: (variances[f] is None, -(variances[f] or 0.0), f))
    return GroupFeatures(tuple(group), tuple(order), tuple(ranked[:most]), variances)
