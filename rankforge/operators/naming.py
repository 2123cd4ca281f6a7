"""Names of methods, configs and tasks, and how numbers are shown."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What display names end in, by variant.
VARIANTS = {"tuned_ensemble": " (tuned + ensemble)", "tuned": " (tuned)", "default": " (default)"}


def task_name(tid: Column, fold: Column) -> Column:
    return F.concat_ws("_", tid, fold)


def task_parts(task: Column) -> tuple[Column, Column]:
    """(tid, fold) of a task name; null where it is none."""
    parts = F.split(task, "_")
    return F.try_element_at(parts, F.lit(1)).try_cast("int"), F.try_element_at(parts, F.lit(2)).try_cast("int")


def base_name(config: Column) -> Column:
    """A config's name without the last _BAG_ and what follows it."""
    return F.regexp_replace(config, "^(.*)_BAG_.*$", "$1")


def display_name(method: Column, variant: Column) -> Column:
    return F.concat(method, F.coalesce(*[F.when(variant == k, F.lit(v)) for k, v in VARIANTS.items()], F.lit("")))


def tuning_variant(name: Column) -> tuple[Column, Column]:
    """(method, variant) of a display name; the variant is null where the name ends in none of VARIANTS."""
    method, kind = name, F.lit(None).cast("string")
    for k, v in reversed(VARIANTS.items()):
        ends = F.endswith(name, F.lit(v))
        method, kind = F.when(ends, F.substr(name, F.lit(1), F.length(name) - len(v))).otherwise(method), F.when(ends, k).otherwise(kind)
    return method, kind


def time_suffix(seconds: Column) -> Column:
    """A time limit as names end in it, like ` (4h)`, ` (1.50h)` or ` (30m)`: hours from one hour on, else minutes; two decimals unless
    whole; empty for none or zero."""
    unit = F.when(seconds >= 3600, 3600).otherwise(60)
    whole = seconds % unit == 0
    number = F.when(whole, F.floor(seconds / unit).cast("string")).otherwise(F.replace(F.format_number((seconds / unit).cast("double"), 2), F.lit(","), F.lit("")))
    return F.when(F.coalesce(seconds, F.lit(0)) == 0, F.lit("")).otherwise(F.concat(F.lit(" ("), number, F.when(seconds >= 3600, "h)").otherwise("m)")))


def interval(text: Column) -> tuple[Column, Column]:
    """(up, down) of an interval written as +106/-103; null where it is none."""
    shape = r"^\+?([0-9.]+)/-([0-9.]+)$"
    return F.regexp_extract(text, shape, 1).try_cast("double"), F.regexp_extract(text, shape, 2).try_cast("double")


def significant(x: Column, digits: int) -> Column:
    """x to so many significant digits, but never rounded before the point; null where it isn't finite."""
    # The largest double has 309 digits before the point; places behind it are as many as are left.
    places = F.greatest(F.lit(0), digits - 1 - F.floor(F.log10(F.abs(x))))
    power = F.pow(F.lit(10.0), places)
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.when(finite, F.when(x == 0, 0.0).otherwise(F.rint(x * power) / power))


def group_key(columns: Sequence[Column]) -> Column:
    """Columns joined by _, nulls written as nan."""
    return F.concat_ws("_", *[F.coalesce(c.cast("string"), F.lit("nan")) for c in columns])


def two_classes(probability: Column) -> Column:
    """Probabilities of both classes from those of the second."""
    return F.transform(probability, lambda p: F.array(1 - p, p))


def renamed(methods: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """methods with `method` renamed by the longest prefix in names that it begins with; others stay. Names are few and given by the caller."""
    out = F.col("method")
    for prefix in sorted(names, key=len):
        out = F.when(F.startswith(F.col("method"), F.lit(prefix)), F.concat(F.lit(names[prefix]), F.substr(F.col("method"), F.lit(len(prefix) + 1)))).otherwise(out)
    return methods.withColumn("method", out)


def family(name: Column, prefixes: Mapping[str, Sequence[str]], systems: Sequence[str] = (), other: str = "other") -> Column:
    """The family whose longest prefix the name begins with, in any case and without a leading TA-; systems are told by their whole name."""
    bare = F.regexp_replace(F.upper(name), "^TA-", "")
    out = F.lit(other)
    for prefix, kind in sorted(((p.upper(), k) for k, ps in prefixes.items() for p in ps), key=lambda x: len(x[0])):
        out = F.when(F.startswith(bare, F.lit(prefix)), kind).otherwise(out)
    return F.when(name.isin(list(systems)), "system").otherwise(out) if systems else out


def default_configs(configs: DataFrame, first_if_missing: bool = False) -> DataFrame:
    """(type, config) of the default config of each type in configs (type, config, place); place gives the order of configs.

    The only config with a part `_c1`, that is one that ends in it or has `_c1_` inside. Of several, those that end in it; without any,
    those with the shortest rest behind their last `_c1_`; of these the first by name. With no such config the first in order with a
    part `_r1`. With none of these either no row, or the first config in order if asked for.
    """
    def part(tag: str) -> Column:
        return F.contains("config", F.lit(f"{tag}_")) | F.endswith("config", F.lit(tag))

    rest = F.when(F.endswith("config", F.lit("_c1")), -1).otherwise(F.length(F.substring_index("config", "_c1_", -1)))
    c1 = F.min(F.when(part("_c1"), F.struct(rest.alias("rest"), "config"))).getField("config")
    r1 = F.min(F.when(part("_r1"), F.struct("place", "config"))).getField("config")
    found = [c1, r1] + ([F.min(F.struct("place", "config")).getField("config")] if first_if_missing else [])
    return configs.groupBy("type").agg(F.coalesce(*found).alias("config")).where("config is not null")


def without_prefixes(methods: DataFrame, prefixes: Sequence[str]) -> DataFrame:
    """The rows whose method begins with none of the prefixes."""
    keep = F.lit(True)
    for p in prefixes:
        keep = keep & ~F.startswith(F.col("method"), F.lit(p))
    return methods.where(keep)


def top_methods(board: DataFrame, place: str, n: int | None) -> DataFrame:
    """The rows of the first n methods of a composite, in the order of their first row by `place`; all rows for no n or one below 1.
    The limit is the feature."""
    if not n or n <= 0:
        return board
    first = board.groupBy("method").agg(F.min(place).alias("_first")).orderBy("_first").limit(n)
    return board.join(first.select("method"), "method", "left_semi")


def ordered_subsets(present: DataFrame, preferred: Sequence[str]) -> DataFrame:
    """(subset, position): preferred ones in their order, then the others by name."""
    place = F.coalesce(*[F.when(F.col("subset") == s, F.lit(i)) for i, s in enumerate(preferred)], F.lit(len(preferred)))
    # One row a name of a subset: few, whatever the results.
    return present.select("subset").distinct().select("subset", F.row_number().over(Window.orderBy(place, "subset")).alias("position"))
