"""Leaderboards of every cell of a grid of subsets, in one plan.

A cell is a pool of entrants, imputation or none, kinds of problems, sizes of datasets, and all splits or the first. What a method's
rank is depends on the field it competes in only, and many cells have the same field: ranks are computed once a field and task, and
averaged over the datasets of each cell.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankforge.operators import pertask
from rankforge.sources.stored import stored

#: The axes of the grid, and the tag that a category of systems stands for (none for systems without tags).
CATEGORIES = {"open": None, "llm": "with_llm", "api": "closed_source_api"}
KINDS = {"all": "true", "classification": "problem_type in ('binary', 'multiclass')", "regression": "problem_type = 'regression'", "binary": "problem_type = 'binary'", "multiclass": "problem_type = 'multiclass'"}
SIZES = {"all": "true", "small": "n_train <= 10000", "medium": "n_train > 10000 and n_train <= 100000"}
SPLITS = ("all", "lite")

POOLS = {"_".join(some) or "models": some for n in range(len(CATEGORIES) + 1) for some in combinations(CATEGORIES, n)}
AXES = ["entrants", "imputation", "splits", "tasks", "datasets"]


def cells(spark) -> DataFrame:
    """(entrants, imputation, splits, tasks, datasets, path) of every cell; path is the folder of its artifacts."""
    def each(values) -> Column:
        return F.array(*[F.lit(v) for v in values])

    out = spark.range(1).select(F.explode(each(POOLS)).alias("entrants"))
    for name, values in (("imputation", ("no", "yes")), ("splits", SPLITS), ("tasks", KINDS), ("datasets", SIZES)):
        out = out.withColumn(name, F.explode(each(values)))
    return out.withColumn("path", F.concat(F.lit("website_data"), *[F.concat(F.lit(f"/{a}_"), F.col(a)) for a in AXES]))


def admits(pool: str, method_class: Column, tags: Column) -> Column:
    """Whether a pool takes a method: models always; a system if it has tags that are all allowed, or none and these are allowed."""
    allowed = [CATEGORIES[c] for c in POOLS[pool] if CATEGORIES[c]]
    own = F.coalesce(tags, F.array().cast("array<string>"))
    outside = F.size(F.array_except(own, F.array(*map(F.lit, allowed)).cast("array<string>")))
    plain = F.lit(any(CATEGORIES[c] is None for c in POOLS[pool]))
    return F.coalesce(method_class != "system", F.lit(True)) | F.when(F.size(own) == 0, plain).otherwise(outside == 0)


def matching(frame: DataFrame, conditions: dict[str, Column], name: str) -> DataFrame:
    """frame with `name`: a row for each condition that holds."""
    marks = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in conditions.items()]))
    return frame.withColumn(name, F.explode(marks))


def dataset_cells(tasks: DataFrame) -> DataFrame:
    """(dataset, tasks, datasets): a row for each kind and size that a dataset belongs to."""
    kinds = matching(tasks, {k: F.expr(c) for k, c in KINDS.items()}, "tasks")
    return matching(kinds, {k: F.expr(c) for k, c in SIZES.items()}, "datasets").select("dataset", "tasks", "datasets").distinct()


def fields(results: DataFrame, tasks: DataFrame, methods: DataFrame) -> DataFrame:
    """(entrants, imputation, splits, tasks, datasets, method): who competes in each cell.

    Without imputation those that miss no task of the cell; with it those that do not miss all of them. A method that methods does not
    name counts as a model.
    """
    missed = F.coalesce("imputed", F.lit(False)).cast("int")
    first = F.col("fold") == 0
    # The parts of a cell are datasets and the first split, so results shrink to sums before they meet cells.
    sums = results.groupBy("method", "dataset").agg(
        F.struct(F.sum(missed).alias("missed"), F.count(F.lit(1)).alias("n")).alias("all"), F.struct(F.sum(F.when(first, missed)).alias("missed"), F.count_if(first).alias("n")).alias("lite")
    )
    by_splits = sums.select("method", "dataset", F.explode(F.array(*[F.struct(F.lit(s).alias("splits"), F.col(f"{s}.missed"), F.col(f"{s}.n")) for s in SPLITS])).alias("x"))
    within = by_splits.select("method", "dataset", "x.*").where("n > 0").join(dataset_cells(tasks), "dataset")
    share = within.groupBy("splits", "tasks", "datasets", "method").agg((F.sum("missed") / F.sum("n")).alias("share"))
    played = matching(share, {"no": F.col("share") <= 0, "yes": F.col("share") < 1}, "imputation")
    known = played.join(methods.select("method", "method_class", "tags"), "method", "left")
    return matching(known, {p: admits(p, F.col("method_class"), F.col("tags")) for p in POOLS}, "entrants").select(*AXES, "method")


def grid_leaderboards(results: DataFrame, tasks: DataFrame, methods: DataFrame) -> DataFrame:
    """(path, method, n_methods, n_datasets, rank, winrate, improvability, mrr, metric_error) of every method in every cell it plays in.

    results (method, dataset, fold, metric_error, imputed) holds a row for every method and task; tasks (dataset, problem_type,
    n_train); methods (method, method_class, tags). Cells without methods have no rows. Folds are averaged within a dataset.
    """
    results = stored(results.select("method", "dataset", "fold", "metric_error", "imputed"), "results")
    members = stored(fields(results, tasks, methods), "fields")
    # Cells whose fields have the same members share an id: their number and two independent sums of hashes.
    ids = members.groupBy(*AXES).agg(F.count(F.lit(1)).alias("n_methods"), F.bit_xor(F.xxhash64("method")).alias("h1"), F.bit_xor(F.xxhash64(F.lit("field"), "method")).alias("h2"))
    ids = ids.withColumn("field", F.concat_ws(":", "n_methods", "h1", "h2"))
    rosters = members.join(ids, AXES).select("field", "n_methods", "method").distinct()
    ranked = pertask.per_task(results.select("method", "dataset", "fold", "metric_error").join(rosters, "method"), ("field", "dataset", "fold"))
    lost = F.coalesce(F.try_divide(F.col("rank") - 1, F.col("n_methods") - 1), F.lit(0.5))
    values = {"rank": F.col("rank"), "winrate": 1 - lost, "improvability": F.col("improvability"), "mrr": 1 / F.col("rank"), "metric_error": F.col("metric_error")}
    means = ranked.groupBy("field", "method", "dataset").agg(
        F.struct(*[F.avg(v).alias(k) for k, v in values.items()]).alias("all"), F.struct(*[F.avg(F.when(F.col("fold") == 0, v)).alias(k) for k, v in values.items()]).alias("lite")
    )
    whole = stored(means, "means").select("field", "method", "dataset", F.explode(F.array(*[F.struct(F.lit(s).alias("splits"), F.col(s).alias("x")) for s in SPLITS])).alias("y"))
    whole = whole.select("field", "method", "dataset", "y.splits", "y.x.*").where("rank is not null")
    per_cell = whole.join(dataset_cells(tasks), "dataset").join(ids.select(*AXES, "field", "n_methods"), ["field", "splits", "tasks", "datasets"])
    board = per_cell.groupBy(*AXES, "method").agg(F.first("n_methods").alias("n_methods"), F.count(F.lit(1)).alias("n_datasets"), *[F.avg(k).alias(k) for k in values])
    return board.join(F.broadcast(cells(results.sparkSession)), AXES).select("path", "method", "n_methods", "n_datasets", *values)
