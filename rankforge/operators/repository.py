"""What a repository of configurations and baselines tells: its datasets, ids and types, one table of metrics with a fallback's rows where
others are missing, and labels and predictions of several repositories as if they were one."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TASK, CELL = ["dataset", "fold"], ["dataset", "fold", "framework"]
#: Columns that every metrics table has, and those that come along where configurations have them.
METRIC = ["metric_error", "time_train_s", "time_infer_s", "metric", "problem_type"]
AUXILIARY = ["aux_metric", "aux_metric_error", "aux_metric_error_val"]
#: What belongs to a framework, not to its result on a task.
IDENTITY = ["method_type", "config_type"]
#: Share of a dataset's instances that a test batch has.
BATCH = 0.1


def refuse(rows: DataFrame, message: str) -> None:
    """Raises with the first few of the rows, if there are any."""
    found = rows.limit(5).collect()
    if found:
        raise ValueError(f"{message}: {', '.join(str(tuple(r)) for r in found)}")


def union(parts: Sequence[DataFrame | None]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [p for p in parts if p is not None])


def dataset_info(configs: DataFrame, baselines: DataFrame | None = None) -> DataFrame:
    """(dataset, metric, problem_type), a row a dataset. A dataset with several problem types, in one source or between them, is refused."""
    rows = union([x.select("dataset", "metric", "problem_type") for x in (configs, baselines) if x is not None])
    found = rows.groupBy("dataset").agg(F.min("metric").alias("metric"), F.min("problem_type").alias("problem_type"), F.max("problem_type").alias("_other"))
    refuse(found.where("problem_type <> _other").select("dataset", "problem_type", "_other"), "datasets with several problem types")
    return found.drop("_other")


def dataset_ids(configs: DataFrame, baselines: DataFrame | None = None, metadata: DataFrame | None = None) -> DataFrame:
    """(dataset, tid): a source's own ids, else those of the metadata, else places in the sorted list of datasets.

    Refused are a dataset with several ids, an id of several datasets, ids that the metadata contradicts, and, without ids in the
    metadata, sources of which only one has ids.
    """
    sources = [x for x in (configs, baselines) if x is not None]
    known = metadata.select("dataset", "tid") if metadata is not None and "tid" in metadata.columns else None
    if known is None and len({"tid" in x.columns for x in sources}) > 1:
        raise ValueError("either all sources have ids or none has")
    if known is None and "tid" not in configs.columns:
        datasets = union([x.select("dataset") for x in sources]).distinct()
        # A row a dataset.
        return datasets.select("dataset", (F.row_number().over(Window.orderBy("dataset")) - 1).cast("long").alias("tid"))
    ids = union([x.select("dataset", "tid") if "tid" in x.columns else x.select("dataset").distinct().join(known, "dataset", "left") for x in sources]).distinct()
    for one, many in (("dataset", "tid"), ("tid", "dataset")):
        refuse(ids.groupBy(one).agg(F.count_distinct(many).alias("k")).where("k > 1"), f"a {one} with several values of {many}")
    if known is not None:
        other = ids.join(known.withColumnRenamed("tid", "_tid"), "dataset", "left").where(~F.col("tid").eqNullSafe(F.col("_tid")))
        refuse(other, "ids that the metadata does not have")
    return ids


def ids_of(ids: DataFrame, info: DataFrame, problem_type: str | None = None) -> DataFrame:
    """(tid) of the datasets of a problem type, or of all."""
    kept = info if problem_type is None else info.where(F.col("problem_type") == problem_type)
    return ids.join(kept.select("dataset"), "dataset", "left_semi").select("tid")


def config_types(specs: DataFrame) -> DataFrame:
    """(config, config_type) of specs (config, spec), spec being JSON with model_type and hyperparameters; null where it tells none."""
    return specs.select("config", F.get_json_object("spec", "$.model_type").alias("config_type"))


def hyperparameters(specs: DataFrame, with_ag_args: bool = True) -> DataFrame:
    """(config, hyperparameters map<string, string>) of specs, with or without the arguments that only name a model; null without any."""
    known = F.from_json(F.get_json_object("spec", "$.hyperparameters"), "map<string,string>")
    return specs.select("config", (known if with_ag_args else F.map_filter(known, lambda k, _: k != "ag_args")).alias("hyperparameters"))


def reported(results: DataFrame, datasets: Sequence[str] | None = None, folds: Sequence[int] | None = None, methods: Sequence[str] | None = None, problem_types: Sequence[str] | None = None, keep_best: bool = True, banned_types: Sequence[str] = ()) -> DataFrame:
    """The results that a report is made of. None keeps all. Rows without a subtype or a type of config are neither best nor banned."""
    for name, values in (("dataset", datasets), ("fold", folds), ("method", methods), ("problem_type", problem_types)):
        if values is not None:
            results = results.where(F.col(name).isin(list(values)))
    if not keep_best:
        results = results.where(~F.col("method_subtype").eqNullSafe("best"))
    if banned_types:
        results = results.where(~F.coalesce(F.col("config_type").isin(list(banned_types)), F.lit(False)))
    return results


def assemble_metrics(
    configs: DataFrame, baselines: DataFrame | None = None, external: DataFrame | None = None, *, datasets: Sequence[str] | None = None, folds: Sequence[int] | None = None,
    config_names: Sequence[str] | None = None, baseline_names: Sequence[str] | None = None, fallback: str | None = None, extra: bool = False, validation: bool = False, metadata: DataFrame | None = None,
) -> DataFrame:
    """One row a (dataset, fold, framework) of configurations, baselines and external results, with METRIC and what else is asked for.

    Datasets, folds and names restrict the repository's own rows, None keeping all datasets that any configuration has; external results
    stay as they are, and keep their further columns with `extra`. `validation` adds metric_error_val, null where a baseline has none.
    With metadata (dataset, NumberOfInstances) the repository's inference times are those of a test batch instead of a row.

    With a fallback configuration every framework has a row for each task that the fallback has: where its own is missing, the fallback's
    metrics with imputed = true and the fallback's name as impute_method; columns of IDENTITY keep the framework's value.
    """
    if baseline_names and baselines is None:
        raise ValueError(f"no baselines, but {', '.join(baseline_names)} are asked for")
    columns = METRIC + ["metric_error_val"] * validation

    def own(rows: DataFrame, names: Sequence[str] | None, more: Sequence[str] = ()) -> DataFrame:
        if validation and "metric_error_val" not in rows.columns:
            rows = rows.withColumn("metric_error_val", F.lit(None).cast("double"))
        rows = rows.select(*CELL, *columns, *more)
        for name, values in (("dataset", datasets), ("fold", folds), ("framework", names)):
            if values is not None:
                rows = rows.where(F.col(name).isin(list(values)))
        if datasets is None and rows is not configs:
            rows = rows.join(configs.select("dataset").distinct(), "dataset", "left_semi")
        if metadata is not None:
            size = metadata.select("dataset", F.col("NumberOfInstances").alias("_size"))
            rows = rows.join(size, "dataset", "left").withColumn("time_infer_s", F.col("time_infer_s") * F.col("_size") * BATCH).drop("_size")
        return rows

    more = [c for c in AUXILIARY if c in configs.columns]
    if external is not None and not extra:
        external = external.select(*CELL, *METRIC)
    every = union([external, own(configs, config_names, more), None if baselines is None else own(baselines, baseline_names)])
    return every if fallback is None else with_fallback(every, own(configs, [fallback], more), fallback)


def with_fallback(metrics: DataFrame, lent: DataFrame, name: str) -> DataFrame:
    """metrics (dataset, fold, framework, ...) and a copy of the fallback's row of each task for every framework that lacks it, with imputed
    and impute_method. A fallback with two rows for a task, and a framework with two values of an IDENTITY column, are refused."""
    lent = lent.drop("framework")
    refuse(lent.groupBy(*TASK).count().where("count > 1"), f"tasks for which {name} has several rows")
    identity = [c for c in IDENTITY if c in metrics.columns]
    ends = [f(c).alias(f"{m}{c}") for c in identity for m, f in (("", F.min), ("_last_", F.max))]
    frameworks = metrics.groupBy("framework").agg(*ends) if identity else metrics.select("framework").distinct()
    if identity:
        several = reduce(lambda a, b: a | b, [F.col(c) != F.col(f"_last_{c}") for c in identity])
        refuse(frameworks.where(several), f"frameworks with several values of {' or '.join(identity)}")
        frameworks = frameworks.select("framework", *identity)
    # The grid of frameworks and tasks, as the benchmark defines it.
    grid = frameworks.crossJoin(lent.drop(*identity))
    gaps = grid.join(metrics.select(*CELL), CELL, "left_anti")
    kept = metrics.withColumns({"imputed": F.lit(False), "impute_method": F.lit(None).cast("string")})
    return kept.unionByName(gaps.withColumns({"imputed": F.lit(True), "impute_method": F.lit(name)}), allowMissingColumns=True)


def merged_labels(sources: Sequence[DataFrame]) -> DataFrame:
    """Labels (dataset, fold, ...) of several repositories; of a task that more than one has, the rows of the last."""
    rows = union([x.withColumn("_at", F.lit(i)) for i, x in enumerate(sources)])
    last = rows.groupBy(*TASK).agg(F.max("_at").alias("_at"))
    return rows.join(last, [*TASK, "_at"]).drop("_at")


def routes(sources: Sequence[DataFrame], tasks: DataFrame, configs: Sequence[str], fallback: str | None = None, overlap: str = "raise") -> DataFrame:
    """(dataset, fold, place, config, source, lender): which repository has each config's predictions on each task.

    sources: (dataset, fold, config, ...) of each repository; place: the config's place in the list. Of several repositories that have a
    cell the first or the last counts, or it is refused. A config that no repository has there lends the fallback's predictions; a cell
    that the fallback lacks too, or a missing cell without a fallback, is refused.
    """
    cells = union([x.select(*TASK, "config").distinct().withColumn("source", F.lit(i)) for i, x in enumerate(sources)])
    owned = cells.groupBy(*TASK, "config").agg((F.max if overlap == "last" else F.min)("source").alias("source"), F.count(F.lit(1)).alias("_k"))
    if overlap == "raise":
        refuse(owned.where("_k > 1").drop("_k"), "predictions that several repositories have")
    owned = owned.drop("_k")
    wanted = tasks.select(*TASK).distinct().select("*", F.posexplode(F.array(*map(F.lit, configs))).alias("place", "config"))
    found = wanted.join(owned, [*TASK, "config"], "left")
    spare: Column = F.lit(None)
    if fallback is not None:
        found = found.join(owned.where(F.col("config") == fallback).select(*TASK, F.col("source").alias("_spare")), TASK, "left")
        spare = F.col("_spare")
    found = found.select(*TASK, "place", "config", F.coalesce("source", spare).cast("int").alias("source"), F.when(F.col("source").isNotNull(), F.col("config")).otherwise(F.lit(fallback)).alias("lender"))
    refuse(found.where("source is null").select(*TASK, "config"), "no repository has predictions of")
    return found


def routed_predictions(sources: Sequence[DataFrame], tasks: DataFrame, configs: Sequence[str], fallback: str | None = None, overlap: str = "raise") -> DataFrame:
    """Predictions (dataset, fold, config, ...) of the listed configs on all tasks at once, with place, source and lender (see routes)."""
    rows = union([x.withColumnRenamed("config", "lender").withColumn("source", F.lit(i)) for i, x in enumerate(sources)])
    return rows.join(routes(sources, tasks, configs, fallback, overlap), [*TASK, "source", "lender"])


def family_weights(results: DataFrame, types: DataFrame, method: str, excluded: Sequence[str] = (), by_dataset: bool = False) -> DataFrame:
    """Weight of each family of configs in an ensemble, a column a family, the heaviest first; a row a task or, averaged over folds, a dataset.

    results: dataset, fold, method, ensemble_weight (a JSON object of configs and weights); types: config, config_type. Families without any
    weight have 0; null weights count as none; a config of unknown type is refused.
    """
    parts = F.explode_outer(F.from_json("ensemble_weight", "map<string,double>")).alias("config", "weight")
    rows = results.where(F.col("method") == method).select(*TASK, parts).join(types.select("config", "config_type"), "config", "left")
    refuse(rows.where("config is not null and config_type is null").select("config").distinct(), "configs of unknown type")
    # A name a family.
    families = [r[0] for r in types.select("config_type").where("config_type is not null").distinct().collect() if r[0] not in excluded]
    wide = rows.groupBy(*TASK).pivot("config_type", families).agg(F.sum("weight"))
    wide = wide.select(*TASK, *[F.coalesce(F.col(f"`{c}`"), F.lit(0.0)).alias(c) for c in families])
    if by_dataset:
        wide = wide.groupBy("dataset").agg(*[F.avg(F.col(f"`{c}`")).alias(c) for c in families])
    total = wide.agg(*[F.sum(F.col(f"`{c}`")).alias(c) for c in families]).first().asDict() if families else {}
    order = sorted(families, key=lambda c: (-(total[c] or 0), c))
    return wide.select(*[c for c in TASK if c in wide.columns], *[F.col(f"`{c}`") for c in order])
