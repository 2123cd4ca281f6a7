"""Queries over names, sets of tasks and merges, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankforge.operators import collection, naming, pertask, stability
from rankforge.plans.registry import RANKED_SQL, query
from rankforge.sources.derived import RESULTS_SQL, SCORES_SQL, TASKS_SQL, results, scores, table, tasks

SOME = ["Brand#11", "Brand#12", "Brand#13"]
FAMILIES = {"tree": ["Brand#1", "Brand#21"], "net": ["brand#2"], "linear": ["BRAND#3", "Brand#35"]}
RENAMES = {"Brand#1": "One", "Brand#11": "OneOne", "Brand#2": "Two"}


@query("SELECT n_nationkey || '_' || n_regionkey AS task, n_nationkey AS tid, n_regionkey AS fold FROM nation")
def task_names(spark, d):
    named = table(spark, d, "nation").select(naming.task_name(F.col("n_nationkey"), F.col("n_regionkey")).alias("task"))
    tid, fold = naming.task_parts(F.col("task"))
    return named.select("task", tid.alias("tid"), fold.alias("fold"))


@query("SELECT p_partkey, regexp_replace(p_brand || '_BAG_' || p_type || CASE WHEN p_size % 2 = 0 THEN '_BAG_L1' ELSE '' END, '^(.*)_BAG_.*$', '\\1') AS base FROM part")
def config_base_names(spark, d):
    name = F.concat("p_brand", F.lit("_BAG_"), "p_type", F.when(F.col("p_size") % 2 == 0, "_BAG_L1").otherwise(""))
    return table(spark, d, "part").select("p_partkey", naming.base_name(name).alias("base"))


@query("SELECT method, fold, method || CASE fold WHEN 0 THEN ' (default)' WHEN 1 THEN ' (tuned)' ELSE ' (tuned + ensemble)' END AS name, method AS base, CASE fold WHEN 0 THEN 'default' WHEN 1 THEN 'tuned' ELSE 'tuned_ensemble' END AS variant FROM (SELECT DISTINCT method, fold FROM results)", RESULTS_SQL)
def display_names(spark, d):
    kind = F.when(F.col("fold") == 0, "default").when(F.col("fold") == 1, "tuned").otherwise("tuned_ensemble")
    named = results(spark, d).select("method", "fold").distinct().withColumn("name", naming.display_name(F.col("method"), kind))
    base, variant = naming.tuning_variant(F.col("name"))
    return named.select("method", "fold", "name", base.alias("base"), variant.alias("variant"))


@query("SELECT o_orderkey, o_orderpriority || CASE WHEN s = 0 THEN '' WHEN s >= 3600 THEN ' (' || CASE WHEN s % 3600 = 0 THEN (s // 3600)::VARCHAR ELSE printf('%.2f', s / 3600.0::DOUBLE) END || 'h)' ELSE ' (' || CASE WHEN s % 60 = 0 THEN (s // 60)::VARCHAR ELSE printf('%.2f', s / 60.0::DOUBLE) END || 'm)' END AS name FROM (SELECT *, (o_orderkey * 450) % 36000 + CASE WHEN o_orderkey % 7 = 0 THEN 36 ELSE 0 END AS s FROM orders)")
def names_with_hours(spark, d):
    seconds = (F.col("o_orderkey") * 450) % 36000 + F.when(F.col("o_orderkey") % 7 == 0, 36).otherwise(0)
    return table(spark, d, "orders").select("o_orderkey", F.concat("o_orderpriority", naming.time_suffix(seconds)).alias("name"))


@query("SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size::DOUBLE END AS up, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size / 2.0::DOUBLE END AS down FROM part")
def interval_texts(spark, d):
    text = F.when(F.col("p_size") % 5 == 0, "none").otherwise(F.concat(F.lit("+"), F.col("p_size"), F.lit("/-"), F.col("p_size") / 2))
    up, down = naming.interval(text)
    return table(spark, d, "part").select("p_partkey", up.alias("up"), down.alias("down"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN x = 0 THEN 0.0::DOUBLE ELSE round(round_even(x * pow(10.0::DOUBLE, p), 0) / pow(10.0::DOUBLE, p), 9) END AS shown FROM (SELECT *, greatest(0, 2 - floor(log10(abs(x)))) AS p FROM (SELECT *, l_extendedprice * l_discount / (1 + l_linenumber * l_linenumber) AS x FROM lineitem))")
def significant_digits(spark, d):
    x = F.col("l_extendedprice") * F.col("l_discount") / (1 + F.col("l_linenumber") * F.col("l_linenumber"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", naming.significant(x, 3).alias("shown"))


@query("SELECT doc_id, coalesce(lang, 'nan') || '_' || coalesce(source, 'nan') || '_' || (n_chars % 3) AS key FROM documents")
def composite_keys(spark, d):
    return table(spark, d, "documents").select("doc_id", naming.group_key([F.col("lang"), F.col("source"), F.col("n_chars") % 3]).alias("key"))


@query("SELECT doc_id, round(1 - score, 9) AS p0, round(score, 9) AS p1 FROM scores", SCORES_SQL)
def class_probabilities(spark, d):
    both = naming.two_classes(F.array("score"))
    return scores(spark, d).select("doc_id", both[0][0].alias("p0"), both[0][1].alias("p1"))


@query("SELECT event_id, epoch_us(ts) AS micros FROM events")
def datetime_micros(spark, d):
    return table(spark, d, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"))


@query("SELECT DISTINCT method AS old, CASE WHEN starts_with(method, 'Brand#11') THEN 'OneOne' || substr(method, 9) WHEN starts_with(method, 'Brand#1') THEN 'One' || substr(method, 8) WHEN starts_with(method, 'Brand#2') THEN 'Two' || substr(method, 8) ELSE method END AS method FROM results", RESULTS_SQL)
def renamed_methods(spark, d):
    return naming.renamed(results(spark, d).select("method").distinct().withColumn("old", F.col("method")), RENAMES)


@query("SELECT DISTINCT method, CASE WHEN method = 'Brand#55' THEN 'system' WHEN starts_with(method, 'Brand#21') OR starts_with(method, 'Brand#1') THEN 'tree' WHEN starts_with(method, 'Brand#2') THEN 'net' WHEN starts_with(method, 'Brand#3') THEN 'linear' ELSE 'other' END AS family FROM results", RESULTS_SQL)
def method_families(spark, d):
    return results(spark, d).select("method").distinct().select("method", naming.family(F.col("method"), FAMILIES, ["Brand#55"]).alias("family"))


DEFAULTS_SQL = """configs AS (SELECT p_brand || p_type AS type, p_partkey AS place, 'X' || p_partkey % 13 || CASE p_partkey % 4 WHEN 0 THEN '_c' ELSE '_r' END || (1 + p_size % 3) || CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN '_BAG_L1' ELSE '_B' END AS config FROM part),
  marked AS (SELECT *, config LIKE '%\\_c1' ESCAPE '\\' AS c_end, contains(config, '_c1_') AS c_in, config LIKE '%\\_r1' ESCAPE '\\' OR contains(config, '_r1_') AS r FROM configs),
  picked AS (SELECT type, coalesce(min(config) FILTER (WHERE c_end), arg_min(config, (length(config) - strpos(config, '_c1_'), config)) FILTER (WHERE c_in), arg_min(config, place) FILTER (WHERE r)) AS config FROM marked GROUP BY 1)"""


@query("SELECT type, config FROM picked WHERE config IS NOT NULL", DEFAULTS_SQL)
def default_configs(spark, d):
    tail = F.when(F.col("p_partkey") % 3 == 0, "").when(F.col("p_partkey") % 3 == 1, "_BAG_L1").otherwise("_B")
    name = F.concat(F.lit("X"), (F.col("p_partkey") % 13).cast("string"), F.when(F.col("p_partkey") % 4 == 0, "_c").otherwise("_r"), (1 + F.col("p_size") % 3).cast("string"), tail)
    return naming.default_configs(table(spark, d, "part").select(F.concat("p_brand", "p_type").alias("type"), F.col("p_partkey").alias("place"), name.alias("config")))


@query("SELECT method, dataset, fold FROM results WHERE NOT starts_with(method, 'Brand#1') AND NOT starts_with(method, 'Brand#32')", RESULTS_SQL)
def methods_without_prefixes(spark, d):
    return naming.without_prefixes(results(spark, d), ["Brand#1", "Brand#32"]).select("method", "dataset", "fold")


@query("SELECT method, dataset, fold FROM results WHERE method IN (SELECT method FROM results GROUP BY 1 ORDER BY min(metric_error * 1000 + fold), method LIMIT 5)", RESULTS_SQL)
def top_methods(spark, d):
    # The place of a row in the composite: lower errors come first.
    placed = results(spark, d).withColumn("place", F.struct((F.col("metric_error") * 1000 + F.col("fold")).alias("e"), "method"))
    return naming.top_methods(placed, "place", 5).select("method", "dataset", "fold")


@query("SELECT problem_type AS subset, CASE problem_type WHEN 'regression' THEN 1 WHEN 'binary' THEN 2 ELSE 3 END AS position FROM (SELECT DISTINCT problem_type FROM tasks)", TASKS_SQL)
def ordered_subsets(spark, d):
    return naming.ordered_subsets(tasks(spark, d).select(F.col("problem_type").alias("subset")), ["none", "regression"])


THINNER_SQL = "few AS (SELECT * FROM results WHERE n % 7 <> 0)"


def thinner(spark, d):
    return results(spark, d).where("n % 7 <> 0")


@query("SELECT dataset, count(DISTINCT method) = 3 AS every FROM few WHERE method IN ('Brand#11', 'Brand#12', 'Brand#13') GROUP BY 1", RESULTS_SQL, THINNER_SQL)
def shared_datasets(spark, d):
    any_, every = (collection.shared_datasets(thinner(spark, d), SOME, union) for union in (True, False))
    return any_.join(every.withColumn("every", F.lit(True)), "dataset", "left").select("dataset", F.coalesce("every", F.lit(False)).alias("every"))


@query("SELECT dataset, array_to_string(list_sort(list(DISTINCT fold)), ',') AS folds FROM few GROUP BY 1", RESULTS_SQL, THINNER_SQL)
def dataset_folds(spark, d):
    return collection.folds_of(thinner(spark, d)).select("dataset", F.array_join(F.col("folds").cast("array<string>"), ",").alias("folds"))


@query("SELECT dataset, fold FROM few WHERE method = 'Brand#11' INTERSECT SELECT dataset, fold FROM few WHERE method = 'Brand#12' INTERSECT SELECT dataset, fold FROM few WHERE method = 'Brand#13'", RESULTS_SQL, THINNER_SQL)
def common_tasks(spark, d):
    return collection.common_tasks(*[thinner(spark, d).where(F.col("method") == m) for m in SOME])


@query("SELECT method, dataset, fold, (dataset, fold) IN (SELECT (dataset, fold) FROM few WHERE method = 'Brand#11') AS valid FROM results", RESULTS_SQL, THINNER_SQL)
def tasks_in_frame(spark, d):
    return collection.in_frame(results(spark, d), thinner(spark, d).where("method = 'Brand#11'")).select("method", "dataset", "fold", "valid")


@query("SELECT n_name, n_regionkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def strict_merges(spark, d):
    left = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "n_regionkey", F.col("r_name").alias("name"))
    right = table(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("name"), "r_name")
    return collection.strict_merge(left, right, ["n_regionkey"]).select("n_name", "n_regionkey", "r_name")


@query("SELECT DISTINCT method, substr(method, 7, 1) AS maker FROM results", RESULTS_SQL)
def method_info(spark, d):
    return collection.method_info(results(spark, d).withColumn("maker", F.substring("method", 7, 1)), ["maker"])


DRAWS_SQL = "draws AS (SELECT r.range AS round, dataset, ('0x' || md5(dataset || ':' || r.range)[1:4])::INT % 4 AS times FROM (SELECT DISTINCT dataset FROM results), range(8) r)"


@query("SELECT round, method, round(sum(metric_error * times / n), 9) AS mean FROM (SELECT dataset, method, avg(metric_error) AS metric_error FROM results GROUP BY 1, 2) JOIN draws USING (dataset) JOIN (SELECT round, sum(times)::DOUBLE AS n FROM draws GROUP BY 1) USING (round) GROUP BY 1, 2", RESULTS_SQL, DRAWS_SQL)
def bootstrap_means(spark, d):
    means = results(spark, d).groupBy("dataset", "method").agg(F.avg("metric_error").alias("metric_error"))
    rounds = means.select("dataset").distinct().withColumn("round", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))))
    times = F.conv(F.substring(F.md5(F.concat("dataset", F.lit(":"), "round")), 1, 4), 16, 10).cast("int") % 4
    return collection.weighted_mean(means, rounds.withColumn("times", times), "metric_error")


@query("SELECT method, round(avg(metric_error), 9) AS mean, round(median(metric_error), 9) AS median, round(stddev_samp(metric_error), 9) AS std FROM results GROUP BY 1", RESULTS_SQL)
def method_spread(spark, d):
    return collection.spread(results(spark, d), "metric_error")


@query("SELECT method, dataset, fold, round(time_infer_s * 1000 / k, 9) AS time_infer_s_per_1k FROM results JOIN (SELECT dataset, sum(n) AS k FROM results GROUP BY 1) USING (dataset)", RESULTS_SQL)
def time_per_thousand(spark, d):
    r = results(spark, d)
    return collection.per_thousand(r, r.groupBy("dataset").agg(F.sum("n").alias("n_test"))).select("method", "dataset", "fold", "time_infer_s_per_1k")


@query("SELECT a.dataset, round(avg(abs(a.rank - b.rank)), 9) AS jitter FROM ranked a JOIN ranked b ON a.dataset = b.dataset AND a.method = b.method AND a.fold < b.fold WHERE (a.dataset, a.method) IN (SELECT (dataset, method) FROM results JOIN (SELECT dataset, count(DISTINCT fold) AS k FROM results GROUP BY 1) USING (dataset) GROUP BY dataset, method, k HAVING count(*) = k) GROUP BY 1", RESULTS_SQL, RANKED_SQL)
def pairwise_jitter(spark, d):
    return collection.pairwise_jitter(pertask.per_task(results(spark, d)))


@query("SELECT dataset, round(rho, 6) AS rho, row_number() OVER (ORDER BY rho DESC, dataset)::INT AS place FROM (SELECT dataset, avg(s) AS rho FROM (SELECT a.dataset, a.fold, b.fold, corr(a.rank, b.rank) AS s FROM ranked a JOIN ranked b ON a.dataset = b.dataset AND a.method = b.method AND a.fold < b.fold GROUP BY 1, 2, 3) GROUP BY 1)", RESULTS_SQL, RANKED_SQL)
def datasets_by_similarity(spark, d):
    r = results(spark, d)
    out = collection.similarity_order(stability.fold_stability(stability.fold_similarity(r, "metric_error", spearman=True), r))
    return out.select("dataset", F.round("rho", 6).alias("rho"), "place")
