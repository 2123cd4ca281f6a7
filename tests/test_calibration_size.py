"""Temperatures where one key has nearly all rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankforge.operators import calibration


def scores(spark, n):
    p = F.array(*[(F.pmod(F.xxhash64(F.lit(i), "id"), F.lit(97)) + 1) / F.lit(300.0) for i in range(3)])
    return spark.range(n).select(F.when(F.col("id") % 50 == 0, F.lit("few")).otherwise("hot").alias("k"), p.alias("p"), (F.col("id") % 3).cast("int").alias("y"))


def test_few_keys_are_not_shuffled_by_key(spark):
    rows = calibration.slope_sums(scores(spark, 100).select(F.col("k").alias("key"), F.lit(-16.0).alias("low"), calibration.logits(F.col("p")).alias("z"), "y"), 32.0, 32)
    got = rows.groupBy("key", "i").agg(F.sum("n").alias("n")).collect()
    assert len(got) == 2 * 31 and {(r["key"], r["n"]) for r in got} == {("hot", 98), ("few", 2)}
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()


def test_many_keys_and_parts_missing(spark, monkeypatch):
    rows = scores(spark, 300).unionByName(spark.createDataFrame([("hot", [0.5, None], 0), ("void", [None, 0.5], 1), (None, [0.5, 0.5], 1)], "k string, p array<double>, y int"))
    few = {r.k: r.invtemp for r in calibration.temperatures(rows, "k").collect()}
    monkeypatch.setattr(calibration, "MOST_KEYS", 0)
    many = {r.k: r.invtemp for r in calibration.temperatures(rows, "k").collect()}
    assert set(few) == {"hot", "few"} and few == pytest.approx(many)
    z = np.log(np.array([r.p for r in scores(spark, 300).where("k = 'hot'").collect()]) + 1e-10)
    y = np.array([r.y for r in scores(spark, 300).where("k = 'hot'").collect()])

    def slope(t):
        e = np.exp(t * z - (t * z).max(axis=1, keepdims=True))
        return ((z * e).sum(axis=1) / e.sum(axis=1) - z[np.arange(len(y)), y]).mean()

    assert slope(few["hot"] * (1 - 1e-6)) <= 0 <= slope(few["hot"] * (1 + 1e-6)) or few["hot"] < 1e-6
