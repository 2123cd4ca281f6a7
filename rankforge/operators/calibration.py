"""Calibration of probabilities over classes, and decision thresholds, by counting and sums in batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rankforge.sources.stored import stored

#: What is added to a probability before its logarithm, and the bounds of the logarithm of the inverse temperature.
EPS, LOW, HIGH = 1e-10, -16.0, 16.0
#: Bits of the bisection that one pass over the rows settles.
BITS = 5
#: Keys that are broadcast with where their intervals start, at most.
MOST_KEYS = 100_000


def logits(p: Column) -> Column:
    """Logarithms of an array of probabilities."""
    return F.transform(p, lambda x: F.log(x.cast("double") + EPS))


def softmax(z: Column) -> Column:
    """Probabilities of an array of logits, the largest taken off first so that nothing overflows."""
    top = F.array_max(z)
    raised = F.transform(z, lambda x: F.exp(x - top))
    return F.transform(raised, lambda x: x / F.aggregate(raised, F.lit(0.0), lambda a, y: a + y))


def slope_sums(met: DataFrame, width: float, parts: int) -> DataFrame:
    """(key, low, i, total, n): the gradient summed over rows (key, low, z, y) at low + i * width / parts, i from 1 to parts - 1.

    A task sends a row a key and point for each of its batches.
    """

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points = np.arange(1, parts)
        for b in batches:
            if not b.num_rows:
                continue
            keys = b.column("key").dictionary_encode()
            own, n = keys.indices.to_numpy(), len(keys.dictionary)
            low, y = b.column("low").to_numpy(), b.column("y").to_numpy()
            sizes = pc.list_value_length(b.column("z")).to_numpy(zero_copy_only=False)
            ends, flat = np.cumsum(sizes), b.column("z").flatten().to_numpy(zero_copy_only=False)
            lows, totals = np.zeros(n), np.zeros((parts - 1, n))
            lows[own] = low
            # Rows may differ in their number of classes.
            for size in np.unique(sizes):
                some = np.flatnonzero(sizes == size)
                z = flat[(ends[some] - size)[:, None] + np.arange(size)]
                right = z[np.arange(len(some)), y[some]]
                for i in points:
                    scaled = np.exp(low[some] + i * (width / parts))[:, None] * z
                    raised = np.exp(scaled - scaled.max(axis=1, keepdims=True))
                    slope = (z * raised).sum(axis=1) / raised.sum(axis=1) - right
                    totals[i - 1] += np.bincount(own[some], slope, n)
            at = pa.array(np.tile(np.arange(n), parts - 1))
            counts = np.tile(np.bincount(own, minlength=n), parts - 1)
            columns = [keys.dictionary.take(at), pa.array(np.tile(lows, parts - 1)), pa.array(np.repeat(points, n), pa.int32()), pa.array(totals.ravel()), pa.array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "low", "i", "total", "n"])

    schema = StructType([met.schema["key"]]).add("low", "double").add("i", "integer").add("total", "double").add("n", "long")
    return met.select("key", "low", "z", "y").mapInArrow(add, schema)


def temperatures(rows: DataFrame, key: str, steps: int = 30) -> DataFrame:
    """(key, invtemp): the inverse temperature of probabilities `p` over classes that minimises the cross-entropy of labels `y`.

    p is an array with the probability of each class, y a class from 0. The gradient grows with the inverse temperature, so its
    logarithm is found by bisection; a pass sums the gradient at the inner points of 2^BITS parts of the interval, BITS steps at once,
    and a key has one row of sums. Rows without p or y, with a part of p missing, or with a class that p lacks, count nothing; a key
    without others has no row. Few keys are broadcast, so a common key is summed by all tasks; many are joined.
    """
    known = rows.where(F.col("p").isNotNull() & (F.col("y") >= 0) & (F.col("y") < F.size("p"))).select(F.col(key).alias("key"), logits(F.col("p")).alias("z"), F.col("y").cast("int").alias("y"))
    known = stored(known.where(F.col("key").isNotNull() & F.forall("z", lambda x: x.isNotNull())), "logits")
    found = known.select("key").distinct().select("key", F.lit(LOW).alias("low"))
    few = found.limit(MOST_KEYS + 1).count() <= MOST_KEYS
    width, done = HIGH - LOW, 0
    while done < steps:
        bits = min(BITS, steps - done)
        parts = 2**bits
        sums = slope_sums(known.join(F.broadcast(found) if few else found, "key"), width, parts)
        slopes = sums.groupBy("key", "low", "i").agg((F.sum("total") / F.sum("n")).alias("slope"))
        # Where the gradient isn't positive yet the temperature goes on.
        found = slopes.groupBy("key", "low").agg(F.count_if(F.col("slope") <= 0).alias("passed")).select("key", (F.col("low") + F.col("passed") * (width / parts)).alias("low"))
        found = stored(found, "inverse-temperatures")
        width, done = width / parts, done + bits
    return found.select(F.col("key").alias(key), F.exp(F.col("low") + width / 2).alias("invtemp"))


def calibrated(rows: DataFrame, fits: DataFrame, key: str) -> DataFrame:
    """rows with `p` scaled by the inverse temperature of their key; a key without one keeps its probabilities."""
    scaled = softmax(F.transform(logits(F.col("p")), lambda x: F.col("invtemp") * x))
    return rows.join(fits, key, "left").withColumn("p", F.when(F.col("invtemp").isNotNull(), scaled).otherwise(F.transform("p", lambda x: x.cast("double")))).drop("invtemp")


def threshold_counts(rows: DataFrame, key: str) -> DataFrame:
    """(key, score, tp, fp, fn, tn) at each distinct score: what is counted if scores of at least it are positive.

    Rows are counted by score first, so the window sees distinct scores of a key.
    """
    counts = rows.where("score is not null and y is not null").groupBy(key, "score").agg(F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") != 1).alias("n"))
    above = Window.partitionBy(key).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(key)
    tp, fp = F.sum("p").over(above), F.sum("n").over(above)
    return counts.select(key, "score", tp.alias("tp"), fp.alias("fp"), (F.sum("p").over(whole) - tp).alias("fn"), (F.sum("n").over(whole) - fp).alias("tn"))


def _part(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top, F.when(bottom != 0, bottom)), F.lit(0.0))


#: Metrics that need classes, by their counts: parts without rows are 0.
THRESHOLD_METRICS = {
    "accuracy": lambda: (F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")),
    "f1": lambda: _part(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")),
    "balanced_accuracy": lambda: (_part(F.col("tp"), F.col("tp") + F.col("fn")) + _part(F.col("tn"), F.col("tn") + F.col("fp"))) / 2,
}


def decision_thresholds(rows: DataFrame, key: str, metric: str) -> DataFrame:
    """(key, threshold, value): the score from which on rows count as positive that gives the best metric; of equals that closest to
    0.5, then the lower one."""
    if metric not in THRESHOLD_METRICS:
        raise ValueError(f"no metric {metric!r}; known: {', '.join(THRESHOLD_METRICS)}")
    at = threshold_counts(rows, key).select(key, "score", F.round(THRESHOLD_METRICS[metric](), 12).alias("value"))
    best = F.min(F.struct((-F.col("value")).alias("v"), F.abs(F.col("score") - 0.5).alias("far"), "score")).alias("b")
    return at.groupBy(key).agg(best).select(key, F.col("b.score").alias("threshold"), (-F.col("b.v")).alias("value"))


def class_metric_at(rows: DataFrame, thresholds: DataFrame, key: str, metric: str, default: float = 0.5) -> DataFrame:
    """(key, metric_error): one less the metric of rows (key, y, score) at the threshold of their key, `default` for one without."""
    seen = rows.join(thresholds.select(key, "threshold"), key, "left").withColumn("hit", F.col("score") >= F.coalesce("threshold", F.lit(default)))
    y = F.col("y") == 1
    counts = seen.groupBy(key).agg(*[F.count_if(c).alias(n) for n, c in (("tp", F.col("hit") & y), ("fp", F.col("hit") & ~y), ("fn", ~F.col("hit") & y), ("tn", ~F.col("hit") & ~y))])
    return counts.select(key, (1 - THRESHOLD_METRICS[metric]()).alias("metric_error"))
