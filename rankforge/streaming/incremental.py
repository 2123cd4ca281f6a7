"""Append-only tables as streams: running aggregates that survive a restart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines share: spark.checkpoint.dir, or a local one where that is unset and all runs in one process."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not known and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (known or "file:///tmp/checkpoints/rankforge").rstrip("/")


def windowed_counts(events: DataFrame, ts: str, category: str, width: str) -> DataFrame:
    """(start, category, n) of tumbling windows of a stream; rows up to a day late still count."""
    late = events.withWatermark(ts, "1 day")
    return late.groupBy(F.window(ts, width).alias("w"), category).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), category, "n")


def drained(stream: DataFrame, name: str, checkpoint: str | None = None) -> DataFrame:
    """Runs an aggregating stream over all that is there and returns its result table.

    Each batch writes a whole new version of the result under its number, so a batch that runs again after a failure replaces
    itself; the checkpoint holds state and offsets, and a later call takes up only new files.
    """
    import uuid

    spark = stream.sparkSession
    root = checkpoint or f"{shared_folder(spark)}/stream-{name}-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/result/version={number}")

    query = stream.writeStream.outputMode("complete").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    versions = spark.read.schema(StructType(list(stream.schema.fields)).add("version", "long")).parquet(f"{root}/result")
    last = versions.agg(F.max("version")).first()[0]
    return versions.where(F.col("version") == last).drop("version")
