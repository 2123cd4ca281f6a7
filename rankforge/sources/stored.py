"""Tables written to the shared folder, for what a plan reads more than once, and batches of texts that stay small."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from rankforge.streaming.incremental import shared_folder


def stored(rows: DataFrame, name: str) -> DataFrame:
    """rows, written and read back: computed once, with their lineage cut, and safe from lost executors."""
    path = f"{shared_folder(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


#: Rows of an Arrow batch that hold whole texts.
BATCH_ROWS = 500


def bounded_batches(spark: SparkSession) -> None:
    """From now on the session sends Python at most BATCH_ROWS rows at a time, so a worker holds little of its partition."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
