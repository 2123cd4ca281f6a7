"""Token counts through a cache of digests: only contents that the cache lacks are encoded, each once."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankforge.llm.common import fresh_path, materialise, piece_encoder, text_batches

CACHE_SCHEMA = "content_digest binary, tokenizer_digest string, n_tokens long"
#: A content is hot if more than one in HOT rows have it; so at most HOT contents are, and their counts may be broadcast.
HOT = 1000


def tokenizer_digest(path: str) -> str:
    """The version of a tokenizer: the digest of its file."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def normalised(text, drops_space: bool):
    """What alone decides the count. A tokenizer that drops white space sees runs of it as one."""
    text = F.coalesce(text, F.lit(""))
    return F.trim(F.regexp_replace(text, "[ \\t\\n\\x0B\\f\\r]+", " ")) if drops_space else text


def read_cache(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """(content_digest, cached) of one tokenizer version, one row a content, although writers may have overlapped."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache)
    there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    rows = spark.read.schema(CACHE_SCHEMA).parquet(cache) if there else spark.createDataFrame([], CACHE_SCHEMA)
    return rows.where(F.col("tokenizer_digest") == version).groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, tokenizer: str, cache: str, drops_space: bool, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) of every row; appends what was missing to the Parquet table at `cache` (a shared path).

    `drops_space`: the tokenizer ignores how long runs of ASCII white space are. Null texts count as empty: 0 bytes, 0 tokens.
    Repeated texts are encoded once, repeated rows stay; null ids stay; other columns are ignored. An interrupted run leaves the
    cache valid, and the next one encodes what is still missing.
    """
    spark, version = docs.sparkSession, tokenizer_digest(tokenizer)
    content = normalised(F.col(text_col), drops_space)
    keyed = docs.select(F.col(id_col), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.unhex(F.sha2(content, 256)).alias("content_digest"))
    contents = docs.select(content.alias("content")).select(F.unhex(F.sha2("content", 256)).alias("content_digest"), "content")
    distinct = contents.groupBy("content_digest").agg(F.first("content").alias("content"))
    misses = distinct.join(read_cache(spark, cache, version), "content_digest", "left_anti")

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = piece_encoder(tokenizer)
        for b in batches:
            texts = b.column(1).to_pylist()
            for part in text_batches(texts):
                counts = [len(x) // 4 for x in encoder.encode(texts[part])]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(part.start, len(counts)), pa.array([version] * len(counts)), pa.array(counts, pa.int64())], names=["content_digest", "tokenizer_digest", "n_tokens"])

    misses.mapInArrow(encode, CACHE_SCHEMA).write.mode("append").parquet(cache)
    known = read_cache(spark, cache, version)
    return spread_join(keyed, known, hot_contents(keyed.select("content_digest"), HOT), id_col).select(id_col, "n_bytes", "n_tokens")


def hot_contents(keyed: DataFrame, hot: int) -> DataFrame:
    """(content_digest): what more than one in `hot` rows have, at most `hot` contents."""
    sizes = materialise(keyed.groupBy("content_digest").agg(F.count(F.lit(1)).alias("rows")), "content-sizes")
    total = sizes.agg(F.sum("rows")).first()[0] or 0
    return sizes.where(F.col("rows") > max(1, total // hot)).select("content_digest")


def spread_join(keyed: DataFrame, known: DataFrame, hot: DataFrame, id_col: str) -> DataFrame:
    """keyed with n_tokens of known (content_digest, n_tokens): hot contents take it from a broadcast, and their rows are dealt by id."""
    # At most HOT rows.
    counts = F.broadcast(known.join(F.broadcast(hot), "content_digest").withColumnRenamed("n_tokens", "_hot"))
    rows = keyed.join(counts, "content_digest", "left")
    # Longer than any digest, so it meets none.
    apart = F.concat("content_digest", F.unhex(F.hex(F.xxhash64(id_col, "n_bytes"))))
    rows = rows.withColumn("content_digest", F.when(F.col("_hot").isNull(), F.col("content_digest")).otherwise(apart))
    return rows.join(known, "content_digest", "left").withColumn("n_tokens", F.coalesce("_hot", "n_tokens"))


def fresh_cache(spark: SparkSession) -> str:
    return fresh_path(spark, "token-cache")
