"""The numbered operators, each over its whole table, with the columns that their contracts name."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankforge.llm import arrow_output, bpe_trie, collocations, html_extract, imatch, jaccard_join, language_id, media, packing, resampling, token_counts, toxicity, url_filter
from rankforge.llm.common import fresh_path, tokenizer_path

LIMIT = 2048


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), token_counts.fresh_cache(spark), drops_space=True)
    return counts.withColumn("over_limit", F.col("n_tokens") > LIMIT)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), LIMIT)[1]


def op4_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_trie.digests(bpe_trie.encode_decode(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json")))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), width=4, percent=85)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.vector_copies(table(spark, sf_dir, "embeddings"))


def op9_arrow_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "arrow-shards")
    manifest = arrow_output.write_sequences(table(spark, sf_dir, "documents"), folder, tokenizer_path("word_bpe_49k.json"), LIMIT)
    return arrow_output.read_documents(spark, manifest, folder)


def op10_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.imatch(table(spark, sf_dir, "documents"))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_html_extract, op2_token_counts, op3_packing, op4_bpe_trie, op5_jaccard_join, op6_toxicity, op7_language_id, op8_media, op9_arrow_output, op10_imatch, op11_resampling, op12_collocations, op13_url_filter)}
QUERIES["pipeline"] = corpus_pipeline.run
ORACLE_SQL: dict[str, str] = {"op10_imatch": imatch.imatch_sql(), "op11_resampling": resampling.resample_sql(), "op12_collocations": collocations.collocations_sql()}
