"""A training corpus in four stages: toxic documents go, unrecognised languages go, one document of each near-duplicate group stays,
and what is left is packed into sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rankforge.llm import jaccard_join, language_id, packing, toxicity
from rankforge.llm.common import materialise, tokenizer_path


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the toxicity grammar, fitted on labels, scores under 0.5. Null and empty texts stay; null ids and repeated rows are judged
    as all others are; an empty table gives no rows."""
    return toxicity.clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def recognised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in a language that the rows' own lang column teaches. Null texts and texts without a letter go; null ids and repeated rows are
    judged as all others are; an empty table gives no rows."""
    return language_id.recognised(docs)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five words, 0.8): the smallest doc_id, a null one only if there is no other. Of rows without
    words, one a doc_id and text stays; of rows repeated as a whole one stays; an empty table gives no rows."""
    return jaccard_join.one_of_each(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows in sequences. Null texts are empty documents of one token; null ids and repeated rows are packed each; an
    empty table gives no rows. Executors are full from the join before, so workers keep nothing between tasks."""
    return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"), lasting=False)[1]


STAGES = [("toxicity", without_toxic), ("language ID", recognised), ("n-gram Jaccard join", without_copies), ("packing", packed)]
#: Models, tokenizers and packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
