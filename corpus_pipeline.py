"""The training-data pipeline: five stages from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. run() writes each stage's result as Parquet into the shared
folder and reads it back as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.bpe import encode_decode
from quillstone.llm.common import cut, documents, tokenizer_path
from quillstone.llm.exact_dedup import keep_one
from quillstone.llm.mixture import mixed
from quillstone.llm.ngram_join import keep_first
from quillstone.llm.resampling import kept_documents


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that importance resampling against the labelled good ones doesn't draw."""
    return kept_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, keep the one with the largest doc_id."""
    return keep_one(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 over five-word shingles, keep the one with the smallest doc_id."""
    return keep_first(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each source's documents, some more than once, up to its target share of words."""
    return mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document that the mix takes, with the digest of their decoding."""
    ids = encode_decode(docs, tokenizer_path("word_bpe_49k.json"), ("doc_id", "source"), with_ids=True)
    return ids.select("doc_id", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [("quality", quality), ("exact_copies", exact_copies), ("near_copies", near_copies), ("mixture", mixture), ("tokens", tokens)]

#: Sampling by weight, Jaccard components, the knapsack and merging by rank are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir).withColumn("n_tokens", F.col("n_tokens").cast("long"))
