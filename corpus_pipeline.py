"""A corpus pipeline of five operators: language ID, line dedup, SimHash near-dedup, mixing, BPE.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before kept and returns the columns of
documents, the last one the encoded documents. Stages are written as Parquet and read back in between.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pergamo.llm.bpe_codec import bpe_encode, word_tokenizer
from pergamo.llm.language_id import keep_known
from pergamo.llm.line_dedup import line_dedup
from pergamo.llm.mixing import take
from pergamo.llm.simhash_dedup import keep_one
from pergamo.session import settle


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or null, go; all others stay."""
    return keep_known(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal and similar lines of all documents one stays; n_chars follows the text."""
    out = line_dedup(docs)
    if "n_chars" in docs.columns:
        n = F.when(F.col("_n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", n.cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicate documents the one with the smallest id stays."""
    return keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    return take(docs)


def bpe_codec(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and decoded_sha256 (of what decoding the ids gives back) of each document."""
    return bpe_encode(docs, word_tokenizer(), ("n_tokens", "ids", "decoded_sha256"))


STAGES = [("language_id", language_id), ("line_dedup", line_dedup_stage), ("simhash_dedup", simhash_dedup), ("mixing", mixing), ("bpe_codec", bpe_codec)]

#: Naive Bayes training, MinHash and byte-pair encoding are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
