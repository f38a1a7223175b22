"""Exact deduplication in two passes of a Bloom filter. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pergamo.llm.common import table
from pergamo.plans import bitmap
from pergamo.plans.skew import attach_groups
from pergamo.session import settle


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, keep_id (largest id among equal texts), group_size, kept, text_sha256.

    Texts are read once and become a fingerprint (SHA-256 of the UTF-8 text); from there on rows are narrow.
    Pass one hashes the fingerprints into a bitmap that keeps the places hit at least twice. Pass two probes
    it: a row with a place hit once is surely alone and goes straight through; only the others shuffle, are
    counted (combined before the shuffle, so a group of any size costs one row a task) and get their group
    back by a join whose hot keys are broadcast. The bitmap has 16 bits a row, up to 64 MB; beyond that more
    rows shuffle than need to and the result is the same.

    Null text counts as empty. Null ids: never chosen over others; a group of null ids only has a null keep_id
    and keeps all its rows. Rows that repeat an id with the same text are all kept or all dropped. An empty
    table gives no rows. Other columns are not read.
    """
    rows = settle(docs.select(F.col(id_col).alias("id"), F.sha2(F.coalesce(text_col, F.lit("")).cast("binary"), 256).alias("sha")))
    n = rows.count()
    bits = bitmap.filter_bits(n)
    twice = bitmap.build(rows, "sha", bits, least=2, seeds=bitmap.SEEDS[:1])
    rows = settle(bitmap.probe(rows, "sha", twice, bits, "maybe", bitmap.SEEDS[:1]))
    alone = rows.where(~F.col("maybe")).select("id", "sha", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    rest = rows.where("maybe").select("id", "sha")
    groups = settle(rest.groupBy("sha").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    many = attach_groups(rest, groups, "sha", "group_size", n).select("id", "sha", "keep_id", "group_size")
    return alone.unionByName(many).select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


QUERIES = {"op3_exact_dedup": op3_exact_dedup}
ORACLE = {
    "op3_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))"""
}
