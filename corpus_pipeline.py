"""A corpus pipeline: each stage is one operator of glyphloom.llm over all that the stage before it kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphloom.llm import bpe, exact_dedup, mixing, near_dedup, quality_rules
from glyphloom.llm.common import shared_dir, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules accept."""
    return quality_rules.accepted(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the largest doc_id."""
    return exact_dedup.deduplicated(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates, the one with the smallest doc_id: five-word shingles, similarity 0.8."""
    return near_dedup.deduplicated(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with mix_slot and mix_rank, by which the schedule interleaves their sources: a table read again has no order.

    Columns of these names that documents has already give way.
    """
    out = mixing.schedule(docs.drop("mix_slot", "mix_rank"))
    return out.select("row.*", F.col("slot").alias("mix_slot"), F.col("rank").alias("mix_rank"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, mix_slot, mix_rank, ids, n_tokens and the digest of the decoded bytes, which is that of the text, in the order of the schedule."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "mix_slot", "mix_rank", "text")
    out = bpe.encoded(own, bpe.public_codec(), "doc_id", "source", "mix_slot", "mix_rank", order=("mix_slot", "mix_rank"))
    return out.select("doc_id", "source", "mix_slot", "mix_rank", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality rules", quality), ("exact dedup", exact), ("near dedup", near), ("mixing", mix), ("byte-level BPE", encode)]
#: The outlier estimates, the schedule and the encoding have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; each one's result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            path = f"{shared_dir(spark)}/stage{i}-{uuid.uuid4().hex}"
            out.write.parquet(path)
            docs = spark.read.parquet(path)
    return out
