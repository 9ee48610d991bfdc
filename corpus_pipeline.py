"""The corpus pipeline: toxic documents go, copies go, near copies go, the rest is mixed and encoded.

Each stage gets what its predecessor wrote; run() writes every stage as Parquet in the shared folder and reads it again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from adsift.llm import bpe, exact_dedup, mixing, simhash, toxicity
from adsift.session import materialise, prepare

RANKS = "byte_bpe_multi_50k.tiktoken"


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the labelled examples do not show to be toxic; labels come from the table beside documents."""
    return toxicity.accepted(docs, prepare(spark).read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the largest doc_id."""
    return exact_dedup.dedup(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the document with the smallest doc_id."""
    return simhash.representatives(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order."""
    return mixing.training_order(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents with ids (the tokens of each text), n_tokens and whether decoding gives the text back."""
    prepare(spark)
    return bpe.encoded(docs, bpe.read_ranks(public_tokenizers.path(RANKS)), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact dedup", exact_dedup_stage),
    ("simhash near-dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("byte-level bpe", encoding_stage),
]
# Nearest examples, bit distances and rank merges are not for SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the whole documents table."""
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
