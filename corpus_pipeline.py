"""The corpus pipeline: documents through the operators, stage by stage.

Quality rules, near-duplicate removal, removal of repeated passages, redaction of
secrets, packing.  Each stage works on everything the one before kept and is
written before the next reads it; all but the last return the columns of
``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from trustweave.llm import near_dup, packing, passages, quality, secrets
from trustweave.llm.shared import Scratch

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules accept."""
    return quality.accepted(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near_dup.deduplicated(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document has."""
    return passages.without_passages(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every secret replaced by its kind."""
    return secrets.without_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 1024 tokens, with their ids."""
    return packing.pack(docs, TOKENIZER, with_ids=True)


STAGES = [
    ("quality rules", quality_rules),
    ("near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("secret scans", secret_scan),
    ("packing", pack),
]
#: Signatures, passages and tokens cannot be expressed in SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written, and the next reads it."""
    scratch = Scratch(spark, "pipeline")
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = scratch.keep(docs)
            scratch.free(before)
            before = docs
    return docs


QUERIES, ORACLES = {"pipeline": run}, {}
