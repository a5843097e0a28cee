"""Documents to packed training sequences in five stages, each written and read again as the next one's input."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cardwatch.llm import exact_dedup, language, mixing, near_dedup, packing
from cardwatch.llm.common import Workspace

TOKENIZER = "byte_bpe_50k.json"
#: Target weights of the sources for mixing and packing; None takes the square roots of their bytes.
WEIGHTS: dict[str, int] | None = None


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go; all others have a language and stay."""
    return language.with_language(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest id stays."""
    return exact_dedup.without_exact_duplicates(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    return near_dedup.without_near_duplicates(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mix of their sources."""
    return mixing.mixed(docs, WEIGHTS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences and offsets, dealt and numbered in the order of the mix.

    Files keep no order, so the places are worked out again from the documents and the weights of the mixing stage.
    """
    order = mixing.interleave(docs, WEIGHTS)
    return packing.pack(docs, public_tokenizers.path(TOKENIZER), order=order)


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = work.write(stage(spark, docs, sf_dir), f"{k}-{name}")
    return docs
