"""The corpus pipeline: documents through quality rules, near-dedup, substring dedup, mixing and tokenisation.

Each stage takes (spark, docs, directory) and returns a frame that is written as Parquet and read again
as the next stage's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from deskstream.llm import bpe, minhash, mixing, passages, perplexity
from deskstream.llm.common import saved, table


def quality_rules(spark: SparkSession, docs: DataFrame, directory: str) -> DataFrame:
    """Documents that the rules and the perplexity bands keep."""
    return perplexity.passing(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, directory: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return minhash.without_near_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, directory: str) -> DataFrame:
    """Repeated passages stay in the first document only."""
    return passages.without_repeats(docs)


def mixture(spark: SparkSession, docs: DataFrame, directory: str) -> DataFrame:
    """Documents drawn to the target weights, once for each epoch that takes them."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, directory: str) -> DataFrame:
    """Token counts and digests of ids and of the decoded bytes, one row per drawn document."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.bpe(docs, ranks, public_tokenizers.PATTERN, digest=True, keep=("doc_id", "lang", "source"))


STAGES = [
    ("quality rules", quality_rules),
    ("near dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("mixture", mixture),
    ("tokens", tokens),
]

#: The perplexity models, the merges and the passage windows have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, directory: str) -> DataFrame:
    docs = table(spark, directory, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, directory)
        if k + 1 < len(STAGES):
            docs = saved(docs, name.replace(" ", "-"))
    return docs
