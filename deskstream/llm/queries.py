"""Registered queries of the operators: one per operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from deskstream.llm import chat, collocations, infill, mixing
from deskstream.llm import common as c

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op4_licence_scan")
def licence_scan(spark: SparkSession, directory: str) -> DataFrame:
    from deskstream.llm.licences import licence_scan

    return licence_scan(c.table(spark, directory, "documents"))


@query("op8_bpe")
def bpe(spark: SparkSession, directory: str) -> DataFrame:
    import public_tokenizers

    from deskstream.llm.bpe import bpe, read_ranks

    ranks = read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe(c.table(spark, directory, "documents"), ranks, public_tokenizers.PATTERN, digest=True)


@query("op10_fingerprints")
def fingerprints(spark: SparkSession, directory: str) -> DataFrame:
    from deskstream.llm.fingerprint import fingerprints

    return fingerprints(c.table(spark, directory, "documents"))


@query("op2_minhash_near_dedup")
def minhash(spark: SparkSession, directory: str) -> DataFrame:
    from deskstream.llm.minhash import near_duplicates

    return near_duplicates(c.table(spark, directory, "documents"))


@query("op5_compact_windows")
def passages(spark: SparkSession, directory: str) -> DataFrame:
    from deskstream.llm.passages import passages

    return passages(c.table(spark, directory, "documents"))


@query("op3_perplexity_bands")
def perplexity(spark: SparkSession, directory: str) -> DataFrame:
    from deskstream.llm.perplexity import quality

    return quality(c.table(spark, directory, "documents"))


@query("op7_toxicity")
def toxicity(spark: SparkSession, directory: str) -> DataFrame:
    from deskstream.llm.toxicity import toxicity

    return toxicity(c.table(spark, directory, "documents"), c.table(spark, directory, "labels"))


@query("op6_quality_classifier")
def classifier(spark: SparkSession, directory: str) -> DataFrame:
    from deskstream.llm.classifier import classify

    return classify(c.table(spark, directory, "documents"), c.table(spark, directory, "labels"))


def _chat(spark: SparkSession, directory: str) -> DataFrame:
    from deskstream.llm.chat import chat_format

    return chat_format(c.table(spark, directory, "conversations"))


def _mix(spark: SparkSession, directory: str) -> DataFrame:
    from deskstream.llm.mixing import mixture

    return mixture(c.table(spark, directory, "documents"))


def _phrases(spark: SparkSession, directory: str) -> DataFrame:
    from deskstream.llm.collocations import collocations

    return collocations(c.table(spark, directory, "documents"))


def _infill(spark: SparkSession, directory: str) -> DataFrame:
    from deskstream.llm.infill import digests

    return digests(c.table(spark, directory, "documents"))


@query("op11_main_text")
def main_text(spark: SparkSession, directory: str) -> DataFrame:
    from deskstream.llm.maincontent import extract

    return extract(c.table(spark, directory, "pages"))


query("op1_chat_format", chat.ORACLE)(_chat)
query("op9_mixture", mixing.oracle())(_mix)
query("op12_collocations", collocations.ORACLE)(_phrases)
query("op13_fill_in_middle", infill.ORACLE)(_infill)
