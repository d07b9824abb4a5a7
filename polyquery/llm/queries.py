"""The registered queries of this subpackage: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from polyquery.llm import chat, substrings


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """Where the public tokenizer's file is; not part of this repository."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from polyquery.llm import mixing

    return mixing.query(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from polyquery.llm import decontaminate

    return decontaminate.query(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from polyquery.llm import simhash

    return simhash.query(_table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from polyquery.llm import quality

    return quality.query(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from polyquery.llm import toxicity

    return toxicity.query(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.query(_table(spark, sf_dir, "documents"))


def op7_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from polyquery.llm import tokens

    return tokens.round_trip(_table(spark, sf_dir, "documents"), tokenizer_path(), 2).select("doc_id", "start", "n_tokens", "ids_crc32")


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from polyquery.llm import licences

    return licences.query(_table(spark, sf_dir, "documents"))


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from polyquery.llm import neighbours

    return neighbours.query(_table(spark, sf_dir, "embeddings"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.query(_table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_decontamination": op2_decontamination,
    "op3_simhash": op3_simhash,
    "op4_quality": op4_quality,
    "op5_toxicity": op5_toxicity,
    "op6_substrings": op6_substrings,
    "op7_tokens": op7_tokens,
    "op8_licences": op8_licences,
    "op9_neighbours": op9_neighbours,
    "op10_chat": op10_chat,
}
ORACLE: dict[str, str] = {"op6_substrings": substrings.ORACLE, "op10_chat": chat.ORACLE}
