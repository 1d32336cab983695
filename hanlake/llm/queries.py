"""The registered queries of this subpackage, one for each operator: thin, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, jpeg, ngram_jaccard, packing, quality, quality_rules, sharding, suffix_dedup, toxicity
from .common import table


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.ngram_jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents").select("doc_id"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digests(table(spark, sf_dir, "documents"), bpe.default_path("byte_bpe_multi_50k.tiktoken"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), bpe.default_path("byte_bpe_50k.json"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repeats: 1 for documents of which bytes were removed, else 0; behind it what passages of over 50 words that repeat cover."""
    found = suffix_dedup.repeat_digests(table(spark, sf_dir, "documents"), suffix_dedup.PASSAGE_WORDS)
    repeats = (F.col("n_removed") > 0).cast("int").alias("repeats")
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", repeats, "n_passage_bytes", "n_passages")


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_digests(chat.format_chats(chat.with_injected(table(spark, sf_dir, "conversations"))))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg.media_digests(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


_ALL = (op1_ngram_jaccard, op2_sharding, op3_bpe, op4_packing, op5_suffix_dedup, op6_chat, op7_media, op8_quality, op9_toxicity, op10_quality_rules)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}

ORACLE_SQL: dict[str, str] = {"op2_sharding": sharding.oracle(), "op10_quality_rules": quality_rules.ORACLE}
