"""A corpus pipeline: documents without toxic and low-quality texts, near copies and repeated passages, packed to sequences."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hanlake.llm import bpe, ngram_jaccard, packing, quality, suffix_dedup, toxicity
from hanlake.llm.common import plainly_named, stage, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier, taught by the labelled ones among them, doesn't predict as toxic.

    Null and empty texts are scored like texts without features, and stay where those aren't toxic; repeated rows stay together.
    Without labels of both kinds all stay or, where all labels are toxic, go.
    """
    model = toxicity.fit_on_labels(docs, table(spark, sf_dir, "labels"))
    plain = plainly_named(docs, "text")
    return toxicity.score(plain, model).where("predicted = 0").select(plain.columns).toDF(*docs.columns)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps. Null and empty texts are scored like texts without features."""
    plain = plainly_named(docs, "text")
    return quality.score(plain, quality.fit(plain)).where("kept").select(plain.columns).toDF(*docs.columns)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the document with the smallest id, once; all rows of texts that are in none."""
    found = ngram_jaccard.ngram_jaccard_components(docs.select("doc_id", "text"))
    key = F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("first_id"), F.col("k_text").alias("first_hash"))
    first = found.where("component is not null").groupBy("component").agg(F.min(key).alias("key")).select("key.*")
    lone = found.where("component is null").select(key.alias("key")).select("key.*")
    chosen = first.withColumn("copy", F.lit(False)).unionByName(lone.distinct().withColumn("copy", F.lit(True)))
    rows = plainly_named(docs, "doc_id", "text").withColumns({"first_id": F.coalesce("doc_id", F.lit(2**63 - 1)), "first_hash": F.xxhash64("text")})
    # rows of texts without a component get numbers of their own, so none of them counts as a copy of another
    kept = rows.join(chosen, ["first_id", "first_hash"]).withColumn("copy", F.when(F.col("copy"), F.monotonically_increasing_id()).otherwise(-1))
    return kept.dropDuplicates(["first_id", "first_hash", "copy"]).drop("first_id", "first_hash", "copy").toDF(*docs.columns)


#: The stage cuts passages of over 50 words that repeat, besides strings of 400 bytes.
PASSAGE_WORDS = suffix_dedup.PASSAGE_WORDS


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str, words: int = 0) -> DataFrame:
    """All documents, without the strings of 400 bytes that repeat and, if given, the passages of so many words that do."""
    return suffix_dedup.drop_repeats(docs, words)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed to sequences of 2048 tokens."""
    return packing.pack(docs, bpe.default_path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", one_of_near_copies),
    ("suffix-array dedup", partial(cut_repeats, words=PASSAGE_WORDS)),
    ("best-fit packing", pack),
]

#: Training, tokenising and byte matching are not expressible in SQL; tests/llm/test_pipeline.py has the plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's are written to the shared folder as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, step) in enumerate(STAGES):
        docs = stage(step(spark, docs, sf_dir), f"stage-{i}")
    return docs
