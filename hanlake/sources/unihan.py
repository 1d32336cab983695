"""Unihan text files and KANJIDIC2 XML as wide tables of one row a character."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text

#: The keys that the derived tables need.
SLIM_KEYS = (
    "kMandarin kCantonese kJapaneseKun kJapaneseOn kHangul kVietnamese kHanyuPinlu kXHC1983 kHanyuPinyin kTotalStrokes kFrequency "
    "kRSKangXi kRSKanWa kRSJapanese kRSKorean kGB0 kBigFive kHKSCS kJis0 kJIS0213 kIICore kCompatibilityVariant kSemanticVariant "
    "kSimplifiedVariant kSpecializedSemanticVariant kTraditionalVariant kZVariant"
).split()
INTEGER_KEYS = ("kTotalStrokes", "kFrequency")


def read_unihan_facts(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """ChineseCharacter, key, value of all lines U+HEX <tab> key <tab> value; other lines are left out."""
    line = r"^U\+([0-9A-F]+)\s+(\w+)\s+(.+?)\s*$"
    rows = spark.read.text(paths).where(F.col("value").rlike(line))
    code = F.conv(F.regexp_extract("value", line, 1), 16, 10)
    return rows.select(text.char_of(code).alias("ChineseCharacter"), F.regexp_extract("value", line, 2).alias("key"), F.regexp_extract("value", line, 3).alias("value"))


def pivot_facts(facts: DataFrame, keys: Sequence[str] | None = SLIM_KEYS, bmp_only: bool = False, entity: str = "ChineseCharacter") -> DataFrame:
    """Entity-attribute-value rows as one row an entity. keys None: all that occur, found in one more pass."""
    if keys is None:
        keys = sorted(r[0] for r in facts.select("key").distinct().collect())
    if bmp_only:
        facts = facts.where(text.codepoint(entity) < 0x10000)
    wide = facts.where(F.col("key").isin(*keys)).groupBy(entity).pivot("key", list(keys)).agg(F.min("value"))
    return wide.withColumns({k: F.col(k).cast("int") for k in keys if k in INTEGER_KEYS})


def read_unihan(spark: SparkSession, paths: str | Sequence[str], keys: Sequence[str] | None = SLIM_KEYS, bmp_only: bool = False) -> DataFrame:
    return pivot_facts(read_unihan_facts(spark, paths), keys, bmp_only)


_KANJIDIC = """literal string, radical struct<rad_value: array<struct<_VALUE: string, _rad_type: string>>>,
misc struct<rad_name: array<string>>,
reading_meaning struct<rmgroup: array<struct<reading: array<struct<_VALUE: string, _r_type: string>>, meaning: array<struct<_VALUE: string, _m_lang: string>>>>>"""


def read_kanjidic(spark: SparkSession, path: str, bmp_only: bool = False) -> DataFrame:
    """Radicals, readings and meanings of each character of a KANJIDIC2 file."""
    rows = spark.read.format("xml").option("rowTag", "character").schema(_KANJIDIC).load(path)
    group = F.col("reading_meaning.rmgroup")
    readings, meanings = F.flatten(group["reading"]), F.flatten(group["meaning"])
    radical = lambda kind: F.try_element_at(F.filter("radical.rad_value", lambda x: x["_rad_type"] == kind), F.lit(1))["_VALUE"].cast("int")
    some = lambda values, sep: F.when(F.size(values) > 0, F.array_join(values, sep))
    reading = lambda kind: some(F.transform(F.filter(readings, lambda x: x["_r_type"] == kind), lambda x: x["_VALUE"]), ",")

    def meaning(lang: str | None):
        chosen = F.filter(meanings, lambda x: x["_m_lang"].isNull() if lang is None else x["_m_lang"] == lang)
        return some(F.transform(chosen, lambda x: x["_VALUE"]), "/")

    out = rows.select(
        F.col("literal").alias("ChineseCharacter"), radical("nelson_c").alias("NelsonCRadical"), radical("nelson_n").alias("NelsonNRadical"),
        reading("ja_on").alias("CharacterJapaneseOn"), reading("ja_kun").alias("CharacterJapaneseKun"), some(F.col("misc.rad_name"), ",").alias("RadicalName"),
        meaning(None).alias("Meaning_en"), *(meaning(x).alias(f"Meaning_{x}") for x in ("fr", "es", "pt")),
    )
    return out.where(text.codepoint("ChineseCharacter") < 0x10000) if bmp_only else out
