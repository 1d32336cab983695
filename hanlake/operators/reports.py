"""Reports put together from the other operators: all about characters, radicals by remaining strokes, tables of syllables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..plans.catalog import CHARACTER as CH
from .characters import CharacterLookup


def character_information(lookup: CharacterLookup, keys: DataFrame, readings: Sequence[str] = ("Pinyin",)) -> DataFrame:
    """One row a character: code point, radical, strokes, variants, readings, domains; what isn't known is null."""
    own = keys.select(CH).distinct()
    out = own.withColumn("codepoint", text.format_codepoint(CH))
    c = lookup.catalog
    if "CharacterKangxiRadical" in c:
        out = out.join(lookup.kangxi_radicals(own).groupBy(CH).agg(F.min("RadicalIndex").alias("radical")), CH, "left")
    if "StrokeCount" in c:
        out = out.join(c["StrokeCount"].groupBy(CH).agg(F.min_by("StrokeCount", "Glyph").alias("strokes")), CH, "left")
    if "CharacterVariant" in c:
        v = F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "Type", "Variant"))), " ")
        out = out.join(c["CharacterVariant"].join(own, CH, "left_semi").groupBy(CH).agg(v.alias("variants")), CH, "left")
    for name in readings:
        if f"Character{name}" in c:
            r = text.fold(F.array_sort(F.collect_set("Reading")))
            out = out.join(c[f"Character{name}"].join(own, CH, "left_semi").groupBy(CH).agg(r.alias(name)), CH, "left")
    for domain in c.domains()[1:]:
        out = out.join(c.domain(domain).withColumn(f"in_{domain}", F.lit(True)), CH, "left").withColumn(f"in_{domain}", F.coalesce(f"in_{domain}", F.lit(False)))
    return out


def characters_by_residual(lookup: CharacterLookup, keys: DataFrame, kangxi_only: bool = True) -> DataFrame:
    """RadicalIndex, ResidualStrokeCount and the characters that have both, in order."""
    rows = lookup.residuals_for_radical(keys, kangxi_only)
    return rows.groupBy("RadicalIndex", "ResidualStrokeCount").agg(F.array_sort(F.collect_set(CH)).alias("characters")).orderBy("RadicalIndex", "ResidualStrokeCount")


def readings_of_text(lookup: CharacterLookup, texts: DataFrame, column: str, reading: str) -> DataFrame:
    """For each character of each text, in order, its readings as [a b], or the character if it has none. texts needs a column id."""
    chars = texts.select("id", F.posexplode(text.characters(column)).alias("pos", CH))
    known = lookup.catalog[f"Character{reading}"].groupBy(CH).agg(text.fold(F.array_sort(F.collect_set("Reading"))).alias("folded"))
    each = chars.join(known, CH, "left").select("id", "pos", F.coalesce("folded", CH).alias("r"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "r"))), lambda x: x["r"])
    return each.groupBy("id").agg(F.array_join(ordered, " ").alias("readings"))


def convert_script(lookup: CharacterLookup, texts: DataFrame, column: str, kind: str) -> DataFrame:
    """Texts with each character's simplified (S) or traditional (T) forms, several as [ab]. texts needs a column id."""
    chars = texts.select("id", F.posexplode(text.characters(column)).alias("pos", CH))
    forms = lookup.simplified_or_traditional(chars, kind).groupBy(CH).agg(F.array_sort(F.collect_set("Variant")).alias("v"))
    shown = F.when(F.size("v") == 1, F.element_at("v", 1)).otherwise(F.concat(F.lit("["), F.array_join("v", ""), F.lit("]")))
    each = chars.join(forms, CH).select("id", "pos", shown.alias("f"))
    return each.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "f"))), lambda x: x["f"]), "").alias("converted"))


def syllable_table(parts: DataFrame, finals: Sequence[str]) -> DataFrame:
    """Initials by finals; fails where two syllables meet in one cell."""
    clash = parts.groupBy("initial", "final").agg(F.count_distinct("syllable").alias("n")).where("n > 1").limit(1).collect()
    if clash:
        raise ValueError(f"more than one syllable of {clash[0]['initial']!r} and {clash[0]['final']!r}")
    return parts.groupBy("initial").pivot("final", list(finals)).agg(F.first("syllable")).orderBy("initial")


def stroke_count_mismatches(own: DataFrame, unihan: DataFrame) -> DataFrame:
    """own: ChineseCharacter, Glyph, StrokeCount; unihan: ChineseCharacter, StrokeCount. Characters none of whose glyphs has Unihan's count:
    ChineseCharacter, own (all counts, sorted), unihan."""
    counts = own.groupBy(CH).agg(F.array_sort(F.collect_set("StrokeCount")).alias("own"))
    both = counts.join(unihan.select(CH, F.col("StrokeCount").alias("unihan")), CH)
    return both.where(~F.array_contains("own", F.col("unihan")))


def not_in_table(parts: DataFrame, finals: Sequence[str]) -> DataFrame:
    """Syllables that a table of these finals leaves out."""
    return parts.where(~F.coalesce(F.col("final").isin(*finals), F.lit(False))).select("syllable")


def upsert(table: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """table with rows in the place of those of the same keys, as for versions of installed tables."""
    return table.join(rows.select(*keys), list(keys), "left_anti").unionByName(rows)
