"""Seed tables: comma-separated files with # comments, one quoting style a file, columns by position.

Specifications are data: columns (int or string), keys. Files are read from a folder given by the caller; none is shipped.
"""

from __future__ import annotations

import csv
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..plans.catalog import assert_unique


@dataclass(frozen=True)
class Spec:
    name: str
    columns: tuple[str, ...]
    keys: tuple[str, ...]

    @property
    def file(self) -> str:
        return f"{self.name.lower()}.csv"

    @property
    def names(self) -> list[str]:
        return [c.split(":")[0] for c in self.columns]


def _spec(line: str) -> Spec:
    name, columns, keys = (x.strip() for x in line.split("|"))
    return Spec(name, tuple(columns.split()), tuple(keys.split()))


#: Table | columns (:int, else text) | key.
SPECS = {s.name: s for s in map(_spec, """
PinyinSyllables | Pinyin Source | Pinyin
PinyinInitialFinal | Pinyin PinyinInitial PinyinFinal | Pinyin
WadeGilesSyllables | WadeGiles | WadeGiles
WadeGilesInitialFinal | WadeGiles WadeGilesInitial WadeGilesFinal | WadeGiles
WadeGilesPinyinMapping | WadeGiles Pinyin PinyinIdx:int | WadeGiles
GRSyllables | GR | GR
GRRhotacisedFinals | GRFinal GRFinal_T1 GRFinal_T2 GRFinal_T3 GRFinal_T4 GRFinal_T3_ZEROINITIAL GRFinal_T4_ZEROINITIAL | GRFinal
GRAbbreviation | TraditionalChinese GR GRAbbreviation Specialised | TraditionalChinese GR GRAbbreviation
PinyinGRMapping | Pinyin GR | Pinyin
PinyinIPAMapping | Pinyin IPA Feature | Pinyin IPA
MandarinIPAInitialFinal | IPA IPAInitial IPAFinal | IPA
PinyinBrailleInitialMapping | PinyinInitial Braille | PinyinInitial
PinyinBrailleFinalMapping | PinyinFinal Braille | PinyinFinal
JyutpingSyllables | Jyutping | Jyutping
JyutpingInitialFinal | Jyutping JyutpingInitial JyutpingFinal | Jyutping
JyutpingYaleMapping | Jyutping CantoneseYale | Jyutping
JyutpingIPAMapping | Jyutping IPA | Jyutping
CantoneseYaleSyllables | CantoneseYale | CantoneseYale
CantoneseYaleInitialNucleusCoda | CantoneseYale CantoneseYaleInitial CantoneseYaleNucleus CantoneseYaleCoda | CantoneseYale
CantoneseIPAInitialFinal | IPA IPAInitial IPAFinal UnreleasedFinal VowelLength | IPA
ShanghaineseIPASyllables | IPA IPAInitial IPAFinal Flags | IPA
CharacterShanghaineseIPA | ChineseCharacter Reading | ChineseCharacter Reading
KangxiRadical | RadicalIndex:int Form Type Locale SubIndex:int | Form
KangxiRadicalIsolatedCharacter | RadicalIndex:int EquivalentForm Type Locale | EquivalentForm Locale
RadicalEquivalentCharacter | Form EquivalentForm Locale | Form Locale
Strokes | StrokeAbbrev Name Stroke | StrokeAbbrev
StrokeOrder | ChineseCharacter StrokeOrder Glyph:int Flags | ChineseCharacter Glyph
CharacterDecomposition | ChineseCharacter Decomposition Glyph:int SubIndex:int Flags | ChineseCharacter Glyph SubIndex
LocaleCharacterGlyph | ChineseCharacter Glyph:int Locale | ChineseCharacter Locale
""".strip().splitlines())}  # fmt: skip


def sniff_quote(line: str) -> str:
    """The quoting character of the first data line; ' where it isn't clear."""
    try:
        found = csv.Sniffer().sniff(line, delimiters=",").quotechar
    except csv.Error:
        found = None
    if found and found in line:
        return found
    return '"' if '"' in line else "'"


def read_seed(spark: SparkSession, folder: str, name: str, bmp_only: bool = False, check: bool = True) -> DataFrame:
    """A seed table with seed_row_id, the order of its rows. Missing values are empty text.

    bmp_only leaves out characters beyond the basic plane; in decompositions it writes such components as unknown.
    """
    spec = SPECS[name]
    path = f"{folder}/{spec.file}"
    first = [r.value for r in spark.read.text(path).where("trim(value) <> '' and not startswith(value, '#')").limit(1).collect()]
    quote = sniff_quote(first[0]) if first else '"'
    schema = ", ".join(f"{n} string" for n in spec.names)
    raw = spark.read.schema(schema).option("comment", "#").option("quote", quote).option("escape", "\\").option("emptyValue", "").option("nullValue", "\\N").option("mode", "FAILFAST").option("ignoreLeadingWhiteSpace", True).csv(path)
    rows = raw.withColumn("seed_row_id", F.monotonically_increasing_id()).where(F.coalesce(*spec.names).isNotNull())
    for column in spec.columns:
        n, _, kind = column.partition(":")
        rows = rows.withColumn(n, F.col(n).cast("int") if kind else F.coalesce(n, F.lit("")))
    if bmp_only:
        if name == "CharacterDecomposition":
            rows = rows.withColumn("Decomposition", F.regexp_replace("Decomposition", "[\\x{10000}-\\x{10FFFF}]|⟦[0-9A-F]{6,}⟧", "？"))
        if "ChineseCharacter" in spec.names:
            rows = rows.where(text.codepoint("ChineseCharacter") < 0x10000)
    return assert_unique(rows, spec.keys) if check else rows
