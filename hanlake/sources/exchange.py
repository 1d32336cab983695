"""Exchange with wikis and corpora of description sequences: their rows as tables, tables as their rows, similar ones merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids, text
from ..plans.derive import CH, first_per_group

# ---------------------------------------------------------------- wikis


def wiki_rows(lines: DataFrame, columns: list[str], separator: str = r"\s*;\s*") -> DataFrame:
    """value: lines of an exported page. Columns of lines that have as many fields; quotes around a field don't count."""
    fields = F.transform(F.split("value", separator), lambda x: F.regexp_replace(F.trim(x), '^"(.*)"$', "$1"))
    rows = lines.select(fields.alias("f")).where(F.size("f") == len(columns))
    return rows.select(*(F.element_at("f", i + 1).alias(c) for i, c in enumerate(columns)))


def wiki_pages(rows: DataFrame, title: Column, template: str) -> DataFrame:
    """(title, page): each row as a page of one template call, XML-escaped, for import; null columns are left out."""
    escaped = lambda c: F.replace(F.replace(F.replace(c.cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    fields = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"|{c}="), escaped(F.col(c)))) for c in rows.columns]
    body = F.concat(F.lit("{{" + template + "\n"), F.concat_ws("\n", *fields), F.lit("\n}}"))
    return rows.select(title.alias("title"), F.concat(F.lit("<page><title>"), escaped(title), F.lit("</title><revision><text>"), body, F.lit("</text></revision></page>")).alias("page"))


# ---------------------------------------------------------------- corpora of description sequences


def sequence_lines(lines: DataFrame) -> DataFrame:
    """value: code <tab> character <tab> sequence lines. ChineseCharacter and Decomposition, comments and damaged lines left out."""
    parts = F.split("value", "\t")
    rows = lines.where(~F.col("value").startswith(";") & ~F.col("value").startswith("#") & (F.size(parts) >= 3))
    return rows.select(F.trim(F.get(parts, 1)).alias(CH), F.trim(F.get(parts, 2)).alias("Decomposition"))


def sequence_csv(lines: DataFrame, separator: str = ",") -> DataFrame:
    """value: character, then its parts: a sequence with two parts and their layout: c,layout,first,second."""
    parts = F.split("value", separator)
    rows = lines.where(~F.col("value").startswith("#") & (F.size(parts) >= 4))
    return rows.select(F.trim(F.get(parts, 0)).alias(CH), F.concat(*(F.trim(F.get(parts, i)) for i in (1, 2, 3))).alias("Decomposition"))


def usable_sequences(rows: DataFrame) -> DataFrame:
    """Whole sequences only, with pseudo characters (&name; and #n) written as unknown; a character that is its own only part
    has none. Rows are numbered anew by SubIndex, from 0."""
    unknown = F.regexp_replace(F.regexp_replace("Decomposition", "&[^;]*;", "？"), r"#\d+", "？")
    found = rows.select(CH, unknown.alias("Decomposition")).where(ids.is_valid("Decomposition") & (F.col("Decomposition") != F.col(CH))).distinct()
    return _numbered(found)


def _numbered(rows: DataFrame) -> DataFrame:
    each = rows.groupBy(CH).agg(F.array_sort(F.collect_set("Decomposition")).alias("all"))
    return each.select(CH, F.lit(0).alias("Glyph"), F.posexplode("all").alias("SubIndex", "Decomposition")).select(CH, "Glyph", "SubIndex", "Decomposition")


def merge_similar(rows: DataFrame) -> DataFrame:
    """Of each character's sequences, those that no other says in more detail.

    One is covered by another of the same layout if each of its parts is the other's or unknown (？); parts that are whole
    sequences are compared one by one, so both must have the same operators at the same places.
    """
    parsed = rows.select(CH, "Decomposition", ids.parse("Decomposition").alias("parts"))
    other = parsed.select(F.col(CH).alias("_c"), F.col("Decomposition").alias("_d"), F.col("parts").alias("_parts"))
    part = lambda x: F.coalesce(x["op"], x["char"])
    same = F.forall(F.zip_with("parts", "_parts", lambda a, b: (part(a) == part(b)) | (part(a) == "？") & b["char"].isNotNull()), lambda x: F.coalesce(x, F.lit(False)))
    # sequences of one character with equal operators meet; those are few
    layout = lambda c: F.array_join(F.transform(F.col(c), lambda x: F.coalesce(x["op"], F.lit("."))), "")
    covered = parsed.join(other, (F.col(CH) == F.col("_c")) & (layout("parts") == layout("_parts")) & (F.col("Decomposition") != F.col("_d"))).where(same).select(CH, "Decomposition").distinct()
    return _numbered(rows.select(CH, "Decomposition").distinct().join(covered, [CH, "Decomposition"], "left_anti"))


def additional_readings(spark) -> DataFrame:
    """Readings of characters that the other sources lack. Fixed values."""
    return spark.createDataFrame([("〇", "ling2")], f"{CH} string, Reading string")


def one_decomposition(rows: DataFrame) -> DataFrame:
    """The first sequence of each character and glyph."""
    return first_per_group(rows.select(CH, "Glyph", "SubIndex", "Decomposition"), [CH, "Glyph"], ["SubIndex"])


def unknown_parts(rows: DataFrame) -> DataFrame:
    """Characters with a part that isn't known."""
    return rows.where(F.exists(ids.parse("Decomposition"), lambda x: x["char"].isin("？", "?"))).select(CH).distinct().where(~text.is_radical_form(CH))
