"""Radicals inside characters: where each radical form stands, and how many strokes remain without it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ids, text
from .rounds import fixpoint, written

CH = "ChineseCharacter"

#: Fixed values: (outer layout, position, inner layout, position) that give a plain layout and position in the whole character.
LAYOUTS = [
    ("⿰", 0, "⿰", 0, "⿰", 0), ("⿰", 1, "⿰", 1, "⿰", 1), ("⿱", 0, "⿱", 0, "⿱", 0), ("⿱", 1, "⿱", 1, "⿱", 1),
    ("⿲", 0, "⿲", 0, "⿰", 0), ("⿲", 2, "⿲", 2, "⿰", 1), ("⿳", 0, "⿳", 0, "⿱", 0), ("⿳", 2, "⿳", 2, "⿱", 0),
    ("⿲", 0, "⿰", 0, "⿰", 0), ("⿲", 2, "⿰", 1, "⿰", 1), ("⿰", 0, "⿲", 0, "⿰", 0), ("⿰", 1, "⿲", 1, "⿰", 1),
    ("⿳", 0, "⿱", 0, "⿱", 0), ("⿳", 2, "⿱", 1, "⿱", 1), ("⿱", 0, "⿳", 0, "⿱", 0), ("⿱", 1, "⿳", 2, "⿱", 1),
]
_WHOLE = {x[:4]: x[4:] for x in LAYOUTS}


def place(outer: str | None, outer_position: int | None, inner: str, inner_position: int) -> tuple[str, int]:
    """Where something stands that stands so inside a part that stands so; anything complex is ⿻."""
    return _WHOLE.get((outer, outer_position, inner, inner_position)) or ((inner, inner_position) if outer is None and inner != "⿻" else ("⿻", 0))


def _placed_parts(parts) -> list[dict]:
    """The components of a parsed sequence with layout and position."""
    waiting: list[tuple[str | None, int | None]] = [(None, None)]
    out = []
    for p in parts:
        if not waiting:
            return []
        layout, position = waiting.pop()
        if p["op"] is None:
            out.append({"part": p["char"], "part_glyph": p["glyph"], "layout": layout, "position": position})
        else:
            waiting += [place(layout, position, p["op"], i) for i in reversed(range(2 + (p["op"] in ids.TRINARY)))]
    return out if not waiting else []


def radical_residuals(decomposition: DataFrame, forms: DataFrame, counts: DataFrame) -> DataFrame:
    """All radical forms (Form, RadicalIndex) in characters: form, glyph, layout, position, residual strokes.

    Parts of parts are joined level by level. Rows whose other parts' strokes aren't all known are left out; a character with
    one form in one place and different counts has no rows. Characters of the radical blocks have none.
    """

    @F.pandas_udf("array<struct<part: string, part_glyph: int, layout: string, position: int>>")
    def placed(parts: pd.Series) -> pd.Series:
        return parts.map(lambda x: _placed_parts(list(x)))

    rows = decomposition.where(~text.is_radical_form(CH)).select(CH, "Glyph", "SubIndex", F.posexplode(placed(ids.parse("Decomposition"))).alias("n", "p")).select(CH, "Glyph", "SubIndex", "n", "p.*")
    strokes = rows.join(counts.select(F.col(CH).alias("part"), F.col("Glyph").alias("part_glyph"), "StrokeCount"), ["part", "part_glyph"], "left")
    whole = strokes.groupBy(CH, "Glyph", "SubIndex").agg(F.sum("StrokeCount").alias("total"), F.count(F.when(F.col("StrokeCount").isNull(), 1)).alias("unknown"))
    rest = F.when(F.col("unknown") == 0, F.col("total") - F.col("StrokeCount")).when((F.col("unknown") == 1) & F.col("StrokeCount").isNull(), F.coalesce("total", F.lit(0)))
    step = strokes.join(whole, [CH, "Glyph", "SubIndex"]).select(CH, "Glyph", "part", "part_glyph", "layout", "position", rest.cast("int").alias("others")).where("others is not null")
    own = step.join(forms.select(F.col("Form").alias("part"), "RadicalIndex").distinct(), "part").where("layout is not null")
    columns = [CH, "Glyph", "RadicalIndex", "RadicalForm", "RadicalGlyph", "MainCharacterLayout", "RadicalRelativePosition", "ResidualStrokeCount"]
    found = own.select(CH, "Glyph", "RadicalIndex", F.col("part").alias("RadicalForm"), F.col("part_glyph").alias("RadicalGlyph"), F.col("layout").alias("MainCharacterLayout"), F.col("position").alias("RadicalRelativePosition"), F.col("others").alias("ResidualStrokeCount")).distinct()
    table = decomposition.sparkSession.createDataFrame(LAYOUTS, "layout string, position int, inner string, inner_position int, made string, made_position int")
    step, table = written(step), F.broadcast(table)

    def inside(known: DataFrame, newest: DataFrame) -> DataFrame:
        inner = newest.select(F.col(CH).alias("part"), F.col("Glyph").alias("part_glyph"), "RadicalIndex", "RadicalForm", "RadicalGlyph", F.col("MainCharacterLayout").alias("inner"), F.col("RadicalRelativePosition").alias("inner_position"), "ResidualStrokeCount")
        up = step.join(inner, ["part", "part_glyph"]).join(table, ["layout", "position", "inner", "inner_position"], "left")
        layout = F.when(F.col("layout").isNull() & (F.col("inner") != "⿻"), F.col("inner")).otherwise(F.coalesce("made", F.lit("⿻")))
        position = F.when(F.col("layout").isNull() & (F.col("inner") != "⿻"), F.col("inner_position")).otherwise(F.coalesce("made_position", F.lit(0)))
        return up.select(CH, "Glyph", "RadicalIndex", "RadicalForm", "RadicalGlyph", layout.alias("MainCharacterLayout"), position.alias("RadicalRelativePosition"), (F.col("ResidualStrokeCount") + F.col("others")).alias("ResidualStrokeCount"))

    found = fixpoint(found, inside, columns)
    unclear = found.groupBy(CH, "Glyph", "RadicalForm", "RadicalGlyph", "MainCharacterLayout", "RadicalRelativePosition").agg(F.count_distinct("ResidualStrokeCount").alias("ways")).where("ways > 1").select(CH, "Glyph").distinct()
    return found.join(unclear, [CH, "Glyph"], "left_anti").select(columns)


def locale_decompositions(decomposition: DataFrame, defaults: DataFrame, locale_default: DataFrame) -> DataFrame:
    """Decompositions with components in the glyphs of a locale, where those differ from the ones that all locales share.

    defaults, locale_default: ChineseCharacter, Glyph. A component written without a glyph of its own (0) gets the locale's.
    """
    changed = locale_default.join(defaults.select(CH, F.col("Glyph").alias("_d")), CH).where(F.col("Glyph") != F.col("_d")).select(F.col(CH).alias("char"), F.col("Glyph").alias("new"))
    parts = decomposition.select(CH, "Glyph", "SubIndex", F.posexplode(ids.parse("Decomposition")).alias("n", "p"))
    parts = parts.select(CH, "Glyph", "SubIndex", "n", F.col("p.op").alias("op"), F.col("p.char").alias("char"), F.col("p.glyph").alias("own"))
    moved = parts.join(changed, "char", "left").withColumn("own", F.when((F.col("own") == 0) & F.col("new").isNotNull(), F.col("new")).otherwise(F.col("own")))
    ordered = F.array_sort(F.collect_list(F.struct("n", "op", "char", F.col("own").alias("glyph"))))
    return moved.groupBy(CH, "Glyph", "SubIndex").agg(ids.write(F.transform(ordered, lambda x: F.struct(x["op"].alias("op"), x["char"].alias("char"), x["glyph"].alias("glyph")))).alias("Decomposition"))


def syllable_mapping(parts: DataFrame, initial_rules: DataFrame, final_rules: DataFrame) -> DataFrame:
    """Syllables of one scheme in another, from rules for initials and finals; syllables without a rule have a null target.

    parts: syllable, initial, final. Rules: initial (final), target, and before: a pattern of the final (initial) that they need.
    """
    a = initial_rules.select("initial", F.col("target").alias("_i"), F.col("before").alias("_bi"))
    b = final_rules.select("final", F.col("target").alias("_f"), F.col("before").alias("_bf"))
    made = parts.join(F.broadcast(a), (parts["initial"] == a["initial"]) & F.coalesce(F.regexp_like(parts["final"], F.concat(F.lit("^(?:"), F.col("_bi"), F.lit(")$"))), F.lit(True)), "left").drop(a["initial"])
    made = made.join(F.broadcast(b), (made["final"] == b["final"]) & F.coalesce(F.regexp_like(made["initial"], F.concat(F.lit("^(?:"), F.col("_bf"), F.lit(")$"))), F.lit(True)), "left").drop(b["final"])
    return made.select("syllable", F.concat("_i", "_f").alias("target")).distinct()
