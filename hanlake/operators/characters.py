"""Character queries in batches: a table of keys in, a table of answers out. What isn't known has no row, or null where said."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import ids, text
from ..plans.catalog import CHARACTER as CH
from ..plans.catalog import Catalog, unicode_domain
from ..plans.derive import closure, first_per_group, stroke_count_of
from ..plans.rounds import fixpoint, sized, written
from .readings import convert

LOCALES = "TCJKV"


def has_locale(column: str, locale: str):
    """Whether a set of locale letters, written as text, has one."""
    locale = locale.upper()
    if len(locale) != 1 or locale not in LOCALES:
        raise ValueError(f"no locale {locale!r}")
    return F.contains(F.col(column), F.lit(locale))


def default_of(keys: DataFrame, preferred: DataFrame, all_values: DataFrame, on: Sequence[str], value: str) -> DataFrame:
    """The smallest preferred value of each key, else the smallest of all."""
    a = preferred.groupBy(*on).agg(F.min(value).alias("_a"))
    b = all_values.groupBy(*on).agg(F.min(value).alias("_b"))
    return keys.join(a, list(on), "left").join(b, list(on), "left").select(*keys.columns, F.coalesce("_a", "_b").alias(value)).where(F.col(value).isNotNull())


def all_slots(rows: DataFrame, slots: DataFrame, key: Sequence[str], slot: str, value: str) -> DataFrame:
    """Keys that have, for every slot, one of the slot's values: relational division by counting met slots."""
    wanted = slots.select(slot).distinct().count()
    met = rows.join(sized(slots.select(slot, value).distinct()), value)
    return met.groupBy(*key).agg(F.count_distinct(slot).alias("_met")).where(F.col("_met") == wanted).drop("_met")


def three_step(keys: DataFrame, on: str, value: str, *steps: DataFrame) -> DataFrame:
    """The value of the first step that knows a key; null if none does."""
    out = keys
    for i, s in enumerate(steps):
        out = out.join(s.groupBy(on).agg(F.min(value).alias(f"_{i}")), on, "left")
    return out.select(*keys.columns, F.coalesce(*(F.col(f"_{i}") for i in range(len(steps)))).alias(value))


class CharacterLookup:
    """Queries for one locale and character domain over a catalog's tables.

    ordered: answers are sorted as each method says. A table needs no order and its sort is a shuffle, so it is off unless asked for.
    """

    def __init__(self, catalog: Catalog, locale: str = "T", domain: str = "Unicode", ordered: bool = False):
        if len(locale) != 1 or locale.upper() not in LOCALES:
            raise ValueError(f"no locale {locale!r}")
        catalog.domain(domain)
        self.catalog, self.locale, self.domain, self.ordered = catalog, locale.upper(), domain, ordered

    def _sorted(self, rows: DataFrame, *order) -> DataFrame:
        return rows.orderBy(*order) if self.ordered else rows

    def _within(self, rows: DataFrame, column: str = CH) -> DataFrame:
        return self.catalog.within(rows, self.domain, column)

    # domains

    def domain_characters(self, spark) -> DataFrame:
        chars = self.catalog.domain(self.domain)
        return unicode_domain(spark) if chars is None else chars

    def filter_domain(self, rows: DataFrame, column: str = CH) -> DataFrame:
        """Rows whose character is in the domain; all rows and their number are kept as they are."""
        return rows.where(text.is_han(column)) if self.domain == "Unicode" else self._within(rows, column)

    def in_domain(self, rows: DataFrame, column: str = CH) -> DataFrame:
        """All rows with in_domain: whether their character is in the domain."""
        if self.domain == "Unicode":
            return rows.withColumn("in_domain", text.is_han(column))
        chars = self.catalog.domain(self.domain).select(F.col(CH).alias(column)).distinct().withColumn("in_domain", F.lit(True))
        return rows.join(chars, column, "left").select(*rows.columns, F.coalesce("in_domain", F.lit(False)).alias("in_domain"))

    # readings

    def readings(self, keys: DataFrame, reading: str, converter=None) -> DataFrame:
        """ChineseCharacter, Reading as stored, sorted; with a converter from the stored form as it makes them, each once, and error.

        A character one of whose readings can't be converted has one row: no reading, and the error.
        """
        stored = self.catalog[f"Character{reading}"].select(CH, "Reading").join(keys.select(CH).distinct(), CH, "left_semi")
        if converter is None:
            return self._sorted(stored, CH, "Reading")
        made = stored.select(CH, convert(F.col("Reading"), converter).alias("x"))
        each = made.groupBy(CH).agg(F.collect_set("x.value").alias("values"), F.min("x.error").alias("error"))
        shown = F.when(F.col("error").isNotNull(), F.array(F.lit(None).cast("string"))).otherwise(F.col("values"))
        return self._sorted(each.select(CH, F.explode(shown).alias("Reading"), "error"), CH, "Reading")

    def characters_for_reading(self, keys: DataFrame, reading: str, converter=None) -> DataFrame:
        """keys: Reading, in the stored form or in that which converter makes it of. (Reading as asked for, ChineseCharacter) in the
        domain, sorted. What can't be converted has no characters."""
        asked = keys.select("Reading").distinct()
        wanted = asked.withColumn("_stored", F.col("Reading") if converter is None else convert(F.col("Reading"), converter)["value"])
        found = self.catalog[f"Character{reading}"].select(CH, F.col("Reading").alias("_stored")).join(wanted.where("_stored is not null"), "_stored")
        return self._sorted(self._within(found.select("Reading", CH).distinct()), "Reading", CH)

    # variants and glyphs

    def variants(self, keys: DataFrame, kind: str | None = None) -> DataFrame:
        """ChineseCharacter, Variant, Type of variants in the domain, sorted."""
        rows = self.catalog["CharacterVariant"]
        if kind is not None:
            if kind.upper() not in ("C", "M", "P", "S", "T", "Z"):
                raise ValueError(f"no variant type {kind!r}")
            rows = rows.where(F.col("Type") == kind.upper())
        return self._sorted(self._within(rows.join(keys.select(CH).distinct(), CH, "left_semi"), "Variant").select(CH, "Variant", "Type"), CH, "Variant", "Type")

    def simplified_or_traditional(self, keys: DataFrame, kind: str) -> DataFrame:
        """Variants of type S or T, with the character itself where it is a semantic variant of one of them; itself where there are none."""
        v = self.catalog["CharacterVariant"]
        own = keys.select(CH).distinct()
        typed = v.where(F.col("Type") == kind.upper()).join(own, CH, "left_semi").select(CH, "Variant")
        back = v.where(F.col("Type").isin("M", "P")).select(F.col(CH).alias("Variant"), F.col("Variant").alias(CH))
        itself = typed.join(back, [CH, "Variant"], "left_semi").select(CH, F.col(CH).alias("Variant"))
        none = own.join(typed, CH, "left_anti").select(CH, F.col(CH).alias("Variant"))
        return typed.union(itself).union(none).distinct()

    def glyphs(self, keys: DataFrame) -> DataFrame:
        return self._sorted(self.catalog["Glyphs"].select(CH, "Glyph").join(keys.select(CH).distinct(), CH, "left_semi"), CH, "Glyph")

    def default_glyphs(self, keys: DataFrame, locale: str | None = None) -> DataFrame:
        """The smallest glyph of the locale, else of all."""
        mine = self.catalog["LocaleCharacterGlyph"].where(has_locale("Locale", locale or self.locale))
        return default_of(keys.select(CH).distinct(), mine, self.catalog["Glyphs"], [CH], "Glyph")

    def glyphs_of_locale(self, glyphs: DataFrame) -> DataFrame:
        """Of (ChineseCharacter, Glyph) those that are the locale's, or no locale's in particular."""
        marked = self.catalog["LocaleCharacterGlyph"].select(CH, "Glyph", "Locale")
        found = glyphs.join(marked, [CH, "Glyph"], "left").where(F.col("Locale").isNull() | has_locale("Locale", self.locale))
        return found.select(CH, "Glyph").distinct()

    def _with_glyph(self, keys: DataFrame) -> DataFrame:
        return keys if "Glyph" in keys.columns else self.default_glyphs(keys)

    # strokes

    def stroke_counts(self, keys: DataFrame | None = None, from_orders: bool = False) -> DataFrame:
        """ChineseCharacter, Glyph, StrokeCount; a count of 0 is unknown. from_orders: what the table doesn't know is the
        length of the stroke order, as it is known or made from components."""
        wanted = None if keys is None else self._with_glyph(keys).select(CH, "Glyph").distinct()
        rows = self._within(self.catalog["StrokeCount"].select(CH, "Glyph", "StrokeCount").where("StrokeCount <> 0"))
        rows = rows if wanted is None else rows.join(wanted, [CH, "Glyph"], "left_semi")
        if from_orders:
            orders = self._within(self.stroke_orders())
            orders = orders if wanted is None else orders.join(wanted, [CH, "Glyph"], "left_semi")
            rows = rows.unionByName(orders.join(rows, [CH, "Glyph"], "left_anti").select(CH, "Glyph", stroke_count_of("StrokeOrder").alias("StrokeCount")))
        return rows

    def stroke_for_abbreviation(self, keys: DataFrame, column: str = "StrokeAbbrev") -> DataFrame:
        return keys.join(self.catalog["Strokes"].select("StrokeAbbrev", "Name", "Stroke"), column, "left")

    def stroke_orders(self, keys: DataFrame | None = None, partial: bool = False) -> DataFrame:
        """ChineseCharacter, Glyph, StrokeOrder, made from components where there is none; see synthesise_stroke_orders()."""
        counts = self.catalog["StrokeCount"] if partial and "StrokeCount" in self.catalog else None
        rows = synthesise_stroke_orders(self.catalog["StrokeOrder"], self.catalog["CharacterDecomposition"], counts)
        return rows if keys is None else rows.join(self._with_glyph(keys).select(CH, "Glyph").distinct(), [CH, "Glyph"], "left_semi")

    def stroke_forms(self, orders: DataFrame) -> DataFrame:
        """Adds Strokes, an array of stroke characters, null where a stroke is unknown."""
        pairs = [tuple(r) for r in self.catalog["Strokes"].select("StrokeAbbrev", "Stroke").limit(1001).collect()]
        if len(pairs) > 1000:
            raise ValueError("more than 1000 kinds of strokes")
        forms = F.create_map(*(F.lit(x) for pair in pairs for x in pair)) if pairs else F.lit(None).cast("map<string,string>")
        return orders.withColumn("Strokes", F.transform(F.split("StrokeOrder", "[ -]"), lambda s: F.try_element_at(forms, s)))

    # radicals

    def kangxi_radicals(self, keys: DataFrame) -> DataFrame:
        return self.catalog["CharacterKangxiRadical"].select(CH, "RadicalIndex").join(keys.select(CH).distinct(), CH, "left_semi")

    def radical_residuals(self, keys: DataFrame | None = None, kangxi_only: bool = False) -> DataFrame:
        """All radical forms in a character, with layout, position and residual strokes, in order."""
        rows = self.catalog["CharacterRadicalResidualStrokeCount"]
        if keys is not None:
            rows = rows.join(self._with_glyph(keys).select(CH, "Glyph").distinct(), [CH, "Glyph"], "left_semi")
        if kangxi_only:
            rows = rows.join(self.catalog["CharacterKangxiRadical"].select(CH, "RadicalIndex"), [CH, "RadicalIndex"], "left_semi")
        return self._sorted(rows, CH, "Glyph", "RadicalIndex", "ResidualStrokeCount", "RadicalGlyph", "RadicalForm", "MainCharacterLayout", "RadicalRelativePosition")

    def radical_residual_maps(self, keys: DataFrame | None = None) -> DataFrame:
        """ChineseCharacter, Glyph, radicals: radical index -> its forms with layout, position and residual strokes, in order."""
        entry = F.struct("ResidualStrokeCount", "RadicalGlyph", "RadicalForm", "MainCharacterLayout", "RadicalRelativePosition")
        each = self.radical_residuals(keys).groupBy(CH, "Glyph", "RadicalIndex").agg(F.array_sort(F.collect_set(entry)).alias("forms"))
        return each.groupBy(CH, "Glyph").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("RadicalIndex", "forms")))).alias("radicals"))

    def residual_maps(self, keys: DataFrame | None = None) -> DataFrame:
        """ChineseCharacter, Glyph, residuals: radical index -> residual strokes."""
        return self.residuals(keys).groupBy(CH, "Glyph").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("RadicalIndex", "ResidualStrokeCount")))).alias("residuals"))

    def residuals(self, keys: DataFrame | None = None, kangxi_only: bool = False) -> DataFrame:
        """ChineseCharacter, Glyph, RadicalIndex, ResidualStrokeCount in the domain; 0 is a count."""
        rows = self._within(self.catalog["CharacterResidualStrokeCount"].select(CH, "Glyph", "RadicalIndex", "ResidualStrokeCount"))
        if kangxi_only:
            rows = rows.join(self.catalog["CharacterKangxiRadical"].select(CH, "RadicalIndex"), [CH, "RadicalIndex"], "left_semi")
        rows = rows if keys is None else rows.join(self._with_glyph(keys).select(CH, "Glyph").distinct(), [CH, "Glyph"], "left_semi")
        return rows.select(CH, "Glyph", "RadicalIndex", "ResidualStrokeCount")

    def characters_for_radical(self, keys: DataFrame, kangxi_only: bool = True) -> DataFrame:
        """keys: RadicalIndex. (RadicalIndex, ChineseCharacter), each once."""
        rows = self.catalog["CharacterKangxiRadical" if kangxi_only else "CharacterResidualStrokeCount"]
        return self._within(rows.select("RadicalIndex", CH).distinct().join(keys.select("RadicalIndex").distinct(), "RadicalIndex", "left_semi"))

    def residuals_for_radical(self, keys: DataFrame, kangxi_only: bool = True) -> DataFrame:
        found = self.residuals(kangxi_only=kangxi_only).join(keys.select("RadicalIndex").distinct(), "RadicalIndex", "left_semi")
        return found.select(CH, "Glyph", "RadicalIndex", "ResidualStrokeCount")

    def _radical_forms(self) -> DataFrame:
        return self.catalog["KangxiRadical"].where(has_locale("Locale", self.locale))

    def radical_forms(self, keys: DataFrame, kind: str = "R") -> DataFrame:
        """RadicalIndex, Form: the first radical form (R), or all variant forms (V) in order."""
        rows = self._radical_forms().where(F.col("Type") == kind).join(keys.select("RadicalIndex").distinct(), "RadicalIndex", "left_semi")
        if kind == "R":
            return first_per_group(rows.select("RadicalIndex", "SubIndex", "Form"), ["RadicalIndex"], ["SubIndex"]).select("RadicalIndex", "Form")
        return self._sorted(rows, "RadicalIndex", "SubIndex").select("RadicalIndex", "Form")

    def _equivalents(self) -> DataFrame:
        return self.catalog["RadicalEquivalentCharacter"].where(has_locale("Locale", self.locale))

    def radical_indices(self, keys: DataFrame) -> DataFrame:
        """keys: Form. RadicalIndex of a radical form, else of a character equivalent to one, else of an isolated character; else null."""
        forms = self._radical_forms().select("Form", "RadicalIndex")
        through = forms.join(self._equivalents().select("Form", "EquivalentForm"), "Form").select(F.col("EquivalentForm").alias("Form"), "RadicalIndex")
        isolated = self.catalog["KangxiRadicalIsolatedCharacter"].where(has_locale("Locale", self.locale)).select(F.col("EquivalentForm").alias("Form"), "RadicalIndex")
        return three_step(keys.select("Form").distinct(), "Form", "RadicalIndex", forms, through, isolated)

    def representative_characters(self, keys: DataFrame) -> DataFrame:
        """RadicalIndex, Form: forms, their equivalents and isolated characters, sorted."""
        forms = self._radical_forms()
        through = forms.join(self._equivalents().select("Form", "EquivalentForm"), "Form").select("RadicalIndex", F.col("EquivalentForm").alias("Form"))
        isolated = self.catalog["KangxiRadicalIsolatedCharacter"].where(has_locale("Locale", self.locale)).select("RadicalIndex", F.col("EquivalentForm").alias("Form"))
        every = forms.select("RadicalIndex", "Form").union(through).union(isolated).distinct()
        return self._sorted(every.join(keys.select("RadicalIndex").distinct(), "RadicalIndex", "left_semi"), "RadicalIndex", "Form")

    def is_radical_form(self, keys: DataFrame) -> DataFrame:
        """keys: Form. The same forms with is_form (a form of a radical, or equivalent to one) and is_radical_char (by code point)."""
        known = self.radical_indices(keys).select("Form", F.col("RadicalIndex").isNotNull().alias("is_form"))
        return keys.join(known, "Form", "left").select(*keys.columns, F.coalesce("is_form", F.lit(False)).alias("is_form"), text.is_radical_form("Form").alias("is_radical_char"))

    def equivalent_of_form(self, keys: DataFrame) -> DataFrame:
        """Form, EquivalentForm: the first of the seed's rows."""
        rows = self._equivalents().join(keys.select("Form").distinct(), "Form", "left_semi")
        return first_per_group(rows.select("Form", "seed_row_id", "EquivalentForm"), ["Form"], ["seed_row_id"]).select("Form", "EquivalentForm")

    def forms_of_equivalent(self, keys: DataFrame) -> DataFrame:
        """EquivalentForm, Form, in the seed's order."""
        return self._sorted(self._equivalents().join(keys.select("EquivalentForm").distinct(), "EquivalentForm", "left_semi"), "seed_row_id").select("EquivalentForm", "Form")

    # components

    def decompositions(self, keys: DataFrame | None = None) -> DataFrame:
        """ChineseCharacter, Glyph, entries: an array of parsed sequences in the order of SubIndex."""
        rows = self._within(self.catalog["CharacterDecomposition"])
        if keys is not None:
            rows = rows.join(self._with_glyph(keys).select(CH, "Glyph").distinct(), [CH, "Glyph"], "left_semi")
        ordered = F.array_sort(F.collect_list(F.struct("SubIndex", ids.parse("Decomposition").alias("parts"))))
        return rows.groupBy(CH, "Glyph").agg(F.transform(ordered, lambda x: x["parts"]).alias("entries"))

    def decomposition_rows(self, keys: DataFrame) -> DataFrame:
        """The trees of all decompositions as rows: root, path (positions of ways and parts from the root), depth, part and part_glyph.

        A character that comes again among its own parts is an error.
        """
        table = self.catalog["CharacterDecomposition"]
        part = F.posexplode(ids.parse("Decomposition")).alias("pos", "c")
        step = table.select(F.col(CH).alias("_ch"), F.col("Glyph").alias("_g"), "SubIndex", part).select("_ch", "_g", "SubIndex", "pos", F.col("c.op").alias("op"), F.col("c.char").alias("part"), F.col("c.glyph").alias("part_glyph"))
        named = F.concat_ws("/", "part", F.col("part_glyph").cast("string"))
        level = self._with_glyph(keys).select(CH, "Glyph", F.lit(None).cast("string").alias("op"), F.col(CH).alias("part"), F.col("Glyph").alias("part_glyph"), F.array().cast("array<int>").alias("path"))
        level = written(level.withColumn("_above", F.array(named)))
        levels = [level]
        while True:
            down = level.select(CH, "Glyph", F.col("part").alias("_ch"), F.col("part_glyph").alias("_g"), "path", "_above").where("_ch is not null")
            below = down.join(step, ["_ch", "_g"]).select(CH, "Glyph", "op", "part", "part_glyph", F.concat("path", F.array("SubIndex", "pos")).alias("path"), "_above")
            again = F.col("part").isNotNull() & F.array_contains("_above", named)
            level = written(below.withColumn("_circle", again).withColumn("_above", F.when(F.col("part").isNotNull(), F.concat("_above", F.array(named))).otherwise(F.col("_above"))))
            if level.isEmpty():
                break
            if circle := level.where("_circle").limit(1).collect():
                raise ValueError(f"the decomposition of {circle[0][CH]!r} goes round in a circle")
            levels.append(level.drop("_circle"))
        return reduce(DataFrame.unionAll, levels).drop("_above").withColumn("depth", F.size("path") / 2)

    def is_component(self, keys: DataFrame) -> DataFrame:
        """keys: ChineseCharacter, Glyph, Component, ComponentGlyph. The same rows with is_component."""
        on = [CH, "Glyph", "Component", "ComponentGlyph"]
        known = self.catalog["ComponentLookup"].select(*on).distinct().withColumn("is_component", F.lit(True))
        return keys.join(known, on, "left").withColumn("is_component", F.coalesce("is_component", F.lit(False)))

    def characters_for_components(self, components: Sequence[Sequence[str]], with_radical_forms: bool = False, all_glyphs: bool = False, expand: bool = True) -> DataFrame:
        """(ChineseCharacter, Glyph) that have one of each slot's characters as a component or are it, by stroke count.

        expand: a radical form or its character stands for all equivalent ones. Radical forms are left out of the result, and only
        the locale's glyphs are looked for, unless said otherwise.
        """
        lookup = self.catalog["ComponentLookup"]
        spark = lookup.sparkSession
        slots = spark.createDataFrame([(i, c) for i, slot in enumerate(components) for c in slot], "slot int, Component string")
        if expand:
            indices = self.radical_indices(slots.select(F.col("Component").alias("Form"))).where("RadicalIndex is not null")
            alike = indices.join(self.representative_characters(indices).select("RadicalIndex", F.col("Form").alias("other")), "RadicalIndex")
            slots = slots.union(slots.join(alike.select(F.col("Form").alias("Component"), "other"), "Component").select("slot", "other")).distinct()
        itself = self.catalog["Glyphs"].select(CH, "Glyph", F.col(CH).alias("Component")) if "Glyphs" in self.catalog else lookup.select(CH, "Glyph", F.col(CH).alias("Component")).distinct()
        found = all_slots(lookup.select(CH, "Glyph", "Component").union(itself), slots, [CH, "Glyph"], "slot", "Component")
        if not all_glyphs and "LocaleCharacterGlyph" in self.catalog:
            found = self.glyphs_of_locale(found)
        if not with_radical_forms:
            found = found.where(~text.is_radical_form(CH))
        found = self._within(found.distinct())
        counts = self.catalog["StrokeCount"].select(CH, "Glyph", "StrokeCount")
        return self._sorted(found.join(counts, [CH, "Glyph"], "left"), F.col("StrokeCount").asc_nulls_first(), CH, "Glyph").select(CH, "Glyph")


# ---------------------------------------------------------------- stroke order synthesis


#: What a whole frame is drawn as before and behind its inside; parts that are drawn last though they come first.
FRAMES = {"⿴": {"S-HZ-H": ("S-HZ", "H")}, "⿷": {"H-SZ": ("H", "SZ"), "H-SW": ("H", "SW")}}
DRAWN_LAST = ("辶", "廴", "乙")


def _compose(parts: list, orders: dict) -> str | None:
    """The stroke order of one parsed sequence, given the orders of its components; null where there is none."""

    def piece(at: int):
        op, char, glyph = parts[at]["op"], parts[at]["char"], parts[at]["glyph"]
        if op is None:
            return ([orders[char, glyph]] if orders.get((char, glyph)) else None), at + 1
        found, first = [], at + 1
        at += 1
        for _ in range(2 + (op in ids.TRINARY)):
            own, at = piece(at)
            if own is None:
                return None, at
            found.append(own)
        if op == "⿻":
            return None, at
        if op in FRAMES:
            frame = FRAMES[op].get(found[0][0].replace(" ", "-")) if len(found[0]) == 1 else None
            return (frame and [frame[0], *found[1], frame[1]]), at
        turned = op == "⿶" or op == "⿺" and parts[first]["char"] in DRAWN_LAST
        return [x for own in (found[::-1] if turned else found) for x in own], at

    try:
        order, end = piece(0)
    except IndexError:
        return None
    return " ".join(order) if order and end == len(parts) else None


def synthesise_stroke_orders(own: DataFrame, decomposition: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """ChineseCharacter, Glyph, StrokeOrder: own entries, and orders put together from components, level by level.

    A character takes its first decomposition all of whose components have an order. A surrounding operator draws the frame
    around what is inside; some draw the second part first; overlaid parts have no known order. With counts, a component that
    has no order gets one ? for each stroke, once all that can be known is.
    """
    parsed = written(decomposition.select(CH, "Glyph", "SubIndex", ids.parse("Decomposition").alias("parts")))
    each = parsed.select(CH, "Glyph", "SubIndex", F.explode(F.array_distinct(F.filter("parts", lambda x: x["char"].isNotNull()))).alias("c"))
    each = written(each.select(CH, "Glyph", "SubIndex", F.col("c.char").alias("part"), F.col("c.glyph").alias("part_glyph")))
    known = own.select(CH, "Glyph", "StrokeOrder").where("StrokeOrder <> ''")

    @F.pandas_udf("string")
    def composed(parts: pd.Series, orders: pd.Series) -> pd.Series:
        return pd.Series([_compose(list(p), {(x["part"], x["part_glyph"]): x["StrokeOrder"] for x in o}) for p, o in zip(parts, orders)], dtype=object)

    def grown(known: DataFrame, newest: DataFrame) -> DataFrame:
        # decompositions that a new order touches, of characters that have none yet
        touched = each.join(newest.select(F.col(CH).alias("part"), F.col("Glyph").alias("part_glyph")), ["part", "part_glyph"], "left_semi").select(CH, "Glyph", "SubIndex").distinct()
        todo = each.join(touched, [CH, "Glyph", "SubIndex"], "left_semi").join(known, [CH, "Glyph"], "left_anti")
        have = todo.join(known.select(F.col(CH).alias("part"), F.col("Glyph").alias("part_glyph"), "StrokeOrder"), ["part", "part_glyph"], "left")
        orders = F.collect_list(F.struct("part", "part_glyph", "StrokeOrder")).alias("orders")
        whole = have.groupBy(CH, "Glyph", "SubIndex").agg(orders, F.count(F.when(F.col("StrokeOrder").isNull(), 1)).alias("lacking")).where("lacking = 0")
        made = whole.join(parsed, [CH, "Glyph", "SubIndex"]).select(CH, "Glyph", "SubIndex", composed("parts", "orders").alias("StrokeOrder")).where("StrokeOrder is not null")
        return first_per_group(made, [CH, "Glyph"], ["SubIndex"]).select(CH, "Glyph", "StrokeOrder")

    known = fixpoint(known, grown, [CH, "Glyph"])
    if counts is not None:
        marks = counts.where("StrokeCount > 0").select(CH, "Glyph", F.array_join(F.array_repeat(F.lit("?"), F.col("StrokeCount")), "-").alias("StrokeOrder"))
        everything = fixpoint(known.unionByName(marks.join(known, [CH, "Glyph"], "left_anti").join(decomposition, [CH, "Glyph"], "left_anti")), grown, [CH, "Glyph"])
        known = everything.join(marks.where(F.col("StrokeOrder").isNotNull()).join(known, [CH, "Glyph"], "left_anti"), [CH, "Glyph", "StrokeOrder"], "left_anti")
    return known


def basic_components(decomposition: DataFrame, characters: DataFrame) -> DataFrame:
    """Component, ComponentGlyph: those in the characters' closure that aren't decomposed themselves."""
    from ..plans.derive import component_edges

    edges = component_edges(decomposition)
    within = closure(edges, [CH, "Glyph"], ["Component", "ComponentGlyph"]).join(characters.select(CH).distinct(), CH, "left_semi")
    parts = within.select("Component", "ComponentGlyph").distinct()
    return parts.join(decomposition.select(F.col(CH).alias("Component"), F.col("Glyph").alias("ComponentGlyph")), ["Component", "ComponentGlyph"], "left_anti")


def missing_component_counts(decomposition: DataFrame, orders: DataFrame) -> DataFrame:
    """Basic components without a stroke order, and how many characters have them."""
    from ..plans.derive import component_lookup

    lookup = component_lookup(decomposition)
    leaf = lookup.join(decomposition.select(F.col(CH).alias("Component"), F.col("Glyph").alias("ComponentGlyph")), ["Component", "ComponentGlyph"], "left_anti")
    lacking = leaf.join(orders.select(F.col(CH).alias("Component"), F.col("Glyph").alias("ComponentGlyph")), ["Component", "ComponentGlyph"], "left_anti")
    return lacking.groupBy("Component", "ComponentGlyph").agg(F.count_distinct(CH).alias("characters"))


def stroke_order_gaps(decomposition: DataFrame, orders: DataFrame) -> DataFrame:
    """missing, characters: each set of basic components without a stroke order, and how many (character, glyph) wait for just these.

    The largest sets of one component are those whose order would unlock most by itself.
    """
    from ..plans.derive import component_lookup

    as_part = lambda rows: rows.select(F.col(CH).alias("Component"), F.col("Glyph").alias("ComponentGlyph")).distinct()
    leaf = component_lookup(decomposition).join(as_part(decomposition), ["Component", "ComponentGlyph"], "left_anti")
    lacking = leaf.join(as_part(orders), ["Component", "ComponentGlyph"], "left_anti").join(orders.select(CH, "Glyph").distinct(), [CH, "Glyph"], "left_anti")
    sets = lacking.groupBy(CH, "Glyph").agg(F.array_sort(F.collect_set(F.struct("Component", "ComponentGlyph"))).alias("missing"))
    return sets.groupBy("missing").agg(F.count("*").alias("characters"))
