"""Derived tables, each a function of other tables, and a runner that builds them in the order of their needs."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids, text
from .rounds import written

CH = "ChineseCharacter"


# ---------------------------------------------------------------- from Unihan


def column_values(wide: DataFrame, column: str, key: str = CH, ignore_missing: bool = False) -> DataFrame:
    """(key, column) where the column isn't null; a missing column is an error or no rows."""
    if column not in wide.columns:
        if not ignore_missing:
            raise ValueError(f"no column {column!r}")
        return wide.where(F.lit(False)).select(key, F.lit(None).cast("string").alias(column))
    return wide.where(F.col(column).isNotNull()).select(key, column)


def stroke_counts_from(wide: DataFrame) -> DataFrame:
    return column_values(wide, "kTotalStrokes").select(CH, F.col("kTotalStrokes").cast("int").alias("StrokeCount"))


def radical_indices(wide: DataFrame, column: str, key: str = CH) -> DataFrame:
    """The radical of entries like 120.3; other entries are left out."""
    pattern = r"^(\d+)\.(\d+)"
    return wide.where(F.col(column).rlike(pattern)).select(key, F.regexp_extract(column, pattern, 1).cast("int").alias("RadicalIndex"))


#: Variant columns and their types; what entries of a type look like, and the code points in them.
VARIANT_TYPES = {
    "kCompatibilityVariant": "C", "kSemanticVariant": "M", "kSimplifiedVariant": "S",
    "kSpecializedSemanticVariant": "P", "kTraditionalVariant": "T", "kZVariant": "Z",
}
_ONE, _SOME, _SOURCED = r"^\s*U\+[0-9A-F]+\s*$", r"^(U\+[0-9A-F]+( |$))+$", r"^(U\+[0-9A-F]+(<\S+)?( |$))+$"
VARIANT_FORMS = {"C": _ONE, "S": _SOME, "T": _SOME, "M": _SOURCED, "P": _SOURCED, "Z": _SOURCED}


def variants(wide: DataFrame) -> DataFrame:
    """ChineseCharacter, Variant, Type: all code points of well-formed variant entries."""
    there = [c for c in VARIANT_TYPES if c in wide.columns]
    pairs = F.array(*(F.struct(F.lit(VARIANT_TYPES[c]).alias("Type"), F.col(c).alias("value")) for c in there))
    rows = wide.select(CH, F.explode(pairs).alias("v")).select(CH, "v.Type", F.trim("v.value").alias("value"))
    form = F.lit(False)
    for kind, pattern in VARIANT_FORMS.items():
        form = form | ((F.col("Type") == kind) & F.col("value").rlike(pattern))
    codes = F.explode(F.regexp_extract_all("value", F.lit(r"(?:^| )U\+([0-9A-F]+)"), 1)).alias("code")
    return rows.where(form).select(CH, codes, "Type").select(CH, text.char_of(F.conv("code", 16, 10)).alias("Variant"), "Type").distinct()


#: Character sets and the Unihan columns that list them.
SET_COLUMNS = {"IICore": "kIICore", "GB2312": "kGB0", "BIG5": "kBigFive", "HKSCS": "kHKSCS", "JISX0208": "kJis0", "JISX0213": "kJIS0213"}
UNION_SETS = {"BIG5HKSCS": ("BIG5", "HKSCS"), "JISX0208_0213": ("JISX0208", "JISX0213")}


def character_set(wide: DataFrame, name: str) -> DataFrame:
    if name in UNION_SETS:
        a, b = (character_set(wide, x) for x in UNION_SETS[name])
        return a.unionByName(b).distinct()
    return column_values(wide, SET_COLUMNS[name], ignore_missing=True).select(CH)


def glyph_information_set(stroke_order: DataFrame, decomposition: DataFrame) -> DataFrame:
    return stroke_order.select(CH).union(decomposition.select(CH)).distinct()


def split_readings(rows: DataFrame, column: str, key: str = CH) -> DataFrame:
    """(key, Reading): the distinct words of a column in lower case."""
    words = F.array_distinct(F.split(F.trim(F.lower(column)), r"\s+"))
    return rows.where(F.col(column).isNotNull()).select(key, F.explode(words).alias("Reading")).where("Reading <> ''")


def readings_with_frequency(rows: DataFrame, column: str = "kHanyuPinlu", key: str = CH) -> DataFrame:
    """(key, Reading, Frequency) of entries like hao3(12); of repeated readings the last counts."""
    pattern = r"([a-zü]+[1-5])\((\d+)\)"
    zipped = F.arrays_zip(F.regexp_extract_all(column, F.lit(pattern), 1).alias("r"), F.regexp_extract_all(column, F.lit(pattern), 2).alias("f"))
    placed = rows.select(key, F.posexplode(zipped).alias("pos", "x")).select(key, "pos", F.col("x.r").alias("Reading"), F.col("x.f").cast("int").alias("Frequency"))
    return placed.groupBy(key, "Reading").agg(F.max_by("Frequency", "pos").alias("Frequency"))


def numeric_pinyin(reading: str | Column) -> Column:
    """hǎo as hao3; without a mark tone 5."""
    return F.concat(text.strip_pinyin_tone(text.col(reading)), text.pinyin_tone(reading).cast("string"))


def located_readings(rows: DataFrame, column: str, key: str = CH) -> DataFrame:
    """(key, Reading) with numbers of entries like 10019.020:hǎo,hào."""
    lists = F.explode(F.regexp_extract_all(column, F.lit(r"[0-9,.*]+:(\S+)"), 1)).alias("list")
    words = rows.select(key, lists).select(key, F.explode(F.split("list", ",")).alias("word"))
    return words.select(key, numeric_pinyin(text.nfc("word")).alias("Reading")).distinct()


def union_distinct(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.distinct()


# ---------------------------------------------------------------- glyphs, components, strokes


def glyphs(decomposition: DataFrame, stroke_order: DataFrame, wide: DataFrame) -> DataFrame:
    """All known (character, glyph) pairs; glyph 0 for characters with a stroke count or radical."""
    known = wide.where("kTotalStrokes is not null or kRSKangXi is not null").select(CH, F.lit(0).alias("Glyph"))
    return union_distinct(decomposition.select(CH, "Glyph"), stroke_order.select(CH, "Glyph"), known)


def component_edges(decomposition: DataFrame) -> DataFrame:
    """(ChineseCharacter, Glyph, Component, ComponentGlyph) of all decompositions' direct components."""
    part = F.explode(ids.components("Decomposition")).alias("c")
    return decomposition.select(CH, "Glyph", part).select(CH, "Glyph", F.col("c.char").alias("Component"), F.col("c.glyph").alias("ComponentGlyph")).distinct()


def closure(edges: DataFrame, source: Sequence[str], target: Sequence[str]) -> DataFrame:
    """Transitive closure, by doubling of path lengths. Pairs whose shortest path has length 2^k, joined with those of shorter
    paths, give all of up to 2^(k+1) - 1, and joined with themselves the next power: in a tree each pair is made once.

    Cycles end, since no shortest path is longer than there are pairs. Rounds are written to the shared folder; there are about as
    many as the longest path has doublings.
    """
    both = [*source, *target]

    def onto(a: DataFrame, b: DataFrame, *known: DataFrame) -> DataFrame:
        """Pairs of a way of a and one of b behind it that aren't known."""
        step = b.select(*(F.col(s).alias(f"_{s}") for s in source), *(F.col(t).alias(f"_{t}") for t in target))
        found = a.join(step, [F.col(t) == F.col(f"_{s}") for s, t in zip(source, target)]).select(*source, *(F.col(f"_{t}").alias(t) for t in target))
        return written(found.distinct().join(reduce(DataFrame.union, known), both, "left_anti").select(*both))

    power, shorter = written(edges.select(*both).distinct()), []
    while not shorter or not power.isEmpty():
        longer = [onto(power, reduce(DataFrame.union, shorter), power, *shorter)] if shorter else []
        shorter = [*shorter, power, *longer]
        power = onto(power, power, *shorter)
    return reduce(DataFrame.union, shorter)


def component_lookup(decomposition: DataFrame) -> DataFrame:
    return closure(component_edges(decomposition), [CH, "Glyph"], ["Component", "ComponentGlyph"])


def stroke_count_of(order: str | Column) -> Column:
    """How many strokes a stroke order has."""
    return F.size(F.split(text.col(order), "[ -]"))


def stroke_counts(stroke_order: DataFrame) -> DataFrame:
    return stroke_order.select(CH, stroke_count_of("StrokeOrder").alias("StrokeCount"), "Glyph")


def priority_fallback(keys: DataFrame, on: Sequence[str], value: str, *sources: DataFrame) -> DataFrame:
    """For each key the value of the first source that has one."""
    out = keys
    for i, s in enumerate(sources):
        out = out.join(s.select(*on, F.col(value).alias(f"_{i}")), list(on), "left")
    return out.select(*keys.columns, F.coalesce(*(F.col(f"_{i}") for i in range(len(sources)))).alias(value))


def combined_stroke_counts(all_glyphs: DataFrame, decomposition: DataFrame, own: DataFrame, wide: DataFrame, rounds: int = 64) -> DataFrame:
    """Own count; else the sum over a decomposition's components, on which all whole decompositions must agree; else the
    character's own count as glyph 0; else its Unihan count. Sums go up level by level
    until nothing changes; it is an error if that isn't so after ``rounds`` levels."""
    part = F.posexplode(ids.components("Decomposition")).alias("pos", "c")
    whole = F.size(ids.components("Decomposition")) == F.size(F.filter(ids.parse("Decomposition"), lambda x: x["char"].isNotNull()))
    parts = decomposition.where(whole).select(CH, "Glyph", "SubIndex", part).select(CH, "Glyph", "SubIndex", "pos", F.col("c.char").alias("part"), F.col("c.glyph").alias("part_glyph"))
    unihan = stroke_counts_from(wide).select(CH, F.lit(0).alias("Glyph"), "StrokeCount")
    counts = own.select(CH, "Glyph", "StrokeCount")
    seen = None
    for _ in range(rounds):
        base = counts.unionByName(unihan.join(counts, [CH, "Glyph"], "left_anti"))
        sums = parts.join(base.select(F.col(CH).alias("part"), F.col("Glyph").alias("part_glyph"), "StrokeCount"), ["part", "part_glyph"], "left")
        sums = sums.groupBy(CH, "Glyph", "SubIndex").agg(F.sum("StrokeCount").alias("n"), F.count(F.when(F.col("StrokeCount").isNull(), 1)).alias("unknown"))
        agreed = sums.where("unknown = 0").groupBy(CH, "Glyph").agg(F.min("n").cast("int").alias("StrokeCount"), F.count_distinct("n").alias("ways")).where("ways = 1").drop("ways")
        counts = own.select(CH, "Glyph", "StrokeCount").unionByName(agreed.join(own, [CH, "Glyph"], "left_anti"))
        counts = written(counts)
        now = counts.agg(F.count("*"), F.sum(F.xxhash64(CH, "Glyph", "StrokeCount").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise ValueError(f"stroke counts still change after {rounds} rounds; decompositions may go round in circles")
    plain = counts.where("Glyph = 0").select(CH, F.col("StrokeCount").alias("zero"))
    out = all_glyphs.join(counts, [CH, "Glyph"], "left").join(plain, CH, "left").join(unihan.select(CH, F.col("StrokeCount").alias("unihan")), CH, "left")
    return out.select(CH, F.coalesce("StrokeCount", "zero", "unihan").alias("StrokeCount"), "Glyph").where("StrokeCount is not null")


def first_per_group(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Of each group the first row in order: a minimum of structs, with partial aggregation, not a window."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    best = rows.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("_first"))
    return best.select(*(F.col(c) if c in keys else F.col(f"_first.{c}").alias(c) for c in rows.columns))


def residual_stroke_counts(radical_rows: DataFrame, unihan_kangxi: DataFrame | None = None) -> DataFrame:
    """One residual count for (character, glyph, radical): the smallest by count, glyph, form, layout and position; with Unihan's
    entries for unseen (character, radical) pairs, if given."""
    order = ["ResidualStrokeCount", "RadicalGlyph", "RadicalForm", "MainCharacterLayout", "RadicalRelativePosition"]
    out = first_per_group(radical_rows, [CH, "Glyph", "RadicalIndex"], order).select(CH, "Glyph", "RadicalIndex", "ResidualStrokeCount")
    if unihan_kangxi is None:
        return out
    pattern = r"^(\d+)\.(\d+)"
    more = unihan_kangxi.where(F.col("kRSKangXi").rlike(pattern)).select(
        CH, F.lit(0).alias("Glyph"), F.regexp_extract("kRSKangXi", pattern, 1).cast("int").alias("RadicalIndex"), F.regexp_extract("kRSKangXi", pattern, 2).cast("int").alias("ResidualStrokeCount"),
    )
    return out.unionByName(more.join(out, [CH, "RadicalIndex"], "left_anti"))


def word_index(entries: DataFrame, headword: str = "Headword", reading: str = "Reading", translation: str = "Translation") -> DataFrame:
    """Headword, Reading, Word: the words between separators of translations, not in parentheses, in lower case, once each.

    An example that follows a separator is left out with all that its sense has after it.
    """
    sense = F.explode(F.split(F.lower(translation), "/")).alias("sense")
    pieces = F.split(F.regexp_replace("sense", r"\([^)]+\)", ","), r"[,()\[\]!?]")
    each = entries.select(F.col(headword).alias("Headword"), F.col(reading).alias("Reading"), sense)
    each = each.select("Headword", "Reading", "sense", F.posexplode(pieces).alias("place", "piece"), F.locate(EXAMPLE, "sense").alias("at"))
    dashes = F.expr("locate('--', sense, at + length('" + EXAMPLE + "') + 1)")
    each = each.withColumn("shown", F.col("piece").startswith(EXAMPLE) & (F.col("at") > 0) & (dashes > 0) & (dashes + 1 < F.length("sense")))
    first = F.coalesce(F.min(F.when(F.col("shown"), F.col("place"))), F.lit(2**31 - 1))
    words = each.groupBy("Headword", "Reading", "sense").agg(F.collect_set(F.struct("place", "piece")).alias("all"), first.alias("first"))
    kept = F.explode(F.filter("all", lambda x: x["place"] < F.col("first"))).alias("x")
    return words.select("Headword", "Reading", kept).select("Headword", "Reading", F.trim("x.piece").alias("Word")).where("Word <> ''").distinct()


#: Fixed value: what introduces an example, in lower case.
EXAMPLE = "; bsp.: "


def augment_readings(readings: DataFrame, variant: DataFrame, kind: str = "T", new_only: bool = False, ambiguous_only: bool = False) -> DataFrame:
    """Readings, and those that characters take over from the characters that they are variants of."""
    pairs = variant.where(F.col("Type") == kind).where(F.col(CH) != F.col("Variant"))
    if ambiguous_only:
        pairs = pairs.join(pairs.groupBy(CH).count().where("count > 1").select(CH), CH, "left_semi")
    more = readings.join(pairs, CH).select(F.col("Variant").alias(CH), "Reading")
    if new_only:
        more = more.join(readings.select(CH).distinct(), CH, "left_anti")
    return readings.select(CH, "Reading").union(more).distinct()


def table_difference(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, status): both, only_first or only_second."""
    left, right = a.select(*keys).distinct().withColumn("_a", F.lit(1)), b.select(*keys).distinct().withColumn("_b", F.lit(1))
    status = F.when(F.col("_a").isNull(), "only_second").when(F.col("_b").isNull(), "only_first").otherwise("both")
    return left.join(right, list(keys), "full").select(*keys, status.alias("status"))


# ---------------------------------------------------------------- the runner


@dataclass(frozen=True)
class Builder:
    """A table, the tables it needs, and how it is made of them."""

    provides: str
    needs: tuple[str, ...]
    make: Callable[..., DataFrame]
    options: Mapping = None


class Build:
    """Builds tables in the order of their needs. Options of one builder go before those given for all."""

    def __init__(self, builders: Iterable[Builder], groups: Mapping[str, Sequence[str]] | None = None, options: Mapping | None = None, prefer: Sequence[str] = ()):
        self.builders: dict[str, Builder] = {}
        for b in builders:
            if b.provides in self.builders and b.make.__name__ not in prefer:
                if self.builders[b.provides].make.__name__ in prefer:
                    continue
                raise ValueError(f"more than one builder for {b.provides}")
            self.builders[b.provides] = b
        self.groups, self.options = dict(groups or {}), dict(options or {})

    def expand(self, names: Iterable[str]) -> list[str]:
        out: list[str] = []
        for n in names:
            out += self.expand(self.groups[n]) if n in self.groups else [n]
        return list(dict.fromkeys(out))

    def order(self, names: Iterable[str], have: Iterable[str] = ()) -> list[str]:
        """All that must be built for the names, each after what it needs."""
        done, doing, out = set(have), [], []

        def visit(name: str) -> None:
            if name in done:
                return
            if name in doing:
                raise ValueError("needs go round in a circle: " + " > ".join([*doing, name]))
            if name not in self.builders:
                raise KeyError(name)
            doing.append(name)
            for need in self.builders[name].needs:
                visit(need)
            doing.pop()
            done.add(name)
            out.append(name)

        for n in self.expand(names):
            visit(n)
        return out

    def dependents(self, names: Iterable[str]) -> set[str]:
        """All tables that need one of the names, directly or not."""
        found = set(names)
        while more := {b.provides for b in self.builders.values() if b.provides not in found and found & set(b.needs)}:
            found |= more
        return found - set(names)

    def run(self, catalog, names: Iterable[str], rebuild: bool = False, no_fail: bool = False) -> list[str]:
        """Registers each built table in the catalog; with no_fail what can't be built, and what needs it, is skipped."""
        wanted = self.expand(names)
        have = [n for n in catalog.names() if not (rebuild and n in {*wanted, *self.dependents(wanted)})]
        built, failed = [], set()
        for name in self.order(wanted, have):
            b = self.builders[name]
            if failed & set(b.needs):
                failed.add(name)
                continue
            try:
                catalog.register(name, b.make(*(catalog[n] for n in b.needs), **{k: v for k, v in self.options.items() if b.options and k in b.options} | dict(b.options or {})))
                built.append(name)
            except OSError:
                if not no_fail:
                    raise
                failed.add(name)
        return built
