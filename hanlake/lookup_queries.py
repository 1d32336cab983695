"""Queries of the character lookups, through the public class over a catalog made of the driver's tables.

A character stands for a part, U+4E00 + p_partkey % 2000; glyphs, radicals and strokes come from lineitem, part and supplier.
Decompositions are a heap: the character of part p has those of 2p and 2p + 1 as components, so trees are as deep as the
tables' logarithm, and the oracles walk them by recursion.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import ids, text
from .operators import characters as ch
from .operators.characters import CharacterLookup
from .plans import derive
from .plans.catalog import Catalog
from .registry import CH, made, query, table, values, with_tables

OF_PART, OF_LINE = "⟦19968 + p_partkey % 2000⟧", "⟦19968 + l_partkey % 2000⟧"
RADICAL = "1 + l_suppkey % 214"
TABLES = {
    "CharacterVariant": f"SELECT DISTINCT {OF_PART} AS ChineseCharacter, ⟦19968 + (p_partkey * 7 + p_size) % 2000⟧ AS Variant, substr('CMPSTZ', 1 + p_size % 6, 1) AS Type FROM {{part}}",
    "SmallSet": f"SELECT DISTINCT {OF_PART} AS ChineseCharacter FROM {{part}} WHERE p_size <= 25",
    "EvenSet": "SELECT DISTINCT ⟦19968 + 2 * s_suppkey⟧ AS ChineseCharacter FROM {supplier}",
    "Glyphs": f"SELECT DISTINCT {OF_LINE} AS ChineseCharacter, l_linenumber - 1 AS Glyph FROM {{lineitem}} WHERE l_quantity > 10",
    "LocaleCharacterGlyph": f"SELECT DISTINCT {OF_LINE} AS ChineseCharacter, l_linenumber - 1 AS Glyph, CASE l_returnflag WHEN 'A' THEN 'TC' WHEN 'N' THEN 'J' ELSE 'KV' END AS Locale FROM {{lineitem}} WHERE l_quantity > 40",
    "StrokeCount": f"SELECT {OF_LINE} AS ChineseCharacter, l_linenumber - 1 AS Glyph, min(l_suppkey) % 25 AS StrokeCount FROM {{lineitem}} GROUP BY 1, 2",
    "CharacterKangxiRadical": f"SELECT {OF_PART} AS ChineseCharacter, 1 + min(p_size) % 214 AS RadicalIndex FROM {{part}} GROUP BY 1",
    "CharacterRadicalResidualStrokeCount": f"""SELECT DISTINCT {OF_LINE} AS ChineseCharacter, l_linenumber - 1 AS Glyph, {RADICAL} AS RadicalIndex, ⟦11904 + l_suppkey % 80⟧ AS RadicalForm, 0 AS RadicalGlyph,
        substr('⿰⿱⿻', 1 + l_suppkey % 3, 1) AS MainCharacterLayout, l_suppkey % 2 AS RadicalRelativePosition, CAST(l_quantity AS INT) % 20 AS ResidualStrokeCount FROM {{lineitem}}""",
    "CharacterResidualStrokeCount": f"SELECT {OF_LINE} AS ChineseCharacter, l_linenumber - 1 AS Glyph, {RADICAL} AS RadicalIndex, min(CAST(l_quantity AS INT) % 20) AS ResidualStrokeCount FROM {{lineitem}} GROUP BY 1, 2, 3",
    "KangxiRadical": "SELECT 1 + p_partkey % 214 AS RadicalIndex, ⟦12032 + p_partkey⟧ AS Form, CASE WHEN p_size % 3 = 0 THEN 'V' ELSE 'R' END AS Type, CASE p_partkey % 3 WHEN 0 THEN 'T' WHEN 1 THEN 'TCJKV' ELSE 'C' END AS Locale, p_partkey AS SubIndex FROM {part}",
    "RadicalEquivalentCharacter": "SELECT ⟦12032 + p_partkey⟧ AS Form, ⟦19968 + p_partkey * 3 % 5000⟧ AS EquivalentForm, CASE p_size % 2 WHEN 0 THEN 'TC' ELSE 'J' END AS Locale, p_partkey AS seed_row_id FROM {part} WHERE p_partkey % 2 = 0",
    "KangxiRadicalIsolatedCharacter": "SELECT 1 + s_suppkey % 214 AS RadicalIndex, ⟦30000 + s_suppkey⟧ AS EquivalentForm, CASE s_suppkey % 2 WHEN 0 THEN 'TC' ELSE 'K' END AS Locale FROM {supplier}",
    "Strokes": "SELECT 'S' || n_nationkey AS StrokeAbbrev, n_name AS Name, ⟦12736 + n_nationkey⟧ AS Stroke FROM {nation}",
    "Heap": "SELECT p_partkey + 1 AS p, ⟦19969 + p_partkey⟧ AS c, CASE WHEN (p_partkey + 1) % 7 = 0 THEN '⿶' WHEN (p_partkey + 1) % 2 = 0 THEN '⿰' ELSE '⿱' END AS op FROM {part}",
    "CharacterDecomposition": "SELECT a.c AS ChineseCharacter, 0 AS Glyph, 0 AS SubIndex, a.op || x.c || y.c AS Decomposition FROM Heap a JOIN Heap x ON x.p = 2 * a.p JOIN Heap y ON y.p = 2 * a.p + 1",
    "StrokeOrder": "SELECT a.c AS ChineseCharacter, 0 AS Glyph, CASE a.p % 3 WHEN 0 THEN 'H' WHEN 1 THEN 'S-P' ELSE 'N-HZ-H' END AS StrokeOrder FROM Heap a LEFT JOIN Heap y ON y.p = 2 * a.p + 1 WHERE y.p IS NULL",
    "Asked": "SELECT DISTINCT ⟦19968 + s_suppkey * 3 % 2000⟧ AS ChineseCharacter FROM {supplier}",
    "AskedRadical": "SELECT DISTINCT 1 + s_suppkey * 5 % 300 AS RadicalIndex FROM {supplier}",
    "Below": "SELECT p AS top, p, '' AS path FROM Heap",
}
#: ancestor, descendant and the way between them (0 left, 1 right).
_BELOW = "WITH RECURSIVE b(top, p, path) AS (SELECT p, p, '' FROM Heap UNION ALL SELECT b.top, h.p, b.path || (h.p % 2) FROM b JOIN Heap h ON h.p IN (2 * b.p, 2 * b.p + 1) JOIN Heap w ON w.p = 2 * b.p + 1)"
#: As _BELOW, but places are those in which strokes are drawn: the second part of ⿶ comes first.
_DRAWN = _BELOW.replace("b.path || (h.p % 2)", "b.path || CASE WHEN b.p % 7 = 0 THEN 1 - h.p % 2 ELSE h.p % 2 END")


def lookup(sql: str, locale: str = "T", domain: str = "Unicode"):
    """Registers a query of a lookup; sql is read over the made tables that it names."""

    def add(f):
        def run(spark: SparkSession, d: str) -> DataFrame:
            return f(CharacterLookup(catalog(spark, d), locale, domain), spark, d)

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        return query(with_tables(TABLES, sql))(run)

    return add


def made_table(spark: SparkSession, d: str, name: str) -> DataFrame:
    sql = TABLES[name]
    if "Heap" in sql:
        heap = made(spark, d, TABLES["Heap"])
        return spark.sql(sql.replace(" Heap ", " {heap} "), heap=heap)
    return made(spark, d, sql)


def catalog(spark: SparkSession, d: str) -> Catalog:
    one = lambda name: cache(lambda: made_table(spark, d, name))
    found = {n: one(n) for n in TABLES if n not in ("Heap", "Below", "Asked", "AskedRadical")}
    found["ComponentLookup"] = cache(lambda: derive.component_lookup(made_table(spark, d, "CharacterDecomposition")))
    return Catalog(found)


def asked(spark: SparkSession, d: str) -> DataFrame:
    return made_table(spark, d, "Asked")


# ---------------------------------------------------------------- domains


@lookup("SELECT chr(c::INTEGER) AS character FROM (SELECT unnest(range(a, b + 1)) AS c FROM " + values(*text.HAN_RANGES) + " r(a, b))")
def lkp01_unicode_domain(look, spark, d):
    return look.domain_characters(spark).select(F.col(CH).alias("character"))


@lookup("SELECT ChineseCharacter AS character FROM SmallSet", domain="Small")
def lkp01_set_domain(look, spark, d):
    return look.domain_characters(spark).select(F.col(CH).alias("character"))


_CUSTOMERS = "SELECT c_custkey, ⟦19968 + c_custkey % 2500⟧ AS ChineseCharacter FROM {customer}"


@lookup(f"SELECT c_custkey, ChineseCharacter AS character FROM ({_CUSTOMERS}) WHERE ChineseCharacter IN (SELECT ChineseCharacter FROM SmallSet)", domain="Small")
def lkp02_filter_domain(look, spark, d):
    return look.filter_domain(made(spark, d, _CUSTOMERS)).select("c_custkey", F.col(CH).alias("character"))


@lookup(f"SELECT c_custkey, ChineseCharacter IN (SELECT ChineseCharacter FROM EvenSet) AS in_domain FROM ({_CUSTOMERS})", domain="Even")
def lkp03_in_domain(look, spark, d):
    return look.in_domain(made(spark, d, _CUSTOMERS)).select("c_custkey", "in_domain")


@lookup("SELECT 'Small' AS domain, count(*) AS characters FROM SmallSet UNION ALL SELECT 'Even', count(*) FROM EvenSet")
def lkp04_domains(look, spark, d):
    sizes = [look.catalog.domain(x).agg(F.lit(x).alias("domain"), F.count("*").alias("characters")) for x in look.catalog.domains()[1:]]
    return sizes[0].unionAll(sizes[1])


@lookup("SELECT a.ChineseCharacter AS character, a.StrokeCount AS strokes FROM StrokeCount a WHERE a.StrokeCount <> 0 AND a.ChineseCharacter IN (SELECT ChineseCharacter FROM EvenSet) AND a.Glyph = 1", domain="Even")
def flt07_subselect(look, spark, d):
    return look.stroke_counts().where("Glyph = 1").select(F.col(CH).alias("character"), F.col("StrokeCount").alias("strokes"))


# ---------------------------------------------------------------- variants and glyphs


@lookup("SELECT ChineseCharacter AS character, Variant AS variant FROM CharacterVariant WHERE Type = 'S' AND ChineseCharacter IN (SELECT ChineseCharacter FROM Asked) AND Variant IN (SELECT ChineseCharacter FROM SmallSet)", domain="Small")
def lkp08_variants_of_a_type(look, spark, d):
    return look.variants(asked(spark, d), "s").select(F.col(CH).alias("character"), F.col("Variant").alias("variant"))


@lookup("SELECT ChineseCharacter AS character, Variant AS variant, Type AS kind FROM CharacterVariant WHERE ChineseCharacter IN (SELECT ChineseCharacter FROM Asked)")
def lkp09_all_variants(look, spark, d):
    return look.variants(asked(spark, d)).toDF("character", "variant", "kind")


@lookup("SELECT ChineseCharacter AS character, Variant AS variant FROM CharacterVariant JOIN SmallSet s USING (ChineseCharacter) WHERE Type IN ('M', 'Z')")
def jon02_variant_domain(look, spark, d):
    keys = made_table(spark, d, "SmallSet")
    return look.variants(keys, "M").union(look.variants(keys, "Z")).select(F.col(CH).alias("character"), F.col("Variant").alias("variant"))


_GLYPH = """SELECT k.ChineseCharacter, coalesce(a.g, b.g) AS Glyph FROM Asked k
LEFT JOIN (SELECT ChineseCharacter, min(Glyph) AS g FROM LocaleCharacterGlyph WHERE Locale LIKE '%J%' GROUP BY 1) a USING (ChineseCharacter)
LEFT JOIN (SELECT ChineseCharacter, min(Glyph) AS g FROM Glyphs GROUP BY 1) b USING (ChineseCharacter) WHERE coalesce(a.g, b.g) IS NOT NULL"""


@lookup(f"SELECT ChineseCharacter AS character, Glyph AS glyph FROM ({_GLYPH})", locale="J")
def lkp10_default_glyphs(look, spark, d):
    return look.default_glyphs(asked(spark, d)).toDF("character", "glyph")


@lookup(f"SELECT ChineseCharacter AS character, Glyph AS glyph FROM ({_GLYPH.replace('%J%', '%K%')})", locale="K")
def agg08_first_of_locale(look, spark, d):
    return look.default_glyphs(asked(spark, d)).toDF("character", "glyph")


@lookup("SELECT ChineseCharacter AS character, Glyph AS glyph FROM Glyphs WHERE ChineseCharacter IN (SELECT ChineseCharacter FROM Asked)")
def lkp11_glyphs(look, spark, d):
    return look.glyphs(asked(spark, d)).toDF("character", "glyph")


# ---------------------------------------------------------------- strokes


@lookup(f"{_DRAWN}, orders AS (SELECT t.c AS character, sum(len(string_split_regex(s.StrokeOrder, '[ -]')))::BIGINT AS n FROM b JOIN Heap t ON t.p = b.top JOIN Heap h ON h.p = b.p JOIN StrokeOrder s ON s.ChineseCharacter = h.c GROUP BY 1)"
        " SELECT a.c AS character, coalesce(nullif(s.StrokeCount, 0), o.n)::BIGINT AS strokes FROM Heap a LEFT JOIN StrokeCount s ON s.ChineseCharacter = a.c AND s.Glyph = 0 JOIN orders o ON o.character = a.c")  # fmt: skip
def lkp12_stroke_counts(look, spark, d):
    """Counts of the table, else the lengths of stroke orders made from components."""
    keys = made(spark, d, TABLES["Heap"]).select(F.col("c").alias(CH), F.lit(0).alias("Glyph"))
    return look.stroke_counts(keys, from_orders=True).select(F.col(CH).alias("character"), F.col("StrokeCount").cast("long").alias("strokes"))


@lookup("SELECT ChineseCharacter AS character, Glyph AS glyph, StrokeCount AS strokes FROM StrokeCount WHERE StrokeCount <> 0 AND ChineseCharacter IN (SELECT ChineseCharacter FROM SmallSet)", domain="Small")
def lkp13_all_stroke_counts(look, spark, d):
    return look.stroke_counts().toDF("character", "glyph", "strokes")


@lookup("SELECT c_custkey, Name AS name, Stroke AS stroke FROM {customer} LEFT JOIN Strokes ON StrokeAbbrev = 'S' || (c_custkey % 30)")
def lkp14_stroke_by_abbreviation(look, spark, d):
    keys = made(spark, d, "SELECT c_custkey, 'S' || (c_custkey % 30) AS StrokeAbbrev FROM {customer}")
    return look.stroke_for_abbreviation(keys).select("c_custkey", F.col("Name").alias("name"), F.col("Stroke").alias("stroke"))


@lookup("SELECT s_suppkey, StrokeAbbrev AS abbreviation FROM {supplier} JOIN {nation} ON n_nationkey = s_nationkey JOIN Strokes ON Name = n_name")
def lkp14_stroke_by_name(look, spark, d):
    keys = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("s_nationkey")).select("s_suppkey", F.col("n_name").alias("Name"))
    return look.stroke_for_abbreviation(keys, "Name").select("s_suppkey", F.col("StrokeAbbrev").alias("abbreviation"))


_ORDERS = "SELECT o_orderkey, 'S' || (o_orderkey % 30) || '-S' || (o_custkey % 25) || ' ?' AS StrokeOrder FROM {orders}"


@lookup(f"SELECT o_orderkey, coalesce(a.Stroke, '-') || coalesce(b.Stroke, '-') || '-' AS strokes FROM {{orders}} LEFT JOIN Strokes a ON a.StrokeAbbrev = 'S' || (o_orderkey % 30) LEFT JOIN Strokes b ON b.StrokeAbbrev = 'S' || (o_custkey % 25)")
def lkp15_stroke_forms(look, spark, d):
    rows = look.stroke_forms(made(spark, d, _ORDERS))
    return rows.select("o_orderkey", F.array_join("Strokes", "", "-").alias("strokes"))


@lookup(f"{_DRAWN} SELECT t.c AS character, string_agg(s.StrokeOrder, ' ' ORDER BY b.path) AS strokes FROM b JOIN Heap t ON t.p = b.top JOIN Heap h ON h.p = b.p JOIN StrokeOrder s ON s.ChineseCharacter = h.c JOIN Asked k ON k.ChineseCharacter = t.c GROUP BY 1")
def lkp16_stroke_order(look, spark, d):
    return look.stroke_orders(asked(spark, d).withColumn("Glyph", F.lit(0))).select(F.col(CH).alias("character"), F.col("StrokeOrder").alias("strokes"))


@lookup(f"{_DRAWN} SELECT t.c AS character, string_agg(s.StrokeOrder, ' ' ORDER BY b.path) AS strokes FROM b JOIN Heap t ON t.p = b.top JOIN Heap h ON h.p = b.p JOIN StrokeOrder s ON s.ChineseCharacter = h.c GROUP BY 1")
def lkp17_all_stroke_orders(look, spark, d):
    return look.stroke_orders().select(F.col(CH).alias("character"), F.col("StrokeOrder").alias("strokes"))


# ---------------------------------------------------------------- radicals

_ROWS = "ChineseCharacter, Glyph, RadicalIndex, RadicalForm, MainCharacterLayout, RadicalRelativePosition, ResidualStrokeCount"
_RENAMED = "a.ChineseCharacter AS character, a.Glyph AS glyph, a.RadicalIndex AS radical, a.RadicalForm AS form, a.MainCharacterLayout AS layout, a.RadicalRelativePosition AS position, a.ResidualStrokeCount AS residual"


def _residual_rows(rows: DataFrame) -> DataFrame:
    return rows.select(*(x.strip() for x in _ROWS.split(","))).toDF("character", "glyph", "radical", "form", "layout", "position", "residual")


@lookup("SELECT ChineseCharacter AS character, RadicalIndex AS radical FROM CharacterKangxiRadical WHERE ChineseCharacter IN (SELECT ChineseCharacter FROM Asked)")
def lkp18_kangxi_radical(look, spark, d):
    return look.kangxi_radicals(asked(spark, d)).toDF("character", "radical")


@lookup(f"SELECT {_RENAMED} FROM CharacterRadicalResidualStrokeCount a JOIN CharacterKangxiRadical k ON k.ChineseCharacter = a.ChineseCharacter AND k.RadicalIndex = a.RadicalIndex")
def lkp19_kangxi_residual_rows(look, spark, d):
    return _residual_rows(look.radical_residuals(kangxi_only=True))


@lookup(f"SELECT {_RENAMED} FROM CharacterRadicalResidualStrokeCount a JOIN ({_GLYPH}) g ON g.ChineseCharacter = a.ChineseCharacter AND g.Glyph = a.Glyph", locale="J")
def lkp20_radical_residual_rows(look, spark, d):
    return _residual_rows(look.radical_residuals(asked(spark, d)))


@lookup("""SELECT ChineseCharacter AS character, Glyph AS glyph, string_agg(RadicalIndex || '=' || forms, ';' ORDER BY RadicalIndex) AS radicals FROM (
SELECT ChineseCharacter, Glyph, RadicalIndex, string_agg(ResidualStrokeCount || RadicalForm || MainCharacterLayout || RadicalRelativePosition, ',' ORDER BY ResidualStrokeCount, RadicalForm, MainCharacterLayout, RadicalRelativePosition) AS forms
FROM CharacterRadicalResidualStrokeCount GROUP BY 1, 2, 3) GROUP BY 1, 2""")
def lkp21_radical_residual_maps(look, spark, d):
    one = lambda x: F.concat(x["ResidualStrokeCount"].cast("string"), x["RadicalForm"], x["MainCharacterLayout"], x["RadicalRelativePosition"].cast("string"))
    shown = F.transform(F.map_entries("radicals"), lambda e: F.concat_ws("=", e["key"].cast("string"), F.array_join(F.transform(e["value"], one), ",")))
    return look.radical_residual_maps().select(F.col(CH).alias("character"), F.col("Glyph").alias("glyph"), F.array_join(shown, ";").alias("radicals"))


@lookup("SELECT a.ChineseCharacter AS character, a.Glyph AS glyph, a.RadicalIndex AS radical, a.ResidualStrokeCount AS residual FROM CharacterResidualStrokeCount a JOIN CharacterKangxiRadical k ON k.ChineseCharacter = a.ChineseCharacter AND k.RadicalIndex = a.RadicalIndex WHERE a.ChineseCharacter IN (SELECT ChineseCharacter FROM SmallSet)", domain="Small")
def lkp22_kangxi_residuals(look, spark, d):
    return look.residuals(kangxi_only=True).toDF("character", "glyph", "radical", "residual")


@lookup(f"SELECT a.ChineseCharacter AS character, a.Glyph AS glyph, a.RadicalIndex AS radical, a.ResidualStrokeCount AS residual FROM CharacterResidualStrokeCount a JOIN ({_GLYPH}) g ON g.ChineseCharacter = a.ChineseCharacter AND g.Glyph = a.Glyph", locale="J")
def lkp22_residuals(look, spark, d):
    return look.residuals(asked(spark, d)).toDF("character", "glyph", "radical", "residual")


_RESIDUAL_MAP = "SELECT ChineseCharacter AS character, Glyph AS glyph, string_agg(RadicalIndex || '=' || ResidualStrokeCount, ';' ORDER BY RadicalIndex) AS residuals FROM CharacterResidualStrokeCount"


def _residual_maps(rows: DataFrame) -> DataFrame:
    shown = F.transform(F.map_entries("residuals"), lambda e: F.concat_ws("=", e["key"].cast("string"), e["value"].cast("string")))
    return rows.select(F.col(CH).alias("character"), F.col("Glyph").alias("glyph"), F.array_join(shown, ";").alias("residuals"))


@lookup(f"{_RESIDUAL_MAP} GROUP BY 1, 2")
def lkp23_residual_maps(look, spark, d):
    return _residual_maps(look.residual_maps())


@lookup(f"{_RESIDUAL_MAP} WHERE ChineseCharacter IN (SELECT ChineseCharacter FROM EvenSet) GROUP BY 1, 2", domain="Even")
def agg03_maps_in_domain(look, spark, d):
    return _residual_maps(look.residual_maps())


@lookup("SELECT DISTINCT RadicalIndex AS radical, ChineseCharacter AS character FROM CharacterKangxiRadical WHERE RadicalIndex IN (SELECT RadicalIndex FROM AskedRadical)")
def lkp24_characters_of_kangxi_radical(look, spark, d):
    return look.characters_for_radical(made_table(spark, d, "AskedRadical")).toDF("radical", "character")


@lookup("SELECT DISTINCT RadicalIndex AS radical, ChineseCharacter AS character FROM CharacterResidualStrokeCount WHERE RadicalIndex IN (SELECT RadicalIndex FROM AskedRadical) AND ChineseCharacter IN (SELECT ChineseCharacter FROM SmallSet)", domain="Small")
def lkp24_characters_of_radical(look, spark, d):
    return look.characters_for_radical(made_table(spark, d, "AskedRadical"), kangxi_only=False).toDF("radical", "character")


@lookup("SELECT a.ChineseCharacter AS character, a.Glyph AS glyph, a.RadicalIndex AS radical, a.ResidualStrokeCount AS residual FROM CharacterResidualStrokeCount a JOIN CharacterKangxiRadical k ON k.ChineseCharacter = a.ChineseCharacter AND k.RadicalIndex = a.RadicalIndex WHERE a.RadicalIndex IN (SELECT RadicalIndex FROM AskedRadical)")
def lkp25_residuals_of_kangxi_radical(look, spark, d):
    return look.residuals_for_radical(made_table(spark, d, "AskedRadical")).toDF("character", "glyph", "radical", "residual")


@lookup("SELECT a.ChineseCharacter AS character, a.Glyph AS glyph, a.RadicalIndex AS radical, a.ResidualStrokeCount AS residual FROM CharacterResidualStrokeCount a WHERE a.RadicalIndex IN (SELECT RadicalIndex FROM AskedRadical) AND a.ChineseCharacter IN (SELECT ChineseCharacter FROM EvenSet)", domain="Even")
def jon03_residuals_in_domain(look, spark, d):
    return look.residuals_for_radical(made_table(spark, d, "AskedRadical"), kangxi_only=False).toDF("character", "glyph", "radical", "residual")


@lookup("SELECT RadicalIndex AS radical, min_by(Form, SubIndex) AS form FROM KangxiRadical WHERE Type = 'R' AND Locale LIKE '%T%' AND RadicalIndex IN (SELECT RadicalIndex FROM AskedRadical) GROUP BY 1")
def lkp26_radical_form(look, spark, d):
    return look.radical_forms(made_table(spark, d, "AskedRadical")).toDF("radical", "form")


@lookup("SELECT RadicalIndex AS radical, Form AS form FROM KangxiRadical WHERE Type = 'V' AND Locale LIKE '%C%' AND RadicalIndex IN (SELECT RadicalIndex FROM AskedRadical)", locale="C")
def lkp26_variant_forms(look, spark, d):
    return look.radical_forms(made_table(spark, d, "AskedRadical"), "V").toDF("radical", "form")


#: Forms asked for: radical forms, equivalent and isolated characters, and others.
_FORMS = "SELECT DISTINCT Form FROM (SELECT ⟦12032 + p_partkey * 2⟧ AS Form FROM {part} UNION ALL SELECT ⟦19968 + p_partkey * 3 % 7000⟧ FROM {part} UNION ALL SELECT ⟦30000 + s_suppkey * 2⟧ FROM {supplier})"
_INDEX = f"""SELECT f.Form, coalesce(a.r, b.r, c.r) AS RadicalIndex FROM ({_FORMS}) f
LEFT JOIN (SELECT Form, min(RadicalIndex) AS r FROM KangxiRadical WHERE Locale LIKE '%T%' GROUP BY 1) a ON a.Form = f.Form
LEFT JOIN (SELECT e.EquivalentForm, min(k.RadicalIndex) AS r FROM KangxiRadical k JOIN RadicalEquivalentCharacter e ON e.Form = k.Form WHERE k.Locale LIKE '%T%' AND e.Locale LIKE '%T%' GROUP BY 1) b ON b.EquivalentForm = f.Form
LEFT JOIN (SELECT EquivalentForm, min(RadicalIndex) AS r FROM KangxiRadicalIsolatedCharacter WHERE Locale LIKE '%T%' GROUP BY 1) c ON c.EquivalentForm = f.Form"""


@lookup(f"SELECT Form AS form, RadicalIndex AS radical FROM ({_INDEX})")
def lkp27_radical_index(look, spark, d):
    return look.radical_indices(made(spark, d, _FORMS)).select(F.col("Form").alias("form"), F.col("RadicalIndex").alias("radical"))


_REPRESENTATIVES = """SELECT RadicalIndex, Form FROM KangxiRadical WHERE Locale LIKE '%T%'
UNION SELECT k.RadicalIndex, e.EquivalentForm FROM KangxiRadical k JOIN RadicalEquivalentCharacter e ON e.Form = k.Form WHERE k.Locale LIKE '%T%' AND e.Locale LIKE '%T%'
UNION SELECT RadicalIndex, EquivalentForm FROM KangxiRadicalIsolatedCharacter WHERE Locale LIKE '%T%'"""


@lookup(f"SELECT RadicalIndex AS radical, Form AS form FROM ({_REPRESENTATIVES}) WHERE RadicalIndex IN (SELECT RadicalIndex FROM AskedRadical)")
def lkp28_representative_characters(look, spark, d):
    return look.representative_characters(made_table(spark, d, "AskedRadical")).toDF("radical", "form")


@lookup(f"SELECT Form AS form, RadicalIndex IS NOT NULL AS is_form, unicode(Form) BETWEEN 11904 AND 12245 AS is_radical_char FROM ({_INDEX})")
def lkp29_is_radical_form(look, spark, d):
    return look.is_radical_form(made(spark, d, _FORMS)).select(F.col("Form").alias("form"), "is_form", "is_radical_char")


@lookup(f"SELECT f.Form AS form, min_by(e.EquivalentForm, e.seed_row_id) AS equivalent FROM ({_FORMS}) f JOIN RadicalEquivalentCharacter e ON e.Form = f.Form WHERE e.Locale LIKE '%J%' GROUP BY 1", locale="J")
def lkp30_equivalent_character(look, spark, d):
    return look.equivalent_of_form(made(spark, d, _FORMS)).toDF("form", "equivalent")


@lookup(f"SELECT e.EquivalentForm AS equivalent, e.Form AS form FROM RadicalEquivalentCharacter e WHERE e.Locale LIKE '%C%' AND e.EquivalentForm IN ({_FORMS})", locale="C")
def lkp30_forms_of_character(look, spark, d):
    keys = made(spark, d, _FORMS).select(F.col("Form").alias("EquivalentForm"))
    return look.forms_of_equivalent(keys).toDF("equivalent", "form")


@query("SELECT k, k BETWEEN 12272 AND 12283 AND k NOT IN (12274, 12275) AS two, k IN (12274, 12275) AS three, k BETWEEN 12272 AND 12283 AS either FROM (SELECT (12256 + o_orderkey % 64)::BIGINT AS k FROM orders)")
def lkp31_description_operators(spark, d):
    rows = table(spark, d, "orders").select((F.lit(12256) + F.col("o_orderkey") % 64).cast("long").alias("k")).withColumn("c", text.char_of("k"))
    return rows.select("k", ids.is_binary("c").alias("two"), ids.is_trinary("c").alias("three"), ids.is_operator("c").alias("either"))


# ---------------------------------------------------------------- components


@lookup(f"{_BELOW} SELECT t.c AS character FROM b JOIN Heap t ON t.p = b.top JOIN Heap h ON h.p = b.p JOIN Glyphs g ON g.ChineseCharacter = t.c AND g.Glyph = 0 WHERE h.c IN (chr(19968 + 40), chr(19968 + 41), chr(19968 + 90)) GROUP BY t.c HAVING count(DISTINCT CASE WHEN h.c = chr(19968 + 90) THEN 1 ELSE 0 END) = 2")
def lkp33_characters_with_components(look, spark, d):
    """A slot of two characters and one of one: all characters that have one of each as a component or are it."""
    rows = look.characters_for_components([[chr(19968 + 40), chr(19968 + 41)], [chr(19968 + 90)]], all_glyphs=True, expand=False)
    return rows.where("Glyph = 0").join(look.catalog["Glyphs"], [CH, "Glyph"], "left_semi").select(F.col(CH).alias("character"))


@lookup(f"""{_BELOW}, i AS (SELECT DISTINCT RadicalIndex FROM ({_REPRESENTATIVES}) WHERE Form = chr(19968 + 60)),
own AS (SELECT min(r) AS r FROM (SELECT RadicalIndex AS r FROM i)),
alike AS (SELECT DISTINCT Form FROM ({_REPRESENTATIVES}) WHERE RadicalIndex IN (SELECT r FROM own) UNION SELECT chr(19968 + 60))
SELECT DISTINCT t.c AS character FROM b JOIN Heap t ON t.p = b.top JOIN Heap h ON h.p = b.p WHERE h.c IN (SELECT Form FROM alike) AND b.top <> b.p""")
def lkp32_characters_with_equivalents(look, spark, d):
    """Equivalent forms of a component's radical stand for it."""
    rows = look.characters_for_components([[chr(19968 + 60)]], all_glyphs=True)
    return rows.where("Glyph = 0").join(look.catalog["ComponentLookup"].select(CH, F.col("Component").alias("c")).join(_alike(look, spark, chr(19968 + 60)), "c", "left_semi"), CH, "left_semi").select(F.col(CH).alias("character")).distinct()


def _alike(look: CharacterLookup, spark: SparkSession, form: str) -> DataFrame:
    keys = spark.createDataFrame([(form,)], "Form string")
    indices = look.radical_indices(keys).where("RadicalIndex is not null").select("RadicalIndex")
    return look.representative_characters(indices).select(F.col("Form").alias("c")).union(keys.select(F.col("Form").alias("c"))).distinct()


@lookup("SELECT a.c AS character, CASE WHEN a.p % 7 = 0 THEN '⿶' WHEN a.p % 2 = 0 THEN '⿰' ELSE '⿱' END || x.c || y.c AS sequence FROM Heap a JOIN Heap x ON x.p = 2 * a.p JOIN Heap y ON y.p = 2 * a.p + 1 WHERE a.c IN (SELECT ChineseCharacter FROM EvenSet)", domain="Even")
def lkp34_decomposition_entries(look, spark, d):
    return look.decompositions().select(F.col(CH).alias("character"), ids.write(F.element_at("entries", 1)).alias("sequence"))


@lookup(f"{_BELOW.replace('b.path || (h.p % 2)', 'b.path || (1 + h.p % 2)')} SELECT t.c AS character, b.path AS path, h.c AS part, length(b.path)::BIGINT AS depth FROM b JOIN Heap t ON t.p = b.top JOIN Heap h ON h.p = b.p JOIN Asked k ON k.ChineseCharacter = t.c")
def lkp35_decomposition_trees(look, spark, d):
    rows = look.decomposition_rows(asked(spark, d).withColumn("Glyph", F.lit(0))).where("part is not null").join(made(spark, d, TABLES["Heap"]).select(F.col("c").alias(CH)), CH, "left_semi")
    places = F.array_join(F.transform(F.filter("path", lambda x, i: i % 2 == 1), lambda x: x.cast("string")), "")
    return rows.select(F.col(CH).alias("character"), places.alias("path"), "part", F.col("depth").cast("long").alias("depth"))


_PAIRS = "SELECT a.s_suppkey AS i, b.s_suppkey AS j FROM {supplier} a JOIN {supplier} b ON b.s_suppkey % 10 = a.s_suppkey % 10"


@lookup(f"{_BELOW} SELECT q.i AS i, q.j AS j, EXISTS (SELECT 1 FROM b WHERE b.top = q.i AND b.p = q.j AND b.top <> b.p) AS is_component FROM ({_PAIRS}) q")
def lkp36_is_component(look, spark, d):
    keys = made(spark, d, f"SELECT i, j, ⟦19968 + i⟧ AS ChineseCharacter, 0 AS Glyph, ⟦19968 + j⟧ AS Component, 0 AS ComponentGlyph FROM ({_PAIRS})")
    return look.is_component(keys).select("i", "j", "is_component")


@lookup(f"{_BELOW} SELECT t.c AS character, h.c AS component FROM b JOIN Heap t ON t.p = b.top JOIN Heap h ON h.p = b.p WHERE b.top <> b.p")
def trv03_closure_of_heap(look, spark, d):
    return look.catalog["ComponentLookup"].select(F.col(CH).alias("character"), F.col("Component").alias("component"))


@lookup(f"{_BELOW} SELECT DISTINCT h.c AS component FROM b JOIN Heap h ON h.p = b.p JOIN Heap t ON t.p = b.top JOIN Asked k ON k.ChineseCharacter = t.c LEFT JOIN Heap w ON w.p = 2 * h.p + 1 WHERE w.p IS NULL AND b.top <> b.p")
def trv04_basic_components_of_heap(look, spark, d):
    return ch.basic_components(look.catalog["CharacterDecomposition"], asked(spark, d)).select(F.col("Component").alias("component"))


@lookup(f"""{_BELOW}, known AS (SELECT * FROM StrokeOrder s JOIN Heap h ON h.c = s.ChineseCharacter WHERE h.p % 5 <> 0),
lacking AS (SELECT b.top, h.c FROM b JOIN Heap h ON h.p = b.p LEFT JOIN Heap w ON w.p = 2 * h.p + 1 WHERE w.p IS NULL AND b.top <> b.p AND h.c NOT IN (SELECT ChineseCharacter FROM known)),
sets AS (SELECT top, string_agg(c, '' ORDER BY c) AS missing FROM lacking GROUP BY 1)
SELECT missing, count(*) AS characters FROM sets GROUP BY 1""")
def trv05_stroke_order_gaps(look, spark, d):
    """A fifth of the basic components' orders is taken away."""
    own = look.catalog["StrokeOrder"].where((text.codepoint(CH) - 19968) % 5 != 0)
    gaps = ch.stroke_order_gaps(look.catalog["CharacterDecomposition"], own)
    return gaps.select(F.array_join(F.transform("missing", lambda x: x["Component"]), "").alias("missing"), "characters")


@lookup(f"""{_BELOW}, known AS (SELECT h.c FROM StrokeOrder s JOIN Heap h ON h.c = s.ChineseCharacter WHERE h.p % 5 <> 0)
SELECT h.c AS component, count(DISTINCT b.top) AS characters FROM b JOIN Heap h ON h.p = b.p LEFT JOIN Heap w ON w.p = 2 * h.p + 1 WHERE w.p IS NULL AND b.top <> b.p AND h.c NOT IN (SELECT c FROM known) GROUP BY 1""")
def trv05_missing_components(look, spark, d):
    own = look.catalog["StrokeOrder"].where((text.codepoint(CH) - 19968) % 5 != 0)
    rows = ch.missing_component_counts(look.catalog["CharacterDecomposition"], own)
    return rows.select(F.col("Component").alias("component"), "characters")


# ---------------------------------------------------------------- joins of derivations over the same catalog


@lookup("SELECT ChineseCharacter AS character FROM StrokeOrder JOIN EvenSet USING (ChineseCharacter) UNION SELECT ChineseCharacter FROM CharacterDecomposition JOIN EvenSet USING (ChineseCharacter)", domain="Even")
def jon04_glyph_information(look, spark, d):
    found = derive.glyph_information_set(look.catalog["StrokeOrder"], look.catalog["CharacterDecomposition"])
    return look.filter_domain(found).select(F.col(CH).alias("character"))


@lookup("SELECT ChineseCharacter AS character FROM StrokeOrder UNION SELECT ChineseCharacter FROM CharacterDecomposition")
def der07_glyph_information(look, spark, d):
    return derive.glyph_information_set(look.catalog["StrokeOrder"], look.catalog["CharacterDecomposition"]).select(F.col(CH).alias("character"))


@lookup("SELECT k.RadicalIndex AS radical, k.Form AS form, e.EquivalentForm AS equivalent FROM KangxiRadical k JOIN RadicalEquivalentCharacter e ON e.Form = k.Form WHERE k.Locale LIKE '%C%' AND e.Locale LIKE '%C%' AND k.Type = 'V'", locale="C")
def jon06_forms_and_equivalents(look, spark, d):
    forms = look.radical_forms(look.catalog["KangxiRadical"].select("RadicalIndex"), "V")
    return look.forms_of_equivalent(look.catalog["RadicalEquivalentCharacter"]).join(forms, "Form").select(F.col("RadicalIndex").alias("radical"), F.col("Form").alias("form"), F.col("EquivalentForm").alias("equivalent"))


@lookup("""WITH w AS (SELECT a.ChineseCharacter, a.RadicalIndex, min(a.ResidualStrokeCount) AS n FROM CharacterRadicalResidualStrokeCount a GROUP BY 1, 2, a.Glyph)
SELECT RadicalIndex AS radical, n AS residual, count(DISTINCT ChineseCharacter) AS characters FROM w WHERE RadicalIndex IN (SELECT RadicalIndex FROM AskedRadical) GROUP BY 1, 2""")
def cli03_characters_by_residual(look, spark, d):
    from .operators import reports

    rows = derive.residual_stroke_counts(look.catalog["CharacterRadicalResidualStrokeCount"])
    own = CharacterLookup(Catalog({"CharacterResidualStrokeCount": rows}), look.locale)
    found = reports.characters_by_residual(own, made_table(spark, d, "AskedRadical"), kangxi_only=False)
    return found.select(F.col("RadicalIndex").alias("radical"), F.col("ResidualStrokeCount").alias("residual"), F.size("characters").cast("long").alias("characters"))


@lookup("""WITH part_counts AS (SELECT h.p, s.StrokeCount FROM Heap h JOIN StrokeCount s ON s.ChineseCharacter = h.c AND s.Glyph = 0)
SELECT a.c AS character, CASE WHEN n.StrokeCount IS NOT NULL THEN n.StrokeCount END::BIGINT AS own, (x.StrokeCount + y.StrokeCount)::BIGINT AS whole
FROM Heap a JOIN Heap v ON v.p = 2 * a.p + 1 JOIN part_counts x ON x.p = 2 * a.p JOIN part_counts y ON y.p = 2 * a.p + 1 LEFT JOIN part_counts n ON n.p = a.p""")
def jon08_component_stroke_sums(look, spark, d):
    """Each character's own count beside the sum of its two components' counts."""
    counts = look.catalog["StrokeCount"].where("Glyph = 0")
    edges = derive.component_edges(look.catalog["CharacterDecomposition"]).join(counts.select(F.col(CH).alias("Component"), "StrokeCount"), "Component")
    sums = edges.groupBy(CH).agg(F.sum("StrokeCount").alias("whole"), F.count("*").alias("n")).where("n = 2")
    own = counts.select(CH, F.col("StrokeCount").cast("long").alias("own"))
    return sums.join(own, CH, "left").select(F.col(CH).alias("character"), "own", "whole")


# ---------------------------------------------------------------- groups, orders and sets that lookups need


@lookup("SELECT character, string_agg('⿰' || a || b, ' ' ORDER BY place) AS entries FROM (SELECT DISTINCT ⟦19968 + l_partkey % 2000⟧ AS character, l_linenumber AS place, ⟦20000 + l_linenumber⟧ AS a, ⟦30000 + l_linenumber⟧ AS b FROM {lineitem}) GROUP BY 1")
def agg01_ordered_groups(look, spark, d):
    """All decompositions of a character in the order of their numbers."""
    rows = made(spark, d, "SELECT DISTINCT ⟦19968 + l_partkey % 2000⟧ AS ChineseCharacter, 0 AS Glyph, l_linenumber AS SubIndex, '⿰' || ⟦20000 + l_linenumber⟧ || ⟦30000 + l_linenumber⟧ AS Decomposition FROM {lineitem}")
    found = CharacterLookup(Catalog({"CharacterDecomposition": rows})).decompositions()
    return found.select(F.col(CH).alias("character"), F.array_join(F.transform("entries", lambda x: ids.write(x)), " ").alias("entries"))


@lookup("""SELECT ChineseCharacter AS character, Glyph AS glyph, string_agg(RadicalIndex || ':' || n, ' ' ORDER BY RadicalIndex) AS forms FROM (
SELECT ChineseCharacter, Glyph, RadicalIndex, count(*) AS n FROM CharacterRadicalResidualStrokeCount WHERE ChineseCharacter IN (SELECT ChineseCharacter FROM Asked) AND Glyph = 1 GROUP BY 1, 2, 3) GROUP BY 1, 2""")
def agg02_nested_groups(look, spark, d):
    """Radical -> its forms in a character, for characters of a list."""
    rows = look.radical_residual_maps(asked(spark, d).withColumn("Glyph", F.lit(1)))
    shown = F.transform(F.map_entries("radicals"), lambda e: F.concat_ws(":", e["key"].cast("string"), F.size(e["value"]).cast("string")))
    return rows.select(F.col(CH).alias("character"), F.col("Glyph").alias("glyph"), F.array_join(shown, " ").alias("forms"))


@lookup("SELECT RadicalIndex AS radical, ResidualStrokeCount AS residual, string_agg(DISTINCT ChineseCharacter, '' ORDER BY ChineseCharacter) AS characters FROM CharacterResidualStrokeCount WHERE RadicalIndex IN (SELECT RadicalIndex FROM AskedRadical) GROUP BY 1, 2")
def agg05_sets_by_residual_strokes(look, spark, d):
    from .operators import reports

    rows = reports.characters_by_residual(look, made_table(spark, d, "AskedRadical"), kangxi_only=False)
    return rows.select(F.col("RadicalIndex").alias("radical"), F.col("ResidualStrokeCount").alias("residual"), F.array_join("characters", "").alias("characters"))


@lookup(f"""{_BELOW}, found AS (SELECT DISTINCT t.c FROM b JOIN Heap t ON t.p = b.top WHERE b.p IN (64, 65, 66, 67, 70, 75, 80, 90, 99) AND b.top <> b.p)
SELECT c AS character FROM found LEFT JOIN StrokeCount s ON s.ChineseCharacter = c AND s.Glyph = 0 ORDER BY s.StrokeCount NULLS FIRST, c LIMIT 10""")
def srt03_order_by_a_column_not_shown(look, spark, d):
    """The ten characters of fewest strokes that have one of some components; the strokes aren't in the answer."""
    look.ordered = True
    parts = [chr(19968 + i) for i in (64, 65, 66, 67, 70, 75, 80, 90, 99)]
    own = CharacterLookup(Catalog({"ComponentLookup": look.catalog["ComponentLookup"], "StrokeCount": look.catalog["StrokeCount"], "Glyphs": look.catalog["Glyphs"].limit(0)}), ordered=True)
    return own.characters_for_components([parts], expand=False).limit(10).select(F.col(CH).alias("character"))


@query("SELECT c_custkey, unicode(c) IS NOT NULL AS han FROM (SELECT c_custkey, chr((19968 + c_custkey * 11 % 24000)::INTEGER) AS c FROM customer) WHERE unicode(c) <= 40907")
def set04_union_of_ranges(spark, d):
    """The Unicode domain is put together of ranges."""
    from .plans.catalog import unicode_domain

    rows = made(spark, d, "SELECT c_custkey, ⟦19968 + c_custkey * 11 % 24000⟧ AS ChineseCharacter FROM {customer}")
    return rows.join(unicode_domain(spark), CH, "left_semi").select("c_custkey", F.lit(True).alias("han"))


@lookup("""WITH w AS (SELECT ChineseCharacter, RadicalIndex FROM CharacterResidualStrokeCount), u AS (SELECT ⟦19968 + p_partkey % 2000⟧ AS c, 1 + p_partkey % 214 AS r, p_size AS n FROM {part})
SELECT c AS character, r AS radical, n AS residual FROM u WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.ChineseCharacter = u.c AND w.RadicalIndex = u.r)""")
def jon11_unseen_keys(look, spark, d):
    """Unihan's counts of (character, radical) that the decompositions don't know."""
    wide = made(spark, d, "SELECT ⟦19968 + p_partkey % 2000⟧ AS ChineseCharacter, (1 + p_partkey % 214) || '.' || p_size AS kRSKangXi FROM {part}")
    known = look.catalog["CharacterRadicalResidualStrokeCount"]
    rows = derive.residual_stroke_counts(known, wide).join(derive.residual_stroke_counts(known), [CH, "Glyph", "RadicalIndex"], "left_anti")
    return rows.select(F.col(CH).alias("character"), F.col("RadicalIndex").alias("radical"), F.col("ResidualStrokeCount").alias("residual"))
