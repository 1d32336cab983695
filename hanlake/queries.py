"""Registered queries of the library's operators over the driver's tables, and the same in DuckDB's SQL.

Class R: the operator's shape on relational tables. Class C: readings or characters made from the tables' keys, so they
grow with them. Class G: fixed inputs with known answers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import ids, text
from .operators import characters as ch
from .operators import dictionary as dic
from .operators import gr
from .operators import readings as rd
from .plans import derive, radicals
from .plans.catalog import Catalog
from .registry import CH, ORACLE_SQL, QUERIES, pick, query, table, values
from .sources import dictionaries, unihan

# ---------------------------------------------------------------- made-up corpora
#
# A character stands for a part: U+4E00 + p_partkey % 2000. Its reading is a syllable of the list and a tone.

#: Pinyin, Wade-Giles, initial, final, IPA.
SYLLABLES = [
    ("ma", "ma", "m", "a", "ma"), ("bei", "pei", "b", "ei", "pei"), ("jing", "ching", "j", "ing", "tɕiŋ"), ("zhong", "chung", "zh", "ong", "tʂuŋ"),
    ("guo", "kuo", "g", "uo", "kuo"), ("xie", "hsieh", "x", "ie", "ɕiɛ"), ("qian", "ch’ien", "q", "ian", "tɕ‘iɛn"), ("lü", "lü", "l", "ü", "ly"),
    ("shu", "shu", "sh", "u", "ʂu"), ("dao", "tao", "d", "ao", "tau"), ("ren", "jên", "r", "en", "ʐən"), ("tai", "t’ai", "t", "ai", "t‘ai"),
    ("nan", "nan", "n", "an", "nan"), ("hou", "hou", "h", "ou", "xou"), ("san", "san", "s", "an", "san"), ("gui", "kuei", "g", "uei", "kuei"),
]
#: Jyutping and Yale.
CANTONESE = [("gwong", "gwong"), ("zau", "jau"), ("waa", "wa"), ("jyut", "yut"), ("jyu", "yu"), ("sik", "sik"), ("ceot", "cheut"), ("hoeng", "heung")]
N, NC = len(SYLLABLES), len(CANTONESE)
rd.register_inventory("Pinyin", [s[0] for s in SYLLABLES])
rd.register_inventory("WadeGiles", [s[1] for s in SYLLABLES])
rd.register_inventory("Jyutping", [j for j, _ in CANTONESE])
rd.register_inventory("CantoneseYale", [y for _, y in CANTONESE])
rd.register_inventory("MandarinIPA", [s[4] for s in SYLLABLES])


def character_readings(spark: SparkSession, d: str) -> DataFrame:
    """A stored table of readings, with numbers, and the part that each is of."""
    part = table(spark, d, "part").select("p_partkey")
    return part.select("p_partkey", text.char_of(F.lit(0x4E00) + F.col("p_partkey") % 2000).alias(CH), F.concat(pick([s[0] for s in SYLLABLES], F.col("p_partkey")), (F.col("p_partkey") % 4 + 1).cast("string")).alias("Reading"))


_READINGS = f"""(SELECT p_partkey, chr((19968 + p_partkey % 2000)::INTEGER) AS "{CH}", s || (p_partkey % 4 + 1)::VARCHAR AS "Reading"
FROM part JOIN {values(*((i, s[0]) for i, s in enumerate(SYLLABLES)))} t(i, s) ON i = p_partkey % {N})"""


#: The syllables with the marks of the four tones.
MARKED = {
    "ma": "mā má mǎ mà", "bei": "bēi béi běi bèi", "jing": "jīng jíng jǐng jìng", "zhong": "zhōng zhóng zhǒng zhòng", "guo": "guō guó guǒ guò", "xie": "xiē xié xiě xiè",
    "qian": "qiān qián qiǎn qiàn", "lü": "lǖ lǘ lǚ lǜ", "shu": "shū shú shǔ shù", "dao": "dāo dáo dǎo dào", "ren": "rēn rén rěn rèn", "tai": "tāi tái tǎi tài",
    "nan": "nān nán nǎn nàn", "hou": "hōu hóu hǒu hòu", "san": "sān sán sǎn sàn", "gui": "guī guí guǐ guì",
}
_MARKS = values(*((s + str(t + 1), m) for s, forms in MARKED.items() for t, m in enumerate(forms.split())))


def _numbers_and_marks():
    return rd.reading("Pinyin", toneMarkType="numbers", erhua="ignore"), rd.reading("Pinyin", erhua="ignore")


def _reading_lookup(spark, d, domain: str = "Unicode") -> ch.CharacterLookup:
    small = table(spark, d, "part").where("p_size <= 25").select(text.char_of(F.lit(0x4E00) + F.col("p_partkey") % 2000).alias(CH)).distinct()
    return ch.CharacterLookup(Catalog({"CharacterPinyin": character_readings(spark, d).select(CH, "Reading").distinct(), "SmallSet": small}), domain=domain)


@query(f"""
SELECT DISTINCT m.diacritic AS query, r."{CH}" AS character FROM {_READINGS} r JOIN {_MARKS} m(numeric, diacritic) ON m.numeric = r."Reading"
WHERE r."{CH}" IN (SELECT chr((19968 + p_partkey % 2000)::INTEGER) FROM part WHERE p_size <= 25)
""")
def lkp05_characters_for_reading(spark, d):
    """Flagship (C): readings asked for with diacritics are converted to the stored style; characters in a domain answer."""
    numbers, marks = _numbers_and_marks()
    asked = spark.createDataFrame([(e,) for e in marks.entities()], "Reading string")
    return _reading_lookup(spark, d, "Small").characters_for_reading(asked, "Pinyin", rd.respelling(marks, numbers)).toDF("query", "character")


@query(f"""SELECT DISTINCT r."{CH}" AS character, m.diacritic AS reading, NULL::VARCHAR AS error FROM {_READINGS} r JOIN {_MARKS} m(numeric, diacritic) ON m.numeric = r."Reading" """)
def lkp06_readings_of_characters(spark, d):
    """All stored readings with the tones' marks instead of numbers, each once."""
    numbers, marks = _numbers_and_marks()
    keys = character_readings(spark, d).select(CH)
    return _reading_lookup(spark, d).readings(keys, "Pinyin", rd.respelling(numbers, marks)).toDF("character", "reading", "error")


@query(f"""SELECT DISTINCT "{CH}" AS character, "Reading" AS reading FROM {_READINGS} WHERE "{CH}" IN (SELECT chr((19968 + s_suppkey * 3 % 2000)::INTEGER) FROM supplier)""")
def lkp06_stored_readings(spark, d):
    keys = table(spark, d, "supplier").select(text.char_of(F.lit(0x4E00) + F.col("s_suppkey") * 3 % 2000).alias(CH))
    return _reading_lookup(spark, d).readings(keys, "Pinyin").toDF("character", "reading")


# ---------------------------------------------------------------- sources

_EVENTS = ("click", "error", "purchase", "signup", "view")


@query("SELECT user_id, " + ", ".join(f"min(CASE WHEN event_type = '{e}' THEN props END) AS \"{e}\"" for e in _EVENTS) + " FROM events GROUP BY user_id")
def src08_eav_pivot(spark, d):
    facts = table(spark, d, "events").select("user_id", F.col("event_type").alias("key"), F.col("props").alias("value"))
    return unihan.pivot_facts(facts, _EVENTS, entity="user_id")


_LINES = "replace(p_name, ' ', '_') || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE ' [' || p_type || ']' END || ' /' || p_brand || '/' || p_name || '/' || CASE WHEN p_partkey % 7 = 0 THEN 'x' ELSE '' END"


@query(rf"""
SELECT regexp_extract(v, '^\s*(\S+)', 1) AS headword, CASE WHEN v LIKE '% [%' THEN regexp_extract(v, '\[([^\]]*)\]', 1) END AS reading, regexp_extract(v, '(/.*/)\s*$', 1) AS translation
FROM (SELECT {_LINES} AS v FROM part WHERE p_partkey % 7 <> 0)
""")
def src11_edict_lines(spark, d):
    lines = table(spark, d, "part").select(F.col("p_partkey").alias("line_no"), F.expr(_LINES).alias("value"))
    return dictionaries.parse_edict(lines).toDF("headword", "reading", "translation")


@query("""SELECT 'T' || p_partkey AS traditional, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 'S' || p_size END AS simplified, p_type AS reading, '/' || p_name || '/' AS translation
FROM part WHERE p_partkey % 11 <> 0""")
def src12_cedict_lines(spark, d):
    line = "CASE WHEN p_partkey % 11 = 0 THEN '# ' ELSE '' END || 'T' || p_partkey || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE ' S' || p_size END || ' [' || p_type || '] /' || p_name || '/'"
    return dictionaries.parse_cedict(table(spark, d, "part").select(F.col("p_partkey").alias("line_no"), F.expr(line).alias("value"))).toDF("traditional", "simplified", "reading", "translation")


# ---------------------------------------------------------------- derivations


@query("SELECT o_orderkey, o_orderpriority AS priority FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS o_orderpriority FROM orders) WHERE o_orderpriority IS NOT NULL")
def der01_column_values(spark, d):
    wide = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).alias("priority"))
    return derive.column_values(wide, "priority", "o_orderkey")


@query("SELECT p_partkey, p_size AS radical FROM part WHERE p_partkey % 5 <> 0")
def der03_radical_index(spark, d):
    wide = table(spark, d, "part").select("p_partkey", F.expr("CASE WHEN p_partkey % 5 = 0 THEN 'x' || p_size ELSE p_size || '.' || p_partkey END").alias("kRS"))
    return derive.radical_indices(wide, "kRS", "p_partkey").toDF("p_partkey", "radical")


@query(f"""
WITH w AS (SELECT chr((19968 + p_partkey)::INTEGER) AS c, 'U+' || printf('%X', (13312 + p_size)::INTEGER) AS one, p_partkey FROM part),
v AS (SELECT c, 'S' AS t, one || CASE WHEN p_partkey % 2 = 0 THEN ' U+4E00' ELSE '' END AS v FROM w UNION ALL SELECT c, 'M', one || '<kX:T' FROM w WHERE p_partkey % 3 = 0)
SELECT DISTINCT c AS character, chr(('0x' || code)::INTEGER) AS variant, t AS kind FROM (SELECT c, t, unnest(regexp_extract_all(v, 'U\\+([0-9A-F]+)', 1)) AS code FROM v)
""")
def der04_variant_explode(spark, d):
    part = table(spark, d, "part").select("p_partkey", text.char_of(F.lit(0x4E00) + F.col("p_partkey")).alias(CH), F.concat(F.lit("U+"), F.hex(F.lit(13312) + F.col("p_size"))).alias("one"))
    wide = part.select(CH, F.expr("one || CASE WHEN p_partkey % 2 = 0 THEN ' U+4E00' ELSE '' END").alias("kSimplifiedVariant"), F.expr("CASE WHEN p_partkey % 3 = 0 THEN one || '<kX:T' WHEN p_partkey % 3 = 1 THEN 'no' END").alias("kSemanticVariant"))
    return derive.variants(wide).toDF("character", "variant", "kind")


@query("SELECT DISTINCT c_custkey AS k FROM customer WHERE c_custkey % 3 = 0 UNION SELECT c_custkey FROM customer WHERE c_custkey % 5 = 0")
def der06_union_of_sets(spark, d):
    wide = table(spark, d, "customer").select(F.col("c_custkey").alias(CH), F.expr("CASE WHEN c_custkey % 3 = 0 THEN 'x' END").alias("kBigFive"), F.expr("CASE WHEN c_custkey % 5 = 0 THEN 'y' END").alias("kHKSCS"))
    return derive.character_set(wide, "BIG5HKSCS").toDF("k")


@query(r"SELECT DISTINCT doc_id, word AS reading FROM (SELECT doc_id, unnest(regexp_split_to_array(trim(lower(text)), '\s+')) AS word FROM documents WHERE text IS NOT NULL) WHERE word <> ''")
def der08_token_set(spark, d):
    return derive.split_readings(table(spark, d, "documents"), "text", "doc_id").toDF("doc_id", "reading")


@query("SELECT user_id, 'hao' || (event_id % 5 + 1) AS reading, max_by(v, event_id) AS frequency FROM (SELECT user_id, event_id, (value * 100)::BIGINT % 97 AS v FROM events) GROUP BY 1, 2")
def der09_reading_frequency(spark, d):
    one = F.struct("event_id", F.expr("'hao' || (event_id % 5 + 1) || '(' || CAST(round(value * 100) AS BIGINT) % 97 || ')'").alias("s"))
    joined = table(spark, d, "events").groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["s"]), " ").alias("kHanyuPinlu"))
    return derive.readings_with_frequency(joined, key="user_id").select("user_id", F.col("Reading").alias("reading"), F.col("Frequency").cast("long").alias("frequency"))


ORACLE_SQL["der09_reading_frequency"] = ORACLE_SQL["der09_reading_frequency"].replace("(value * 100)::BIGINT", "round(value * 100)::BIGINT")


@query(f"""SELECT p_partkey, numeric AS reading FROM part JOIN {values(*((i, s[0] + str(i % 4 + 1)) for i, s in enumerate(SYLLABLES)))} t(i, numeric) ON i = p_partkey % {N}
UNION SELECT p_partkey, 'ma5' FROM part""")
def der10_located_readings(spark, d):
    marked = [rd.Pinyin([s[0]]).tonal(s[0], i % 4 + 1) for i, s in enumerate(SYLLABLES)]
    rows = table(spark, d, "part").select("p_partkey", F.concat(F.lit("1"), F.col("p_size").cast("string"), F.lit(".020:"), pick(marked, F.col("p_partkey")), F.lit(",ma")).alias("kHanyuPinyin"))
    return derive.located_readings(rows, "kHanyuPinyin", "p_partkey").toDF("p_partkey", "reading")


@query("SELECT DISTINCT l_partkey AS c, l_linenumber AS glyph FROM lineitem UNION SELECT p_partkey, 0 FROM part WHERE p_size > 30 UNION SELECT p_partkey, 1 FROM part WHERE p_size < 5")
def der12_glyphs(spark, d):
    part = table(spark, d, "part")
    lines = table(spark, d, "lineitem").select(F.col("l_partkey").alias(CH), F.col("l_linenumber").alias("Glyph"))
    wide = part.select(F.col("p_partkey").alias(CH), F.expr("CASE WHEN p_size > 30 THEN 1 END").alias("kTotalStrokes"), F.lit(None).cast("string").alias("kRSKangXi"))
    orders = part.where("p_size < 5").select(F.col("p_partkey").alias(CH), F.lit(1).alias("Glyph"))
    return derive.glyphs(lines, orders, wide).toDF("c", "glyph")


@query("SELECT p_partkey, (length(p_name) - length(replace(replace(p_name, ' ', ''), '-', '')) + 1)::BIGINT AS strokes FROM part")
def der13_stroke_count(spark, d):
    return table(spark, d, "part").select("p_partkey", derive.stroke_count_of("p_name").cast("long").alias("strokes"))


@query("SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 4 = 0 THEN 1000 END, n, -1)::BIGINT AS v FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_linenumber) AS n FROM lineitem WHERE l_linenumber > 2 GROUP BY 1) ON l_orderkey = o_orderkey")
def der14_priority_fallback(spark, d):
    keys = table(spark, d, "orders").select("o_orderkey")
    own = keys.where("o_orderkey % 4 = 0").select("o_orderkey", F.lit(1000).cast("long").alias("v"))
    sums = table(spark, d, "lineitem").where("l_linenumber > 2").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_linenumber").alias("v"))
    return derive.priority_fallback(keys, ["o_orderkey"], "v", own, sums, keys.select("o_orderkey", F.lit(-1).cast("long").alias("v")))


_EDGES = "SELECT 'r' || n_regionkey AS a, 'n' || n_nationkey AS b FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier"


@query(f"WITH RECURSIVE e AS ({_EDGES}), t AS (SELECT a, b FROM e UNION SELECT t.a, e.b FROM t JOIN e ON t.b = e.a) SELECT a AS source, b AS target FROM t")
def der15_closure(spark, d):
    n, c, s = (table(spark, d, x) for x in ("nation", "customer", "supplier"))
    pair = lambda t, x, a, y, b: t.select(F.concat(F.lit(x), a).alias("source"), F.concat(F.lit(y), b).alias("target"))
    edges = pair(n, "r", "n_regionkey", "n", "n_nationkey").union(pair(c, "n", "c_nationkey", "c", "c_custkey")).union(pair(s, "n", "s_nationkey", "s", "s_suppkey"))
    return derive.closure(edges, ["source"], ["target"])


@query("SELECT l_orderkey, l_partkey, l_linenumber, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_linenumber, l_suppkey) AS n FROM lineitem) WHERE n = 1")
def der17_first_per_group(spark, d):
    return derive.first_per_group(table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey"), ["l_orderkey"], ["l_partkey", "l_linenumber", "l_suppkey"])


@query("SELECT DISTINCT p_brand AS headword, p_type AS reading, trim(lower(w)) AS word FROM (SELECT p_brand, p_type, unnest([p_name, p_brand || '!', p_type]) AS w FROM part)".replace("p_brand || '!'", "p_brand"))
def der18_word_index(spark, d):
    entries = table(spark, d, "part").select(F.col("p_brand").alias("Headword"), F.col("p_type").alias("Reading"), F.expr("'/' || p_name || ' (n)/' || p_brand || '!/' || p_type || '/'").alias("Translation"))
    return derive.word_index(entries).toDF("headword", "reading", "word")


@query("SELECT c_custkey AS c, c_mktsegment AS reading FROM customer UNION SELECT c_custkey + 1, c_mktsegment FROM customer WHERE c_custkey % 4 = 0")
def der21_augment_readings(spark, d):
    c = table(spark, d, "customer")
    readings = c.select(F.col("c_custkey").alias(CH), F.col("c_mktsegment").alias("Reading"))
    pairs = c.where("c_custkey % 4 = 0").select(F.col("c_custkey").alias(CH), (F.col("c_custkey") + 1).alias("Variant"), F.lit("T").alias("Type"))
    return derive.augment_readings(readings, pairs).toDF("c", "reading")


@query("""SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'only_second' WHEN b.k IS NULL THEN 'only_first' ELSE 'both' END AS status
FROM (SELECT DISTINCT c_custkey AS k FROM customer) a FULL JOIN (SELECT DISTINCT o_custkey * 2 AS k FROM orders) b ON a.k = b.k""")
def der24_table_difference(spark, d):
    return derive.table_difference(table(spark, d, "customer").select(F.col("c_custkey").alias("k")), table(spark, d, "orders").select((F.col("o_custkey") * 2).alias("k")), ["k"])


# ---------------------------------------------------------------- filters and text functions

_CHARS = "SELECT unnest(string_split(text, '')) AS c FROM documents"


@query(f"SELECT c, unicode(c)::BIGINT AS code, printf('U+%04X', unicode(c)) AS formatted, count(*) AS n FROM ({_CHARS}) WHERE c <> '' GROUP BY 1, 2, 3")
def str01_codepoints(spark, d):
    chars = table(spark, d, "documents").select(F.explode(text.characters("text")).alias("c")).groupBy("c").agg(F.count("*").alias("n"))
    return chars.select("c", text.codepoint("c").cast("long").alias("code"), text.format_codepoint("c").alias("formatted"), "n")


@query("""SELECT k, k BETWEEN 11904 AND 11929 OR k BETWEEN 11931 AND 12019 OR k BETWEEN 12032 AND 12245 OR k IN (12293, 12295) OR k BETWEEN 12321 AND 12329 OR k BETWEEN 12344 AND 12347
OR k BETWEEN 13312 AND 19893 OR k BETWEEN 19968 AND 40907 AS han, k BETWEEN 44032 AND 55203 AS hangul, k BETWEEN 11904 AND 12245 AS radical FROM (SELECT (8192 + o_orderkey * 7 % 50000)::BIGINT AS k FROM orders)""")
def flt08_code_ranges(spark, d):
    k = (F.lit(8192) + F.col("o_orderkey") * 7 % 50000).cast("long")
    rows = table(spark, d, "orders").select(k.alias("k")).withColumn("c", text.char_of("k"))
    return rows.select("k", text.is_han("c").alias("han"), text.in_script("c", "Hangul").alias("hangul"), text.is_radical_form("c").alias("radical"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag || l_linestatus LIKE '%F%'")
def flt02_flag_set(spark, d):
    return table(spark, d, "lineitem").withColumn("Locale", F.translate(F.concat("l_returnflag", "l_linestatus"), "FO", "TC")).where(ch.has_locale("Locale", "t")).select("l_orderkey", "l_linenumber")


@query("SELECT p_partkey, upper(left(lower(p_name), 1)) || substr(lower(p_name), 2) AS title, CASE WHEN p_partkey % 3 = 0 THEN upper(p_type) WHEN p_partkey % 3 = 1 THEN upper(left(p_type, 1)) || lower(substr(p_type, 2)) ELSE lower(p_type) END AS moved FROM part")
def str04_title_and_case(spark, d):
    source = F.expr("CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) WHEN p_partkey % 3 = 1 THEN upper(left(p_name, 1)) || lower(substr(p_name, 2)) ELSE lower(p_name) END")
    return table(spark, d, "part").select("p_partkey", text.titlecase(F.upper("p_name")).alias("title"), text.transfer_case(source, F.lower("p_type")).alias("moved"))


@query("SELECT p_partkey, p_size AS n, '⿰' || chr((19968 + p_size)::INTEGER) || '[' || p_size || ']⿱木水' AS written, true AS valid, false AS cut FROM part WHERE p_size > 0")
def str06_description_sequences(spark, d):
    seq = F.concat(F.lit("⿰"), text.char_of(F.lit(19968) + F.col("p_size")), F.lit("["), F.col("p_size").cast("string"), F.lit("]⿱木水"))
    rows = table(spark, d, "part").where("p_size > 0").withColumn("s", seq)
    return rows.select("p_partkey", F.element_at(ids.components("s"), 1)["glyph"].alias("n"), ids.write(ids.parse("s")).alias("written"), ids.is_valid("s").alias("valid"), ids.is_valid(F.concat("s", F.lit("木"))).alias("cut"))


@query(f"SELECT p_partkey, translate(p_name, '{text.ASCII_LETTERS}', '{text.FULL_WIDTH}') AS wide FROM part")
def str08_full_width(spark, d):
    return table(spark, d, "part").select("p_partkey", text.full_width("p_name").alias("wide"))


@query("SELECT n_nationkey, r_regionkey, n_name || '-' || r_name AS pair FROM nation, region")
def str15_cross_product(spark, d):
    n = table(spark, d, "nation").withColumn("rs", F.array(*(F.lit(i) for i in range(5))))
    names = table(spark, d, "region").select("r_regionkey", "r_name")
    each = n.select("n_nationkey", F.explode(text.cross_product(F.array("n_name"), F.col("rs"), lambda a, b: F.struct(a.alias("n"), b.alias("r_regionkey")))).alias("x")).select("n_nationkey", "x.n", "x.r_regionkey")
    return each.join(F.broadcast(names), "r_regionkey").select("n_nationkey", "r_regionkey", F.concat_ws("-", "n", "r_name").alias("pair"))


@query("SELECT o_custkey, CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN min(o_orderstatus) ELSE '[' || string_agg(DISTINCT o_orderstatus, ' ' ORDER BY o_orderstatus) || ']' END AS folded FROM orders GROUP BY 1")
def str16_fold(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderstatus")).alias("s")).select("o_custkey", text.fold("s").alias("folded"))


# ---------------------------------------------------------------- joins, aggregations, orders


@query("SELECT c_custkey, c_name FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def jon01_domain_filter(spark, d):
    catalog = Catalog({"RegionSet": table(spark, d, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias(CH))})
    return catalog.within(table(spark, d, "customer"), "Region", "c_nationkey").select("c_custkey", "c_name")


@query("SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey AND o_orderdate < l_shipdate JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING'")
def jon05_composite_join(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    within = Catalog({"SegmentSet": table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias(CH))}).within(o, "Segment", "o_custkey")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    return lines.join(within, (F.col("o_orderkey") == F.col("l_orderkey")) & (F.col("o_orderdate") < F.col("l_shipdate"))).select("l_orderkey", "l_linenumber", "o_custkey")


@query("SELECT l_orderkey FROM lineitem JOIN (SELECT unnest([0, 0, 1, 1, 2, 2]) AS slot, unnest(['R', 'A', 'N', 'R', 'A', 'N']) AS v) ON v = l_returnflag GROUP BY 1 HAVING count(DISTINCT slot) = 3")
def jon07_component_search(spark, d):
    slots = spark.createDataFrame([(0, "R"), (0, "A"), (1, "N"), (1, "R"), (2, "A"), (2, "N")], "slot int, l_returnflag string")
    return ch.all_slots(table(spark, d, "lineitem").select("l_orderkey", "l_returnflag"), slots, ["l_orderkey"], "slot", "l_returnflag")


@query("SELECT c_nationkey, c_mktsegment AS segment FROM (SELECT c_nationkey, c_mktsegment, row_number() OVER (PARTITION BY c_nationkey ORDER BY count(*) DESC, c_mktsegment) AS n FROM customer GROUP BY 1, 2) WHERE n = 1")
def agg10_vote_with_tie_break(spark, d):
    counts = table(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg((-F.count("*")).alias("votes"))
    return derive.first_per_group(counts, ["c_nationkey"], ["votes", "c_mktsegment"]).select("c_nationkey", F.col("c_mktsegment").alias("segment"))


@query("SELECT l_orderkey, coalesce(min(CASE WHEN l_returnflag = 'N' THEN l_linenumber END), min(l_linenumber)) AS glyph FROM lineitem GROUP BY 1")
def lkp10_default_glyph(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_linenumber").withColumnRenamed("l_linenumber", "glyph")
    return ch.default_of(lines.select("l_orderkey").distinct(), lines.where("l_returnflag = 'N'"), lines, ["l_orderkey"], "glyph")


@query("""SELECT c_custkey AS k, coalesce(a.v, b.v, CASE WHEN c_custkey % 2 = 0 THEN -1 END) AS v FROM customer
LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS v FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) a ON a.o_custkey = c_custkey
LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) b ON b.o_custkey = c_custkey""")
def lkp27_three_step_fallback(spark, d):
    keys, o = table(spark, d, "customer").select(F.col("c_custkey").alias("k")), table(spark, d, "orders")
    step = lambda s: o.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v"))
    return ch.three_step(keys, "k", "v", step("P"), step("F"), keys.where("k % 2 = 0").select("k", F.lit(-1).cast("long").alias("v")))


@query("SELECT p_partkey, p_name FROM (SELECT * FROM part WHERE lower(p_name) LIKE '%ring%' ORDER BY p_name, p_partkey LIMIT 200) WHERE p_size > 10")
def srt04_limit_then_filter(spark, d):
    return dic.limit_then_filter(table(spark, d, "part"), F.lower("p_name").like("%ring%"), F.col("p_size") > 10, 200, ["p_name", "p_partkey"]).select("p_partkey", "p_name")


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier UNION SELECT n_regionkey + 100 FROM nation")
def set02_union_of_three(spark, d):
    one = lambda t, e: table(spark, d, t).select(F.expr(e).cast("int").alias("k"))
    return derive.union_distinct(one("customer", "c_nationkey"), one("supplier", "s_nationkey"), one("nation", "n_regionkey + 100"))


# ---------------------------------------------------------------- dictionary search


def _entries(spark, d):
    return table(spark, d, "part").select("p_partkey", F.col("p_name").alias("Headword"), F.col("p_type").alias("Reading"), F.expr("'/(n) ' || p_name || ' (x)/' || p_brand || ', ' || p_type || '/'").alias("Translation"))


@query("SELECT p_partkey FROM part WHERE lower(p_name) = 'blue bolt'")
def sch02_exact(spark, d):
    return _entries(spark, d).where(dic.Exact(True)("Headword", "Blue BOLT")).select("p_partkey")


@query(r"SELECT p_partkey FROM (SELECT p_partkey, p_name || CASE WHEN p_partkey % 2 = 0 THEN '_%' ELSE 'ab' END AS n FROM part) WHERE n LIKE 'b__e %\_\%' ESCAPE '\'")
def sch04_wildcards(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.expr("p_name || CASE WHEN p_partkey % 2 = 0 THEN '_%' ELSE 'ab' END").alias("n"))
    return rows.where(dic.Wildcard()("n", r"b__e %\_\%")).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE lower(p_brand || ', ' || p_type) = 'brand#4, small'")
def sch05_single_sense(spark, d):
    return _entries(spark, d).where(dic.SingleEntry()("Translation", "BRAND#4, small")).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE lower(p_name) = 'small ring'")
def sch07_simple_translation(spark, d):
    return _entries(spark, d).where(dic.SimpleTranslation("Translation", "Small Ring")).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE regexp_matches(lower(p_name), '^.* bolt$')")
def sch08_wildcard_translation(spark, d):
    return _entries(spark, d).where(dic.SimpleWildcardTranslation("Translation", "% bolt")).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_brand = 'Brand#4'")
def sch09_translation_to_comma(spark, d):
    return _entries(spark, d).where(dic.CEDICTTranslation("Translation", "brand#4")).select("p_partkey")


@query("SELECT doc, true AS found FROM " + values((0,), (3,)) + " t(doc)")
def sch10_sense_after_sign(spark, d):
    rows = spark.createDataFrame([(0, "/Wind (u.E.); Nordwind/"), (1, "/Wind; Bsp.: kalt -- kalter Nordwind/"), (2, "/Nordwinde/"), (3, "/(kalter) Nordwind! ja/")], "doc int, t string")
    return rows.where(dic.HanDeDictTranslation("t", "nordwind")).select("doc", F.lit(True).alias("found"))


def _words(spark, d):
    """Headwords of two characters, with their readings."""
    r = character_readings(spark, d)
    second = F.concat(pick([s[0] for s in SYLLABLES], F.col("p_partkey") + 1), (F.col("p_partkey") % 3 + 1).cast("string"))
    return r.select("p_partkey", F.concat(F.col(CH), text.char_of(F.lit(0x5000) + F.col("p_partkey") % 50)).alias("Headword"), F.concat_ws(" ", "Reading", second).alias("Reading"))


_TWO = f"""(SELECT p_partkey, a.s || (p_partkey % 4 + 1)::VARCHAR AS r1, b.s || (p_partkey % 3 + 1)::VARCHAR AS r2, chr((20480 + p_partkey % 50)::INTEGER) AS c2, chr((19968 + p_partkey % 2000)::INTEGER) AS c1
FROM part JOIN {values(*((i, s[0]) for i, s in enumerate(SYLLABLES)))} a(i, s) ON a.i = p_partkey % {N} JOIN {values(*((i, s[0]) for i, s in enumerate(SYLLABLES)))} b(i, s) ON b.i = (p_partkey + 1) % {N})"""


def _search(**options):
    return dic.pinyin_search(rd.reading("Pinyin", toneMarkType="numbers", erhua="ignore"), **options)


@query(f"SELECT p_partkey FROM {_TWO} WHERE r1 = 'zhong4' AND r2 = 'guo1'")
def sch11_simple_reading(spark, d):
    return _words(spark, d).where(_search(wildcards=False, toneless=False)("Reading", "zhong4guo1")).select("p_partkey")


@query(f"SELECT p_partkey FROM {_TWO} WHERE r1 = 'zhong4'")
def sch12_wildcard_reading(spark, d):
    return _words(spark, d).where(_search(toneless=False)("Reading", "zhong4_")).select("p_partkey")


@query(f"SELECT p_partkey FROM {_TWO} WHERE r1 LIKE 'zhong_' AND r2 LIKE 'guo_'")
def sch13_toneless_reading(spark, d):
    return _words(spark, d).where(_search()("Reading", "zhongguo")).select("p_partkey")


@query(f"SELECT p_partkey FROM {_TWO} WHERE r1 = 'zhong4' AND c2 = chr(20483)")
def sch14_mixed_reading(spark, d):
    return _words(spark, d).where(dic.MixedSearch(_search(toneless=False))("Headword", "Reading", "zhong4" + chr(0x5003))).select("p_partkey")


@query(f"SELECT p_partkey FROM {_TWO} WHERE r1 LIKE 'zhong_' AND c2 = chr(20483)")
def sch15_mixed_toneless_reading(spark, d):
    return _words(spark, d).where(dic.MixedSearch(_search())("Headword", "Reading", "zhong" + chr(0x5003) + "%")).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE contains('a small ring and a blue bolt', p_name)")
def sch16_headword_within(spark, d):
    return table(spark, d, "part").where(dic.exact_multiple("p_name", "a small ring and a blue bolt")).select("p_partkey")


@query("SELECT p_partkey, headword FROM (SELECT p_partkey, p_name AS headword FROM part WHERE p_name LIKE 'small %' OR p_type = 'SMALL' OR p_brand = 'Brand#4')")
def dic07_search_everything(spark, d):
    found = dic.Dictionary(_entries(spark, d), headword_search=dic.Wildcard(True), reading_search=dic.Wildcard(True), translation_search=dic.CEDICTWildcardTranslation)
    e = found.headword_condition("small %") | found.reading_condition("SMALL") | found.translation_condition("brand#4")
    return found._run(e).select("p_partkey", F.col("Headword").alias("headword"))


@query(f"""
WITH w AS (SELECT DISTINCT c1 || c2 AS headword, r1 || ' ' || r2 AS reading, unnest([c1, c2]) AS character, unnest([r1, r2]) AS entity FROM {_TWO})
SELECT * FROM w WHERE NOT EXISTS (SELECT 1 FROM {_READINGS} k WHERE k."{CH}" = character AND k."Reading" = entity)
""")
def dic10_unknown_readings(spark, d):
    words = _words(spark, d).select("Headword", "Reading").distinct()
    return dic.check_readings(words, character_readings(spark, d).select(CH, "Reading").distinct(), "Headword", "Reading").distinct().toDF("headword", "reading", "character", "entity")


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE p_type || '（' || p_brand || '）' END AS headword FROM part WHERE p_brand <> p_type")
def prj06_unified_headword(spark, d):
    rows = table(spark, d, "part").where("p_brand <> p_type").select("p_partkey", F.col("p_brand").alias("t"), F.expr("CASE WHEN p_partkey % 4 = 0 THEN p_brand WHEN p_partkey % 2 = 1 THEN p_type END").alias("s"))
    return rows.select("p_partkey", dic.unified_headword("t", "s").alias("headword"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'USB shou3 zhi3' ELSE 'ka3 C' END AS reading FROM part")
def prj03_reading_spaces(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.expr("CASE WHEN p_partkey % 2 = 0 THEN 'ＵＳＢ手指' ELSE '卡Ｃ' END").alias("h"), F.expr("CASE WHEN p_partkey % 2 = 0 THEN 'U S B shou3 zhi3' ELSE 'ka3 C' END").alias("r"))
    return rows.select("p_partkey", dic.normalise_reading_spaces("h", "r").alias("reading"))


# ---------------------------------------------------------------- readings


@query(f"SELECT p_partkey, r1 || ' ' || r2 AS entities FROM {_TWO}")
def rdo01_segment(spark, d):
    r = rd.reading("Pinyin", toneMarkType="numbers", erhua="ignore")
    rows = _words(spark, d).withColumn("x", rd.decompose(F.regexp_replace("Reading", " ", ""), r))
    return rows.select("p_partkey", F.array_join("x.value", " ").alias("entities"))


@query(f"SELECT s || t AS entity FROM {values(*((s[0],) for s in SYLLABLES))} a(s), (SELECT unnest(['1', '2', '3', '4', '5', '']) AS t)")
def rdo07_entities(spark, d):
    r = rd.reading("Pinyin", toneMarkType="numbers", erhua="ignore")
    return spark.createDataFrame([(e,) for e in r.entities()], "entity string")


@query(f"SELECT p_partkey, left(\"Reading\", length(\"Reading\") - 1) AS plain, right(\"Reading\", 1) AS tone FROM {_READINGS}")
def rdo09_tone_split(spark, d):
    r = rd.reading("Pinyin", toneMarkType="numbers", erhua="ignore")
    rows = character_readings(spark, d).withColumn("x", rd.split_tone(F.col("Reading"), r))
    return rows.select("p_partkey", F.element_at("x.value", 1).alias("plain"), F.element_at("x.value", 2).alias("tone"))


@query("SELECT o_orderkey, 'ab|' || chr((44032 + o_orderkey % 11000)::INTEGER) || '|' || chr((44032 + o_orderkey % 11000)::INTEGER) || '|, x' AS parts FROM orders")
def rdo13_script_runs(spark, d):
    c = text.char_of(F.lit(44032) + F.col("o_orderkey") % 11000)
    return table(spark, d, "orders").select("o_orderkey", F.array_join(text.script_runs(F.concat(F.lit("ab"), c, c, F.lit(", x")), "Hangul"), "|").alias("parts"))


@query(f"SELECT i AS syllable, initial, final, count(*) AS parts FROM part JOIN {values(*((i, s[2], s[3]) for i, s in enumerate(SYLLABLES)))} t(i, initial, final) ON i = p_partkey % {N} GROUP BY 1, 2, 3")
def rdo14_onset_and_rhyme(spark, d):
    parts = spark.createDataFrame([(i, s[0], s[2], s[3]) for i, s in enumerate(SYLLABLES)], "syllable int, plain string, initial string, final string")
    plain = character_readings(spark, d).select(F.substring("Reading", 1, 0).alias("_"), F.regexp_replace("Reading", r"\d$", "").alias("plain")).drop("_")
    return plain.groupBy("plain").agg(F.count("*").alias("parts")).join(F.broadcast(parts), "plain").select("syllable", "initial", "final", "parts")


def _converted(spark, d, converter, source="Reading"):
    rows = character_readings(spark, d).withColumn("x", rd.convert(F.col(source), converter))
    return rows.select("p_partkey", F.col("x.value").alias("value"), F.col("x.error").alias("error"))


def _mapped(f) -> str:
    """The oracle of a conversion of single syllables: what f says of each syllable and tone."""
    pairs = values(*((s[0] + str(t), f(s, t)) for s in SYLLABLES for t in (1, 2, 3, 4)))
    return f"SELECT p_partkey, v AS value, NULL::VARCHAR AS error FROM {_READINGS} r JOIN {pairs} m(k, v) ON k = r.\"Reading\""


@query(_mapped(lambda s, t: MARKED[s[0]].split()[t - 1]))
def cnv03_pinyin_styles(spark, d):
    return _converted(spark, d, rd.respelling(rd.reading("Pinyin", toneMarkType="numbers", erhua="ignore"), rd.reading("Pinyin", erhua="ignore")))


@query(_mapped(lambda s, t: s[1] + "¹²³⁴"[t - 1]))
def cnv05_pinyin_to_wade_giles(spark, d):
    rows = [(s[1], s[0], 0) for s in SYLLABLES]
    return _converted(spark, d, rd.pinyin_to_wade_giles(rows, rd.reading("Pinyin", toneMarkType="numbers", erhua="ignore"), rd.reading("WadeGiles")))


@query(_mapped(lambda s, t: s[4] + ["˥˥", "˧˥", "˨˩˦", "˥˩"][t - 1]))
def cnv08_pinyin_to_ipa(spark, d):
    rows = [(s[0], s[4], "") for s in SYLLABLES]
    return _converted(spark, d, rd.pinyin_to_ipa(rows, rd.reading("Pinyin", toneMarkType="numbers", erhua="ignore"), rd.reading("MandarinIPA")))


#: Cells of initials and finals.
BRAILLE_INITIALS = {"m": "⠍", "b": "⠃", "j": "⠛", "zh": "⠌", "g": "⠛", "x": "⠓", "q": "⠅", "l": "⠇", "sh": "⠱", "d": "⠙", "r": "⠚", "t": "⠞", "n": "⠝", "h": "⠓", "s": "⠎"}
BRAILLE_FINALS = {"a": "⠔", "ei": "⠮", "ing": "⠡", "ong": "⠲", "uo": "⠕", "ie": "⠑", "ian": "⠩", "ü": "⠬", "u": "⠥", "ao": "⠖", "en": "⠴", "ai": "⠪", "an": "⠧", "ou": "⠷", "uei": "⠺"}


@query(_mapped(lambda s, t: BRAILLE_INITIALS[s[2]] + BRAILLE_FINALS[s[3]] + "⠁⠂⠄⠆"[t - 1]))
def cnv09_pinyin_to_braille(spark, d):
    made = rd.PinyinBraille(rd.reading("Pinyin", toneMarkType="numbers", erhua="ignore"), rd.MandarinBraille(), {s[0]: (s[2], s[3]) for s in SYLLABLES}, BRAILLE_INITIALS, BRAILLE_FINALS)
    return _converted(spark, d, made)


_YALE = {"gwong": "gwōng gwóng gwong gwòhng gwóhng gwohng", "zau": "jāu jáu jau jàuh jáuh jauh", "waa": "wā wá wa wàh wáh wah", "jyu": "yū yú yu yùh yúh yuh", "hoeng": "hēung héung heung hèuhng héuhng heuhng"}


@query(f"SELECT o_orderkey, y AS value FROM orders JOIN {values(*((i * 6 + t, y) for i, ys in enumerate(_YALE.values()) for t, y in enumerate(ys.split())))} v(i, y) ON i = o_orderkey % 30")
def cnv11_jyutping_to_yale(spark, d):
    pairs = [(j, y) for j, y in CANTONESE]
    made = rd.jyutping_to_yale(pairs, rd.reading("Jyutping"), rd.reading("CantoneseYale"))
    asked = F.concat(pick([s for s in _YALE for _ in range(6)], F.col("o_orderkey")), (F.col("o_orderkey") % 6 + 1).cast("string"))
    return table(spark, d, "orders").select("o_orderkey", rd.convert(asked, made)["value"].alias("value"))


@query(_mapped(lambda s, t: s[4] + ["˥˥", "˧˥", "˨˩˦", "˥˩"][t - 1]).replace("r.\"Reading\"", "r.\"Reading\""))
def cnv12_bridge(spark, d):
    """Wade-Giles to IPA over Pinyin."""
    pairs = [(s[1], s[0], 0) for s in SYLLABLES]
    all_ways = rd.Conversions()
    all_ways.publish("WadeGiles", "Pinyin", lambda a, b: rd.wade_giles_to_pinyin(pairs, a, b))
    all_ways.publish("Pinyin", "MandarinIPA", lambda a, b: rd.pinyin_to_ipa([(s[0], s[4], "") for s in SYLLABLES], a, b))
    wg = pick([s[1] for s in SYLLABLES], F.col("p_partkey"))
    rows = table(spark, d, "part").select("p_partkey", F.concat(wg, (F.col("p_partkey") % 4 + 1).cast("string")).alias("w"))
    rows = rows.withColumn("x", rd.convert(F.col("w"), all_ways.get(rd.reading("WadeGiles", toneMarkType="numbers"), rd.reading("MandarinIPA"))))
    return rows.select("p_partkey", F.col("x.value").alias("value"), F.col("x.error").alias("error"))


#: Gwoyeu Romatzyh of the syllables, plain and in four tones.
GR_FORMS = {
    "ma": ("ma", "mha ma maa mah"), "bei": ("bei", "bei beir beei bey"), "jing": ("jing", "jing jyng jiing jinq"), "zhong": ("jong", "jong jorng joong jonq"),
    "guo": ("guo", "guo gwo guoo guoh"), "xie": ("shie", "shie shye shiee shieh"), "qian": ("chian", "chian chyan chean chiann"), "lü": ("liu", "lhiu liu leu liuh"),
    "shu": ("shu", "shu shwu shuu shuh"), "dao": ("dau", "dau daur dao daw"), "ren": ("ren", "rhen ren reen renn"), "tai": ("tai", "tai tair tae tay"),
    "nan": ("nan", "nhan nan naan nann"), "hou": ("hou", "hou hour hoou how"), "san": ("san", "san sarn saan sann"), "gui": ("guei", "guei gwei goei guey"),
}
_GR_ROWS = [(p, g) for p, (g, _) in GR_FORMS.items()]


@query(_mapped(lambda s, t: GR_FORMS[s[0]][1].split()[t - 1]))
def cnv07_pinyin_to_gr(spark, d):
    return _converted(spark, d, gr.GRPinyin(_GR_ROWS, rd.reading("Pinyin", toneMarkType="numbers", erhua="ignore"), gr.GR([g for _, g in _GR_ROWS])))


@query(_mapped(lambda s, t: s[0] + str(t)))
def cnv07_gr_to_pinyin(spark, d):
    forms = spark.createDataFrame([(p + str(t + 1), form) for p, (_, forms) in GR_FORMS.items() for t, form in enumerate(forms.split())], "Reading string, form string")
    back = gr.GRPinyin(_GR_ROWS, gr.GR([g for _, g in _GR_ROWS]), rd.reading("Pinyin", toneMarkType="numbers", erhua="ignore"))
    rows = character_readings(spark, d).join(F.broadcast(forms), "Reading").withColumn("x", rd.convert(F.col("form"), back))
    return rows.select("p_partkey", F.col("x.value").alias("value"), F.col("x.error").alias("error"))


@query("SELECT * FROM " + values(("g", "˳geh", None), ("x", None, "ConversionError"), ("guoh .x", "guoh .guoh", None), ("maa shu vx", "maa shu maa shu", None)) + " t(text, value, error)")
def cnv06_gr_full_forms(spark, d):
    own = gr.GR([*(g for _, g in _GR_ROWS), "ge"], abbreviated=[("˳geh", "g", "")])
    rows = spark.createDataFrame([("g",), ("x",), ("guoh .x",), ("maa shu vx",)], "text string").withColumn("x", rd.convert(F.col("text"), gr.GRToGR(own, own, True)))
    return rows.select("text", F.col("x.value").alias("value"), F.col("x.error").alias("error"))


def _decompositions(spark):
    rows = [("他", "⿰亻也"), ("休", "⿰亻木"), ("鸺", "⿰休鸟"), ("林", "⿰木木"), ("森", "⿱木林"), ("回", "⿴囗口"), ("凶", "⿶凵乂")]
    return spark.createDataFrame([(c, s, 0, 0) for c, s in rows], f"{CH} string, Decomposition string, Glyph int, SubIndex int")


@query("SELECT * FROM " + values(("他", "亻", "⿰", 0, 3), ("休", "亻", "⿰", 0, 4), ("休", "木", "⿰", 1, 2), ("鸺", "鸟", "⿰", 1, 6), ("鸺", "亻", "⿰", 0, 9), ("鸺", "木", "⿻", 0, 7), ("林", "木", "⿰", 0, 4), ("林", "木", "⿰", 1, 4), ("森", "木", "⿱", 0, 8), ("森", "木", "⿻", 0, 8)) + " t(character, form, layout, position, residual)")
def der16_radical_residuals(spark, d):
    forms = spark.createDataFrame([("亻", 9), ("木", 75), ("鸟", 196)], "Form string, RadicalIndex int")
    counts = spark.createDataFrame([("亻", 0, 2), ("也", 0, 3), ("木", 0, 4), ("鸟", 0, 5), ("休", 0, 6), ("林", 0, 8)], f"{CH} string, Glyph int, StrokeCount int")
    out = radicals.radical_residuals(_decompositions(spark), forms, counts)
    return out.select(F.col(CH).alias("character"), F.col("RadicalForm").alias("form"), F.col("MainCharacterLayout").alias("layout"), F.col("RadicalRelativePosition").alias("position"), F.col("ResidualStrokeCount").alias("residual"))


@query("SELECT * FROM " + values(("木", "H-S-P-N"), ("囗", "S-HZ-H"), ("口", "S-HZ-H"), ("凵", "SZ-S"), ("乂", "P-N"), ("林", "H-S-P-N H-S-P-N"), ("森", "H-S-P-N H-S-P-N H-S-P-N"), ("回", "S-HZ S-HZ-H H"), ("凶", "P-N SZ-S")) + " t(character, strokes)")
def trv02_stroke_orders(spark, d):
    own = spark.createDataFrame([("木", "H-S-P-N", 0), ("囗", "S-HZ-H", 0), ("口", "S-HZ-H", 0), ("凵", "SZ-S", 0), ("乂", "P-N", 0)], f"{CH} string, StrokeOrder string, Glyph int")
    return ch.synthesise_stroke_orders(own, _decompositions(spark)).select(F.col(CH).alias("character"), F.col("StrokeOrder").alias("strokes"))


@query("SELECT * FROM " + values(("鸺", "休"), ("鸺", "亻"), ("鸺", "木"), ("鸺", "鸟"), ("休", "亻"), ("休", "木"), ("森", "木"), ("森", "林"), ("林", "木"), ("他", "亻"), ("他", "也"), ("回", "囗"), ("回", "口"), ("凶", "凵"), ("凶", "乂")) + " t(character, component)")
def trv03_component_closure(spark, d):
    return derive.component_lookup(_decompositions(spark)).select(F.col(CH).alias("character"), F.col("Component").alias("component"))


@query("SELECT * FROM " + values(("乂",), ("也",), ("亻",), ("凵",), ("口",), ("囗",), ("木",), ("鸟",)) + " t(component)")
def trv04_basic_components(spark, d):
    rows = _decompositions(spark)
    return ch.basic_components(rows, rows.select(CH)).select(F.col("Component").alias("component"))


# the other modules of queries register themselves
from . import lookup_queries, reading_queries, table_queries  # noqa: E402, F401
