"""Queries of sources, sinks, derivations, filters, orders, sets and column functions.

Sources read files that are written from the driver's tables to the shared folder first, so what they parse grows with these.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import dates, ids, text
from .lookup_queries import TABLES, asked, lookup, made_table
from .operators import characters as ch
from .operators import dictionary as dic
from .operators import reports
from .plans import derive, radicals, sinks
from .plans.catalog import Catalog, assert_unique
from .plans.rounds import shared_folder
from .registry import CH, made, query, table, values
from .sources import dictionaries, exchange, files, seeds, unihan


def _lines(rows: DataFrame, name: str = "lines") -> str:
    """A folder of text files with the rows of the one column."""
    folder = f"{shared_folder(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"
    rows.write.text(folder)
    return folder


def _seed(spark: SparkSession, name: str, rows: DataFrame) -> str:
    """A folder with a seed file of the lines, as files are shipped: comments on top."""
    folder = f"{shared_folder(spark)}/seed-{uuid.uuid4().hex}"
    spark.createDataFrame([("# a comment",)], "value string").unionAll(rows).coalesce(1).write.text(f"{folder}/{seeds.SPECS[name].file}")
    return folder


# ---------------------------------------------------------------- sources


@query("SELECT chr((19968 + p_partkey)::INTEGER) AS character, p_size % 3 AS glyph, 'H-' || p_size AS strokes FROM part")
def src03_seed_table(spark, d):
    """A seed file in single quotes, with comments, columns by position, and keys that are checked."""
    lines = made(spark, d, "SELECT '''' || ⟦19968 + p_partkey⟧ || ''',''H-' || p_size || ''',' || p_size % 3 || ',''x''' AS value FROM {part}")
    rows = seeds.read_seed(spark, _seed(spark, "StrokeOrder", lines), "StrokeOrder")
    return rows.select(F.col(CH).alias("character"), F.col("Glyph").alias("glyph"), F.col("StrokeOrder").alias("strokes"))


@query("SELECT p_partkey AS place, chr((19968 + p_partkey)::INTEGER) AS character FROM part")
def src04_sniffed_quotes(spark, d):
    """The same in double quotes: the quoting is found in the first line of data."""
    lines = made(spark, d, "SELECT '\"' || ⟦19968 + p_partkey⟧ || '\",\"H\",' || p_partkey || ',\"\"' AS value FROM {part}")
    rows = seeds.read_seed(spark, _seed(spark, "StrokeOrder", lines), "StrokeOrder", check=False)
    return rows.select(F.col("Glyph").alias("place"), F.col(CH).alias("character"))


@query("SELECT chr((19968 + p_partkey)::INTEGER) AS character, '⿰' || chr((19968 + p_size)::INTEGER) || CASE WHEN p_partkey % 2 = 0 THEN '？' ELSE '口' END AS sequence FROM part")
def src06_basic_plane_only(spark, d):
    """Components beyond the basic plane become unknown."""
    lines = made(spark, d, "SELECT '\"' || ⟦19968 + p_partkey⟧ || '\",\"⿰' || ⟦19968 + p_size⟧ || CASE WHEN p_partkey % 2 = 0 THEN ⟦131072 + p_partkey⟧ ELSE '口' END || '\",0,0,\"\"' AS value FROM {part}")
    rows = seeds.read_seed(spark, _seed(spark, "CharacterDecomposition", lines), "CharacterDecomposition", bmp_only=True)
    return rows.select(F.col(CH).alias("character"), F.col("Decomposition").alias("sequence"))


_UNIHAN = """SELECT 'U+' || HEXOF || chr(9) || 'kTotalStrokes' || chr(9) || p_size AS value FROM {part} UNION ALL
SELECT 'U+' || HEXOF || chr(9) || 'kRSKangXi' || chr(9) || (1 + p_partkey % 214) || '.' || p_size FROM {part} WHERE p_partkey % 3 = 0 UNION ALL
SELECT 'U+' || HEXOF || chr(9) || 'kOther' || chr(9) || 'x ' || p_size FROM {part} WHERE p_partkey % 5 = 0 UNION ALL SELECT '# comment ' || p_size FROM {part}"""


def _unihan_lines(spark, d) -> str:
    return _lines(made(spark, d, _UNIHAN.replace("HEXOF", "hex(19968 + p_partkey)")), "unihan")


@query("""SELECT chr((19968 + p_partkey)::INTEGER) AS character, 'kTotalStrokes' AS key, p_size::VARCHAR AS value FROM part UNION ALL
SELECT chr((19968 + p_partkey)::INTEGER), 'kRSKangXi', (1 + p_partkey % 214) || '.' || p_size FROM part WHERE p_partkey % 3 = 0 UNION ALL
SELECT chr((19968 + p_partkey)::INTEGER), 'kOther', 'x ' || p_size FROM part WHERE p_partkey % 5 = 0""")
def src09_unihan_facts(spark, d):
    return unihan.read_unihan_facts(spark, _unihan_lines(spark, d)).toDF("character", "key", "value")


@query("SELECT chr((19968 + p_partkey)::INTEGER) AS character, p_size AS strokes, CASE WHEN p_partkey % 3 = 0 THEN (1 + p_partkey % 214) || '.' || p_size END AS radical FROM part")
def src08_unihan_wide(spark, d):
    wide = unihan.read_unihan(spark, _unihan_lines(spark, d), ["kTotalStrokes", "kRSKangXi"])
    return wide.select(F.col(CH).alias("character"), F.col("kTotalStrokes").alias("strokes"), F.col("kRSKangXi").alias("radical"))


@query("SELECT chr((19968 + s_suppkey)::INTEGER) AS character, 1 + s_suppkey % 214 AS radical, 'ON' || s_suppkey || ',ON2' AS readings, 'name ' || s_name || '/other' AS meaning, CASE WHEN s_suppkey % 2 = 0 THEN 'nom' END AS french FROM supplier")
def src10_character_xml(spark, d):
    xml = """SELECT '<character><literal>' || ⟦19968 + s_suppkey⟧ || '</literal><radical><rad_value rad_type="classical">9</rad_value><rad_value rad_type="nelson_c">' || (1 + s_suppkey % 214) ||
    '</rad_value></radical><reading_meaning><rmgroup><reading r_type="ja_on">ON' || s_suppkey || '</reading><reading r_type="ja_kun">k</reading><reading r_type="ja_on">ON2</reading><meaning>name ' || s_name ||
    '</meaning><meaning>other</meaning>' || CASE WHEN s_suppkey % 2 = 0 THEN '<meaning m_lang="fr">nom</meaning>' ELSE '' END || '</rmgroup></reading_meaning></character>' AS value FROM {supplier}"""
    tag = lambda x: spark.createDataFrame([(x,)], "value string")
    rows = unihan.read_kanjidic(spark, _lines(tag("<kanjidic2>").unionAll(made(spark, d, xml)).unionAll(tag("</kanjidic2>")).coalesce(1), "xml"))
    return rows.select(F.col(CH).alias("character"), F.col("NelsonCRadical").alias("radical"), F.col("CharacterJapaneseOn").alias("readings"), F.col("Meaning_en").alias("meaning"), F.col("Meaning_fr").alias("french"))


@query("SELECT name, (p_partkey - CASE WHEN name = 'EDICT' THEN 1 ELSE 0 END)::BIGINT AS entries FROM (SELECT max(p_partkey) + 1 AS p_partkey FROM part), (SELECT unnest(['EDICT', 'CEDICT', 'CEDICTGR', 'HanDeDict', 'CFDICT']) AS name)")
def src13_dictionary_formats(spark, d):
    """Each dictionary's file in its own encoding and form; EDICT's first line is skipped."""
    out = None
    for name, spec in dictionaries.FORMATS.items():
        head = "'w' || p_partkey || ' s' || p_size || ' [r]'" if spec.four else "'w' || p_partkey || ' [r]'"
        folder = f"{shared_folder(spark)}/dictionary-{uuid.uuid4().hex}"
        lines = made(spark, d, f"SELECT {head} || ' /' || p_name || '/' AS value FROM {{part}}").coalesce(1)
        lines.write.option("encoding", "utf-8").text(folder)
        path = files.find_file(spark, "part-*.txt", [folder])
        rows = dictionaries.read_dictionary(spark, path, spec).agg(F.lit(name).alias("name"), F.count("*").alias("entries"))
        out = rows if out is None else out.unionAll(rows)
    return out


@query("SELECT o_orderkey, o_orderstatus AS status, o_orderpriority AS priority FROM orders")
def src14_archive(spark, d):
    """Lines of packed bytes are those of the file inside."""
    import gzip

    @F.pandas_udf("binary")
    def packed(s: pd.Series) -> pd.Series:
        return s.map(lambda x: gzip.compress(x.encode("big5hkscs")))

    @F.pandas_udf("string")
    def opened(s: pd.Series) -> pd.Series:
        return s.map(lambda x: dictionaries.unpack(bytes(x)).decode("big5hkscs"))

    rows = table(spark, d, "orders").select("o_orderkey", opened(packed(F.concat_ws("|", "o_orderstatus", "o_orderpriority"))).alias("s"))
    return rows.select("o_orderkey", F.get(F.split("s", r"\|"), 0).alias("status"), F.get(F.split("s", r"\|"), 1).alias("priority"))


@query("SELECT 'handedict-' || max(20100000 + s_suppkey) || '.txt' AS newest FROM supplier")
def src15_newest_file(spark, d):
    """A file for each release, written by all executors: Spark's writer makes a folder for each name, and takes tens of milliseconds for one."""
    folder = f"{shared_folder(spark)}/releases-{uuid.uuid4().hex}"

    def stored(batches):
        from pyarrow.fs import FileSystem

        store, path = FileSystem.from_uri(folder)
        store.create_dir(path)
        for batch in batches:
            for name in batch["name"]:
                with store.open_output_stream(f"{path}/{name}") as out:
                    out.write(b"x\n")
            yield batch

    names = table(spark, d, "supplier").select(F.concat(F.lit("handedict-"), (F.lit(20100000) + F.col("s_suppkey")).cast("string"), F.lit(".txt")).alias("name"))
    names.repartition(spark.sparkContext.defaultParallelism).mapInPandas(stored, "name string").write.format("noop").mode("overwrite").save()
    newest = dictionaries.newest_file(spark, folder)
    return spark.createDataFrame([(newest.rpartition("/")[2],)], "newest string")


@query("SELECT p_name AS traditional, p_name AS simplified, p_type AS reading, '/' || p_brand || '/' || p_size || '/' AS translation FROM part")
def src16_record_file(spark, d):
    """Records between lines of ***, with numbered fields."""
    blocks = made(spark, d, "SELECT concat('***', chr(10), '10char   ', p_name, chr(10), '20pinyin ', p_type, chr(10), '30df1 ', p_brand, chr(10), '31df2 ', p_size) AS value FROM {part}")
    return dictionaries.wenlin_entries(dictionaries.parse_records(spark, _lines(blocks, "records"))).toDF("traditional", "simplified", "reading", "translation")


@query("SELECT '〇' AS character, 'ling2' AS reading UNION SELECT chr((19968 + p_partkey)::INTEGER), 'ma' || (p_partkey % 4) FROM part")
def src17_inline_constants(spark, d):
    stored = made(spark, d, "SELECT ⟦19968 + p_partkey⟧ AS ChineseCharacter, 'ma' || (p_partkey % 4) AS Reading FROM {part}")
    return derive.union_distinct(stored, exchange.additional_readings(spark)).toDF("character", "reading")


@query("SELECT n_nationkey, 'http://x/' || n_name || '.zip' AS link, n_nationkey || '.01.2011' AS written FROM nation")
def src18_release_on_a_page(spark, d):
    release = files.Release(r'href="([^"]+\.zip)"', "page", r"Stand: ([0-9.]+)")
    pages = table(spark, d, "nation").select("n_nationkey", "n_name").collect()  # 25 nations
    found = [(r.n_nationkey, *release.on(f'<a href="http://x/{r.n_name}.zip">x</a> Stand: {r.n_nationkey}.01.2011 (neu)')) for r in pages]
    return spark.createDataFrame(found, "n_nationkey int, link string, written string")


@query("SELECT 'Nations' AS name, count(*) AS n FROM nation UNION ALL SELECT 'Regions', count(*) FROM region")
def src19_namespaces(spark, d):
    """Tables of configured folders; of two of one name the first folder's counts."""
    first, second = (f"{shared_folder(spark)}/ns-{uuid.uuid4().hex}" for _ in range(2))
    sinks.write_table(table(spark, d, "nation"), first, "Nations")
    sinks.write_table(table(spark, d, "nation").limit(0), second, "Nations")
    sinks.write_table(table(spark, d, "region"), second, "Regions")
    found = Catalog(*files.configured(spark, f"[Tables]\nfolder = {first} {second}"))
    return found["Nations"].agg(F.lit("Nations").alias("name"), F.count("*").alias("n")).unionAll(found["Regions"].agg(F.lit("Regions"), F.count("*")))


@query("SELECT min(r_name) AS first, count(*)::BIGINT AS n FROM region")
def src20_single_rows(spark, d):
    names = table(spark, d, "region").select("r_name").orderBy("r_name")
    return spark.createDataFrame([(files.first_value(names), len(list(files.iterate_values(names))))], "first string, n long")


@query("SELECT p_partkey::VARCHAR AS number, p_name AS name, p_brand AS brand FROM part WHERE p_partkey % 4 <> 0")
def src21_wiki_rows(spark, d):
    lines = made(spark, d, "SELECT p_partkey || ' ; \"' || p_name || '\"' || CASE WHEN p_partkey % 4 = 0 THEN '' ELSE ';' || p_brand END AS value FROM {part}")
    return exchange.wiki_rows(lines, ["number", "name", "brand"])


@query("SELECT 'part ' || p_partkey AS title, '<page><title>part ' || p_partkey || '</title><revision><text>{{Part' || chr(10) || '|p_name=' || p_name || CASE WHEN p_partkey % 2 = 0 THEN chr(10) || '|note=a &lt; b' ELSE '' END || chr(10) || '}}</text></revision></page>' AS page FROM part")
def src21_wiki_pages(spark, d):
    rows = made(spark, d, "SELECT p_name, CASE WHEN p_partkey % 2 = 0 THEN 'a < b' END AS note, p_partkey FROM {part}")
    title = F.concat(F.lit("part "), F.col("p_partkey").cast("string"))
    return exchange.wiki_pages(rows.select("p_name", "note", title.alias("t")), F.col("t"), "Part").select("title", F.regexp_replace("page", r"\n\|t=part \d+", "").alias("page"))


@query("""SELECT c AS character, 0 AS place, '⿰木' || chr((19968 + p_size)::INTEGER) AS sequence FROM (SELECT chr((20000 + p_partkey)::INTEGER) AS c, p_size, p_partkey FROM part) WHERE p_partkey % 3 <> 2
UNION ALL SELECT chr((20000 + p_partkey)::INTEGER), 0, '⿱木口' FROM part WHERE p_partkey % 3 = 2""")
def src22_sequence_corpora(spark, d):
    """Lines of a corpus: sequences that others say in more detail, damaged ones and pseudo characters go."""
    lines = made(spark, d, """SELECT 'U+' || p_partkey || chr(9) || ⟦20000 + p_partkey⟧ || chr(9) || CASE WHEN p_partkey % 3 = 2 THEN '⿱木口' ELSE '⿰木' || ⟦19968 + p_size⟧ END AS value FROM {part}
    UNION ALL SELECT 'U+' || p_partkey || chr(9) || ⟦20000 + p_partkey⟧ || chr(9) || CASE WHEN p_partkey % 3 = 2 THEN '⿱木&CDP-8C4D;' ELSE '⿰#3' || ⟦19968 + p_size⟧ END FROM {part}
    UNION ALL SELECT 'U+' || p_partkey || chr(9) || ⟦20000 + p_partkey⟧ || chr(9) || '⿰木' FROM {part} UNION ALL SELECT ';; comment' FROM {part}""")
    rows = exchange.merge_similar(exchange.usable_sequences(exchange.sequence_lines(lines)))
    return rows.select(F.col(CH).alias("character"), F.col("SubIndex").alias("place"), F.col("Decomposition").alias("sequence"))


@query("SELECT p_partkey, p_size FROM part WHERE p_partkey % 2 = 0")
def src01_search_path(spark, d):
    """A file of a name is that of the first folder that has it."""
    empty, first, second = (f"{shared_folder(spark)}/path-{uuid.uuid4().hex}" for _ in range(3))
    sinks.write_table(table(spark, d, "region"), empty, "Other")
    sinks.write_table(table(spark, d, "part").where("p_partkey % 2 = 0").select("p_partkey", "p_size"), first, "Seeds")
    sinks.write_table(table(spark, d, "part").select("p_partkey", "p_size"), second, "Seeds")
    return spark.read.parquet(files.find_file(spark, ["Missing.parquet", "Seeds.parquet"], [empty, first, second]))


@query("SELECT c_nationkey AS k, count(*) AS customers, sum(n)::BIGINT AS orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey GROUP BY 1")
def src02_builders(spark, d):
    """Tables made by builders from tables that other builders make, in the order of their needs."""
    build = derive.Build([
        derive.Builder("ByNation", ("WithOrders",), lambda t: t.groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("customers"), F.sum("n").alias("orders"))),
        derive.Builder("WithOrders", ("Customers", "Orders"), lambda c, o: c.join(o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n")), "c_custkey", "left")),
    ], {"all": ("ByNation",)})
    catalog = Catalog({"Customers": table(spark, d, "customer"), "Orders": table(spark, d, "orders")})
    build.run(catalog, ["all"])
    return catalog["ByNation"]


@query("SELECT * FROM " + values(("ByNation", 1), ("WithOrders", 0), ("Reports", 2)) + " t(name, place)")
def der20_build_groups(spark, d):
    builders = [derive.Builder("Reports", ("ByNation", "WithOrders"), lambda *t: t[0]), derive.Builder("ByNation", ("WithOrders",), lambda t: t), derive.Builder("WithOrders", ("Customers",), lambda t: t)]
    order = derive.Build(builders, {"small": ("ByNation",), "all": ("small", "Reports")}).order(["all"], ["Customers"])
    return spark.createDataFrame([(n, i) for i, n in enumerate(order)], "name string, place int")


# ---------------------------------------------------------------- sinks


@query("SELECT l_orderkey, l_linenumber, l_quantity::INT AS quantity FROM lineitem")
def snk01_table_with_types_and_keys(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("quantity"))
    return sinks.write_table(rows, f"{shared_folder(spark)}/snk-{uuid.uuid4().hex}", "Lines", types={"quantity": "int"})


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey BETWEEN 10 AND 20")
def snk02_sorted_files(spark, d):
    """Rows sorted by a column inside of files, so that a range of it reads few row groups."""
    rows = sinks.write_table(table(spark, d, "orders").select("o_orderkey", "o_custkey"), f"{shared_folder(spark)}/snk-{uuid.uuid4().hex}", "Orders", ["o_orderkey"], ["o_custkey", "o_orderkey"])
    return rows.where("o_custkey between 10 and 20")


@query("SELECT * FROM " + values(("Nations", 1, 0), ("Missing", 0, 0)) + " t(name, dropped, there)")
def snk04_dropped_table(spark, d):
    folder = f"{shared_folder(spark)}/snk-{uuid.uuid4().hex}"
    sinks.write_table(table(spark, d, "nation"), folder, "Nations")
    return spark.createDataFrame([(n, int(sinks.drop_table(spark, folder, n)), int(sinks.exists(spark, folder, n))) for n in ("Nations", "Missing")], "name string, dropped int, there int")


@query("SELECT c_custkey, c_mktsegment AS segment, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE 'old' END AS release FROM customer")
def snk05_upserted_versions(spark, d):
    old = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"), F.lit("old").alias("release"))
    return reports.upsert(old, old.where("c_custkey % 3 = 0").withColumn("release", F.lit("new")), ["c_custkey"])


@query("SELECT count(*)::BIGINT AS orders, sum(o_custkey)::BIGINT AS customers, 1 AS files FROM orders")
def snk06_compacted_table(spark, d):
    folder = f"{shared_folder(spark)}/snk-{uuid.uuid4().hex}"
    sinks.write_table(table(spark, d, "orders").select("o_custkey").repartition(7), folder, "Orders")
    n = sinks.compact(spark, folder, "Orders", 10_000_000)
    return spark.read.parquet(f"{folder}/Orders.parquet").agg(F.count("*").alias("orders"), F.sum("o_custkey").alias("customers")).withColumn("files", F.lit(n))


@query("SELECT * FROM " + values((1, 1), (2, 0), (3, 1)) + " t(turn, installed)")
def cli09_installed_once(spark, d):
    """A release is installed once; the same one not again, a newer one in its place."""
    import datetime

    folder = f"{shared_folder(spark)}/installed-{uuid.uuid4().hex}"
    days = [datetime.datetime(2011, 1, 1), datetime.datetime(2011, 1, 1), datetime.datetime(2012, 1, 1)]
    return spark.createDataFrame([(i + 1, int(sinks.install(table(spark, d, "nation"), folder, "CEDICT", day))) for i, day in enumerate(days)], "turn int, installed int")


# ---------------------------------------------------------------- derivations

_WIDE = """SELECT ⟦19968 + p_partkey⟧ AS ChineseCharacter, CASE WHEN p_partkey % 4 <> 0 THEN p_size END AS kTotalStrokes, CASE WHEN p_partkey % 3 = 0 THEN 'x' END AS kIICore, CASE WHEN p_partkey % 2 = 0 THEN 'x' END AS kGB0,
CASE WHEN p_partkey % 5 = 0 THEN 'x' END AS kJis0, CASE WHEN p_partkey % 7 = 0 THEN 'x' END AS kJIS0213, CASE WHEN p_partkey % 3 <> 0 THEN (1 + p_size) || '.' || p_partkey % 20 END AS kRSKangXi FROM {part}"""


@query("SELECT chr((19968 + p_partkey)::INTEGER) AS character, p_size AS strokes FROM part WHERE p_partkey % 4 <> 0")
def der02_stroke_counts(spark, d):
    return derive.stroke_counts_from(made(spark, d, _WIDE)).toDF("character", "strokes")


@query("""SELECT 'IICore' AS name, chr((19968 + p_partkey)::INTEGER) AS character FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT 'GB2312', chr((19968 + p_partkey)::INTEGER) FROM part WHERE p_partkey % 2 = 0
UNION ALL SELECT 'JISX0208_0213', chr((19968 + p_partkey)::INTEGER) FROM part WHERE p_partkey % 5 = 0 OR p_partkey % 7 = 0""")
def der05_character_sets(spark, d):
    wide = made(spark, d, _WIDE)
    one = lambda name: derive.character_set(wide, name).select(F.lit(name).alias("name"), F.col(CH).alias("character"))
    return one("IICore").unionAll(one("GB2312")).unionAll(one("JISX0208_0213"))


@query("SELECT DISTINCT chr((19968 + p_partkey % 1000)::INTEGER) AS character, 'ma' || (p_size % 4 + 1) AS reading FROM part UNION SELECT chr((19968 + s_suppkey)::INTEGER), 'shu1' FROM supplier UNION SELECT chr((19968 + n_nationkey)::INTEGER), 'dao4' FROM nation UNION SELECT '〇', 'ling2'")
def der11_union_of_four_sources(spark, d):
    one = lambda sql: made(spark, d, sql)
    rows = derive.union_distinct(
        one("SELECT ⟦19968 + p_partkey % 1000⟧ AS ChineseCharacter, 'ma' || (p_size % 4 + 1) AS Reading FROM {part}"), one("SELECT ⟦19968 + s_suppkey⟧ AS ChineseCharacter, 'shu1' AS Reading FROM {supplier}"),
        one("SELECT ⟦19968 + n_nationkey⟧ AS ChineseCharacter, 'dao4' AS Reading FROM {nation}"), exchange.additional_readings(spark),
    )
    return rows.toDF("character", "reading")


@lookup("""SELECT a.c AS character, 0 AS glyph, CASE WHEN a.p % 7 = 0 THEN '⿶' WHEN a.p % 2 = 0 THEN '⿰' ELSE '⿱' END || x.c || CASE WHEN x.p % 3 = 0 THEN '[2]' ELSE '' END || y.c || CASE WHEN y.p % 3 = 0 THEN '[2]' ELSE '' END AS sequence
FROM Heap a JOIN Heap x ON x.p = 2 * a.p JOIN Heap y ON y.p = 2 * a.p + 1""")
def der22_locale_decompositions(look, spark, d):
    """Components whose glyph differs in the locale get that glyph."""
    heap = made(spark, d, TABLES["Heap"])
    defaults = heap.select(F.col("c").alias(CH), F.lit(0).alias("Glyph"))
    mine = heap.select(F.col("c").alias(CH), F.when(F.col("p") % 3 == 0, 2).otherwise(0).alias("Glyph"))
    rows = radicals.locale_decompositions(look.catalog["CharacterDecomposition"], defaults, mine)
    return rows.select(F.col(CH).alias("character"), F.col("Glyph").alias("glyph"), F.col("Decomposition").alias("sequence"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 4 THEN NULL ELSE 'x' || (s_suppkey % 5) || CASE WHEN s_suppkey % 3 = 0 AND s_suppkey % 5 = 0 THEN 'Y' ELSE 'y' || (s_suppkey % 3) END END AS target FROM supplier")
def der23_syllable_mapping(spark, d):
    """Initials and finals by rules; one final's rule depends on the initial."""
    parts = made(spark, d, "SELECT s_suppkey AS syllable, 'i' || (s_suppkey % 5) AS initial, 'f' || (s_suppkey % 3) AS final FROM {supplier}")
    initials = spark.createDataFrame([(f"i{i}", f"x{i}", None) for i in range(4)], "initial string, target string, before string")
    finals = spark.createDataFrame([("f0", "Y", "i0"), ("f0", "y0", "i[1-4]"), ("f1", "y1", None), ("f2", "y2", None)], "final string, target string, before string")
    return radicals.syllable_mapping(parts, initials, finals).toDF("s_suppkey", "target")


@query("SELECT c_custkey AS k, CASE WHEN min(o_totalprice) IS NULL THEN -1 ELSE count(*) END::BIGINT AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def agg06_count_or_fallback(spark, d):
    keys = table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    counts = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"))
    return derive.priority_fallback(keys, ["k"], "n", counts, keys.select("k", F.lit(-1).cast("long").alias("n")))


# ---------------------------------------------------------------- filters, orders, sets, aggregates


@lookup("SELECT ChineseCharacter AS character, Glyph AS glyph, StrokeCount AS strokes FROM StrokeCount WHERE Glyph = 2 AND StrokeCount <> 0 AND ChineseCharacter IN (SELECT ChineseCharacter FROM Asked)")
def flt01_equal_keys(look, spark, d):
    return look.stroke_counts(asked(spark, d).withColumn("Glyph", F.lit(2))).toDF("character", "glyph", "strokes")


@lookup("SELECT g.ChineseCharacter AS character, g.Glyph AS glyph FROM Glyphs g LEFT JOIN LocaleCharacterGlyph l ON l.ChineseCharacter = g.ChineseCharacter AND l.Glyph = g.Glyph WHERE l.Locale IS NULL OR l.Locale LIKE '%V%' GROUP BY 1, 2", locale="V")
def flt03_null_or_locale(look, spark, d):
    return look.glyphs_of_locale(look.catalog["Glyphs"]).select(F.col(CH).alias("character"), F.col("Glyph").alias("glyph"))


@lookup("SELECT DISTINCT RadicalIndex AS radical, ChineseCharacter AS character FROM CharacterKangxiRadical WHERE RadicalIndex IN (3, 5, 7, 11, 13)")
def flt04_in_list(look, spark, d):
    return look.characters_for_radical(spark.createDataFrame([(i,) for i in (3, 5, 7, 11, 13)], "RadicalIndex int")).toDF("radical", "character")


@lookup("WITH RECURSIVE b(top, p) AS (SELECT p, p FROM Heap UNION ALL SELECT b.top, h.p FROM b JOIN Heap h ON h.p IN (2 * b.p, 2 * b.p + 1) JOIN Heap w ON w.p = 2 * b.p + 1) SELECT DISTINCT t.c AS character FROM b JOIN Heap t ON t.p = b.top WHERE b.p IN (33, 77) AND b.top <> b.p")
def flt05_either_component(look, spark, d):
    rows = look.characters_for_components([[chr(19968 + 33), chr(19968 + 77)]], all_glyphs=True, expand=False)
    return rows.join(look.catalog["ComponentLookup"].where(F.col("Component").isin(chr(19968 + 33), chr(19968 + 77))), [CH, "Glyph"], "left_semi").select(F.col(CH).alias("character"))


@query("SELECT chr((19968 + p_partkey)::INTEGER) AS character, 'x' AS value FROM part WHERE p_partkey % 2 = 0")
def flt06_not_null(spark, d):
    return derive.column_values(made(spark, d, _WIDE), "kGB0").toDF("character", "value")


@query("SELECT k, k BETWEEN 11904 AND 12245 AS radical FROM (SELECT (11800 + o_orderkey % 600)::BIGINT AS k FROM orders)")
def flt09_radical_block(spark, d):
    rows = table(spark, d, "orders").select((F.lit(11800) + F.col("o_orderkey") % 600).cast("long").alias("k"))
    return rows.select("k", text.is_radical_form(text.char_of("k")).alias("radical"))


@query("""SELECT k, k BETWEEN 12353 AND 12438 OR k BETWEEN 12445 AND 12447 AS hiragana, k BETWEEN 12449 AND 12538 OR k BETWEEN 12540 AND 12543 OR k BETWEEN 12784 AND 12799 OR k BETWEEN 65382 AND 65439 AS katakana,
k BETWEEN 10240 AND 10495 AS braille FROM (SELECT (CASE WHEN o_orderkey % 3 = 0 THEN 65300 ELSE 10200 END + o_orderkey % 2700)::BIGINT AS k FROM orders WHERE NOT (o_orderkey % 3 = 0 AND 65300 + o_orderkey % 2700 > 65500))""")
def flt10_scripts(spark, d):
    k = (F.when(F.col("o_orderkey") % 3 == 0, 65300).otherwise(10200) + F.col("o_orderkey") % 2700).cast("long")
    rows = table(spark, d, "orders").select(k.alias("k")).where("k <= 65500").withColumn("c", text.char_of("k"))
    return rows.select("k", text.in_script("c", "Hiragana").alias("hiragana"), text.in_script("c", "Katakana").alias("katakana"), text.in_script("c", "Braille").alias("braille"))


@query("SELECT p_partkey FROM part WHERE p_name LIKE 'blue%' OR p_brand = 'Brand#3' OR lower(p_type) = 'small'")
def flt11_any_of_conditions(spark, d):
    rows = table(spark, d, "part")
    found = dic.Dictionary(rows, ("p_name", "p_brand"), "p_type", "p_type", headword_search=dic.Wildcard(), reading_search=dic.Exact(True), translation_search=dic.Exact(True))
    condition = found.headword_condition("blue%") | found.headword_condition("Brand#3") | found.reading_condition("Small")
    return rows.where(condition).select("p_partkey")


@query("SELECT name, CASE WHEN name = 'Small' THEN 1 ELSE 0 END AS valid FROM " + values(("Small",), ("Wrong",), ("None",)) + " t(name)")
def flt12_valid_domains(spark, d):
    catalog = Catalog({"SmallSet": made_table(spark, d, "SmallSet"), "WrongSet": table(spark, d, "region")})

    def valid(name: str) -> int:
        try:
            return int(catalog.domain(name) is not None)
        except ValueError:
            return 0

    return spark.createDataFrame([(n, valid(n)) for n in ("Small", "Wrong", "None")], "name string, valid int")


@lookup("SELECT ChineseCharacter AS character, Variant AS variant FROM CharacterVariant WHERE Type = 'T' AND ChineseCharacter IN (SELECT ChineseCharacter FROM SmallSet)")
def srt01_sorted(look, spark, d):
    """Sorted as the lookup says, since it is asked to."""
    look.ordered = True
    return look.variants(made_table(spark, d, "SmallSet"), "T").select(F.col(CH).alias("character"), F.col("Variant").alias("variant"))


_FIVE = "ResidualStrokeCount, RadicalGlyph, RadicalForm, MainCharacterLayout, RadicalRelativePosition"


@lookup(f"SELECT ChineseCharacter AS character, Glyph AS glyph, RadicalIndex AS radical, ResidualStrokeCount AS residual FROM (SELECT *, row_number() OVER (PARTITION BY ChineseCharacter, Glyph, RadicalIndex ORDER BY {_FIVE}) AS n FROM CharacterRadicalResidualStrokeCount) WHERE n = 1")
def srt02_first_by_five_columns(look, spark, d):
    return derive.residual_stroke_counts(look.catalog["CharacterRadicalResidualStrokeCount"]).toDF("character", "glyph", "radical", "residual")


@query("SELECT user_id, string_agg(event_type, ' ' ORDER BY event_id) AS kept FROM events WHERE event_type IN ('click', 'view') GROUP BY 1")
def srt05_order_preserving_filter(spark, d):
    """Of each user's list of events those of a domain, in the list's order and as often as they come."""
    lists = table(spark, d, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x["event_type"]).alias("list"))
    placed = lists.select("user_id", F.posexplode("list").alias("place", CH))
    catalog = Catalog({"KindSet": spark.createDataFrame([("click",), ("view",)], f"{CH} string")})
    kept = ch.CharacterLookup(catalog, domain="Kind").filter_domain(placed)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("place", CH))), lambda x: x[CH])
    return kept.groupBy("user_id").agg(F.array_join(ordered, " ").alias("kept"))


@query("SELECT user_id, string_agg(event_type, ' ' ORDER BY first) AS kinds FROM (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY 1, 2) GROUP BY 1")
def srt06_order_preserving_distinct(spark, d):
    lists = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x["event_type"])
    return table(spark, d, "events").groupBy("user_id").agg(F.array_join(F.array_distinct(lists), " ").alias("kinds"))


@lookup("SELECT Form AS form, min_by(EquivalentForm, seed_row_id) AS first FROM RadicalEquivalentCharacter WHERE Locale LIKE '%T%' GROUP BY 1")
def srt07_first_physical_row(look, spark, d):
    return look.equivalent_of_form(look.catalog["RadicalEquivalentCharacter"].select("Form")).toDF("form", "first")


@query("SELECT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer WHERE c_nationkey < 5")
def set01_union_of_two(spark, d):
    return derive.union_distinct(table(spark, d, "orders").select(F.col("o_custkey").alias("k")), table(spark, d, "customer").where("c_nationkey < 5").select(F.col("c_custkey").alias("k")))


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier UNION SELECT n_nationkey + 10 FROM nation UNION SELECT r_regionkey + 100 FROM region")
def set03_union_of_four(spark, d):
    one = lambda t, e: table(spark, d, t).select(F.expr(e).cast("int").alias("k"))
    return derive.union_distinct(one("customer", "c_nationkey"), one("supplier", "s_nationkey"), one("nation", "n_nationkey + 10"), one("region", "r_regionkey + 100"))


@query("SELECT k, CASE WHEN a AND b THEN 'both' WHEN a THEN 'only_first' ELSE 'only_second' END AS status FROM (SELECT k, bool_or(s = 'a') AS a, bool_or(s = 'b') AS b FROM (SELECT o_custkey AS k, 'a' AS s FROM orders UNION ALL SELECT c_custkey, 'b' FROM customer WHERE c_custkey % 2 = 0) GROUP BY 1)")
def set05_differences(spark, d):
    return derive.table_difference(table(spark, d, "orders").select(F.col("o_custkey").alias("k")), table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k")), ["k"])


@lookup("SELECT ChineseCharacter AS character, string_agg(Glyph || '=' || StrokeCount, ' ' ORDER BY Glyph) AS counts FROM StrokeCount WHERE StrokeCount <> 0 GROUP BY 1")
def agg04_count_maps(look, spark, d):
    m = F.map_from_entries(F.array_sort(F.collect_list(F.struct("Glyph", "StrokeCount"))))
    rows = look.stroke_counts().groupBy(CH).agg(m.alias("m"))
    return rows.select(F.col(CH).alias("character"), F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat_ws("=", e["key"].cast("string"), e["value"].cast("string"))), " ").alias("counts"))


@query("SELECT DISTINCT chr((19968 + l_partkey % 2000)::INTEGER) AS character, l_linenumber AS glyph FROM lineitem")
def agg07_distinct_glyphs(spark, d):
    rows = made(spark, d, "SELECT ⟦19968 + l_partkey % 2000⟧ AS ChineseCharacter, l_linenumber AS Glyph FROM {lineitem}")
    return derive.glyphs(rows, rows.limit(0), made(spark, d, _WIDE).limit(0)).toDF("character", "glyph")


@lookup("""SELECT a.ChineseCharacter AS character, string_agg(DISTINCT a.StrokeCount, ' ' ORDER BY a.StrokeCount) AS own, any_value(u.n) AS unihan FROM StrokeCount a
JOIN (SELECT DISTINCT ⟦19968 + p_partkey⟧ AS c, p_size % 25 AS n FROM {part}) u ON u.c = a.ChineseCharacter GROUP BY 1 HAVING NOT bool_or(a.StrokeCount = u.n)""")
def agg09_stroke_count_mismatches(look, spark, d):
    other = made(spark, d, "SELECT ⟦19968 + p_partkey⟧ AS ChineseCharacter, p_size % 25 AS StrokeCount FROM {part}")
    rows = reports.stroke_count_mismatches(look.catalog["StrokeCount"], other)
    return rows.select(F.col(CH).alias("character"), F.array_join(F.col("own").cast("array<string>"), " ").alias("own"), "unihan")


@query("SELECT max(p_name) AS newest FROM part")
def agg11_greatest_text(spark, d):
    return table(spark, d, "part").agg(F.max("p_name").alias("newest"))


@query("SELECT user_id, min(CASE WHEN event_type = 'click' THEN props END) AS click, min(CASE WHEN event_type = 'view' THEN props END) AS view FROM events WHERE event_type IN ('click', 'view') GROUP BY 1")
def agg13_pivot_of_chosen_keys(spark, d):
    facts = table(spark, d, "events").select("user_id", F.col("event_type").alias("key"), F.col("props").alias("value"))
    return unihan.pivot_facts(facts, ("click", "view"), entity="user_id")


@query("SELECT initial, max(CASE WHEN final = 'f0' THEN syllable END) AS f0, max(CASE WHEN final = 'f1' THEN syllable END) AS f1 FROM (SELECT DISTINCT 'i' || (p_partkey % 50) AS initial, 'f' || (p_partkey % 50 % 3) AS final, 's' || (p_partkey % 50) AS syllable FROM part) WHERE final IN ('f0', 'f1') GROUP BY 1")
def agg12_syllable_tables(spark, d):
    parts = made(spark, d, "SELECT DISTINCT 'i' || (p_partkey % 50) AS initial, 'f' || (p_partkey % 50 % 3) AS final, 's' || (p_partkey % 50) AS syllable FROM {part}").where("final <> 'f2'")
    return reports.syllable_table(parts, ["f0", "f1"])


@query("SELECT DISTINCT 's' || (p_partkey % 50) AS syllable FROM part WHERE p_partkey % 50 % 3 = 2")
def agg12_not_in_table(spark, d):
    parts = made(spark, d, "SELECT DISTINCT 'i' || (p_partkey % 50) AS initial, 'f' || (p_partkey % 50 % 3) AS final, 's' || (p_partkey % 50) AS syllable FROM {part}")
    return reports.not_in_table(parts, ["f0", "f1"])


# ---------------------------------------------------------------- column functions


@query("SELECT p_partkey, length(p_name)::BIGINT AS n, p_name[1] AS first, p_name[-1] AS last FROM part")
def str02_character_lists(spark, d):
    c = text.characters("p_name")
    return table(spark, d, "part").select("p_partkey", F.size(c).cast("long").alias("n"), F.element_at(c, 1).alias("first"), F.element_at(c, -1).alias("last"))


@query("SELECT p_partkey, false AS surrogate FROM part")
def str03_surrogates(spark, d):
    """Characters of text are whole code points, so none is a surrogate."""
    return table(spark, d, "part").select("p_partkey", text.is_surrogate(text.char_of(F.lit(0x20000) + F.col("p_partkey"))).alias("surrogate"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN upper(p_brand) WHEN 1 THEN upper(left(p_brand, 1)) || lower(substr(p_brand, 2)) ELSE lower(p_brand) END AS moved FROM part")
def str05_case_transfer(spark, d):
    source = F.expr("CASE p_partkey % 3 WHEN 0 THEN 'ABC' WHEN 1 THEN 'Abc' ELSE 'abc' END")
    return table(spark, d, "part").select("p_partkey", text.transfer_case(source, F.lower("p_brand")).alias("moved"))


@query("SELECT p_partkey, p_partkey % 4 IN (0, 1) AS valid FROM part")
def str07_valid_sequences(spark, d):
    seq = F.expr("CASE p_partkey % 4 WHEN 0 THEN '⿰木⿱口口' WHEN 1 THEN '⿲木木木' WHEN 2 THEN '⿰木' ELSE '⿱木木木' END")
    return table(spark, d, "part").select("p_partkey", ids.is_valid(seq).alias("valid"))


@query(r"SELECT p_partkey FROM (SELECT p_partkey, p_name || CASE p_partkey % 3 WHEN 0 THEN '%' WHEN 1 THEN '_' ELSE '\' END AS s FROM part) WHERE contains(s, '%') OR contains(s, '\')")
def str09_like_escapes(spark, d):
    s = F.expr(r"p_name || CASE p_partkey % 3 WHEN 0 THEN '%' WHEN 1 THEN '_' ELSE '\\' END")
    rows = table(spark, d, "part").withColumn("s", s)
    return rows.where(F.col("s").like("%" + text.like_escape("%")) | F.col("s").like("%" + text.like_escape("\\"))).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE lower(p_name) = 'small ring' OR lower(p_name) = 'blue bolt'")
def str10_patterns(spark, d):
    pattern = dic.FLAGS[True] + "^(?:" + text.java_quote("SMALL ring") + "|" + text.java_quote("Blue BOLT") + ")$"
    return table(spark, d, "part").where(F.col("p_name").rlike(pattern)).select("p_partkey")


@query("SELECT p_partkey, nfc_normalize(p_name || 'e' || chr(769) || 'u' || chr(776)) AS composed, length(nfc_normalize(p_name || 'e' || chr(769)))::BIGINT AS n FROM part")
def str11_composed_forms(spark, d):
    rows = made(spark, d, "SELECT p_partkey, p_name || 'e' || ⟦769⟧ AS a, p_name || 'e' || ⟦769⟧ || 'u' || ⟦776⟧ AS b FROM {part}")
    return rows.select("p_partkey", text.nfc("b").alias("composed"), F.length(text.nfc("a")).cast("long").alias("n"))


@query("SELECT p_partkey, strip_accents(w) AS plain, (strpos('āáǎà', w[2]))::INT AS tone FROM (SELECT p_partkey, 'm' || substr('āáǎà', 1 + p_partkey % 4, 1) || 'ng' AS w FROM part)")
def str12_tone_marks(spark, d):
    w = F.expr("'m' || substr('āáǎà', 1 + p_partkey % 4, 1) || 'ng'")
    return table(spark, d, "part").select("p_partkey", text.strip_pinyin_tone(w).alias("plain"), text.pinyin_tone(w).cast("int").alias("tone"))


@query("SELECT n_nationkey, substr(n_name, i::INT, k::INT) AS part FROM nation, (SELECT unnest(range(1, 40)) AS i), (SELECT unnest(range(1, 40)) AS k) WHERE i + k - 1 <= length(n_name) GROUP BY 1, 2")
def str13_substrings(spark, d):
    return table(spark, d, "nation").select("n_nationkey", F.explode(text.substrings("n_name")).alias("part"))


@query("SELECT o_orderkey, printf('U+%04X', (8192 + o_orderkey)::INTEGER) AS formatted FROM orders")
def str14_formatted_codepoints(spark, d):
    return table(spark, d, "orders").select("o_orderkey", text.format_codepoint(text.char_of(F.lit(8192) + F.col("o_orderkey"))).alias("formatted"))


@query("SELECT p_partkey, (19968 + p_partkey)::BIGINT AS code, chr((19968 + p_partkey)::INTEGER) AS c FROM part")
def mth01_numbers_of_characters(spark, d):
    c = text.char_of(F.lit(19968) + F.col("p_partkey"))
    return table(spark, d, "part").select("p_partkey", text.codepoint(c).cast("long").alias("code"), c.alias("c"))


@query("SELECT p_partkey, chr((19968 + p_size)::INTEGER) || '木口' AS parts, 3::BIGINT AS n FROM part")
def arr01_components_in_order(spark, d):
    seq = made(spark, d, "SELECT p_partkey, '⿰' || ⟦19968 + p_size⟧ || '⿱木#4口？' AS s FROM {part}")
    parts = ids.components("s")
    return seq.select("p_partkey", F.array_join(F.transform(parts, lambda x: x["char"]), "").alias("parts"), F.size(parts).cast("long").alias("n"))


@lookup("SELECT o_orderkey, Stroke AS stroke FROM {orders} LEFT JOIN Strokes ON StrokeAbbrev = 'S' || (o_orderkey % 40)")
def map01_lookup_with_default(look, spark, d):
    rows = look.stroke_forms(made(spark, d, "SELECT o_orderkey, 'S' || (o_orderkey % 40) AS StrokeOrder FROM {orders}"))
    return rows.select("o_orderkey", F.element_at("Strokes", 1).alias("stroke"))


@query("SELECT o_orderkey, strftime(make_date(2000 + (o_orderkey % 20)::INT, 1 + (o_orderkey % 12)::INT, 1 + (o_orderkey % 28)::INT), '%Y-%m-%d') AS day, o_orderkey % 20 > 10 AS newer FROM orders")
def dat01_release_dates(spark, d):
    parts = "lpad(1 + o_orderkey % 28, 2, '0') || SEP || lpad(1 + o_orderkey % 12, 2, '0') || SEP || (2000 + o_orderkey % 20)"
    german, iso = parts.replace("SEP", "'.'"), "(2000 + o_orderkey % 20) || '-' || lpad(1 + o_orderkey % 12, 2, '0') || '-' || lpad(1 + o_orderkey % 28, 2, '0')"
    compact = iso.replace("'-'", "''")
    rows = table(spark, d, "orders").select("o_orderkey", F.expr(f"CASE o_orderkey % 3 WHEN 0 THEN {german} WHEN 1 THEN {iso} ELSE {compact} END").alias("written"))
    day = dates.release_date("written")
    return rows.select("o_orderkey", F.date_format(day, "yyyy-MM-dd").alias("day"), dates.is_newer(day, F.to_timestamp(F.lit("2010-12-31"))).alias("newer"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) = 1")
def src07_unique_keys(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n = 1")
    return assert_unique(rows.select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"])
