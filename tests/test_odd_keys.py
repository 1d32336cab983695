"""Queries over parts whose numbers give U+FEFF, halves of pairs and numbers beyond U+10FFFF, compared with their SQL.

DuckDB's chr() fails there; here it gives what text.char_of() gives, all else of the SQL is as registered.
"""

import re
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__

SMALL = "/root/testdata/sf0.001"
#: Numbers of the heap, p_partkey + 1: ways from the parts that are asked for down to such numbers.
HEAP = [1104, 2208, 2209, 4416, 4417, 8832, 8833, 17664, 17665, 35328, 35329, 70656, 70657, 22655, 45310, 45311, 547072, 1094144, 1094145]
CASES = [
    "lkp17_all_stroke_orders",
    "der22_locale_decompositions",
    "src03_seed_table",
    "agg09_stroke_count_mismatches",
    "der02_stroke_counts",
    "der04_variant_explode",
    "der05_character_sets",
    "der07_glyph_information",
    "flt06_not_null",
    "jon04_glyph_information",
    "jon08_component_stroke_sums",
    "jon06_forms_and_equivalents",
    "lkp26_variant_forms",
    "lkp26_radical_form",
    "lkp27_radical_index",
    "lkp28_representative_characters",
    "lkp29_is_radical_form",
    "flt05_either_component",
    "trv03_closure_of_heap",
    "src15_newest_file",
    "str14_formatted_codepoints",
    "lkp35_decomposition_trees",
    "lkp12_stroke_counts",
    "lkp16_stroke_order",
    "cli04_components_command",
    "cli08_build_command",
]


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    folder = tmp_path_factory.mktemp("odd")
    c = duckdb.connect()
    for name in ("part", "supplier", "nation", "region", "customer", "orders", "lineitem"):
        more = ""
        if name == "part":
            more = f" UNION ALL SELECT h - 1, 'small ring', 'Brand#1', 'SMALL', (h % 50)::INTEGER, 1.0 FROM unnest({HEAP}) t(h)"
        elif name == "supplier":
            more = " UNION ALL SELECT 368, 'Supplier', 1, 1.0"
        c.execute(f"COPY (SELECT * FROM '{SMALL}/{name}.parquet'{more}) TO '{folder}/{name}.parquet'")
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    there = "n BETWEEN 0 AND 55295 OR n BETWEEN 57344 AND 1114111"
    c.execute(f"CREATE MACRO char_of(n) AS CASE WHEN {there} THEN chr(CASE WHEN {there} THEN n ELSE 63 END) ELSE '⟦' || printf('%X', n) || '⟧' END")
    return Path(folder), c


@pytest.mark.parametrize("name", CASES)
def test_query_equals_its_sql(spark, odd, name):
    folder, c = odd
    rows = __spark_entry__.queries()[name](spark, str(folder))
    found = Counter(map(tuple, rows.collect()))
    sql = re.sub(r"\bchr\(", "char_of(", __spark_entry__.oracle_sql()[name])
    columns = ", ".join(f'"{x}"' for x in rows.columns)
    assert found == Counter(c.execute(f"SELECT {columns} FROM ({sql})").fetchall()) and found


def test_basic_plane_only(spark, odd):
    """Characters beyond the basic plane are left out, which its SQL, made for smaller tables, doesn't say."""
    folder, c = odd
    there = lambda n: f"⟦{n:X}⟧" if 0xD800 <= n < 0xE000 else chr(n)
    parts = c.execute("SELECT p_partkey, p_size FROM part WHERE 19968 + p_partkey < 65536").fetchall()
    rows = __spark_entry__.queries()["src06_basic_plane_only"](spark, str(folder))
    assert Counter(map(tuple, rows.collect())) == Counter((there(19968 + k), f"⿰{chr(19968 + n)}" + ("口" if k % 2 else "？")) for k, n in parts)


def test_unknown_variants_of_the_first_place(spark, tmp_path):
    """中 has a simplified variant here, so it doesn't stand for itself in the second place; the SQL doesn't ask for that place."""
    c = duckdb.connect()
    c.execute("CREATE TABLE part AS SELECT k::BIGINT AS p_partkey, 'small ring' AS p_name, 'Brand#1' AS p_brand, 3 AS p_size FROM unnest([45, 46, 47]) t(k)")
    c.execute(f"COPY part TO '{tmp_path}/part.parquet'")
    found = __spark_entry__.queries()["dic10_unknown_variants"](spark, str(tmp_path)).collect()
    assert Counter(map(tuple, found)) == Counter(c.execute(__spark_entry__.oracle_sql()["dic10_unknown_variants"]).fetchall()) and len(found) == 2
