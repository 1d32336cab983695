from pyspark.sql import functions as F

from hanlake.functions import ids, text


def one(spark, *columns, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return list(row.select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first())


def test_codepoints(spark):
    assert one(spark, text.codepoint("a"), text.codepoint("b"), text.format_codepoint("a"), text.char_of(F.lit(0x289C0)), a="𨧀x", b="") == [0x289C0, None, "U+289C0", "𨧀"]
    assert one(spark, text.characters("a"), a="丷か𨧀")[0] == ["丷", "か", "𨧀"]
    rows = spark.createDataFrame([(c,) for c in "说説說丷か국𠃓"], "c string")
    assert [r.c for r in rows.where(text.is_han("c")).collect()] == list("说説說丷𠃓")


def test_numbers_without_a_character(spark):
    numbers = [0xD7FF, 0xD800, 0xDFFF, 0xE000, 0xFEFF, 0x10FFFF, 0x110000, 0x7FFFFFF]
    rows = spark.createDataFrame([(n,) for n in numbers], "n int").withColumn("c", text.char_of("n")).withColumn("s", F.concat(F.lit("⿰"), "c", "c", F.lit("[2]")))
    found = rows.select("n", "c", text.codepoint("c").alias("n2"), text.format_codepoint("c").alias("u"), ids.parse("s").alias("p"), (ids.write(ids.parse("s")) == F.col("s")).alias("same")).collect()
    assert [r.n2 for r in found] == numbers and len({r.c for r in found}) == len(numbers)
    assert [r.u for r in found] == [f"U+{n:04X}" for n in numbers] and all(r.same for r in found)
    assert [[(p.char, p.glyph) for p in r.p[1:]] for r in found] == [[(r.c, 0), (r.c, 2)] for r in found]
    assert [r.c for r in found][1:5:3] == ["⟦D800⟧", "\ufeff"] and one(spark, text.codepoint("a"), a="⟦AB⟧") == [0x27E6]


def test_case_and_patterns(spark):
    assert one(spark, text.titlecase("a"), text.titlecase("b"), a="LAO3SHI1", b="˳geh") == ["Lao3shi1", "˳Geh"]
    assert one(spark, text.transfer_case("a", F.lit("guó")), text.transfer_case(F.upper("a"), F.lit("guó")), text.transfer_case(F.lower("a"), F.lit("guó")), a="Kuo") == ["Guó", "GUÓ", "guó"]
    assert text.like_escape("100%_\\") == "100\\%\\_\\\\"
    assert one(spark, F.lit("a.b(c)").rlike("^" + text.java_quote("a.b(c)") + "$"), F.lit("axb(c)").rlike("^" + text.java_quote("a.b(c)") + "$")) == [True, False]
    assert one(spark, text.full_width("a"), a="USB手") == ["ＵＳＢ手"]
    assert sorted(one(spark, text.substrings("a"), a="aba")[0]) == ["a", "ab", "aba", "b", "ba"]
    assert one(spark, text.script_runs("a", "Hangul"), a="ab한국 c")[0] == ["ab", "한", "국", " c"]
    assert one(spark, text.nfc("a"), text.strip_pinyin_tone("b"), text.pinyin_tone("b"), text.pinyin_tone("c"), a="ü", b="lǚ", c="ma") == ["ü", "lü", 3, 5]


def test_description_sequences(spark):
    parts = one(spark, ids.parse("a"), ids.write(ids.parse("a")), ids.write(ids.parse("a"), True), a="⿰亻[2]⿱#3？")
    assert [(p.op, p.char, p.glyph) for p in parts[0]] == [("⿰", None, None), (None, "亻", 2), ("⿱", None, None), (None, "#3", 0), (None, "？", 0)]
    assert parts[1:] == ["⿰亻[2]⿱#3？", "⿰亻⿱#3？"]
    for seq, good in (("⿰氵龠", True), ("⿰氵", False), ("⿲木木木", True), ("⿲木木", False), ("⿰氵龠木", False), ("木", True), ("𨧀", True)):
        assert one(spark, ids.is_valid("a"), a=seq) == [good], seq
    assert [c.char for c in one(spark, ids.components("a"), a="⿰亻？")[0]] == ["亻"]
