import pytest

from hanlake.operators import reports
from hanlake.operators.characters import CharacterLookup
from hanlake.plans import radicals
from hanlake.plans.catalog import Catalog

CH = "ChineseCharacter"


def test_radicals_inside(spark):
    t = spark.createDataFrame
    decomposition = t([("他", "⿰亻也", 0, 0), ("休", "⿰亻木", 0, 0), ("鸺", "⿰休鸟", 0, 0), ("x", "⿰亻⿱木口", 0, 0), ("y", "⿱他口", 0, 0), ("z", "⿰亻？", 0, 0)], f"{CH} string, Decomposition string, Glyph int, SubIndex int")
    forms = t([("亻", 9), ("木", 75), ("鸟", 196), ("口", 30)], "Form string, RadicalIndex int")
    counts = t([("亻", 0, 2), ("也", 0, 3), ("木", 0, 4), ("鸟", 0, 5), ("口", 0, 3), ("休", 0, 6), ("他", 0, 5)], f"{CH} string, Glyph int, StrokeCount int")
    out = {(r[CH], r.RadicalForm): (r.MainCharacterLayout, r.RadicalRelativePosition, r.ResidualStrokeCount) for r in radicals.radical_residuals(decomposition, forms, counts).collect()}
    assert out == {
        ("他", "亻"): ("⿰", 0, 3), ("休", "亻"): ("⿰", 0, 4), ("休", "木"): ("⿰", 1, 2), ("鸺", "鸟"): ("⿰", 1, 6), ("鸺", "亻"): ("⿰", 0, 9), ("鸺", "木"): ("⿻", 0, 7),
        ("x", "亻"): ("⿰", 0, 7), ("x", "木"): ("⿻", 0, 5), ("x", "口"): ("⿻", 0, 6), ("y", "口"): ("⿱", 1, 5), ("y", "亻"): ("⿻", 0, 6),
    }


def test_locales_and_syllables(spark):
    t = spark.createDataFrame
    decomposition = t([("好", "⿰女子", 0, 0), ("a", "⿰女[2]子", 0, 0)], f"{CH} string, Decomposition string, Glyph int, SubIndex int")
    made = radicals.locale_decompositions(decomposition, t([("女", 0)], f"{CH} string, Glyph int"), t([("女", 1)], f"{CH} string, Glyph int"))
    assert {r[CH]: r.Decomposition for r in made.collect()} == {"好": "⿰女[1]子", "a": "⿰女[2]子"}
    parts = t([("zhong", "zh", "ong"), ("zhi", "zh", "i"), ("qi", "q", "i"), ("xx", "x", "x")], "syllable string, initial string, final string")
    initials = t([("zh", "ch", None), ("q", "ch’", None), ("x", "hs", "i|in")], "initial string, target string, before string")
    finals = t([("ong", "ung", None), ("i", "ih", "zh|ch"), ("i", "i", "q|x")], "final string, target string, before string")
    assert {r.syllable: r.target for r in radicals.syllable_mapping(parts, initials, finals).collect()} == {"zhong": "chung", "zhi": "chih", "qi": "ch’i", "xx": None}


def test_reports(spark):
    t = spark.createDataFrame
    c = Catalog({
        "CharacterPinyin": t([("中", "zhong1"), ("中", "zhong4"), ("国", "guo2")], f"{CH} string, Reading string"),
        "CharacterVariant": t([("国", "國", "T"), ("國", "国", "S")], f"{CH} string, Variant string, Type string"),
        "StrokeCount": t([("中", 0, 4)], f"{CH} string, Glyph int, StrokeCount int"),
        "CharacterKangxiRadical": t([("中", 2), ("国", 31)], f"{CH} string, RadicalIndex int"),
        "CharacterResidualStrokeCount": t([("中", 0, 2, 3), ("国", 0, 31, 5), ("回", 0, 31, 3)], f"{CH} string, Glyph int, RadicalIndex int, ResidualStrokeCount int"),
        "GB2312Set": t([("中",)], f"{CH} string"),
    })
    look = CharacterLookup(c, ordered=True)
    info = {r[CH]: r for r in reports.character_information(look, t([("中",), ("国",)], f"{CH} string")).collect()}
    assert (info["中"].codepoint, info["中"].radical, info["中"].strokes, info["中"].Pinyin, info["中"].in_GB2312) == ("U+4E2D", 2, 4, "[zhong1 zhong4]", True)
    assert (info["国"].variants, info["国"].strokes, info["国"].in_GB2312) == ("T:國", None, False)
    rows = reports.characters_by_residual(look, t([(31,)], "RadicalIndex int"), False).collect()
    assert [(r.ResidualStrokeCount, r.characters) for r in rows] == [(3, ["回"]), (5, ["国"])]
    texts = t([(1, "中国！")], "id int, s string")
    assert reports.readings_of_text(look, texts, "s", "Pinyin").first().readings == "[zhong1 zhong4] guo2 ！"
    assert reports.convert_script(look, texts, "s", "T").first().converted == "中國！"
    parts = t([("ma", "m", "a"), ("na", "n", "a")], "syllable string, initial string, final string")
    assert [tuple(r) for r in reports.syllable_table(parts, ["a", "o"]).collect()] == [("m", "ma", None), ("n", "na", None)]
    with pytest.raises(ValueError):
        reports.syllable_table(parts.union(t([("mā", "m", "a")], "a string, b string, c string")), ["a"])
    new = reports.upsert(t([("A", 1), ("B", 2)], "TableName string, v int"), t([("A", 3)], "TableName string, v int"), ["TableName"])
    assert sorted(map(tuple, new.collect())) == [("A", 3), ("B", 2)]
