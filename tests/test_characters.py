import pytest

from hanlake.operators.characters import CharacterLookup, basic_components, missing_component_counts
from hanlake.plans import derive
from hanlake.plans.catalog import Catalog, assert_unique

CH = "ChineseCharacter"


@pytest.fixture(scope="module")
def catalog(spark):
    table = spark.createDataFrame
    decomposition = table(
        [("瀹", "⿰氵龠", 0, 0), ("他", "⿰亻也", 0, 0), ("好", "⿰女子", 0, 0), ("森", "⿱木林", 0, 0), ("林", "⿰木木", 0, 0), ("回", "⿴囗口", 0, 0), ("匠", "⿷匚斤", 0, 0), ("凶", "⿶凵乂", 0, 0), ("达", "⿺辶大", 0, 0), ("巫", "⿻工从", 0, 0), ("怪", "⿰？圣", 0, 0), ("怪", "⿰忄圣", 0, 1)],
        f"{CH} string, Decomposition string, Glyph int, SubIndex int",
    )
    orders = table([("口", "S-HZ-H", 0), ("木", "H-S-P-N", 0), ("囗", "S-HZ-H", 0), ("匚", "H-SZ", 0), ("斤", "P-P-H-S", 0), ("凵", "SZ-S", 0), ("乂", "P-N", 0), ("辶", "D-HZZP-N", 0), ("大", "H-P-N", 0), ("忄", "D D-S", 0), ("圣", "HP-N-H-S-H", 0), ("女", "PD-P-H", 0), ("子", "HG-SG-H", 0), ("工", "H-S-H", 0), ("从", "P-D-P-N", 0)], f"{CH} string, StrokeOrder string, Glyph int")
    glyphs = decomposition.select(CH, "Glyph").union(orders.select(CH, "Glyph")).distinct()
    counts = derive.stroke_counts(orders)
    return Catalog({
        "CharacterDecomposition": decomposition, "StrokeOrder": orders, "Glyphs": glyphs, "StrokeCount": counts,
        "ComponentLookup": lambda: derive.component_lookup(decomposition),
        "LocaleCharacterGlyph": table([("好", 0, "TC")], f"{CH} string, Glyph int, Locale string"),
        "Strokes": table([("S", "shù", "㇑"), ("HZ", "héngzhé", "㇕"), ("H", "héng", "㇐")], "StrokeAbbrev string, Name string, Stroke string"),
        "CharacterPinyin": table([("二", "er4"), ("佴", "er4"), ("贰", "er4"), ("中", "zhong1"), ("中", "zhong4"), ("貳", "er4")], f"{CH} string, Reading string"),
        "GB2312Set": table([("二",), ("佴",), ("贰",), ("瀹",), ("说",)], f"{CH} string"),
        "CharacterVariant": table([("台", "檯", "T"), ("台", "臺", "T"), ("台", "颱", "T"), ("台", "台", "T"), ("他", "她", "M"), ("他", "牠", "M"), ("钟", "鐘", "T"), ("鐘", "钟", "M")], f"{CH} string, Variant string, Type string"),
        "KangxiRadical": table([(149, "⾔", "R", "TCJKV", 0), (149, "訁", "V", "T", 1), (149, "⻈", "R", "C", 2), (149, "讠", "V", "C", 3), (85, "⽔", "R", "TC", 0), (85, "氵", "V", "TC", 1), (122, "⽹", "R", "T", 0)], "RadicalIndex int, Form string, Type string, Locale string, SubIndex int"),
        "RadicalEquivalentCharacter": table([(1, "⾔", "言", "TC"), (2, "⽹", "网", "T"), (3, "⺳", "网", "T"), (4, "⺴", "网", "T"), (5, "⽔", "水", "T")], "seed_row_id long, Form string, EquivalentForm string, Locale string"),
        "KangxiRadicalIsolatedCharacter": table([(85, "氺", "V", "T")], "RadicalIndex int, EquivalentForm string, Type string, Locale string"),
        "CharacterKangxiRadical": table([("他", 9), ("瀹", 85), ("龠", 214)], f"{CH} string, RadicalIndex int"),
        "CharacterResidualStrokeCount": table([("他", 0, 9, 3), ("瀹", 0, 85, 17), ("瀹", 0, 214, 3), ("龠", 0, 214, 0)], f"{CH} string, Glyph int, RadicalIndex int, ResidualStrokeCount int"),
        "CharacterRadicalResidualStrokeCount": table([("他", 0, 9, "亻", 0, "⿰", 0, 3)], f"{CH} string, Glyph int, RadicalIndex int, RadicalForm string, RadicalGlyph int, MainCharacterLayout string, RadicalRelativePosition int, ResidualStrokeCount int"),
    })


def keys(spark, column, *values):
    return spark.createDataFrame([(v,) for v in values], f"{column} {'int' if isinstance(values[0], int) else 'string'}")


def test_catalog_and_domains(spark, catalog):
    assert catalog.domains() == ["Unicode", "GB2312"]
    with pytest.raises(ValueError):
        CharacterLookup(catalog, "T", "BIG5")
    with pytest.raises(ValueError):
        CharacterLookup(catalog, "X")
    found = CharacterLookup(catalog, "T", "GB2312", ordered=True).filter_domain(keys(spark, CH, "说", "説", "说"))
    assert [r[0] for r in found.collect()] == ["说", "说"]
    with pytest.raises(ValueError):
        assert_unique(catalog["CharacterPinyin"], ["Reading"])
    assert CharacterLookup(catalog).domain_characters(spark).count() > 70_000


def test_readings_and_variants(spark, catalog):
    t = CharacterLookup(catalog, "T", "GB2312", ordered=True)
    assert [r[1] for r in t.characters_for_reading(keys(spark, "Reading", "er4"), "Pinyin").collect()] == ["二", "佴", "贰"]
    t = CharacterLookup(catalog, "T", ordered=True)
    assert [r[1] for r in t.readings(keys(spark, CH, "中"), "Pinyin").collect()] == ["zhong1", "zhong4"]
    assert [r[1] for r in t.variants(keys(spark, CH, "台"), "t").collect()] == ["台", "檯", "臺", "颱"]
    assert [tuple(r)[1:] for r in t.variants(keys(spark, CH, "他")).collect()] == [("她", "M"), ("牠", "M")]
    assert sorted(r[1] for r in t.simplified_or_traditional(keys(spark, CH, "钟"), "T").collect()) == sorted(["钟", "鐘"])
    assert [r[1] for r in t.simplified_or_traditional(keys(spark, CH, "口"), "S").collect()] == ["口"]
    with pytest.raises(ValueError):
        t.variants(keys(spark, CH, "他"), "Q")


def test_strokes(spark, catalog):
    t = CharacterLookup(catalog, "T", ordered=True)
    made = {r[CH]: r.StrokeOrder for r in t.stroke_orders().collect()}
    want = {"口": "S-HZ-H", "林": "H-S-P-N H-S-P-N", "森": "H-S-P-N H-S-P-N H-S-P-N", "回": "S-HZ S-HZ-H H", "匠": "H P-P-H-S SZ", "凶": "P-N SZ-S", "达": "H-P-N D-HZZP-N", "怪": "D D-S HP-N-H-S-H", "好": "PD-P-H HG-SG-H"}
    assert {k: made.get(k) for k in want} == want and "巫" not in made and "他" not in made
    one = t.stroke_forms(t.stroke_orders(keys(spark, CH, "口"))).first()
    assert one.Strokes == ["㇑", "㇕", "㇐"]
    assert t.stroke_counts(keys(spark, CH, "口")).first().StrokeCount == 3
    assert [r.Stroke for r in t.stroke_for_abbreviation(keys(spark, "StrokeAbbrev", "HZ", "?")).orderBy("StrokeAbbrev").collect()] == [None, "㇕"]
    assert {r.Component for r in missing_component_counts(catalog["CharacterDecomposition"], t.stroke_orders()).collect()} >= {"氵", "龠", "亻", "也"}


def test_radicals(spark, catalog):
    t, c = CharacterLookup(catalog, "T", ordered=True), CharacterLookup(catalog, "C", "GB2312", ordered=True)
    assert [r.RadicalIndex for r in t.kangxi_radicals(keys(spark, CH, "他")).collect()] == [9]
    assert [tuple(r)[3:] for r in t.radical_residuals(keys(spark, CH, "他").selectExpr(CH, "0 Glyph"), True).collect()] == [("亻", 0, "⿰", 0, 3)]
    assert [r[1] for r in c.characters_for_radical(keys(spark, "RadicalIndex", 214), False).collect()] == ["瀹"]
    assert [r[1] for r in t.characters_for_radical(keys(spark, "RadicalIndex", 214)).collect()] == ["龠"]
    assert sorted((r[CH], r.ResidualStrokeCount) for r in t.residuals_for_radical(keys(spark, "RadicalIndex", 214), False).collect()) == [("瀹", 3), ("龠", 0)]
    assert [r.Form for r in t.representative_characters(keys(spark, "RadicalIndex", 149)).collect()] == ["⾔", "言", "訁"]
    assert [r.Form for r in CharacterLookup(catalog, "C", ordered=True).representative_characters(keys(spark, "RadicalIndex", 149)).collect()] == ["⻈", "⾔", "言", "讠"]
    assert [r.Form for r in t.radical_forms(keys(spark, "RadicalIndex", 149)).collect()] == ["⾔"]
    assert [r.Form for r in t.radical_forms(keys(spark, "RadicalIndex", 149), "V").collect()] == ["訁"]
    assert {r.Form: r.RadicalIndex for r in t.radical_indices(keys(spark, "Form", "⾔", "水", "氺", "木")).collect()} == {"⾔": 149, "水": 85, "氺": 85, "木": None}
    assert [r.Form for r in t.forms_of_equivalent(keys(spark, "EquivalentForm", "网")).collect()] == ["⽹", "⺳", "⺴"]
    assert [r.EquivalentForm for r in t.equivalent_of_form(keys(spark, "Form", "⽹")).collect()] == ["网"]


def test_components(spark, catalog):
    t = CharacterLookup(catalog, "T", ordered=True)
    assert [tuple(r) for r in CharacterLookup(catalog, "C", "GB2312", ordered=True).characters_for_components([["⿕", "龠"], ["氵"]]).collect()] == [("瀹", 0)]
    assert [r[0] for r in t.characters_for_components([["木"]]).collect()] == ["林", "森", "木"]
    assert [r[0] for r in t.characters_for_components([["女"], ["子"]]).collect()] == ["好"]
    asked = spark.createDataFrame([("好", 0, "女", 0), ("他", 0, "女", 0), ("森", 0, "木", 0)], f"{CH} string, Glyph int, Component string, ComponentGlyph int")
    assert {r[CH]: r.is_component for r in t.is_component(asked).collect()} == {"好": True, "他": False, "森": True}
    entry = t.decompositions(keys(spark, CH, "瀹").selectExpr(CH, "0 Glyph")).first().entries
    assert [[(p.op, p.char, p.glyph) for p in e] for e in entry] == [[("⿰", None, None), (None, "氵", 0), (None, "龠", 0)]]
    rows = t.decomposition_rows(keys(spark, CH, "森").selectExpr(CH, "0 Glyph")).collect()
    assert sorted((tuple(r.path), r.op or r.part) for r in rows) == [((), "森"), ((0, 0), "⿱"), ((0, 1), "木"), ((0, 2), "林"), ((0, 2, 0, 0), "⿰"), ((0, 2, 0, 1), "木"), ((0, 2, 0, 2), "木")]
    assert {r.Component for r in basic_components(catalog["CharacterDecomposition"], keys(spark, CH, "森", "好")).collect()} == {"木", "女", "子"}
    assert [r.Glyph for r in t.default_glyphs(keys(spark, CH, "好", "口")).collect()] == [0, 0]


def chain(spark, pairs):
    return spark.createDataFrame([(c, s, 0, 0) for c, s in pairs], f"{CH} string, Decomposition string, Glyph int, SubIndex int")


def test_deep_chains_and_circles(spark):
    from hanlake.plans.derive import component_lookup
    from hanlake.plans.catalog import Catalog

    deep = [(chr(0x4E00 + i), "⿰" + chr(0x4E00 + i + 1) + "口") for i in range(40)]
    rows = chain(spark, deep)
    assert component_lookup(rows).count() == 40 * 41 // 2 + 40
    look = CharacterLookup(Catalog({"CharacterDecomposition": rows}))
    tree = look.decomposition_rows(spark.createDataFrame([(chr(0x4E00), 0)], f"{CH} string, Glyph int"))
    assert tree.agg({"depth": "max"}).first()[0] == 40 and tree.count() == 1 + 3 * 40
    circle = chain(spark, [("甲", "⿰乙口"), ("乙", "⿰甲口")])
    assert component_lookup(circle).count() == 2 * 3
    with pytest.raises(ValueError):
        CharacterLookup(Catalog({"CharacterDecomposition": circle})).decomposition_rows(spark.createDataFrame([("甲", 0)], f"{CH} string, Glyph int"))
