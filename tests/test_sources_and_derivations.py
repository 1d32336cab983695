import io
import zipfile

import pytest

from hanlake.plans import derive
from hanlake.plans.catalog import Catalog
from hanlake.plans.derive import Build, Builder
from hanlake.sources import dictionaries, seeds, unihan

CH = "ChineseCharacter"


def test_seeds(spark, tmp_path):
    (tmp_path / "kangxiradical.csv").write_text("# radicals\n#\n149,'⾔','R','TCJKV',0\n149,'訁','V','T',1\n\n")
    (tmp_path / "strokeorder.csv").write_text('# orders\n"口","S-HZ-H",0,""\n"𨧀","H-H",0,"O"\n')
    (tmp_path / "pinyinipamapping.csv").write_text("'a','a',''\n'e','ɤ','Default'\n")
    (tmp_path / "jyutpingsyllables.csv").write_text("'aa'\n'aa'\n")
    radicals = seeds.read_seed(spark, str(tmp_path), "KangxiRadical").orderBy("seed_row_id").collect()
    assert [(r.RadicalIndex, r.Form, r.Type, r.Locale, r.SubIndex) for r in radicals] == [(149, "⾔", "R", "TCJKV", 0), (149, "訁", "V", "T", 1)]
    assert [tuple(r)[:4] for r in seeds.read_seed(spark, str(tmp_path), "StrokeOrder", bmp_only=True).collect()] == [("口", "S-HZ-H", 0, "")]
    assert {r.Feature for r in seeds.read_seed(spark, str(tmp_path), "PinyinIPAMapping").collect()} == {"", "Default"}
    with pytest.raises(ValueError):
        seeds.read_seed(spark, str(tmp_path), "JyutpingSyllables")
    assert len(seeds.SPECS) == 29


def test_unihan_and_kanjidic(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# x\nU+4E2D\tkMandarin\tZHONG1 ZHONG4\nU+4E2D\tkTotalStrokes\t4\nU+200D3\tkTotalStrokes\t3\nU+53F0\tkRSKangXi\t30.2\nU+53F0\tkTraditionalVariant\tU+53F0 U+81FA\n")
    (tmp_path / "b.txt").write_text("U+53F0\tkSemanticVariant\tU+81FA<kMatthews U+6AAF<kX:T\nU+53F0\tkHanyuPinlu\ttai2(12) tai2(7)\nU+53F0\tkHanyuPinyin\t10571.060:tái,yí\nU+53F0\tkGB0\t4445\nU+53F0\tkZVariant\tnone\n")
    wide = unihan.read_unihan(spark, [str(tmp_path / "a.txt"), str(tmp_path / "b.txt")])
    assert {r[CH]: r.kTotalStrokes for r in wide.collect()} == {"中": 4, "台": None, "𠃓": 3}
    assert unihan.read_unihan(spark, str(tmp_path / "a.txt"), keys=None, bmp_only=True).count() == 2
    assert sorted(r.Reading for r in derive.split_readings(wide, "kMandarin").collect()) == ["zhong1", "zhong4"]
    assert sorted((r.Variant, r.Type) for r in derive.variants(wide).collect()) == sorted([("台", "T"), ("臺", "T"), ("臺", "M"), ("檯", "M")])
    assert [tuple(r) for r in derive.radical_indices(wide, "kRSKangXi").collect()] == [("台", 30)]
    assert [tuple(r) for r in derive.readings_with_frequency(wide).collect()] == [("台", "tai2", 7)]
    assert sorted(r.Reading for r in derive.located_readings(wide, "kHanyuPinyin").collect()) == ["tai2", "yi2"]
    assert [r[0] for r in derive.character_set(wide, "GB2312").collect()] == ["台"]
    assert derive.column_values(wide, "kNone", ignore_missing=True).count() == 0
    with pytest.raises(ValueError):
        derive.column_values(wide, "kNone")
    (tmp_path / "k.xml").write_text('<kanjidic2><character><literal>中</literal><radical><rad_value rad_type="classical">2</rad_value><rad_value rad_type="nelson_c">5</rad_value></radical><misc><rad_name>x</rad_name></misc><reading_meaning><rmgroup><reading r_type="ja_on">チュウ</reading><reading r_type="ja_kun">なか</reading><reading r_type="ja_kun">うち</reading><meaning>in</meaning><meaning>middle</meaning><meaning m_lang="fr">milieu</meaning></rmgroup></reading_meaning></character></kanjidic2>')
    k = unihan.read_kanjidic(spark, str(tmp_path / "k.xml")).first()
    assert (k[CH], k.NelsonCRadical, k.CharacterJapaneseOn, k.CharacterJapaneseKun, k.Meaning_en, k.Meaning_fr, k.Meaning_es) == ("中", 5, "チュウ", "なか,うち", "in/middle", "milieu", None)


def test_dictionaries(spark, tmp_path):
    text = "header\n東京 [とうきょう] /(n) Tokyo/capital/\nかな /kana/\n# no\nbad line\n"
    (tmp_path / "edict").write_bytes(text.encode("euc-jp"))
    rows = dictionaries.read_dictionary(spark, str(tmp_path / "edict"), "EDICT").collect()
    assert [tuple(r) for r in rows] == [("東京", "とうきょう", "/(n) Tokyo/capital/"), ("かな", None, "/kana/")]
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        z.writestr("c.u8", "知道 知道 [zhi1 dao5] /to know/\n只 [zhi3] /only/\n")
    assert [tuple(r) for r in dictionaries.read_dictionary(spark, str(tmp_path / "c.zip"), "CEDICT").collect()] == [("知道", "知道", "zhi1 dao5", "/to know/"), ("只", None, "zhi3", "/only/")]
    for name in ("handedict-20090101.txt", "handedict-20100505.txt", "other.txt"):
        (tmp_path / name).write_text("x")
    assert dictionaries.newest_file(spark, str(tmp_path)).endswith("20100505.txt")
    (tmp_path / "w.txt").write_text("***\npinyin zhōngguó\nchar 中国[-國]\ndf China\n***\npinyin hǎo\nchar 好\n1df good\n2df fine\n")
    rows = dictionaries.wenlin_entries(dictionaries.parse_records(spark, str(tmp_path / "w.txt"))).collect()
    assert [tuple(r) for r in rows] == [("中國", "中国", "zhōngguó", "/China/"), ("好", "好", "hǎo", "/good/fine/")]
    assert dictionaries.unpack(b"plain") == b"plain" and io


def test_stroke_count_derivation(spark):
    t = spark.createDataFrame
    decomposition = t([("林", "⿰木木", 0, 0), ("森", "⿱木林", 0, 0), ("怪", "⿰忄圣", 0, 0), ("怪", "⿰忄土", 0, 1), ("x", "⿰木？", 0, 0)], f"{CH} string, Decomposition string, Glyph int, SubIndex int")
    own = t([("木", 4, 0), ("忄", 3, 0), ("圣", 5, 0), ("土", 3, 0)], f"{CH} string, StrokeCount int, Glyph int")
    wide = t([("怪", 8, None), ("u", 9, "1.1")], f"{CH} string, kTotalStrokes int, kRSKangXi string")
    glyphs = derive.glyphs(decomposition, own.select(CH, "Glyph"), wide)
    out = {r[CH]: r.StrokeCount for r in derive.combined_stroke_counts(glyphs, decomposition, own, wide).collect()}
    assert out == {"木": 4, "忄": 3, "圣": 5, "土": 3, "林": 8, "森": 12, "怪": 8, "u": 9}
    rows = t([("a", 0, 1, "f", 0, "⿰", 0, 5), ("a", 0, 1, "g", 0, "⿰", 1, 3)], f"{CH} string, Glyph int, RadicalIndex int, RadicalForm string, RadicalGlyph int, MainCharacterLayout string, RadicalRelativePosition int, ResidualStrokeCount int")
    more = derive.residual_stroke_counts(rows, t([("a", "1.9"), ("b", "2.4")], f"{CH} string, kRSKangXi string"))
    assert sorted(tuple(r) for r in more.collect()) == [("a", 0, 1, 3), ("b", 0, 2, 4)]
    cyclic = t([("a", 0, "b", 0), ("b", 0, "a", 0)], f"{CH} string, Glyph int, Component string, ComponentGlyph int")
    assert derive.closure(cyclic, [CH, "Glyph"], ["Component", "ComponentGlyph"]).count() == 4


def test_build_order(spark):
    made = []

    def make(name):
        def f(*tables, **options):
            made.append((name, options))
            return spark.range(1)

        return f

    def fails(*tables):
        raise OSError("no file")

    builders = [Builder("A", (), make("A")), Builder("B", ("A",), make("B"), {"wide": True}), Builder("C", ("B", "A"), make("C")), Builder("D", (), fails), Builder("E", ("D",), make("E"))]
    build, catalog = Build(builders, {"all": ["C", "small"], "small": ["A"]}), Catalog({})
    assert build.run(catalog, ["all"]) == ["A", "B", "C"] and made == [("A", {}), ("B", {"wide": True}), ("C", {})]
    assert build.run(catalog, ["C"]) == [] and build.run(catalog, ["B"], rebuild=True) == ["B"]
    assert build.dependents(["A"]) == {"B", "C"}
    assert build.run(catalog, ["E", "A"], no_fail=True) == []
    with pytest.raises(OSError):
        build.run(catalog, ["E"])
    with pytest.raises(KeyError):
        build.order(["Z"])
    with pytest.raises(ValueError):
        Build([Builder("A", ("B",), make("A")), Builder("B", ("A",), make("B"))]).order(["A"])
    with pytest.raises(ValueError):
        Build([Builder("A", (), make("A")), Builder("A", (), fails)])


def test_closure_makes_each_pair_of_a_tree_once(spark, monkeypatch):
    way = spark.createDataFrame([(str(i), 0, str(i + 1), 0) for i in range(21)], f"{CH} string, Glyph int, Component string, ComponentGlyph int")
    made = []
    with monkeypatch.context() as m:
        for name in ("distinct", "dropDuplicates"):
            m.setattr(type(way), name, lambda self, *a, f=getattr(type(way), name): made.append(self.count()) or f(self, *a))
        found = derive.closure(way, [CH, "Glyph"], ["Component", "ComponentGlyph"])
    assert sum(made) == found.count() == found.distinct().count() == 21 * 22 // 2


def test_newest_file_asks_for_many_names_at_once(spark, tmp_path, monkeypatch):
    for day in range(400):
        (tmp_path / f"handedict-2010{day:04}.txt").write_text("x")
    calls = []
    client = type(spark.sparkContext._gateway._gateway_client)
    monkeypatch.setattr(client, "send_command", lambda self, *a, f=client.send_command, **k: calls.append(1) and None or f(self, *a, **k))
    assert dictionaries.newest_file(spark, str(tmp_path)).endswith("handedict-20100399.txt") and len(calls) < 100
    assert sorted(x[-8:] for x in dictionaries._listed(spark, str(tmp_path), 7)) == [f"{day:04}.txt" for day in range(400)]
