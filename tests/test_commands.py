import io

from hanlake.__main__ import main

CH = "ChineseCharacter"


def test_commands(spark, tmp_path):
    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))

    write("CharacterPinyin", [("中", "zhong1"), ("国", "guo2")], f"{CH} string, Reading string")
    write("CharacterVariant", [("国", "國", "T")], f"{CH} string, Variant string, Type string")
    write("CharacterResidualStrokeCount", [("国", 0, 31, 5)], f"{CH} string, Glyph int, RadicalIndex int, ResidualStrokeCount int")
    write("GB2312Set", [("中",)], f"{CH} string")
    write("PinyinSyllables", [("zhong",), ("guo",)], "Pinyin string")
    write("CEDICT", [("中國", "中国", "zhong1 guo2", "/China/")], "HeadwordTraditional string, HeadwordSimplified string, Reading string, Translation string")

    def said(*args):
        out = io.StringIO()
        main(["--tables", str(tmp_path), *args], spark, out)
        return out.getvalue().strip().split("\n")

    assert said("readings", "Pinyin", "中国")[1] == "zhong1 guo2" and said("script", "T", "中国")[1] == "中國"
    assert said("convert", "Pinyin", "zhong1guo2", "--source", "toneMarkType=numbers") == ["zhōngguó"]
    assert said("search", "CEDICT", "china")[1].startswith("中國\t中国") and said("search", "CEDICT", "中国")[1:] == said("search", "CEDICT", "中_")[1:]
    assert said("radical", "31")[1] == "31\t5\t国" and "domain GB2312" in said("list") and len(said("info", "中国中")) == 3
