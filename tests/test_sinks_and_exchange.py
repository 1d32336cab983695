import datetime

import pytest

from hanlake.operators import dictionary as dic
from hanlake.operators import readings as rd
from hanlake.operators import reports
from hanlake.plans import sinks
from hanlake.plans.catalog import Catalog
from hanlake.sources import exchange, files

CH = "ChineseCharacter"


def test_tables_are_written_replaced_and_dropped(spark, tmp_path):
    folder = f"file://{tmp_path}"
    rows = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "k int, v string")
    assert [tuple(r) for r in sinks.write_table(rows, folder, "T", ["k"], ["k"], {"k": "long"}).orderBy("k").collect()] == [(1, "a"), (2, "b"), (3, "c")]
    with pytest.raises(ValueError):
        sinks.write_table(rows.union(rows), folder, "T", ["k"])
    assert sinks.compact(spark, folder, "T") == 1 and spark.read.parquet(f"{folder}/T.parquet").count() == 3
    day = datetime.datetime(2011, 1, 1)
    assert sinks.install(rows, folder, "D", day) and not sinks.install(rows, folder, "D", day) and sinks.install(rows, folder, "D", day + datetime.timedelta(1))
    assert sinks.drop_table(spark, folder, "T") and not sinks.drop_table(spark, folder, "T") and not sinks.exists(spark, folder, "T")


def test_files_are_found_and_fetched(spark, tmp_path):
    for folder in ("a", "b"):
        (tmp_path / folder).mkdir()
    (tmp_path / "b" / "x.csv").write_text("1")
    assert files.find_file(spark, ["y.csv", "x.csv"], [f"file://{tmp_path}/a", f"file://{tmp_path}/b"]).endswith("b/x.csv")
    with pytest.raises(FileNotFoundError):
        files.find_file(spark, "z.csv", [f"file://{tmp_path}/a"])
    (tmp_path / "page.html").write_text('<a href="b/x.csv">x</a> Stand: 01.02.2011')
    got, date = files.fetch(files.Release(r'href="([^"]+)"', f"file://{tmp_path}/page.html", r"Stand: ([\d.]+)"), str(tmp_path / "a"))
    assert (tmp_path / "a" / "x.csv").read_text() == "1" and got.endswith("a/x.csv") and date == "01.02.2011"
    with pytest.raises(ValueError):
        files.Release("nothing (here)").on("a page")


def test_similar_sequences(spark):
    rows = spark.createDataFrame([("a", "⿰木口"), ("a", "⿰木？"), ("a", "⿱木？"), ("b", "⿰？？"), ("c", "⿰木"), ("d", "d")], f"{CH} string, Decomposition string")
    found = exchange.merge_similar(exchange.usable_sequences(rows))
    assert sorted((r[CH], r.SubIndex, r.Decomposition) for r in found.collect()) == [("a", 0, "⿰木口"), ("a", 1, "⿱木？"), ("b", 0, "⿰？？")]
    assert [r[0] for r in exchange.unknown_parts(found).orderBy(CH).collect()] == ["a", "b"]


def test_guessed_dialects():
    g = rd.guess_dialect
    assert g("Pinyin", "Wǒ shì lǜshī")["toneMarkType"] == "diacritics" and g("Pinyin", "lü4shi1")["yVowel"] == "ü" and g("Pinyin", "nu:3ren2")["yVowel"] == "u:"
    assert g("Pinyin", "wo shi")["toneMarkType"] == "numbers" and g("Pinyin", "wo shi", True)["toneMarkType"] == "none" and g("Pinyin", "zher4 nar3")["erhua"] == "oneSyllable" and g("Pinyin", "ẑongguo")["shortenedLetters"]
    assert g("WadeGiles", "kuo²-yü³")["toneMarkType"] == "superscriptNumbers" and g("WadeGiles", "t'ai2")["wadeGilesApostrophe"] == "'"
    assert g("CantoneseYale", "gwóngdūngwá")["toneMarkType"] == "diacritics" and g("CantoneseYale", "gwong2")["toneMarkType"] == "numbers"
    assert g("MandarinIPA", "pei²¹⁴")["toneMarkType"] == "superscriptChaoDigits" and g("MandarinIPA", "pei3.ma1")["toneMarkType"] == "numbers" and g("MandarinIPA", "pei˧˥")["toneMarkType"] == "ipaToneBar"
    assert g("WadeGiles", "kuo-yü")["neutralToneMark"] == "zero" and g("WadeGiles", "ti5 kuo2")["neutralToneMark"] == "five" and g("WadeGiles", "tzu3 hsu1") == g("WadeGiles", "tzu3 hsu1") | {"zeroFinal": "u", "umlautU": "u"}
    assert g("GR", "sheau jie'l")["grRhotacisedFinalApostrophe"] == "'" and g("Hangul", "x") == {}


def test_dictionary_registry(spark):
    entries = spark.createDataFrame([("說", "说", "shuo1", "/to speak/")], "HeadwordTraditional string, HeadwordSimplified string, Reading string, Translation string")
    catalog = Catalog({"CEDICT": entries})
    rd.register_inventory("Pinyin", sorted({*rd.INVENTORY.get("Pinyin", ()), "shuo"}))
    assert dic.available_dictionaries(catalog) == ["CEDICT"] and dic.dictionary(catalog, "CEDICT").release() is None
    assert dic.dictionary(catalog, "CEDICT", headword="t").get_for_headword("说").count() == 0 and dic.dictionary(catalog, "CEDICT", headword="s").get_for_headword("说").count() == 1
    with pytest.raises(ValueError):
        dic.dictionary(catalog, "Other")
    with pytest.raises(ValueError):
        dic.dictionary(catalog, "CEDICT", headword="x")
    dic.set_default_wildcards("?", "*")
    assert dic.Wildcards().has("a*") and not dic.Wildcards().has("a%")
    dic.set_default_wildcards()
    variants = spark.createDataFrame([("說", "説", "S")], f"{CH} string, Variant string, Type string")
    assert [r["character"] for r in dic.check_variants(entries, variants).collect()] == ["說"]


def test_mismatches(spark):
    own = spark.createDataFrame([("a", 0, 3), ("a", 1, 4), ("b", 0, 2), ("c", 0, 1)], f"{CH} string, Glyph int, StrokeCount int")
    other = spark.createDataFrame([("a", 4), ("b", 5)], f"{CH} string, StrokeCount int")
    assert [(r[CH], r.own, r.unihan) for r in reports.stroke_count_mismatches(own, other).collect()] == [("b", [2], 5)]
