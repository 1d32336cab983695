import pytest

from hanlake.operators import dictionary as dic
from hanlake.operators import readings as rd

PLAIN = "zhi dao zhong shou dui qi pan bo guo xi an xian".split()
CEDICT = [
    ("知道", "知道", "zhi1 dao5", "/to know/to be aware of/"),
    ("執導", "执导", "zhi2 dao3", "/to direct (a film, play etc)/"),
    ("直到", "直到", "zhi2 dao4", "/until/"),
    ("直搗", "直捣", "zhi2 dao3", "/to storm/to attack directly/"),
    ("指導", "指导", "zhi3 dao3", "/to guide, direction/"),
    ("制導", "制导", "zhi4 dao3", "/to control/to guide (a missile)/"),
    ("指導員", "指导员", "zhi3 dao3 xi1", "/instructor/"),
    ("C盤", "C盘", "C pan2", "/C drive/"),
    ("USB手指", "USB手指", "U S B shou3 zhi3", "/USB stick/"),
    ("西安", "西安", "xi1 an1", "/Xi'an/"),
]


@pytest.fixture(scope="module")
def cedict(spark):
    entries = spark.createDataFrame(CEDICT, "HeadwordTraditional string, HeadwordSimplified string, Reading string, Translation string")
    reading = rd.Pinyin(PLAIN, toneMarkType="numbers", erhua="ignore")
    return dic.cedict(entries, reading)


def rows(found):
    place = {r: i for i, r in enumerate(CEDICT)}
    return sorted(place[tuple(r)] for r in found.collect())


def test_readings(cedict):
    assert rows(cedict.get_for_reading("zhidao")) == [0, 1, 2, 3, 4, 5]
    assert rows(cedict.get_for_reading("zhi2dao")) == [1, 2, 3]
    assert rows(cedict.get_for_reading("zhi2dao3")) == [1, 3]
    assert rows(cedict.get_for_reading("zhi3%")) == [4, 6]
    assert rows(cedict.get_for_reading("%dao3")) == [1, 3, 4, 5] and rows(cedict.get_for_reading("_dao5")) == [0]
    assert rows(cedict.get_for_reading("xian")) == [9]
    assert rows(cedict.get_for_reading("zhi导")) == [1, 4, 5] and rows(cedict.get_for_reading("zhi导%")) == [1, 4, 5, 6]
    assert rows(cedict.get_for_reading("USB shou指")) == [8]
    assert rows(cedict.get_for_reading("qqq")) == []


def test_translations_and_headwords(cedict):
    assert rows(cedict.get_for_translation("to guide")) == [4, 5] and rows(cedict.get_for_translation("To Know")) == [0]
    assert rows(cedict.get_for_translation("to %")) == [0, 1, 3, 4, 5]
    assert rows(cedict.get_for_headword("指%")) == [4, 6] and rows(cedict.get_for_headword("执导")) == [1]
    assert rows(cedict.get_for_headword("执导", ["HeadwordTraditional"])) == []
    assert rows(cedict.get_for("until")) == [2] and rows(cedict.get_for("zhi2dao4")) == [2]
    assert cedict.get_all(3, ["Reading"]).count() == 3


def test_wildcards():
    w = dic.Wildcards()
    assert w.like("a_%\\_\\\\") == "a_%\\_\\\\" and w.has("a%") and not w.has("a\\%") and w.plain("a\\%b\\") == "a%b\\"
    other = dic.Wildcards("?", "*", "y")
    assert other.parse("ay?*")[:2] == ["a", "?"] and other.pattern("a?.") == "a.\\."


def test_senses(spark):
    t = spark.createDataFrame([(0, "/(n) Tokyo (current capital of Japan)/(P)/"), (1, "/Tokyo Inn/"), (2, "/in Tokyo/"), (3, None)], "i int, t string")
    found = lambda s, q: [r.i for r in t.where(s("t", q)).collect()]
    assert found(dic.SimpleTranslation, "tokyo") == [0] and found(dic.SimpleWildcardTranslation, "tokyo%") == [0, 1]
    assert found(dic.SimpleWildcardTranslation, "_Tokyo") == [] and found(dic.SingleEntry(), "Tokyo Inn") == [1]
    assert found(dic.WildcardTranslation, "%tokyo") == [2] and found(dic.Exact(), "/in Tokyo/") == [2]
    de = spark.createDataFrame([(0, "/Wind (u.E.); Nordwind/"), (1, "/Wind; Bsp.: kalt -- kalter Nordwind/")], "i int, t string")
    assert [r.i for r in de.where(dic.HanDeDictTranslation("t", "nordwind")).collect()] == [0]
    assert [r.i for r in de.where(dic.HanDeDictWildcardTranslation("t", "%nordwind%")).collect()] == [0, 1]


def test_formats_and_parts(spark):
    t = spark.createDataFrame([("ＵＳＢ手指", "U S B shou3 zhi3"), ("C盘", "C pan2")], "h string, r string")
    assert [r[0] for r in t.select(dic.normalise_reading_spaces("h", "r")).collect()] == ["USB shou3 zhi3", "C pan2"]
    u = spark.createDataFrame([("國", "国"), ("人", "人"), ("x", None)], "t string, s string")
    assert [r[0] for r in u.select(dic.unified_headword("t", "s")).collect()] == ["国（國）", "人", "x"]
    entries = spark.createDataFrame([("知道",), ("不",)], "Headword string")
    found = dic.headwords_within(spark.createDataFrame([("我知道",)], "text string"), entries, "text")
    assert [r.Headword for r in found.collect()] == ["知道"]
    known = spark.createDataFrame([("知", "zhi1")], "ChineseCharacter string, Reading string")
    words = spark.createDataFrame([("知道", "zhi1 dao5")], "h string, r string")
    assert [(r.ChineseCharacter, r.entity) for r in dic.check_readings(words, known, "h", "r").collect()] == [("道", "dao5")]
