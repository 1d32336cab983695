import pytest
from pyspark.sql import functions as F

from hanlake.operators import readings as rd

PLAIN = "a ai an ang ao ba bei bo dao de deng duo e er fu gu guo ha hai he ji jie ju jiao lao li lü ma me men mi mo n ng nan nü ni qi qian qing ren shi shui si tai ti tian wang wo xi xian xiao xie yi yin yu zhi zhong an".split()
WG = {"kuo": "guo", "yü": "yu", "ssŭ": "si", "ma": "ma", "ch’ien": "qian", "t’ien": "tian", "an": "an", "mên": "men", "ho": "he", "hê": "he"}


@pytest.fixture(scope="module", autouse=True)
def inventory():
    old = dict(rd.INVENTORY)
    rd.register_inventory("Pinyin", PLAIN)
    rd.register_inventory("WadeGiles", WG)
    rd.register_inventory("Jyutping", ["gwong", "zau", "waa", "sik", "aa"])
    rd.register_inventory("CantoneseYale", ["gwong", "jau", "wa", "sik", "a", "m", "ng"])
    yield
    rd.INVENTORY.clear()
    rd.INVENTORY.update(old)


def fails(error, f, *args):
    with pytest.raises(error) as found:
        f(*args)
    assert type(found.value) is error


def test_pinyin_cuts():
    r = rd.reading("Pinyin")
    assert r.decompose("tiān'ānmén") == ["tiān", "'", "ān", "mén"]
    assert r.decompose("xīān") == ["xī", "ān"] and r.decompose("xian") == ["xian"]
    fails(rd.AmbiguousDecompositionError, r.decompose, "tiananmen")
    n = rd.reading("Pinyin", toneMarkType="numbers")
    assert n.decompose("tian1'an1men2") == ["tian1", "'", "an1", "men2"] and n.decompose("xīān") == ["xīān"]
    assert n.segment("xian") == [["xi", "a", "n"], ["xi", "an"], ["xian"]] == rd.reading("Pinyin").decompositions("xian")
    fails(rd.DecompositionError, rd.reading("Pinyin", strictSegmentation=True).segment, "qqq")
    with pytest.raises(ValueError):
        rd.reading("Pinyin", colour="red")
    with pytest.raises(rd.UnsupportedError):
        rd.reading("Klingon")


def test_tones_go_both_ways():
    for r in (rd.reading("Pinyin"), rd.reading("Pinyin", toneMarkType="numbers"), rd.reading("WadeGiles"), rd.reading("WadeGiles", toneMarkType="numbers", neutralToneMark="zero"), rd.reading("Jyutping"), rd.reading("CantoneseYale"), rd.reading("CantoneseYale", toneMarkType="numbers")):
        for plain in r.plain:
            for tone in r.tones():
                if r.tone_fits(plain, tone) and tone is not None:
                    e = r.tonal(plain, tone)
                    p, t = r.split(e)
                    assert p == plain and (t == tone or r.tonal(plain, t) == e), (r.name, plain, tone, e)
                    assert r.is_entity(e) and r.decompose(e) == [e]
    assert rd.reading("Pinyin").tonal("lü", 3) == "lǚ" and rd.reading("Pinyin").tonal("duo", 4) == "duò" and rd.reading("Pinyin").tonal("jiao", 3) == "jiǎo"
    fails(rd.InvalidEntityError, rd.reading("Pinyin").tonal, "ma", 7)
    assert not rd.reading("Jyutping").is_entity("sik2") and rd.reading("Jyutping").is_entity("sik3")


def test_pairs_round_trip():
    r = rd.reading("Pinyin", toneMarkType="numbers", erhua="ignore")
    some = [e for e in r.entities() if e[-1] in "14"][::3]
    for a in some:
        for b in some:
            text = r.compose([a, b])
            assert r.without_apostrophes(r.decompose(text)) == [a, b]
    m = rd.reading("Pinyin", erhua="ignore")
    some = m.entities()[::4]
    for a in some:
        for b in some:
            assert m.without_apostrophes(m.decompose(m.compose([a, b]))) == [a, b], (a, b)


def test_pinyin_styles():
    def made(text, source, target):
        return rd.respelling(rd.reading("Pinyin", **source), rd.reading("Pinyin", **target)).convert(text)

    numbers = {"toneMarkType": "numbers"}
    assert made("xīān", {}, {}) == "xī'ān"
    assert made("lao3shi1", numbers, {}) == "lǎoshī"
    assert made("nv3hai2", numbers | {"yVowel": "v"}, {}) == "nǚhái"
    assert made("Zhi1shi5", numbers, {"shortenedLetters": True}) == "Ẑīŝi"
    assert made("LAO3SHI1, Ma1!", numbers, {}) == "LǍOSHĪ, Mā!"
    fails(rd.AmbiguousConversionError, made, "lao", numbers, {})


def test_wade_giles():
    rows = [(w, p, 1 if w == "ho" else 0) for w, p in WG.items()]
    wg, py = rd.reading("WadeGiles"), rd.reading("Pinyin")
    assert rd.wade_giles_to_pinyin(rows, wg, py).convert("kuo³-yü²") == "guǒyú"
    assert rd.wade_giles_to_pinyin(rows, wg, py).convert("KUO³-YÜ²") == "GUǑYÚ"
    assert rd.wade_giles_to_pinyin(rows, rd.reading("WadeGiles", toneMarkType="numbers"), py).convert("ssŭ1ma3 ch’ien1") == "sīmǎ qiān"
    there = rd.pinyin_to_wade_giles(rows, py, rd.reading("WadeGiles", toneMarkType="numbers"))
    assert there.convert("tiān'ānmén") == "t’ien1-an1-mên2"
    fails(rd.AmbiguousConversionError, there.convert, "hé")
    fails(rd.ConversionError, there.convert, "lǎo")


def test_cantonese():
    pairs = [("gwong", "gwong"), ("zau", "jau"), ("waa", "wa"), ("sik", "sik")]
    j, y = rd.reading("Jyutping"), rd.reading("CantoneseYale")
    assert j.decompose("gwong2zau1waa2") == ["gwong2", "zau1", "waa2"]
    assert rd.jyutping_to_yale(pairs, j, y).convert("gwong2zau1waa2") == "gwóngjāuwá"
    assert rd.jyutping_to_yale(pairs, j, y).convert("GWONG2ZAU1WAA2") == "GWÓNGJĀUWÁ"
    assert rd.yale_to_jyutping(pairs, y, j).convert("gwóngjāuwá") == "gwong2zau1waa2"
    assert y.tonal("wa", "4thTone") == "wàh" and y.split("wàh") == ("wa", "4thTone") and y.split("gwohng") == ("gwong", "6thTone")


def test_braille_and_ipa():
    parts = {"lao": ("l", "ao"), "shi": ("sh", "i"), "mo": ("m", "o"), "me": ("m", "e"), "gu": ("g", "u"), "ju": ("g", "ü")}
    initials, finals = {"l": "⠇", "sh": "⠱", "m": "⠍", "g": "⠛"}, {"ao": "⠖", "i": "⠊", "o": "⠢", "e": "⠢", "u": "⠥", "ü": "⠬"}
    numbers = rd.reading("Pinyin", toneMarkType="numbers")
    b = rd.MandarinBraille()
    assert rd.PinyinBraille(numbers, b, parts, initials, finals).convert("lao3shi1") == "⠇⠖⠄⠱⠁"
    assert rd.PinyinBraille(rd.reading("Pinyin"), b, parts, initials, finals).convert("mò, mè") == "⠍⠢⠆⠐ ⠍⠢⠆"
    back = rd.PinyinBraille(b, numbers, parts, initials, finals)
    assert [back.convert(x) for x in ("⠛⠥", "⠛⠥⠁", "⠛⠬")] == ["gu5", "gu1", "ju5"]
    fails(rd.AmbiguousConversionError, back.convert, "⠍⠢⠆")
    fails(rd.AmbiguousConversionError, back.convert, "⠰⠆")
    rd.register_inventory("MandarinIPA", ["lau", "ʂʅ"])
    assert rd.pinyin_to_ipa([("lao", "lau", ""), ("shi", "ʂʅ", "")], numbers, rd.reading("MandarinIPA")).convert("lao3shi1") == "lau˨˩.ʂʅ˥˥"
    s = rd.ShanghaineseIPA(["ɦi", "ɦɑ̃", "ʦɤ"])
    assert s.decompose("ɦi⁵³ ɦɑ̃⁵³.ʦɤ") == ["ɦi⁵³", " ", "ɦɑ̃⁵³", ".", "ʦɤ"]
    assert rd.READINGS["Hangul"]().decompose("ab한국어c") == ["ab", "한", "국", "어", "c"]


def test_erhua():
    def made(text, source, target):
        return rd.respelling(rd.reading("Pinyin", **source), rd.reading("Pinyin", **target)).convert(text)

    one, two = {"erhua": "oneSyllable"}, {"erhua": "twoSyllables"}
    assert made("mār", two, one) == "mār" == made("mār", one, two) and made("nǚhái", one, two) == "nǚhái"
    numbers = {"toneMarkType": "numbers"}
    assert made("xian1r5", numbers | two, numbers | one) == "xianr1" and made("xianr1", numbers | one, numbers | two) == "xian1r5"
    assert made("er2", numbers | two, numbers | one) == "er2"


def test_ipa_marks():
    styles = {"ipaToneBar": "ma˧˥", "chaoDigits": "ma35", "superscriptChaoDigits": "ma³⁵", "numbers": "ma2", "superscriptNumbers": "ma²"}
    for kind, want in styles.items():
        r = rd.MandarinIPA(["ma"], toneMarkType=kind)
        assert r.tonal("ma", "2ndTone") == want and r.split(want) == ("ma", "2ndTone")
    c = rd.CantoneseIPA(["sɪk", "waː"], stopTones="explicit")
    assert c.tonal("sɪk", "HighLevel") == "sɪk˥" and c.split("sɪk˥") == ("sɪk", "HighLevel") and c.split("waː˥˥") == ("waː", "HighLevel")
    assert not c.tone_fits("sɪk", "LowRising") and c.tone_fits("waː", "LowRising")
    s = rd.ShanghaineseIPA(["gəˀ", "ɦi"], flags={"gəˀ": "VG", "ɦi": "V"}, constrainEntering=True, constrainToneCategories=True)
    assert s.is_entity("gəˀ¹²") and not s.is_entity("gəˀ⁵³") and not s.is_entity("ɦi⁵³") and s.is_entity("ɦi²³")
    with pytest.raises(ValueError):
        rd.MandarinIPA(["ma"], toneMarkType="colours").tones()


def test_registry_and_guess():
    ways = rd.Conversions()
    rows = [(w, p, 0) for w, p in WG.items() if w != "ho"]
    ways.publish("WadeGiles", "Pinyin", lambda a, b: rd.wade_giles_to_pinyin(rows, a, b))
    ways.publish("Pinyin", "MandarinIPA", lambda a, b: rd.pinyin_to_ipa([("guo", "kuo", ""), ("yu", "y", "")], a, b))
    rd.register_inventory("MandarinIPA", ["kuo", "y"])
    assert ways.supports("WadeGiles", "MandarinIPA") and not ways.supports("MandarinIPA", "Pinyin")
    assert ways.get(rd.reading("WadeGiles", toneMarkType="numbers"), rd.reading("MandarinIPA")).convert("kuo3-yü2") == "kuo˨˩.y˧˥"
    fails(rd.UnsupportedError, ways.get, rd.reading("MandarinIPA"), rd.reading("Pinyin"))
    styles = [rd.reading("Pinyin", toneMarkType=t) for t in ("diacritics", "numbers")]
    assert rd.guess_options("lao3shi1", styles)["toneMarkType"] == "numbers" and rd.guess_options("lǎoshī", styles)["toneMarkType"] == "diacritics"


def test_columns(spark):
    rows = spark.createDataFrame([("lao3shi1",), ("lao",), (None,)], "t string")
    numbers = rd.reading("Pinyin", toneMarkType="numbers")
    out = rows.select(rd.convert(F.col("t"), rd.respelling(numbers, rd.reading("Pinyin"))).alias("c"), rd.is_entity(F.col("t"), numbers).alias("e"), rd.decompose(F.col("t"), numbers).alias("d"), rd.split_tone(F.col("t"), numbers).alias("s")).collect()
    assert [(r.c.value, r.c.error) for r in out] == [("lǎoshī", None), (None, "AmbiguousConversionError"), (None, None)]
    assert [r.e for r in out] == [False, True, None] and out[0].d.value == ["lao3", "shi1"] and out[1].s.value == ["lao", None]
    assert rows.limit(1).select(rd.compose(F.array(F.lit("xi1"), F.lit("an1")), numbers).alias("c")).first().c.value == "xi1'an1"


def test_stream(spark, tmp_path):
    from hanlake.streaming import columns

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("lao3shi1\nzzz3\n")
    made = rd.respelling(rd.reading("Pinyin", toneMarkType="numbers"), rd.reading("Pinyin"))
    stream = columns.convert_stream(columns.read_texts(spark, str(tmp_path / "in")), "value", made)
    columns.write_parquet(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(60)
    assert sorted((r.value, r.converted) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("lao3shi1", "lǎoshī"), ("zzz3", "zzz3")]
