"""Dictionary search: query texts become column predicates on the driver; a search is one filter over the entries."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ASCII_LETTERS, FULL_WIDTH, col, full_width, java_quote, like_escape, substrings
from .readings import Pinyin, Reading, ReadingError, convert
from .readings import reading as reading_of

ONE, MANY = object(), object()


# ---------------------------------------------------------------- wildcards


#: The signs that searches read which aren't told others.
DEFAULT_SIGNS = {"single": "_", "multiple": "%"}


def set_default_wildcards(single: str = "_", multiple: str = "%") -> None:
    """The signs of searches made from now on."""
    DEFAULT_SIGNS.update(single=single, multiple=multiple)


@dataclass(frozen=True)
class Wildcards:
    """Signs for one and for any number of characters, and one that takes a sign literally."""

    single: str = field(default_factory=lambda: DEFAULT_SIGNS["single"])
    multiple: str = field(default_factory=lambda: DEFAULT_SIGNS["multiple"])
    escape: str = "\\"

    def parse(self, query: str) -> list:
        """Characters, ONE and MANY; a sign behind an escape is itself, and so is an escape before anything else."""
        out: list = []
        at = 0
        while at < len(query):
            c = query[at]
            if c == self.escape and query[at + 1 : at + 2] in (self.single, self.multiple, self.escape) and at + 1 < len(query):
                out.append(query[at + 1])
                at += 1
            else:
                out.append(ONE if c == self.single else MANY if c == self.multiple else c)
            at += 1
        return out

    def has(self, query: str) -> bool:
        return any(x is ONE or x is MANY for x in self.parse(query))

    def plain(self, query: str) -> str:
        """The query with escapes taken away; for queries without wildcards."""
        return "".join(x for x in self.parse(query) if isinstance(x, str))

    def like(self, query: str) -> str:
        return "".join("_" if x is ONE else "%" if x is MANY else like_escape(x) for x in self.parse(query))

    def pattern(self, query: str, one: str = ".", many: str = ".*") -> str:
        return "".join(one if x is ONE else many if x is MANY else java_quote(x) for x in self.parse(query))


# ---------------------------------------------------------------- strategies

FLAGS = {True: "(?iu)", False: ""}


@dataclass(frozen=True)
class Exact:
    """The whole column; letters may be meant as full-width ones."""

    case_insensitive: bool = False
    full_width: bool = False

    def text(self, query: str) -> str:
        return query.translate(str.maketrans(ASCII_LETTERS, FULL_WIDTH)) if self.full_width else query

    def __call__(self, c: str | Column, query: str) -> Column:
        query = self.text(query)
        return F.lower(col(c)) == query.lower() if self.case_insensitive else col(c) == query


@dataclass(frozen=True)
class Wildcard(Exact):
    signs: Wildcards = field(default_factory=Wildcards)

    def __call__(self, c: str | Column, query: str) -> Column:
        if not self.signs.has(query):
            return Exact.__call__(self, c, self.signs.plain(query))
        pattern = self.signs.like(self.text(query))
        return F.lower(col(c)).like(pattern.lower()) if self.case_insensitive else col(c).like(pattern)


@dataclass(frozen=True)
class SingleEntry:
    """One sense between slashes."""

    case_insensitive: bool = True

    def __call__(self, c: str | Column, query: str) -> Column:
        senses = F.split(F.lower(col(c)) if self.case_insensitive else col(c), "/")
        return F.array_contains(senses, query.lower() if self.case_insensitive else query)


@dataclass(frozen=True)
class WholeSense:
    """One sense between slashes, with wildcards."""

    signs: Wildcards = field(default_factory=Wildcards)
    case_insensitive: bool = True

    def __call__(self, c: str | Column, query: str) -> Column:
        if not self.signs.has(query):
            return SingleEntry(self.case_insensitive)(c, self.signs.plain(query))
        pattern = f"{FLAGS[self.case_insensitive]}^{self.signs.pattern(query)}$"
        return F.exists(senses(c), lambda x: x.rlike(pattern))


def senses(translation: str | Column) -> Column:
    """The senses of a translation: what stands between two slashes."""
    parts = F.split(col(translation), "/")
    return F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0)))


#: Stands for a space beside a parenthesis while single wildcards, which never stand for one, are matched.
_GAP = "\ue000"
_ASIDES = rf"(?:[\s{_GAP}]|\([^)]*\))+"
#: Fixed value: what introduces an example; its original and translation are set apart by two dashes.
EXAMPLE = "; Bsp.: "


def _outside(before: Column) -> Column:
    """Whether what follows some text is outside of parentheses."""
    return ~F.regexp_replace(before, r"\([^)]*\)", "").contains("(")


def _opens_example(sense: Column, place: Column) -> Column:
    """Whether the sign at a place (from 1) introduces an example."""
    rest = F.substring(sense, place, F.length(sense))
    dashes = F.locate("--", rest, len(EXAMPLE) + 2)
    return rest.startswith(EXAMPLE) & (dashes > 0) & (dashes + 1 < F.length(rest))


@dataclass(frozen=True)
class Sense:
    """A sense that is the query, without asides: parenthesised parts and space at its ends don't count.

    begins: signs inside a sense behind which the query may begin, outside of parentheses and not where an example is
    introduced. ends: signs before which it may end. signs: wildcards, if they are to be read; single ones don't stand for a space beside
    a parenthesis, and where the query begins or ends with any number of characters no aside is skipped there.
    """

    begins: str = ""
    ends: str = ""
    signs: Wildcards | None = None
    case_insensitive: bool = True

    def rest(self, sense: Column) -> Column:
        """All that a sense has from each place on where the query may begin."""
        if not self.begins:
            return F.array(sense)
        places = F.filter(F.sequence(F.lit(1), F.greatest(F.length(sense), F.lit(1))), lambda i: F.contains(F.lit(self.begins), F.substring(sense, i, 1)) & (i <= F.length(sense)) & _outside(F.substring(sense, 1, i - 1)) & ~_opens_example(sense, i))
        return F.concat(F.array(sense), F.transform(places, lambda i: F.substring(sense, i + 1, F.length(sense))))

    def __call__(self, c: str | Column, query: str) -> Column:
        wild = self.signs is not None and self.signs.has(query)
        open_left = not (wild and query.startswith(self.signs.multiple))
        open_right = not (wild and query.endswith(self.signs.multiple))
        plain = query if self.signs is None else self.signs.plain(query)
        gap = lambda text: re.sub(r"(?<=\)) | (?=\()", _GAP, text)
        body = self.signs.pattern(gap(query), f"[^{_GAP}]") if wild else java_quote(gap(plain))
        end = f"(?:$|[{java_quote(self.ends)}])" if self.ends else "$"
        pattern = f"{FLAGS[self.case_insensitive]}^{body}{f'(?:{_ASIDES})?' if open_right else ''}{end}"

        def fits(rest: Column) -> Column:
            return rest.rlike(pattern) | (F.regexp_replace(rest, "^" + _ASIDES, "").rlike(pattern) if open_left else F.lit(False))

        marked = lambda x: F.regexp_replace(x, r"(?<=\)) | (?=\()", _GAP)
        found = F.exists(senses(c), lambda x: F.exists(self.rest(x), lambda rest: fits(marked(rest))))
        if wild:
            return found
        near = F.lower(col(c)).contains(plain.lower()) if self.case_insensitive else col(c).contains(plain)
        return near & found


SIGNS = Wildcards()
WildcardTranslation = WholeSense()
SimpleTranslation = Sense()
SimpleWildcardTranslation = Sense(signs=SIGNS)
CEDICTTranslation = Sense(ends=",")
CEDICTWildcardTranslation = Sense(ends=",", signs=SIGNS)
HanDeDictTranslation = Sense(begins=",;.?!", ends=",;.?!")
HanDeDictWildcardTranslation = Sense(begins=",;.?!", ends=",;.?!", signs=SIGNS)


@dataclass(frozen=True)
class ReadingSearch:
    """The query is cut in all ways and written as the dictionary's readings; entities are set apart by spaces there.

    reading: of the query; convert: to the dictionary's entity, null if there is none. wildcards: single ones stand for an
    entity, multiple ones for any number. toneless: an entity without a tone stands for all its tones.
    """

    reading: Reading
    convert: Callable[[str], str | None] = staticmethod(lambda e: e)
    wildcards: bool = False
    toneless: bool = False
    signs: Wildcards = field(default_factory=Wildcards)

    def ways(self, query: str) -> list[list]:
        """All ways to read a query: entities, ONE and MANY."""
        parts: list = [""]
        for x in self.signs.parse(query) if self.wildcards else list(query):
            if isinstance(x, str):
                parts[-1] += x
            else:
                parts += [x, ""]
        found: list[list] = [[]]
        for p in parts:
            if not isinstance(p, str):
                found = [[*w, p] for w in found]
            elif p:
                try:
                    own = self.reading.decompositions(p)
                except ReadingError:
                    return []
                own = [[e for e in way if e.strip() and e != getattr(self.reading, "options", {}).get("pinyinApostrophe")] for way in own]
                found = [[*w, *o] for w in found for o in own]
        return found

    def entity_pattern(self, x) -> str | None:
        if x is ONE:
            return r"\S+"
        if not self.reading.is_entity(x):
            return java_quote(x)
        if self.toneless and self.reading.split(x)[1] is None:
            e = self.convert(x)
            return None if e is None else java_quote(e) + r"\d?"
        e = self.convert(x)
        return None if e is None else java_quote(e)

    def pattern(self, query: str) -> str | None:
        out = []
        for way in self.ways(query):
            body, first = "", True
            for x in way:
                if x is MANY:
                    body += r"(?:\S+ )*" if first else r"(?: \S+)*"
                    continue
                p = self.entity_pattern(x)
                if p is None:
                    break
                body += ("" if first else " ") + p
                first = False
            else:
                out.append(".*" if all(x is MANY for x in way) else body)
        return "(?iu)^(?:" + "|".join(dict.fromkeys(out)) + ")$" if out else None

    def __call__(self, c: str | Column, query: str) -> Column:
        pattern = self.pattern(query)
        return F.lit(False) if pattern is None else col(c).rlike(pattern)


@dataclass(frozen=True)
class MixedSearch:
    """Headword characters and syllables mixed: each headword character stands beside its entity as c⟂e, and a pattern over these
    pairs is sought. At least one of each must be in the query."""

    search: ReadingSearch
    han: Callable[[str], bool] = staticmethod(lambda c: ord(c) >= 0x2E80 and not (0xFF00 <= ord(c) <= 0xFF5E and not c.isalpha()))

    def __call__(self, headword: str | Column, reading: str | Column, query: str) -> Column:
        pattern = self.pattern(query)
        if pattern is None:
            return F.lit(False)
        chars, entities = F.array_remove(F.split(col(headword), ""), ""), F.split(col(reading), " ")
        pairs = F.array_join(F.zip_with(chars, entities, lambda c, e: F.concat(c, F.lit("⟂"), e)), " ")
        return (F.size(chars) == F.size(entities)) & pairs.rlike(pattern)

    def pattern(self, query: str) -> str | None:
        s, parts = self.search, [""]
        for x in s.signs.parse(query) if s.wildcards else list(query):
            if isinstance(x, str) and not self.han(x):
                parts[-1] += x
            else:
                parts += [x, ""]
        ways: list[list[tuple[str, object]]] = [[]]
        for p in parts:
            if not isinstance(p, str):
                ways = [[*w, ("sign", p)] for w in ways]
            elif len(p) == 1 and self.han(p):
                ways = [[*w, ("char", p)] for w in ways]
            elif p:
                try:
                    own = [[x for e in way if e.strip() for x in ([e] if s.reading.is_entity(e) else e)] for way in s.reading.decompositions(p)]
                except ReadingError:
                    return None
                ways = [[*w, *(("entity", e) for e in o)] for w in ways for o in own]
        out = []
        for way in ways:
            kinds = {k for k, _ in way}
            if not {"char", "entity"} <= kinds:
                continue
            body, first = "", True
            for kind, x in way:
                if x is MANY:
                    body += r"(?:\S+ )*" if first else r"(?: \S+)*"
                    continue
                p = r"\S+" if x is ONE else java_quote(x) + r"⟂\S+" if kind == "char" else None
                if kind == "entity":
                    e = s.entity_pattern(x)
                    letter = java_quote(x.upper().translate(str.maketrans(ASCII_LETTERS, FULL_WIDTH)))
                    p = rf"\S⟂{e}" if e is not None else None
                    if len(x) == 1 and not s.reading.is_entity(x):
                        p = rf"(?:{java_quote(x)}|{letter})⟂\S+"
                if p is None:
                    break
                body += ("" if first else " ") + p
                first = False
            else:
                out.append(body)
        return "(?iu)^(?:" + "|".join(dict.fromkeys(out)) + ")$" if out else None


def exact_multiple(c: str | Column, text: str) -> Column:
    """Whether a headword is any part of a text."""
    return F.lit(text).contains(col(c)) & (F.length(col(c)) > 0)


def headwords_within(texts: DataFrame, entries: DataFrame, text: str, headword: str = "Headword") -> DataFrame:
    """Entries whose headword is part of a text, for a table of texts: exploded parts and an equi-join."""
    return texts.select("*", F.explode(substrings(text)).alias(headword)).join(entries, headword)


# ---------------------------------------------------------------- dictionaries


@dataclass
class Dictionary:
    """Entries and their search strategies. headwords: the columns that hold forms of the headword."""

    entries: DataFrame
    headwords: Sequence[str] = ("Headword",)
    reading_column: str = "Reading"
    translation_column: str = "Translation"
    headword_search: Callable = Wildcard()
    reading_search: Callable | None = None
    mixed_search: MixedSearch | None = None
    translation_search: Callable = SimpleWildcardTranslation
    kana: Reading | None = None
    formats: Sequence[Callable[[DataFrame], DataFrame]] = ()
    version: DataFrame | None = None

    def release(self):
        """The release date of the table, null if it isn't known."""
        row = self.version.first() if self.version is not None else None
        return row[0] if row else None

    def formatted(self, rows: DataFrame) -> DataFrame:
        """rows after all formats, one after another."""
        return reduce(lambda found, f: f(found), self.formats, rows)

    def _run(self, condition: Column | None, limit: int | None = None, order_by: Sequence = (), exact: Column | None = None) -> DataFrame:
        rows = self.entries.distinct()
        rows = rows if condition is None else rows.where(condition)
        if order_by:
            rows = rows.orderBy(*order_by)
        if limit is not None:
            rows = rows.limit(limit)
        return self.formatted(rows if exact is None else rows.where(exact))

    def get_all(self, limit: int | None = None, order_by: Sequence = ()) -> DataFrame:
        return self._run(None, limit, order_by)

    def headword_condition(self, query: str, forms: Sequence[str] | None = None) -> Column:
        return reduce(Column.__or__, [F.coalesce(self.headword_search(c, query), F.lit(False)) for c in forms or self.headwords])

    def reading_condition(self, query: str) -> Column:
        found = F.lit(False)
        if self.reading_search:
            found = found | F.coalesce(self.reading_search(self.reading_column, query), F.lit(False))
        if self.mixed_search:
            for c in self.headwords:
                found = found | F.coalesce(self.mixed_search(c, self.reading_column, query), F.lit(False))
        return found

    def translation_condition(self, query: str) -> Column:
        return F.coalesce(self.translation_search(self.translation_column, query), F.lit(False))

    def get_for_headword(self, query: str, forms: Sequence[str] | None = None, **options) -> DataFrame:
        return self._run(self.headword_condition(query, forms), **options)

    def get_for_reading(self, query: str, **options) -> DataFrame:
        return self._run(self.reading_condition(query), **options)

    def get_for_translation(self, query: str, **options) -> DataFrame:
        return self._run(self.translation_condition(query), **options)

    def get_for(self, query: str, **options) -> DataFrame:
        return self._run(self.headword_condition(query) | self.reading_condition(query) | self.translation_condition(query), **options)


def limit_then_filter(rows: DataFrame, coarse: Column, exact: Column, limit: int, order_by: Sequence) -> DataFrame:
    """The first rows that a coarse condition lets through, and of these the ones that are exact."""
    return rows.where(coarse).orderBy(*order_by).limit(limit).where(exact)


def pinyin_search(reading: Pinyin, wildcards: bool = True, toneless: bool = True) -> ReadingSearch:
    """For dictionaries that write Pinyin with numbers: queries in the given style."""
    numbers = Pinyin((), toneMarkType="numbers", erhua="ignore")

    def convert(entity: str) -> str | None:
        plain, tone = reading.split(entity)
        return numbers.tonal(plain.lower(), tone if tone in numbers.tones() else None).replace("ü", "u:")

    return ReadingSearch(reading, convert, wildcards, toneless)


def edict(entries: DataFrame, reading: Reading | None = None) -> Dictionary:
    """Headword, Reading in Kana, Translation."""
    return Dictionary(entries, reading_search=Wildcard(True), translation_search=SimpleWildcardTranslation, kana=reading)


def cedict(entries: DataFrame, reading: Pinyin, headword: str = "b") -> Dictionary:
    """Traditional and simplified headwords, Pinyin with numbers. headword: s, t or b, which forms are looked for."""
    if headword not in FORMS_OF:
        raise ValueError(f"no headword forms {headword!r}")
    search = pinyin_search(reading)
    return Dictionary(entries, FORMS_OF[headword], headword_search=Wildcard(full_width=True), reading_search=search, mixed_search=MixedSearch(search), translation_search=CEDICTWildcardTranslation)


def handedict(entries: DataFrame, reading: Pinyin, headword: str = "b") -> Dictionary:
    made = cedict(entries, reading, headword)
    made.headword_search, made.translation_search = Wildcard(), HanDeDictWildcardTranslation
    return made


def cedictgr(entries: DataFrame, reading: Reading) -> Dictionary:
    """One headword, readings in Gwoyeu Romatzyh."""
    search = ReadingSearch(reading, wildcards=True)
    return Dictionary(entries, reading_search=search, mixed_search=MixedSearch(search), translation_search=CEDICTWildcardTranslation)


FORMS_OF = {"b": ("HeadwordTraditional", "HeadwordSimplified"), "t": ("HeadwordTraditional",), "s": ("HeadwordSimplified",)}
#: Names of dictionaries -> how they are made of entries and a reading, and which reading that is.
DICTIONARIES: dict[str, tuple[Callable[..., Dictionary], str]] = {
    "EDICT": (edict, "Kana"), "CEDICT": (cedict, "Pinyin"), "CEDICTGR": (cedictgr, "GR"), "HanDeDict": (handedict, "Pinyin"), "CFDICT": (handedict, "Pinyin"),
}


def publish_dictionary(name: str, make: Callable[..., Dictionary], reading: str) -> None:
    """Adds a dictionary of one's own."""
    DICTIONARIES[name] = make, reading


def available_dictionaries(catalog) -> list[str]:
    """The dictionaries whose table is in a catalog."""
    return [n for n in DICTIONARIES if n in catalog]


def dictionary(catalog, name: str, reading: Reading | None = None, **options) -> Dictionary:
    """A dictionary over its table in a catalog, with the reading of its entries, or one given."""
    if name not in DICTIONARIES:
        raise ValueError(f"no dictionary {name!r}")
    make, kind = DICTIONARIES[name]
    style = {"toneMarkType": "numbers", "erhua": "ignore"} if kind == "Pinyin" else {}
    made = make(catalog[name], reading or reading_of(kind, **style), **options)
    made.version = catalog["Version"].where(F.col("TableName") == name).select("ReleaseDate") if "Version" in catalog else None
    return made


# ---------------------------------------------------------------- what results look like


def single_column(column: str, strategy: Callable[[Column], Column]) -> Callable[[DataFrame], DataFrame]:
    """A format that works on one column."""
    return lambda rows: rows.withColumn(column, strategy(F.col(column)))


def converted_readings(converter, column: str = "Reading") -> Callable[[DataFrame], DataFrame]:
    """A format that writes readings in another way; null where they can't be."""
    return single_column(column, lambda c: convert(c, converter)["value"])


def reading_spaces(headword: str, column: str = "Reading") -> Callable[[DataFrame], DataFrame]:
    """A format that puts single letters of readings together; see normalise_reading_spaces()."""
    return lambda rows: rows.withColumn(column, normalise_reading_spaces(headword, column))


def unified(traditional: str = "HeadwordTraditional", simplified: str = "HeadwordSimplified", out: str = "Headword") -> Callable[[DataFrame], DataFrame]:
    """A format with one column for both forms of the headword."""
    others = lambda rows: [c for c in rows.columns if c not in (traditional, simplified)]
    return lambda rows: rows.select(unified_headword(traditional, simplified).alias(out), *others(rows))


def unified_headword(traditional: str, simplified: str) -> Column:
    """One form if both are the same, else simplified（traditional）."""
    s, t = F.col(simplified), F.col(traditional)
    return F.when(s.isNull() | (s == t), t).otherwise(F.concat(s, F.lit("（"), t, F.lit("）")))


def normalise_reading_spaces(headword: str | Column, reading: str | Column) -> Column:
    """Single letters that stand for the headword's letters are put together: U S B shou3 zhi3 as USB shou3 zhi3."""
    h, r = col(headword), F.split(col(reading), " ")

    def sign(e: Column, i: Column) -> Column:
        c = F.substring(h, i + 1, 1)
        return (F.length(e) == 1) & ((c == e) | (c == full_width(F.upper(e))))

    marked = F.transform(r, lambda e, i: F.concat(e, F.when(sign(e, i) & (i + 1 < F.size(r)) & F.coalesce(sign(F.get(r, i + 1), i + 1), F.lit(False)), F.lit("")).otherwise(F.lit(" "))))
    return F.rtrim(F.array_join(marked, ""))


def check_readings(entries: DataFrame, known: DataFrame, headword: str, reading: str) -> DataFrame:
    """Characters of headwords beside a reading that isn't known for them: (headword, reading, ChineseCharacter, entity)."""
    chars, entities = F.array_remove(F.split(headword, ""), ""), F.split(reading, " ")
    pairs = entries.where(F.size(chars) == F.size(entities)).select(headword, reading, F.explode(F.arrays_zip(chars.alias("c"), entities.alias("e"))).alias("p"))
    each = pairs.select(headword, reading, F.col("p.c").alias("ChineseCharacter"), F.lower(F.col("p.e")).alias("entity"))
    return each.join(known.select("ChineseCharacter", F.col("Reading").alias("entity")), ["ChineseCharacter", "entity"], "left_anti").select(headword, reading, "ChineseCharacter", "entity")


def check_variants(entries: DataFrame, variant: DataFrame, traditional: str = "HeadwordTraditional", simplified: str = "HeadwordSimplified") -> DataFrame:
    """Places where a simplified headword's character isn't a known simplified form of the traditional one's.

    (traditional, simplified, place from 0, character, as), and place null for headwords of different lengths. A character without
    simplified variants, or that is a variant of its own form, stands for itself too.
    """
    t, s = F.array_remove(F.split(traditional, ""), ""), F.array_remove(F.split(simplified, ""), "")
    rows = entries.where(F.col(simplified).isNotNull() & (F.col(traditional) != F.col(simplified))).select(F.col(traditional).alias("traditional"), F.col(simplified).alias("simplified"), t.alias("t"), s.alias("s")).distinct()
    unequal = rows.where(F.size("t") != F.size("s")).select("traditional", "simplified", F.lit(None).cast("int").alias("place"), F.lit(None).cast("string").alias("character"), F.lit(None).cast("string").alias("as"))
    each = rows.where(F.size("t") == F.size("s")).select("traditional", "simplified", F.posexplode(F.arrays_zip("t", "s")).alias("place", "p"))
    each = each.select("traditional", "simplified", "place", F.col("p.t").alias("character"), F.col("p.s").alias("as"))
    forms = variant.where(F.col("Type") == "S").select(F.col("ChineseCharacter").alias("character"), F.col("Variant").alias("as")).distinct()
    back = variant.where(F.col("Type").isin("M", "P")).select(F.col("Variant").alias("character"), F.col("ChineseCharacter").alias("as"))
    own = forms.join(back.select(F.col("as").alias("character"), F.col("character").alias("as")), ["character", "as"], "left_semi").select("character", F.col("character").alias("as"))
    known = forms.union(own).distinct()
    wrong = each.join(known, ["character", "as"], "left_anti").join(forms.select("character", F.lit(True).alias("_has")).distinct(), "character", "left")
    wrong = wrong.where(F.col("_has") | (F.col("character") != F.col("as")))
    return wrong.select("traditional", "simplified", "place", "character", "as").unionByName(unequal)
