"""Readings: cutting strings into syllables, tones, writing styles, and converting between readings.

A reading is a small Python object made on the driver from its options and its inventory of plain syllables, and sent to the
executors with the vectorised functions below. Results are structs (value, error): an error is the name of what went wrong.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import product

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import SCRIPT_RANGES


class ReadingError(ValueError):
    """What can't be read, written or converted."""


class DecompositionError(ReadingError):
    pass


class AmbiguousDecompositionError(DecompositionError):
    pass


class InvalidEntityError(ReadingError):
    pass


class CompositionError(ReadingError):
    pass


class ConversionError(ReadingError):
    pass


class AmbiguousConversionError(ConversionError):
    pass


class UnsupportedError(ReadingError):
    pass


def nfc(s: str) -> str:
    return unicodedata.normalize("NFC", s)


def nfd(s: str) -> str:
    return unicodedata.normalize("NFD", s)


def titlecase(s: str) -> str:
    m = re.match(r"^([.˳｡￮₀ₒ]?\W*)(\w)(.*)$", s.lower(), re.S)
    return m[1] + m[2].upper() + m[3] if m else s.lower()


def like_case(source: str, target: str) -> str:
    """target in the case of source."""
    letters = sum(c.isalpha() for c in source)
    if source.isupper() and letters > 1:
        return target.upper()
    if source != source.lower() and titlecase(source) == source:
        return titlecase(target)
    return target.upper() if source.isupper() else target


class Reading:
    """A reading of single characters or of syllables. Subclasses say how tones are written."""

    name = ""
    defaults: Mapping[str, object] = {}
    letters = "a-zêüŋẑĉŝ"
    separator = ""

    def __init__(self, plain: Iterable[str] = (), **options):
        if unknown := set(options) - set(self.defaults) - {"strictSegmentation", "case"}:
            raise ValueError(f"{self.name} has no options {sorted(unknown)}")
        self.options = {"strictSegmentation": False, "case": "both"} | dict(self.defaults) | options
        self.plain = frozenset(self.respelled(nfc(p)) for p in plain)
        self.longest = 0
        self._entity = lru_cache(1 << 16)(self._is_entity)

    def __reduce__(self):
        return _remake, (type(self), self.plain, self.options)

    def respelled(self, plain: str) -> str:
        """A plain syllable of the inventory in the spelling of the options."""
        return plain

    # tones

    def tones(self) -> list:
        return [None]

    def tonal(self, plain: str, tone) -> str:
        return plain

    def split(self, entity: str) -> tuple[str, object]:
        return entity, None

    def tone_fits(self, plain: str, tone) -> bool:
        return tone in self.tones()

    # entities

    def _is_entity(self, entity: str) -> bool:
        if not entity or self.options["case"] == "lower" and entity != entity.lower():
            return False
        try:
            plain, tone = self.split(entity)
        except InvalidEntityError:
            return False
        return plain.lower() in self.plain and self.tone_fits(plain.lower(), tone)

    def is_entity(self, entity: str) -> bool:
        return self._entity(entity)

    def is_plain(self, entity: str) -> bool:
        return nfc(entity).lower() in self.plain

    def entities(self) -> list[str]:
        """All syllables with all tones that they may have."""
        return sorted({self.tonal(p, t) for p in self.plain for t in self.tones() if self.tone_fits(p, t)})

    def characters(self) -> set[str]:
        """The letters that syllables are written with."""
        return {c for e in self.entities() for c in nfc(e)}

    # cutting

    def run_pattern(self) -> str:
        return rf"(?i:[{self.letters}]|[̀-ͯ])+[1-6¹²³⁴⁵⁶]?"

    def segment(self, run: str) -> list[list[str]]:
        """All ways to cut a run of letters into syllables, shorter first syllables first; [run] if there is none."""
        longest = max((len(nfd(p)) for p in self.plain), default=0) + 3
        ways: dict[int, list[list[str]]] = {len(run): [[]]}
        for at in range(len(run) - 1, -1, -1):
            ways[at] = [[run[at:end], *rest] for end in range(at + 1, min(len(run), at + longest) + 1) if ways.get(end) and self.is_entity(run[at:end]) for rest in ways[end]]
        if ways[0]:
            return ways[0]
        if self.options["strictSegmentation"]:
            raise DecompositionError(f"{run!r} can't be cut")
        return [[run]]

    def runs(self, text: str) -> list[tuple[bool, str]]:
        """(is it a run of letters, text) in order."""
        out, at = [], 0
        for m in re.finditer(self.run_pattern(), text):
            if m.start() > at:
                out.append((False, text[at : m.start()]))
            out.append((True, m[0]))
            at = m.end()
        return out + ([(False, text[at:])] if at < len(text) else [])

    def decompositions(self, text: str) -> list[list[str]]:
        """All ways to cut a text; what isn't letters stays as it is."""
        merged: list[list[list[str]]] = []
        letters = ""
        for inside, part in self.runs(nfc(text)):
            if inside:
                letters += part
            else:
                merged += [self.segment(letters)] if letters else []
                merged.append([[part]])
                letters = ""
        merged += [self.segment(letters)] if letters else []
        return [[e for way in ways for e in way] for ways in product(*merged)]

    def mergeable(self, entities: list[str]) -> bool:
        """Whether two neighbours make one syllable."""
        return any(self.is_entity(a) and self.is_entity(b) and self.is_entity(a + b) for a, b in zip(entities, entities[1:]))

    def strict(self, entities: list[str]) -> bool:
        return False

    def decompose(self, text: str) -> list[str]:
        """The one way to cut a text: by itself, without mergeable neighbours, or by strict rules."""
        chosen: list[str] = []
        letters, parts = "", []
        for inside, part in [*self.runs(nfc(text)), (False, "")]:
            if inside:
                letters += part
                continue
            parts += [(True, letters)] if letters else []
            parts += [(False, part)] if part else []
            letters = ""
        for inside, part in parts:
            ways = self.segment(part) if inside else [[part]]
            if len(ways) > 1:
                apart = [w for w in ways if not self.mergeable(w)]
                ways = apart if len(apart) == 1 else [w for w in apart or ways if self.strict(w)]
                if not ways:
                    raise AmbiguousDecompositionError(f"{part!r} can be cut in several ways")
            chosen += ways[0]
        return chosen

    def compose(self, entities: list[str]) -> str:
        out, last = [], None
        for e in entities:
            if last is not None and self.is_entity(last) and self.is_entity(e):
                out.append(self.between(last, e))
            elif last and e and self.is_entity(last) != self.is_entity(e):
                self.check_fuse(last, e)
            out.append(e)
            last = e
        return "".join(out)

    def between(self, last: str, following: str) -> str:
        return self.separator

    def check_fuse(self, last: str, following: str) -> None:
        """Whether a syllable and other text stay apart."""
        if not last[-1].isdigit() and last[-1] in self.characters() and following[0] in self.characters():
            raise CompositionError(f"{last!r} and {following!r} can't be told apart")


def _remake(kind, plain, options):
    made = kind((), **options)
    made.plain = plain
    return made


class Numbered(Reading):
    """Tones as a number behind the syllable, or none."""

    defaults = {"toneMarkType": "numbers", "missingToneMark": "noinfo"}
    last_tone = 6

    def tones(self) -> list:
        if self.options["toneMarkType"] == "none":
            return [None]
        return [*range(1, self.last_tone + 1), *([None] if self.options["missingToneMark"] == "noinfo" else [])]

    def tonal(self, plain: str, tone) -> str:
        if tone not in self.tones():
            raise InvalidEntityError(f"{plain!r} has no tone {tone!r}")
        return plain if tone is None else f"{plain}{tone}"

    def split(self, entity: str) -> tuple[str, object]:
        entity = nfc(entity)
        if self.options["toneMarkType"] == "none":
            return entity, None
        if m := re.fullmatch(rf"(.*?)([1-{self.last_tone}])", entity):
            return m[1], int(m[2])
        if self.options["missingToneMark"] == "ignore":
            raise InvalidEntityError(f"{entity!r} has no tone")
        return entity, None


class Pinyin(Numbered):
    name = "Pinyin"
    defaults = {"toneMarkType": "diacritics", "missingToneMark": "noinfo", "strictDiacriticPlacement": False, "yVowel": "ü", "shortenedLetters": False, "pinyinApostrophe": "'", "erhua": "twoSyllables"}
    marks = "̄́̌̀"
    last_tone = 5
    #: Spellings of the shortened letters.
    short = {"zh": "ẑ", "ch": "ĉ", "sh": "ŝ", "ng": "ŋ"}

    def __init__(self, plain: Iterable[str] = (), **options):
        super().__init__(plain, **options)
        if self.options["erhua"] == "oneSyllable":
            self.plain |= {p + "r" for p in self.plain if p not in ("e", "er", "r")}
        elif self.options["erhua"] == "twoSyllables" and self.plain:
            self.plain |= {"r"}

    def respelled(self, plain: str) -> str:
        if self.options["shortenedLetters"]:
            for long, short in self.short.items():
                plain = plain.replace(long, short)
        return plain.replace("ü", str(self.options["yVowel"]))

    def run_pattern(self) -> str:
        y = re.escape(str(self.options["yVowel"]))
        return rf"(?i:{y}|[{self.letters}āáǎàēéěèīíǐìōóǒòūúǔùǖǘǚǜńňǹḿ]|[̀-ͯ])+[1-5]?"

    def tones(self) -> list:
        if self.options["toneMarkType"] == "none":
            return [None]
        return [1, 2, 3, 4, 5, *([None] if self.options["toneMarkType"] == "numbers" and self.options["missingToneMark"] == "noinfo" else [])]

    def _nucleus(self, plain: str) -> tuple[int, int]:
        """Where the nucleus begins and ends: the vowels, or a syllabic nasal."""
        low = plain.lower()
        if m := re.search("[aeiouêüv]+", low):
            start, end = m.span()
            if end - start > 1 and low[start] in "iuüv" and low[start + 1] in "aeoê":
                start += 1
            return start, end
        m = re.search("[nmŋr]", low)
        if not m:
            raise InvalidEntityError(f"{plain!r} has no vowel")
        return m.span()

    def tonal(self, plain: str, tone) -> str:
        if self.options["toneMarkType"] != "diacritics":
            if tone == 5 and self.options["missingToneMark"] == "fifth":
                return plain
            return super().tonal(plain, tone)
        if tone not in self.tones():
            raise InvalidEntityError(f"{plain!r} has no tone {tone!r}")
        plain = nfc(plain)
        if tone == 5:
            return plain
        start, end = self._nucleus(plain)
        # several vowels: on a, e or o if it comes first, else on the second one
        at = start + (1 if end - start > 1 and plain[start].lower() not in "aeoê" else 0)
        return nfc(plain[: at + 1] + self.marks[tone - 1] + plain[at + 1 :])

    def split(self, entity: str) -> tuple[str, object]:
        if self.options["toneMarkType"] != "diacritics":
            plain, tone = super().split(entity)
            return plain, 5 if tone is None and self.options["missingToneMark"] == "fifth" and self.options["toneMarkType"] == "numbers" else tone
        parts = nfd(entity)
        at = [i for i, c in enumerate(parts) if c in self.marks]
        if len(at) > 1:
            raise InvalidEntityError(f"{entity!r} has several tone marks")
        if not at:
            return nfc(entity), 5
        plain, tone = nfc(parts[: at[0]] + parts[at[0] + 1 :]), self.marks.index(parts[at[0]]) + 1
        if self.options["strictDiacriticPlacement"] and self.tonal(plain, tone) != nfc(entity):
            raise InvalidEntityError(f"{entity!r} has its mark in the wrong place")
        return plain, tone

    def needs_apostrophe(self, last: str, following: str) -> bool:
        plain = self.split(following)[0].lower()
        if plain == "r":
            return self.split(last)[0].lower() == "e"
        return plain[0] in "aeo" or plain in ("n", "ng", "nr", "ngr", "ê", "ŋ", "ŋr")

    def between(self, last: str, following: str) -> str:
        return str(self.options["pinyinApostrophe"]) if self.needs_apostrophe(last, following) else ""

    def strict(self, entities: list[str]) -> bool:
        return not any(self.is_entity(a) and self.is_entity(b) and self.needs_apostrophe(a, b) for a, b in zip(entities, entities[1:]))

    def without_apostrophes(self, entities: list[str]) -> list[str]:
        mark = self.options["pinyinApostrophe"]
        return [e for i, e in enumerate(entities) if not (e == mark and 0 < i < len(entities) - 1 and self.is_entity(entities[i - 1]) and self.is_entity(entities[i + 1]))]


class WadeGiles(Numbered):
    name = "WadeGiles"
    defaults = {"toneMarkType": "superscriptNumbers", "missingToneMark": "noinfo", "neutralToneMark": "none", "wadeGilesApostrophe": "’", "diacriticE": "ê", "zeroFinal": "ŭ", "umlautU": "ü", "useInitialSz": False}
    letters = "a-zêüŭ’'‘´"
    separator = "-"
    last_tone = 5
    upper = dict(zip("0123456", "⁰¹²³⁴⁵⁶"))

    def respelled(self, plain: str) -> str:
        if self.options["useInitialSz"] and plain == "ssŭ":
            plain = "szŭ"
        for mark, option in (("’", "wadeGilesApostrophe"), ("ê", "diacriticE"), ("ŭ", "zeroFinal"), ("ü", "umlautU")):
            plain = plain.replace(mark, str(self.options[option]))
        return plain

    def run_pattern(self) -> str:
        return rf"(?i:[{self.letters}]|{re.escape(str(self.options['wadeGilesApostrophe']))})+[0-5⁰¹²³⁴⁵]?"

    def split(self, entity: str) -> tuple[str, object]:
        entity = nfc(entity)
        if self.options["toneMarkType"] == "none":
            return entity, None
        digits = "012345" if self.options["toneMarkType"] == "numbers" else "⁰¹²³⁴⁵"
        if entity and entity[-1] in digits:
            return entity[:-1], digits.index(entity[-1]) or 5
        if self.options["neutralToneMark"] == "none" and self.options["missingToneMark"] != "ignore":
            return entity, 5 if self.options["missingToneMark"] == "fifth" else None
        if self.options["missingToneMark"] == "ignore":
            raise InvalidEntityError(f"{entity!r} has no tone")
        return entity, None

    def tonal(self, plain: str, tone) -> str:
        if tone not in self.tones():
            raise InvalidEntityError(f"{plain!r} has no tone {tone!r}")
        if tone is None or tone == 5 and self.options["neutralToneMark"] == "none":
            return plain
        mark = "0" if tone == 5 and self.options["neutralToneMark"] == "zero" else str(tone)
        return plain + (mark if self.options["toneMarkType"] == "numbers" else self.upper[mark])


class Jyutping(Numbered):
    name = "Jyutping"

    def tone_fits(self, plain: str, tone) -> bool:
        return tone in self.tones() and (plain[-1:] not in "ptk" or tone in (None, 1, 3, 6))


class CantoneseYale(Numbered):
    """Diacritics: the three marks stand on the first vowel, low tones have an h behind the vowels."""

    name = "CantoneseYale"
    defaults = {"toneMarkType": "diacritics", "missingToneMark": "noinfo", "yaleFirstTone": "1stToneLevel"}
    letters = "a-z"
    #: Tone -> (mark, low).
    written = {"1stToneLevel": ("̄", False), "1stToneFalling": ("̀", False), "2ndTone": ("́", False), "3rdTone": ("", False), "4thTone": ("̀", True), "5thTone": ("́", True), "6thTone": ("", True)}

    def tones(self) -> list:
        if self.options["toneMarkType"] == "none":
            return [None]
        return [*self.written, *([None] if self.options["toneMarkType"] == "numbers" and self.options["missingToneMark"] == "noinfo" else [])]

    def run_pattern(self) -> str:
        return r"(?i:[a-zàáāèéēìíīòóōùúūǹńḿ]|[̀-ͯ])+[1-6]?"

    def tone_fits(self, plain: str, tone) -> bool:
        stop = plain[-1:] in "ptk"
        return tone in self.tones() and (not stop or tone in (None, "1stToneLevel", "3rdTone", "6thTone"))

    def tonal(self, plain: str, tone) -> str:
        if tone not in self.tones():
            raise InvalidEntityError(f"{plain!r} has no tone {tone!r}")
        if tone is None:
            return plain
        if self.options["toneMarkType"] == "numbers":
            return plain + tone[0]
        mark, low = self.written[tone]
        m = re.search("[aeiou]+", plain, re.I) or re.search("m|ng", plain, re.I)
        if not m:
            raise InvalidEntityError(f"{plain!r} has no vowel")
        at, end = m.span()
        return nfc(plain[: at + 1] + mark + plain[at + 1 : end] + ("h" if low and not plain.isupper() else "H" if low else "") + plain[end:])

    def split(self, entity: str) -> tuple[str, object]:
        if self.options["toneMarkType"] == "none":
            return nfc(entity), None
        if self.options["toneMarkType"] == "numbers":
            plain, tone = super().split(entity)
            if tone == 1:
                return plain, self.options["yaleFirstTone"]
            return plain, None if tone is None else [t for t in self.written if t[0] == str(tone)][0]
        parts = nfd(entity)
        at = [i for i, c in enumerate(parts) if c in "̄́̀"]
        if len(at) > 1:
            raise InvalidEntityError(f"{entity!r} has several tone marks")
        mark = parts[at[0]] if at else ""
        bare = nfc(parts[: at[0]] + parts[at[0] + 1 :] if at else parts)
        low = bool(re.search("(?:[aeiou]|^h?m|^h?ng)h", bare, re.I))
        tone = [t for t, (m, h) in self.written.items() if (m, h) == (mark, low)]
        if not tone:
            raise InvalidEntityError(f"{entity!r} has an unknown tone")
        return (re.sub("((?:[aeiou]|^h?m|^h?ng))h", r"\1", bare, count=1, flags=re.I) if low else bare), tone[0]


_BARS, _SUPERSCRIPTS = str.maketrans("12345", "˩˨˧˦˥"), str.maketrans("0123456789", "⁰¹²³⁴⁵⁶⁷⁸⁹")


class Toned(Reading):
    """IPA: a tone mark behind each syllable, a point between syllables. Tones have names, and contours of digits from 1 (low) to 5."""

    contours: Mapping[str, str] = {}
    #: Tone name -> number, for the mark types that write numbers.
    numbers: Mapping[str, str] = {}
    defaults = {"toneMarkType": "ipaToneBar", "missingToneMark": "noinfo", "marks": None}
    separator = "."

    def _marks(self) -> Mapping[str, str]:
        if self.options["marks"]:
            return self.options["marks"]
        kind = self.options["toneMarkType"]
        if kind in ("numbers", "superscriptNumbers"):
            plain = {t: self.numbers.get(t, "") for t in self.contours}
            return {t: m.translate(_SUPERSCRIPTS) if kind == "superscriptNumbers" else m for t, m in plain.items()}
        if kind not in ("ipaToneBar", "chaoDigits", "superscriptChaoDigits", "none"):
            raise ValueError(f"no tone marks of type {kind!r}")
        by = {"ipaToneBar": _BARS, "superscriptChaoDigits": _SUPERSCRIPTS}.get(kind)
        return {t: "" if kind == "none" else c.translate(by) if by else c for t, c in self.contours.items()}

    def tones(self) -> list:
        if self.options["toneMarkType"] == "none":
            return [None]
        return [*self._marks(), *([None] if self.options["missingToneMark"] == "noinfo" else [])]

    def tonal(self, plain: str, tone) -> str:
        if tone not in self.tones():
            raise InvalidEntityError(f"{plain!r} has no tone {tone!r}")
        return plain + (self._marks()[tone] if tone is not None else "")

    def split(self, entity: str) -> tuple[str, object]:
        """The longest mark at the end counts; of tones with equal marks the first."""
        found = [(len(m), t) for t, m in self._marks().items() if m and entity.endswith(m)]
        if found:
            longest = max(n for n, _ in found)
            return entity[:-longest], next(t for n, t in found if n == longest)
        return entity, None if self.options["toneMarkType"] == "none" else next((t for t, m in self._marks().items() if not m), None)

    def decompositions(self, text: str) -> list[list[str]]:
        return [self.decompose(text)]

    def decompose(self, text: str) -> list[str]:
        return [x for x in re.split(r"([.\s]+)", text) if x]


class MandarinIPA(Toned):
    name = "MandarinIPA"
    #: Contours and numbers of the tones.
    contours = {"1stTone": "55", "2ndTone": "35", "3rdToneRegular": "214", "3rdToneLow": "21", "4thTone": "51", "5thTone": "", "5thToneHalfHigh": "4", "5thToneMiddle": "3", "5thToneHalfLow": "2", "5thToneLow": "1"}
    numbers = {"1stTone": "1", "2ndTone": "2", "3rdToneRegular": "3", "3rdToneLow": "3", "4thTone": "4", "5thTone": "", "5thToneHalfHigh": "5", "5thToneMiddle": "5", "5thToneHalfLow": "5", "5thToneLow": "5"}


class CantoneseIPA(Toned):
    """Syllables on p, t, k have the level tones only; explicit: their tones are written short."""

    name = "CantoneseIPA"
    defaults = dict(Toned.defaults) | {"stopTones": "none"}
    #: Contours and numbers of the tones; tones of stops.
    contours = {"HighLevel": "55", "HighFalling": "52", "MiddleRising": "25", "MiddleLevel": "33", "LowFalling": "21", "LowRising": "23", "LowLevel": "22"}
    numbers = {"HighLevel": "1", "HighFalling": "1", "MiddleRising": "2", "MiddleLevel": "3", "LowFalling": "4", "LowRising": "5", "LowLevel": "6"}
    stops = {"HighLevel": "5", "MiddleLevel": "3", "LowLevel": "2"}

    def tone_fits(self, plain: str, tone) -> bool:
        return tone in self.tones() and (not self.has_stop(plain) or tone in (None, *self.stops))

    def has_stop(self, plain: str) -> bool:
        return plain.rstrip("̚")[-1:] in "ptk"

    def tonal(self, plain: str, tone) -> str:
        if self.options["stopTones"] == "explicit" and tone in self.stops and self.has_stop(plain) and self.options["toneMarkType"] == "ipaToneBar":
            return plain + self.stops[tone].translate(_BARS)
        return super().tonal(plain, tone)

    def split(self, entity: str) -> tuple[str, object]:
        if self.options["stopTones"] == "explicit" and self.options["toneMarkType"] == "ipaToneBar":
            for tone, mark in self.stops.items():
                plain = entity.removesuffix(mark.translate(_BARS))
                if plain != entity and self.has_stop(plain):
                    return plain, tone
        return super().split(entity)


class ShanghaineseIPA(Toned):
    """flags: plain syllable -> V (voiced initial), U (unvoiced), G (glottal stop), which the tones then must fit."""

    name = "ShanghaineseIPA"
    defaults = dict(Toned.defaults) | {"toneMarkType": "superscriptChaoDigits", "constrainEntering": False, "constrainToneCategories": False, "flags": None}
    #: Contours of the tones.
    contours = {"HighLevel": "53", "MiddleRising": "34", "LowRising": "23", "HighEntering": "55", "LowEntering": "12"}
    numbers = {t: str(i + 1) for i, t in enumerate(contours)}

    def tone_fits(self, plain: str, tone) -> bool:
        flags = (self.options["flags"] or {}).get(plain, "")
        if tone is None or tone not in self.tones():
            return tone in self.tones()
        if self.options["constrainEntering"] and ("G" in flags) != tone.endswith("Entering"):
            return False
        if self.options["constrainToneCategories"] and ("V" in flags and not tone.startswith("Low") or "U" in flags and tone.startswith("Low")):
            return False
        return True


class MandarinBraille(Reading):
    name = "MandarinBraille"
    defaults = {"toneMarkType": "braille", "missingToneMark": "extended"}
    letters = "⠀-⣿"
    #: The cells of tones 1 to 4.
    marks = "⠁⠂⠄⠆"

    def run_pattern(self) -> str:
        return "[⠁-⣿]+"

    def tones(self) -> list:
        return [None] if self.options["toneMarkType"] == "none" else [1, 2, 3, 4, 5]

    def tonal(self, plain: str, tone) -> str:
        return plain + self.marks[tone - 1] if tone in (1, 2, 3, 4) else plain

    def split(self, entity: str) -> tuple[str, object]:
        if self.options["toneMarkType"] == "none":
            return entity, None
        return (entity[:-1], self.marks.index(entity[-1]) + 1) if len(entity) > 1 and entity[-1] in self.marks else (entity, 5)


class Script(Reading):
    """A script whose characters are the entities."""

    script = ""

    def is_entity(self, entity: str) -> bool:
        return len(entity) == 1 and any(a <= ord(entity) <= b for a, b in SCRIPT_RANGES[self.script])

    def decompositions(self, text: str) -> list[list[str]]:
        return [self.decompose(text)]

    def decompose(self, text: str) -> list[str]:
        out: list[str] = []
        for c in text:
            if not self.is_entity(c) and out and not self.is_entity(out[-1][-1]):
                out[-1] += c
            else:
                out.append(c)
        return out

    def compose(self, entities: list[str]) -> str:
        return "".join(entities)


SCRIPTS = {s: type(s, (Script,), {"name": s, "script": s, "__module__": __name__}) for s in ("Hangul", "Hiragana", "Katakana", "Kana")}
globals().update(SCRIPTS)

READINGS: dict[str, type[Reading]] = {c.name: c for c in (Pinyin, WadeGiles, Jyutping, CantoneseYale, MandarinIPA, CantoneseIPA, ShanghaineseIPA, MandarinBraille, *SCRIPTS.values())}


def publish_reading(kind: type[Reading]) -> None:
    """Adds a reading of one's own."""
    READINGS[kind.name] = kind


# ---------------------------------------------------------------- conversion


@dataclass
class Converter:
    """From one reading to another: an entity's plain syllable and tone are mapped; all else stays. Case is kept.

    syllables: plain -> plain, or a list of several if it is ambiguous. tones: tone -> tone (None: as they are).
    sequence: a function of all (plain, tone) pairs at once, for what depends on neighbours.
    """

    source: Reading
    target: Reading
    syllables: Mapping[str, object] | None = None
    tones: Mapping | None = None
    sequence: Callable[[list[tuple[str, object]]], list[tuple[str, object]]] | None = None
    #: (plain syllable, tone) of the source -> plain syllable: what is spoken otherwise in a tone; goes before syllables.
    in_tone: Mapping[tuple[str, object], str] | None = None

    def convert(self, text: str) -> str:
        entities = self.source.decompose(text)
        if isinstance(self.source, Pinyin):
            entities = self.source.without_apostrophes(entities)
        return self.target.compose(self.convert_entities(entities))

    def convert_entities(self, entities: list[str]) -> list[str]:
        out: list[str] = []
        held: list[tuple[str, str, object]] = []

        def flush() -> None:
            pairs = [(p, t) for _, p, t in held]
            pairs = self.sequence(pairs) if self.sequence else pairs
            special = [self.in_tone.get((p, t)) if self.in_tone else None for _, p, t in held]
            out.extend(like_case(e, self.one(p, t) if x is None else self.target.tonal(x, t)) for (e, _, _), (p, t), x in zip(held, pairs, special))
            held.clear()

        for e in entities:
            if self.source.is_entity(e):
                plain, tone = self.source.split(e)
                held.append((plain, plain.lower(), tone))
            elif e == self.source.separator and self.source.separator:
                continue
            else:
                flush()
                out.append(e)
        flush()
        return out

    def one(self, plain: str, tone) -> str:
        if self.syllables is not None:
            found = self.syllables.get(plain)
            if found is None:
                raise ConversionError(f"{plain!r} has no counterpart")
            if not isinstance(found, str):
                if len(found) > 1:
                    raise AmbiguousConversionError(f"{plain!r} has several counterparts")
                found = found[0]
            plain = found
        if self.tones is not None:
            if tone not in self.tones:
                raise ConversionError(f"tone {tone!r} has no counterpart")
            tone = self.tones[tone]
        elif tone not in self.target.tones():
            if tone is None:
                raise AmbiguousConversionError("the tone is missing")
            if self.target.tones() != [None]:
                raise ConversionError(f"tone {tone!r} has no counterpart")
            tone = None
        try:
            return self.target.tonal(plain, tone)
        except InvalidEntityError as error:
            raise ConversionError(str(error)) from error


@dataclass
class Bridge:
    """Two conversions, one behind the other."""

    first: Converter | Bridge
    second: Converter | Bridge

    def convert(self, text: str) -> str:
        return self.second.convert(self.first.convert(text))


class ErhuaConverter(Converter):
    """Between Pinyin with r as a syllable of its own and Pinyin with r in the syllable before it."""

    #: Syllables that don't take an r.
    never = ("e", "er", "r", "n", "ng", "hng", "hm", "m", "ê")

    def convert_entities(self, entities: list[str]) -> list[str]:
        joined = self.target.options["erhua"] == "oneSyllable"
        out: list[str] = []
        for e in entities:
            if not self.source.is_entity(e):
                out.append(e)
                continue
            plain, tone = self.source.split(e)
            low = plain.lower()
            if joined and low == "r" and out and self.source.is_entity(out[-1]) and self.source.split(out[-1])[0].lower() not in self.never:
                before, own = self.source.split(out.pop())
                out.append(self.source.tonal(before + plain, own) if self.source.tones() != [None] else before + plain)
            elif not joined and low.endswith("r") and low not in ("r", "er"):
                out += [self.source.tonal(plain[:-1], tone), self.source.tonal(plain[-1], 5 if 5 in self.source.tones() else None)]
            else:
                out.append(e)
        return super().convert_entities(out)


def respelling(source: Reading, target: Reading) -> Converter:
    """Between two spellings of one reading: plain syllables by their common origin."""
    if type(source) is not type(target):
        raise UnsupportedError(f"{source.name} and {target.name} are different readings")
    spelled = lambda r: {r.respelled(p): p for p in INVENTORY.get(source.name, ())} or {p: p for p in r.plain}
    back, there = spelled(source), {p: s for s, p in spelled(target).items()}
    syllables = {s: there[p] for s, p in back.items() if p in there}
    if not isinstance(source, Pinyin):
        return Converter(source, target, syllables)
    syllables |= {"r": "r"} | {f"{s}r": f"{t}r" for s, t in syllables.items()}
    differ = {source.options["erhua"], target.options["erhua"]} == {"oneSyllable", "twoSyllables"}
    if differ:  # the source must read what stands between the two forms
        source = _remake(Pinyin, source.plain | {p + "r" for p in source.plain if p not in ErhuaConverter.never} | {"r"}, source.options)
    return (ErhuaConverter if differ else Converter)(source, target, syllables)


def onset_and_rhyme(rows, parts, column: str):
    """rows with the columns of parts (plain syllable in the column of that name, initial, final) by their plain syllables."""
    return rows.join(parts, column, "left")


#: Plain syllables of readings, as register_inventory() was told.
INVENTORY: dict[str, frozenset[str]] = {}


def register_inventory(name: str, plain: Iterable[str]) -> None:
    INVENTORY[name] = frozenset(plain)


def reading(name: str, **options) -> Reading:
    """A reading of registered inventory with options."""
    if name not in READINGS:
        raise UnsupportedError(f"no reading {name!r}")
    return READINGS[name](INVENTORY.get(name, ()), **options)


def wade_giles_to_pinyin(rows: Iterable[tuple[str, str, int]], source: WadeGiles, target: Pinyin) -> Converter:
    """rows: WadeGiles, Pinyin, PinyinIdx."""
    return Converter(source, target, {source.respelled(w): target.respelled(p) for w, p, _ in rows})


def pinyin_to_wade_giles(rows: Iterable[tuple[str, str, int]], source: Pinyin, target: WadeGiles) -> Converter:
    """Only rows of index 0 count; a syllable with several of them is ambiguous."""
    found: dict[str, list[str]] = {}
    ambiguous = {p for _, p, i in rows if i}
    for w, p, i in rows:
        if not i or p in ambiguous:
            found.setdefault(source.respelled(p), []).append(target.respelled(w))
    return Converter(source, target, found)


#: Jyutping tones and those of Yale.
YALE_TONES = {1: None, 2: "2ndTone", 3: "3rdTone", 4: "4thTone", 5: "5thTone", 6: "6thTone", None: None}


def jyutping_to_yale(rows: Iterable[tuple[str, str]], source: Jyutping, target: CantoneseYale) -> Converter:
    return Converter(source, target, dict(rows), YALE_TONES | {1: target.options["yaleFirstTone"]})


def yale_to_jyutping(rows: Iterable[tuple[str, str]], source: CantoneseYale, target: Jyutping) -> Converter:
    return Converter(source, target, {y: j for j, y in rows}, {t: None if t is None else int(t[0]) for t in source.tones()})


def neutral_tone_by_neighbour(pairs: list[tuple[str, object]]) -> list[tuple[str, object]]:
    """Mandarin tones as spoken: a neutral tone follows the tone before it; a third tone is low unless it is the last."""
    after = {1: "5thToneHalfLow", 2: "5thToneMiddle", 3: "5thToneHalfHigh", 4: "5thToneLow"}
    plain_tone = {1: "1stTone", 2: "2ndTone", 4: "4thTone", None: None}
    out = []
    for i, (p, t) in enumerate(pairs):
        if t == 3:
            out.append((p, "3rdToneLow" if len(pairs) > 1 and i < len(pairs) - 1 or len(pairs) > 1 else "3rdToneRegular"))
        elif t == 5:
            out.append((p, after.get(pairs[i - 1][1], "5thTone") if i else "5thTone"))
        else:
            out.append((p, plain_tone[t]))
    return out


def pinyin_to_ipa(rows: Iterable[tuple[str, str, str]], source: Pinyin, target: MandarinIPA, sandhi: Callable = neutral_tone_by_neighbour, coarticulation: bool = False) -> Converter:
    """rows: Pinyin, IPA, Feature; those of feature '' or Default count, with coarticulation those of 5thTone in the neutral tone too.
    sandhi: how tones follow from their neighbours."""
    rows = list(rows)
    weak = {(source.respelled(p), 5): i for p, i, f in rows if f == "5thTone"} if coarticulation else None
    return Converter(source, target, {source.respelled(p): i for p, i, f in rows if f in ("", "Default")}, None, sandhi, weak)


#: Syllables whose final isn't written in Braille; punctuation and its cells.
BARE_FINALS = ("zi", "ci", "si", "zhi", "chi", "shi", "ri")
BRAILLE_PUNCTUATION = {".": "⠐⠆", ",": "⠐", "?": "⠐⠄", "!": "⠰⠂", ":": "⠒", ";": "⠰", "-": "⠠⠤", "…": "⠐⠐⠐", "·": "⠠⠄", "(": "⠰⠄", ")": "⠠⠆", "[": "⠰⠆", "]": "⠰⠆"}


@dataclass
class PinyinBraille:
    """Both ways, from initials and finals; syllables that look alike in Braille are ambiguous."""

    source: Reading
    target: Reading
    parts: Mapping[str, tuple[str, str]]  # plain Pinyin -> initial, final
    initials: Mapping[str, str]
    finals: Mapping[str, str]
    made: dict = field(default_factory=dict)

    def __post_init__(self):
        for plain, (initial, final) in self.parts.items():
            self.made[plain] = self.initials.get(initial, "") + ("" if plain in BARE_FINALS else self.finals[final])

    def convert(self, text: str) -> str:
        return self._to_braille(text) if isinstance(self.source, Pinyin) else self._to_pinyin(text)

    def _to_braille(self, text: str) -> str:
        out = []
        for e in self.source.without_apostrophes(self.source.decompose(text)):
            if self.source.is_entity(e):
                plain, tone = self.source.split(e)
                if plain.lower() not in self.made:
                    raise ConversionError(f"{plain!r} has no counterpart")
                out.append(self.target.tonal(self.made[plain.lower()], tone))
            else:
                out.append("".join(BRAILLE_PUNCTUATION.get(c, c) for c in e))
        return "".join(out)

    def _to_pinyin(self, text: str) -> str:
        back: dict[str, list[str]] = {}
        for plain, cells in self.made.items():
            back.setdefault(cells, []).append(plain)
        signs: dict[str, list[str]] = {}
        for sign, cells in BRAILLE_PUNCTUATION.items():
            signs.setdefault(cells, []).append(sign)
        out = []
        for e in re.findall("[⠁-⣿]+|[^⠁-⣿]+", text):
            plain, tone = self.source.split(e)
            found = back.get(plain) or signs.get(e)
            if found is None:
                out.append(e)
            elif len(found) > 1:
                raise AmbiguousConversionError(f"{e!r} has several readings")
            else:
                out.append(self.target.tonal(found[0], tone) if plain in back else found[0])
        return self.target.compose(out)


class Conversions:
    """A registry of converters by the names of readings; what has no direct way goes over Pinyin."""

    def __init__(self):
        self.direct: dict[tuple[str, str], Callable[[Reading, Reading], object]] = {}

    def publish(self, source: str, target: str, make: Callable[[Reading, Reading], object]) -> None:
        self.direct[source, target] = make

    def supports(self, source: str, target: str) -> bool:
        return source == target or (source, target) in self.direct or (source, "Pinyin") in self.direct and ("Pinyin", target) in self.direct

    def get(self, source: Reading, target: Reading):
        if source.name == target.name:
            return respelling(source, target)
        if (source.name, target.name) in self.direct:
            return self.direct[source.name, target.name](source, target)
        if self.supports(source.name, target.name):
            middle = reading("Pinyin", toneMarkType="numbers")
            return Bridge(self.get(source, middle), self.get(middle, target))
        raise UnsupportedError(f"no conversion from {source.name} to {target.name}")


# ---------------------------------------------------------------- columns


def _each(values: pd.Series, f: Callable) -> pd.DataFrame:
    """Results and errors; each distinct value is worked out once a batch."""
    made: dict = {}

    def one(x):
        if x is None:
            return None, None
        key = tuple(x) if not isinstance(x, str) else x
        if key not in made:
            try:
                made[key] = f(x), None
            except ReadingError as error:
                made[key] = None, type(error).__name__
        return made[key]

    return pd.DataFrame([one(x) for x in values], columns=["value", "error"])


def _column(kind: str, f: Callable):
    @F.pandas_udf(f"value {kind}, error string")
    def udf(values: pd.Series) -> pd.DataFrame:
        return _each(values, f)

    return udf


def decompose(c: Column, r: Reading) -> Column:
    """struct(value array<string>, error)."""
    return _column("array<string>", r.decompose)(c)


def decompositions(c: Column, r: Reading) -> Column:
    return _column("array<array<string>>", r.decompositions)(c)


def compose(c: Column, r: Reading) -> Column:
    return _column("string", lambda x: r.compose(list(x)))(c)


def split_tone(c: Column, r: Reading) -> Column:
    """struct(value array(plain, tone), error)."""
    def pair(entity: str) -> list:
        plain, tone = r.split(entity)
        return [plain, None if tone is None else str(tone)]

    return _column("array<string>", pair)(c)


def is_entity(c: Column, r: Reading) -> Column:
    @F.pandas_udf("boolean")
    def udf(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if x is None else r.is_entity(x))

    return udf(c)


def convert(c: Column, converter) -> Column:
    """struct(value string, error)."""
    return _column("string", converter.convert)(c)


# ---------------------------------------------------------------- guessing how a text is written


#: Apostrophes in the order in which they are looked for, and marks of optional neutral tones.
APOSTROPHES = ("'", "’", "´", "‘", "`", "ʼ", "ˈ", "′", "ʻ")
OPTIONAL_MARKS = ("˳", "｡", "￮", "₀", "ₒ")


def _first(signs: Sequence[str], text: str, default: str) -> str:
    return next((x for x in signs if x in text), default)


def _most(votes: Mapping[str, int], default: str) -> str:
    """The kind with most votes, of equal ones the first; the default without votes."""
    best = max(votes, key=votes.get)
    return best if votes[best] else default


def _marked(runs: int, diacritics: int, numbers: int, include_toneless: bool) -> str:
    """Diacritics if more runs have them than have numbers. Without either the text is taken for numbers that were left out, or,
    with include_toneless, for toneless where under a tenth of all runs has a tone."""
    if include_toneless and max(diacritics, numbers) * 10 < runs:
        return "none"
    return "diacritics" if diacritics > numbers else "numbers"


def guess_pinyin(text: str, include_toneless: bool = False) -> dict:
    """How Pinyin is written: tone marks as diacritics or numbers, the vowel ü, short forms of ng, zh, ch, sh, apostrophes, and,
    for numbers, r as a syllable of its own or not."""
    text = nfc(text).lower()
    runs = re.findall(r"[a-zêüŋẑĉŝ\u0300-\u036f\u00e0-\u01dc:]+[0-5]?", text)
    kind = _marked(len(runs), sum(bool(re.search("[\u0300\u0301\u0304\u030c]", nfd(r))) for r in runs), sum(r[-1].isdigit() for r in runs), include_toneless)
    bare = nfc(re.sub("[\u0300\u0301\u0304\u030c]", "", nfd(text)))
    vowels = {v: len(re.findall(rf"[nl]{re.escape(v)}(?![a-df-mo-z])", bare)) for v in ("ü", "v", "u:")}
    joined, apart = len(re.findall(r"(?<!e)[a-zü]r[1-5]", text)), len(re.findall(r"(?<![a-zü])r5?(?![a-zü])", text))
    return {
        "toneMarkType": kind, "yVowel": _most(vowels, "ü"), "shortenedLetters": bool(re.search("[ŋẑĉŝ]", text)), "pinyinApostrophe": _first(APOSTROPHES, text, "'"),
        "erhua": "oneSyllable" if kind == "numbers" and joined > apart else "twoSyllables",
    }


def guess_wade_giles(text: str, include_toneless: bool = False) -> dict:
    """How Wade-Giles is written: the apostrophe of aspiration, tones as plain or raised numbers, the neutral tone as zero, five or
    nothing, ê, ŭ, ü, and sz for ss at the beginning. Without any tone, the neutral tone is taken to be marked, so that none is given."""
    text = nfc(text).lower()
    sign = f"[{''.join(APOSTROPHES)}]?"
    plain, raised = re.findall("(?<=[a-zêŭǔü])[0-5]", text), re.findall("(?<=[a-zêŭǔü])[⁰¹²³⁴⁵]", text)
    zero, five = plain.count("0") + raised.count("⁰"), plain.count("5") + raised.count("⁵")
    final = re.search(f"(?:tz|ss|sz){sign}([ŭǔu])", text)
    return {
        "wadeGilesApostrophe": _first(APOSTROPHES, text, "’"), "toneMarkType": "numbers" if len(plain) > len(raised) else "superscriptNumbers",
        "neutralToneMark": "zero" if zero > five or not plain and not raised else "five" if five else "none",
        "diacriticE": "e" if "ê" not in text and re.search(f"(?<![a-z])(?:(?:ch|hs|sh|ts|[pmftnlkhjyw]){sign})?e(?:ng|n|rh)?(?![a-z])", text) else "ê",
        "zeroFinal": "ŭ" if "ŭ" in text or not final else final[1],
        "umlautU": "u" if "ü" not in text and re.search(f"hs{sign}u|(?<![a-z])y(?!u)[a-z]*u|ueh|uo(?![a-z])", text) else "ü",
        "useInitialSz": bool(re.search("(?<![a-z])sz", text)),
    }


def guess_yale(text: str, include_toneless: bool = False) -> dict:
    """How Cantonese Yale is written: with diacritics (an h behind the vowels counts as one), or numbers (or nothing) behind the syllables."""
    runs = re.findall("[a-z\u0300\u0301\u0304]+[1-6]?", nfd(text.lower()))
    numbers = sum(r[-1].isdigit() for r in runs)
    marked = sum(not r[-1].isdigit() and ("h" in r[1:] or bool(re.search("[\u0300\u0301\u0304]", r))) for r in runs)
    return {"toneMarkType": _marked(len(runs), marked, numbers, include_toneless)}


def guess_gr(text: str, include_toneless: bool = False) -> dict:
    """How Gwoyeu Romatzyh is written: its apostrophes, and the mark of an optional neutral tone."""
    sign = _first(APOSTROPHES, text, "’")
    return {"grRhotacisedFinalApostrophe": sign, "grSyllableSeparatorApostrophe": sign, "optionalNeutralToneMarker": _first(OPTIONAL_MARKS, text, "˳")}


def guess_ipa(text: str, include_toneless: bool = False) -> dict:
    """How tones are written in IPA: bars, digits of contours or numbers, plain or raised."""
    plain, raised = re.findall(r"(?<!\d)[0-9]+", text), re.findall("[⁰¹²³⁴⁵⁶⁷⁸⁹]+", text)
    many = lambda found: any(len(x) > 1 for x in found)
    votes = {"ipaToneBar": len(re.findall("[˥˦˧˨˩]+", text)), "chaoDigits" if many(plain) else "numbers": len(plain), "superscriptChaoDigits" if many(raised) else "superscriptNumbers": len(raised)}
    return {"toneMarkType": _most(votes, "none")}


GUESSES = {"Pinyin": guess_pinyin, "WadeGiles": guess_wade_giles, "CantoneseYale": guess_yale, "GR": guess_gr, "MandarinIPA": guess_ipa, "CantoneseIPA": guess_ipa, "ShanghaineseIPA": guess_ipa}


def guess_dialect(name: str, text: str, include_toneless: bool = False) -> dict:
    """The options of a reading that a text is written with, by what speaks for each; readings written in one way have none."""
    return GUESSES[name](text, include_toneless) if name in GUESSES else {}


def guess_column(name: str, c: Column, include_toneless: bool = False) -> Column:
    """guess_dialect() of each text, as a map of texts."""

    @F.pandas_udf("map<string,string>")
    def udf(values: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else {k: str(v) for k, v in guess_dialect(name, x, include_toneless).items()} for x in values], dtype=object)

    return udf(c)


def _covered(r: Reading, text: str) -> int:
    """The most letters of a text that syllables can cover."""
    total, longest = 0, max((len(nfd(p)) for p in r.plain), default=0) + 3
    for inside, run in r.runs(nfc(text)):
        if inside:
            best = [0] * (len(run) + 1)
            for at in range(len(run) - 1, -1, -1):
                best[at] = max([best[at + 1], *(end - at + best[end] for end in range(at + 1, min(len(run), at + longest) + 1) if r.is_entity(run[at:end]))])
            total += best[0]
    return total


def guess_options(text: str, candidates: Iterable[Reading]) -> dict:
    """The options of the candidate whose syllables cover most letters of a text; the first of equal ones."""
    candidates = list(candidates)
    return dict(max(candidates, key=lambda r: _covered(r, text)).options) if candidates else {}
