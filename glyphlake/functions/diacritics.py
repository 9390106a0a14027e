"""Overlay diacritics: marks that a language's ordinary spelling leaves out, and their removal and rewriting."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrow import mapped
from .expressions import char_class, col, strip_class

# Languages whose word stress is marked, marks of each family, and the vowels that bear stress.
STRESS_LANGS = "az ba be bg cv hy ka kbd kjh kk ky lv mdf mk myv ru sah sl tg tt udm uk uz xal".split()
MARKS = {
    "stress": [(0x0300, 0x0301)],
    "ar": [(0x064B, 0x065F), (0x0670, 0x0670)],
    "he": [(0x05B0, 0x05BD), (0x05BF, 0x05BF), (0x05C1, 0x05C2), (0x05C4, 0x05C5), (0x05C7, 0x05C7)],
}
STRESS_SCRIPT = dict.fromkeys("ba be bg cv kbd kjh kk ky mdf mk myv ru sah tg tt udm uk xal az-Cyrl uz-Cyrl".split(), "Cyrl") | dict.fromkeys("lv sl az-Latn uz-Latn".split(), "Latn") | {"hy": "Armn", "ka": "Geor"}
STRESS_VOWELS = {
    "Cyrl": "аеёиоуыэюяіїєәөүұӑӗӳӥӧўъӣӯӱ",
    "Latn": "aeiouyáéíóúàèìòùâêîôûäëïöüåæøœãõāēīōūəı",
    "Armn": "աեէըիուօ",
    "Geor": "აეიოუ",
}
#: Arabic and its varieties by primary subtag.  The language distance of a tag is decided by this list, not by a distance model.
ARABIC = frozenset("ar ara arb arq ary arz apc ajp apd acm acq acw acx aeb aec afb ars ayl ayn ayh adf abh shu ssh mey".split())


def _tag(lang: str) -> tuple[str, str | None, list[str]]:
    parts = lang.replace("_", "-").split("-")
    script = parts[1].title() if len(parts) > 1 and len(parts[1]) == 4 and parts[1].isalpha() else None
    return parts[0].lower(), script, [p.upper() for p in parts[1:]]


def family(lang: str) -> str | None:
    """he, stress, pt (European Portuguese), ar (Arabic in Arabic script) or none."""
    primary, script, rest = _tag(lang)
    if primary == "he":
        return "he"
    if primary in STRESS_LANGS:
        return "stress"
    if primary in ("pt", "por") and (not rest or rest == ["LATN"] or "PT" in rest):
        return "pt"
    return "ar" if primary in ARABIC and script in (None, "Arab") else None


def is_stress_lang(lang: str) -> bool:
    """Whether marks can be generated: Azerbaijani and Uzbek need a script subtag, the others must have none."""
    primary, script, _ = _tag(lang)
    return primary in STRESS_LANGS and (script in ("Cyrl", "Latn") if primary in ("az", "uz") else script is None)


def supports_strip(lang: str) -> bool:
    return family(lang) in MARKS


def strip_diacritics(text: str | Column, lang: str = "und") -> Column:
    """Without the language's overlay marks; letters of its alphabet stay, composed where a mark makes them."""
    found = family(lang)
    if found not in MARKS:
        raise ValueError(f"cannot strip diacritics for lang={lang!r}: they are part of its spelling, or unknown")
    text = col(text)
    if _tag(lang)[0] == "mk":  # the grave goes first, as it doesn't part a letter from its acute
        text = F.replace(text, F.lit("̀"), F.lit(""))
        for plain, written in ("гѓ", "кќ", "ГЃ", "КЌ"):
            text = F.replace(text, F.lit(plain + "́"), F.lit(written))
    return strip_class(text, char_class(ranges=MARKS[found]))


#: family -> column function of (text, lang), added by register_diacritizer().
DIACRITIZERS: dict[str, Callable[[Column, str], Column]] = {}


def register_diacritizer(name: str, fn: Callable[[Column, str], Column]) -> None:
    """An engine that writes the marks of a family (he, ar, stress, pt), or one to be asked for by name."""
    DIACRITIZERS[name] = fn


def diacritize(text: str | Column, lang: str = "und", model: str | None = None) -> Column:
    """The text with its language's marks written by the family's engine; a language of no family stays as it is.

    An engine that was not registered is an error when the plan is made.
    """
    found = family(lang)
    if found == "stress" and not is_stress_lang(lang):
        raise ValueError(f"{lang!r} needs a script subtag, or must not have this one")
    if found is None:
        return col(text)
    name = model or found
    if name not in DIACRITIZERS:
        raise ImportError(f"no engine for {name!r}; register_diacritizer({name!r}, fn) adds one")
    return DIACRITIZERS[name](col(text), lang)


def stress_vowels(lang: str) -> str:
    primary, script, _ = _tag(lang)
    primary = {"rus": "ru", "ukr": "uk", "bel": "be", "bul": "bg", "mkd": "mk"}.get(primary, primary)
    found = STRESS_SCRIPT.get(f"{primary}-{script}" if primary in ("az", "uz") else primary)
    return STRESS_VOWELS[found] if found and script in (None, found) else ""


def replace_stress_mark(text: str | Column, lang: str, before: str = "", after: str = "") -> Column:
    """Each acute on a stressable vowel becomes `before` in front of the vowel and `after` behind it; other acutes are spelling."""
    vowels = stress_vowels(lang)
    if not vowels:
        return col(text)

    def one(t: str) -> str:
        if "́" not in t:
            return t
        # clusters: a character and the combining marks after it
        clusters: list[list[str]] = []
        for c in t:
            if clusters and unicodedata.combining(c):
                clusters[-1][1] += c
            else:
                clusters.append([c, ""])
        out = []
        for base, marks in clusters:
            if "́" in marks and base.lower()[:1] in vowels:
                out.append(before * marks.count("́") + base + marks.replace("́", after))
            else:
                out.append(base + marks)
        return "".join(out)

    return mapped(one)(text)


# How characters read for a Hebrew vowel model.
HEBREW_PLAIN = "אבגדהוזחטיכלמנסעפצקרשת"
HEBREW_KEPT = " !\"'(),-.:;?" + HEBREW_PLAIN
HEBREW_READ = {"ך": "כ", "ם": "מ", "ן": "נ", "ף": "פ", "ץ": "צ", "\n": " ", "\t": " ", "־": "-", "‒": "-", "–": "-", "—": "-", "―": "-", "−": "-", "[": "(", "]": ")",
               "´": "'", "‘": "'", "’": "'", "“": '"', "”": '"', "״": '"', "…": ",", "ײ": "H", "װ": "H", "ױ": "H"}


def hebrew_model_text(text: str | Column) -> Column:
    """Each character as the model reads it: digits are 5, double letters H, all that it doesn't know O."""
    known = char_class([*HEBREW_KEPT, *HEBREW_READ, "5"], negate=True)
    text = F.regexp_replace(col(text), r"\p{Nd}", "5")
    return F.translate(F.regexp_replace(text, known, "O"), "".join(HEBREW_READ), "".join(HEBREW_READ.values()))


def remove_niqqud(text: str | Column) -> Column:
    """Hebrew points go."""
    return strip_class(col(text), char_class(ranges=[(0x05B0, 0x05BC), (0x05BF, 0x05BF), (0x05C1, 0x05C2), (0x05C7, 0x05C7)]))
