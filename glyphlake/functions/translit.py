"""Transliteration between scripts: Hangul to its letters, kana to kana, and glyph codes from a given table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expressions import col, map_literal

# Modern letters of Hangul in Unicode order; leads, vowels and tails.
LEADS = "ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ"
VOWELS = "ㅏㅐㅑㅒㅓㅔㅕㅖㅗㅘㅙㅚㅛㅜㅝㅞㅟㅠㅡㅢㅣ"
TAILS = "ㄱㄲㄳㄴㄵㄶㄷㄹㄺㄻㄼㄽㄾㄿㅀㅁㅂㅄㅅㅆㅇㅈㅊㅋㅌㅍㅎ"
CONJOINING = ("".join(chr(0x1100 + i) for i in range(19)), "".join(chr(0x1161 + i) for i in range(21)), "".join(chr(0x11A8 + i) for i in range(27)))
SILENT = LEADS.index("ㅇ")
JAMO_FORMS = ("compatibility", "conjoining")
#: Hiragana with a counterpart in katakana, 0x60 further on.
HIRAGANA = "".join(map(chr, (*range(0x3041, 0x3097), 0x309D, 0x309E)))
KATAKANA = "".join(chr(ord(c) + 0x60) for c in HIRAGANA)


def decompose_hangul(text: str | Column, form: str = "compatibility", drop_silent_initial: bool = False) -> Column:
    """Syllables as their letters, by arithmetic on code points; all else stays."""
    if form not in JAMO_FORMS:
        raise ValueError(f"form must be 'compatibility' or 'conjoining', not {form!r}")
    leads, vowels, tails = (LEADS, VOWELS, TAILS) if form == "compatibility" else CONJOINING
    text = col(text)

    def at(letters: str, index: Column) -> Column:
        return F.substring(F.lit(letters), index.cast("int") + 1, F.lit(1))

    def one(c: Column) -> Column:
        n = F.ascii(c) - 0xAC00
        lead, vowel, tail = F.floor(n / 588), F.floor((n % 588) / 28), n % 28
        first = F.when(lead == SILENT, "").otherwise(at(leads, lead)) if drop_silent_initial else at(leads, lead)
        return F.when(n.between(0, 11171), F.concat(first, at(vowels, vowel), F.when(tail > 0, at(tails, tail - 1)).otherwise(""))).otherwise(c)

    # texts without a syllable, most of a mixed corpus, are not cut up
    return F.when(text.rlike(r"[\x{AC00}-\x{D7A3}]"), F.array_join(F.transform(F.split(text, ""), one), "")).otherwise(text)


def hira_to_kana(text: str | Column) -> Column:
    return F.translate(col(text), HIRAGANA, KATAKANA)


def kana_to_hira(text: str | Column) -> Column:
    """The long-vowel mark stays."""
    return F.translate(col(text), KATAKANA, HIRAGANA)


def cangjie_code(char: str | Column, table: Mapping[str, str]) -> Column:
    """The code of one glyph in a small table given as a mapping, or null; for a whole table see operators.lookups."""
    return F.element_at(map_literal(dict(table)), col(char))


def to_cangjie(text: str | Column, table: Mapping[str, str], sep: str = " ") -> Column:
    """Each glyph of the table as its code, runs of others as they are, joined by sep."""
    known = map_literal(dict(table))
    glyphs = "[" + "".join("\\x{%X}" % ord(c) for c in table) + "]"
    parts = F.regexp_extract_all(col(text), F.lit(f"(?s){glyphs}|[^{glyphs[1:]}+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.coalesce(F.element_at(known, p), p)), sep)
