"""Korean spelling to sounds: coda simplification, sandhi between syllables, and transcription, word by word.

A word is a string of letters without silent onsets.  Rules are lists of (letters, letters) that are replaced one after the other; their order is
part of the result.
"""

from __future__ import annotations

import functools
import re

from .arrow import mapped
from .translit import LEADS, TAILS, VOWELS

# Letters and their transcriptions.
CONSONANTS = "ㅂㄷㅌㅈㅉㅊㄱㅎㄲㅋㄹㅁㄴㅇㄸㅃㅍㅅㅆ"
VOWEL_ORDER = "ㅏㅔㅐㅣㅗㅚㅜㅓㅡㅢㅛㅠㅑㅕㅖㅒㅘㅝㅟㅙㅞ"
IPA = dict(zip(CONSONANTS, "p t tʰ tɕ tɕ* tɕʰ k h k* kʰ l m n ŋ t* p* pʰ s s*".split())) | dict(zip("ㅏㅔㅐㅣㅗㅚㅜㅓㅡㅢㅛㅠㅑㅕㅖㅒㅘㅝㅟ", "ä e ɛ i o wɛ u ʌ̹ ɯ ɰi jo ju ja jʌ̹ je jɛ wa wʌ̹ wi".split())) | {"ㅙ": "wɛ", "ㅞ": "we"}
YALE = dict(zip(CONSONANTS, "p t th c cc ch k h kk kh l m n ng tt pp ph s ss".split())) | dict(zip("ㅏㅔㅐㅣㅗㅚㅜㅓㅡㅢㅛㅠㅑㅕㅖㅒㅘㅝㅟ", "a ey ay i o oy wu e u uy yo yu ya ye yey yay wa we wi".split())) | {"ㅙ": "way", "ㅞ": "wey"}
# Two letters of a coda and the one that is left of them; the first eleven in this order are letters of their own.
CODA_PAIRS = dict(x.split(":") for x in "ㄱㅅ:ㄱ ㄱㄴ:ㄱ ㄴㅈ:ㄴ ㄴㄴ:ㄴ ㄹㅂ:ㄹ ㄹㅅ:ㄹ ㄹㄴ:ㄹ ㄹㅌ:ㄹ ㅂㅅ:ㅂ ㅂㄴ:ㅂ ㄹㄱ:ㄱ ㄹㅇ:ㅇ ㄹㅁ:ㅁ ㄹㅍ:ㅂ ㄴㅎ:ㄴ ㄹㅎ:ㄹ".split())
SPLIT_CODAS = dict(zip("ㄳㄵㄼㄽㄾㅄㄺㄻㄿㄶㅀ", "ㄱㅅ ㄴㅈ ㄹㅂ ㄹㅅ ㄹㅌ ㅂㅅ ㄹㄱ ㄹㅁ ㄹㅍ ㄴㅎ ㄹㅎ".split()))
NEUTRAL = str.maketrans("ㄲㅋㅅㅆㅈㅊㅌㅎㅂㅍ", "ㄱㄱㄷㄷㄷㄷㄷㄷㅂㅂ")
ASPIRATION = [x.split(":") for x in "ㅎㄱ:ㅋ ㅎㅋ:ㅋ ㅎㄷ:ㅌ ㅎㅌ:ㅌ ㅎㅈ:ㅊ ㅎㅊ:ㅊ ㅎㅎ:ㅌ ㄱㅎ:ㅋ ㅋㅎ:ㅋ ㄷㅎ:ㅌ ㅌㅎ:ㅌ ㅂㅎ:ㅍ ㅍㅎ:ㅍ ㅈㅎ:ㅊ ㅊㅎ:ㅌ ㅅㅎ:ㅌ ㅈㅎ:ㅌ ㅊㅎ:ㅌ ㅎㅅ:ㅆ".split()]
# Built from the classes of codas: before a nasal a coda becomes the nasal of its place; after an obstruent a plain onset is tense.
PLACES = {"ㅇ": "ㄱㄲㅋ", "ㄴ": "ㄷㅅㅆㅈㅊㅌㅎ", "ㅁ": "ㅂㅍ"}
ASSIMILATION = [(c + n, nasal + n) for nasal, codas in PLACES.items() for n in "ㄴㅁ" for c in codas] + [tuple(x.split(":")) for x in "ㅁㄹ:ㅁㄴ ㅇㄹ:ㅇㄴ ㄱㄹ:ㅇㄴ ㅂㄹ:ㅁㄴ ㄴㄹ:ㄹㄹ ㄹㄴ:ㄹㄹ".split()]
TENSIFICATION = [(c + o, c + tense) for codas in PLACES.values() for o, tense in zip("ㄱㄷㅂㅅㅈ", "ㄲㄸㅃㅆㅉ") for c in codas if c != "ㅎ"]
VOICED = {"p": "b", "t": "d", "k": "ɡ", "tɕ": "dʑ"}

_C, _V = f"[{CONSONANTS}]", f"[{VOWEL_ORDER}]"
_SONORANT = f"[{VOWEL_ORDER}ㄴㄹㅇㅁ]"
_CLUSTER = re.compile(f"(?<={_V})({_C}{_C})(?={_C})")


def syllable(c: str) -> str:
    """Letters of a syllable: no silent onset, a double coda as two; other letters stay, a lone ㅇ goes."""
    n = ord(c) - 0xAC00
    if not 0 <= n < 11172:
        return "" if c == "ㅇ" else c
    lead, vowel, tail = LEADS[n // 588], VOWELS[n % 588 // 28], TAILS[n % 28 - 1] if n % 28 else ""
    return lead.replace("ㅇ", "") + vowel + SPLIT_CODAS.get(tail, tail)


def simplified(s: str) -> str:
    """Of three consonants after a vowel the first two become one; so do two at the end."""
    while (m := _CLUSTER.search(s)) and m[1] in CODA_PAIRS:
        s = s[: m.start()] + CODA_PAIRS[m[1]] + s[m.end() :]
    return s[:-2] + CODA_PAIRS.get(s[-2:], s[-2:]) if re.search(f"{_C}{_C}$", s) else s


def palatalized(syllables: list[str]) -> str:
    """ㄷ and ㅌ at the end of a syllable before one that begins with ㅣ."""
    turned = [s[:-1] + s[-1:].translate(str.maketrans("ㄷㅌ", "ㅈㅊ")) if after[:1] == "ㅣ" else s for s, after in zip(syllables, [*syllables[1:], ""])]
    return "".join(turned)


def replaced(s: str, rules) -> str:
    for a, b in rules:
        s = s.replace(a, b)
    return s


@functools.lru_cache(maxsize=100_000)
def word_letters(word: str) -> str:
    """A word's letters after all rules."""
    syllables = [syllable(c) for c in re.sub("[^가-힣ㄱ-ㅎㅏ-ㅣ]", "", word)]
    s = simplified("".join(syllables))
    if "ㄷㅣ" in s or "ㅌㅣ" in s:  # codas as they were written
        s = palatalized(syllables)
    if "ㅎ" in s:
        s = replaced(s, ASPIRATION)
    s = replaced(s, ASSIMILATION)
    s = simplified(replaced(s, TENSIFICATION))
    s = re.sub(f"({_C})(?={_C}|$)", lambda m: m[1].translate(NEUTRAL), s)
    s = re.sub(f"(?<={_SONORANT})ㅎ(?={_SONORANT})", "", s)
    s = re.sub(f"(?<=.)[ㅁㄴ](?=[ㄱㅋㄲ])", "ㅇ", s)
    return re.sub(f"(?<=.)[ㅁㄴ](?=[ㅂㅍㅃㅁ])", "ㅁ", s)


@functools.lru_cache(maxsize=100_000)
def word_ipa(word: str) -> str:
    letters = [c for c in word_letters(word) if c in IPA]
    sounds = [IPA[c] for c in letters]
    sonorant = [c in VOWEL_ORDER or c in "ㄴㄹㅇㅁ" for c in letters]
    for i in range(1, len(letters) - 1):
        if sonorant[i - 1] and sonorant[i + 1]:
            sounds[i] = VOICED.get(sounds[i], sounds[i])
        if letters[i] == "ㄹ" and letters[i - 1] in VOWEL_ORDER and letters[i + 1] in VOWEL_ORDER:
            sounds[i] = "ɾ"
    return "".join(sounds)


def ipa_text(text: str) -> str:
    """Words apart by one space."""
    return " ".join(word_ipa(w) for w in text.split())


def yale_text(text: str, merge: bool = False) -> str:
    """In Yale's letters; with `merge` ㅜ after a labial is ㅡ."""
    def one(w: str) -> str:
        s = word_letters(w)
        s = re.sub("(?<=[ㅂㅃㅍㅁ])ㅜ", "ㅡ", s) if merge else s
        return "".join(YALE[c] for c in s if c in YALE)

    return " ".join(one(w) for w in text.split())


hangul_to_ipa, hangul_to_yale = mapped(ipa_text), mapped(yale_text)
