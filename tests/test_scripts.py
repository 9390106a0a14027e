import pytest

from glyphlake.functions import scripts as S
from glyphlake.functions import tables as T


def tuples(rows):
    return [None if r is None else [tuple(x) for x in r] for r in rows]


def test_registry():
    assert len(T.SCRIPTS) == 34 and len(S.RANGES) == 85
    assert all(a[1] < b[0] for a, b in zip(S.RANGES, S.RANGES[1:]))
    assert {c for c, s in T.SCRIPTS.items() if s["direction"] == "rtl"} == {"Arab", "Hebr", "Cprt", "Phnx"}
    assert len(T.WHITE_SPACE) == len(set(T.WHITE_SPACE)) == 25 and "\x1c" not in T.WHITE_SPACE


def test_char_script(values):
    assert values(S.char_script, "a", "я", "ab", "", "ʃ", " ", "😀", "\U00020000", None, "́") == ["Latn", "Cyrl", None, None, "Latn", None, None, "Hani", None, None]


def test_every_range_end(values):
    points = [p for lo, hi, _ in S.RANGES for p in (lo, hi) if not 0xD800 <= p <= 0xDFFF]
    expected = [next(c for lo, hi, c in S.RANGES if lo <= p <= hi) for p in points]
    assert values(S.char_script, *map(chr, points)) == expected


def test_detect_and_distribution(values):
    assert values(S.detect_script, "Hello Привет мир", "ab пр", "12", None, "") == ["Cyrl", "Latn", None, None, None]
    assert tuples(values(S.script_distribution, "Hello Привет мир", "日本語ひらがなカタカナ", "", None)) == [[("Cyrl", 9), ("Latn", 5)], [("Hira", 4), ("Kana", 4), ("Hani", 3)], [], None]


def test_runs(values):
    texts = ["привет hello", "  12 hi", "", "日本語カナ x", None, "😀 a"]
    runs = tuples(values(S.script_runs, *texts))
    assert runs == [[("Cyrl", "привет "), ("Latn", "hello")], [(None, "  12 "), ("Latn", "hi")], [], [("Hani", "日本語"), ("Kana", "カナ "), ("Latn", "x")], None, [(None, "😀 "), ("Latn", "a")]]
    assert ["".join(x for _, x in r) for r in runs if r is not None] == [t for t in texts if t is not None]


def test_direction(values):
    assert values(S.base_direction, "Hello مرحبا", "مرحبا", "abc", "12", None) == ["mixed", "rtl", "ltr", "mixed", None]


@pytest.mark.parametrize("tag, script", [("pt-BR", "Latn"), ("ru", "Cyrl"), ("sr-Latn", "Latn"), ("uzb_cyr", "Cyrl"), ("aze_lat", "Latn"), ("rus", "Cyrl"), ("xx", None), ("zh-Hant", "Hani"), ("", None)])
def test_lang(values, tag, script):
    assert values(S.lang_to_script, tag) == [script]


def test_labels_and_langs(values):
    assert values(S.normalize_script_tag, " Latin ", "LATN", "jamo", "zzz", None) == ["Latn", "Latn", "Hang", None, None]
    assert values(S.script_to_langs, "Armn", "Zzzz", None) == [["hy"], [], None]
