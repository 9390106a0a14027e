import random

import pytest

from glyphlake.functions import notation as N
from glyphlake.functions import tables as T
from glyphlake.functions.transcode import clash, quarantined, transcode
from glyphlake.plans import graph as P

GOLDEN = [
    (N.arpa_to_ipa, "HH AH0 L OW1", "həloʊ"), (N.arpa_to_ipa, "ZZZ Q9", "ZZZQ9"), (N.ipa_to_arpa, "həloʊ", "HH AX L OW"), (N.ipa_to_arpa, "χψ", "? ?"), (N.ipa_to_arpa, "ɛ ɛ", "EH EH"),
    (N.xsampa_to_ipa, "k{t", "kæt"), (N.xsampa_to_ipa, "??unknown", "ʔʔunknown"), (N.xsampa_to_ipa, "S_1a", "ʃ_1a"), (N.ipa_to_xsampa, "kʰã", "k_ha~"), (N.ipa_to_xsampa, "t͡s", "t_s"), (N.ipa_to_xsampa, "t͡θ", "tT"),
    (N.buckwalter_to_arabic, "mHmd", "محمد"), (N.buckwalter_to_arabic, "ZZ##", "ظظ##"), (N.arabic_to_buckwalter, "مرحبا", "mrHbA"), (N.arabic_to_buckwalter, "ﻻ", "lA"),
    (N.lexique_to_ipa, "b§ZuR", "bɔ̃ʒuʁ"), (N.ipa_to_lexique, "bɔ̃ʒuʁ", "b§ZuR"), (N.kirshenbaum_to_ipa, "S", "ʃ"), (N.ipa_to_kirshenbaum, "ŋ", "N"), (N.cotovia_to_ipa, "karro", "karo"), (N.ipa_to_cotovia, "ʎ", "L"),
    (N.rfe_to_ipa, "kaša", "kaʃa"), (N.ipa_to_rfe, "ɲ", "ñ"), (N.halabi_to_ipa, "b_dbl_a", "bːa"), (N.halabi_to_ipa, "s a l aa m", "s a l aː m"), (N.halabi_to_ipa, "_sil_a_eos_", " a"),
    (N.iqra_halabi_to_ipa, "f ii h i x A y r aa t u n", "fiːhixɑjraːtun"),
]


@pytest.mark.parametrize("fn, text, expected", GOLDEN)
def test_golden(values, fn, text, expected):
    assert values(fn, text, "", None) == [expected, "", None]


def test_stress(values):
    assert values(lambda c: N.arpa_to_ipa(c, stress=True), "HH AH0 L OW1") == ["həlˈoʊ"]
    assert values(lambda c: N.ipa_to_arpa(c, stress=True), "həlˈoʊ", None) == ["HH AH0 L OW1", None]


def test_stress_round_trip():
    rng = random.Random(7)
    plain = [a for a in T.ARPA if a not in T.ARPA_VOWELS and a not in ("H", "EM", "EN", "ENG", "EL", "NX", "DX", "WH", "Q")]
    vowels = [v for v in T.ARPA_VOWELS if v not in ("AX", "AXR")]
    same = 0
    for _ in range(400):
        tokens = [rng.choice(vowels) + rng.choice("012") if rng.random() < 0.4 else rng.choice(plain) for _ in range(rng.randint(1, 8))]
        marks = {"1": "ˈ", "2": "ˌ", "0": ""}
        ipa = "".join((marks[t[-1]] if t[-1] in marks else "") + N.ARPA_IPA[t] for t in tokens)
        same += N.ipa_to_arpa_text(ipa, stress=True) == " ".join(tokens)
    assert same > 350


@pytest.mark.parametrize("errors, expected", [("pass", "karo #?q"), ("replace", "karo ???"), ("ignore", "karo ")])
def test_policies(values, errors, expected):
    assert values(lambda c: N.cotovia_to_ipa(c, errors), "karro #?q") == [expected]


def test_strict(values):
    assert values(lambda c: N.cotovia_to_ipa(c, "strict"), "karro k", None) == ["karo k", None]
    with pytest.raises(Exception, match="no cotovia mapping for '#' at position 2"):
        values(lambda c: N.cotovia_to_ipa(c, "strict"), "ka#")
    with pytest.raises(ValueError):
        N.cotovia_to_ipa("t", "loose")


def test_quarantine(values):
    rows = values(lambda c: quarantined(c, N.cotovia_to_ipa(c), T.COTOVIA, "cotovia"), "karro", "tS#")
    assert rows[0].value == "karo" and rows[0].error is None
    assert rows[1].value is None and (rows[1].error.symbol, rows[1].error.position) == ("#", 2)


@pytest.mark.parametrize("table", [T.COTOVIA, T.RFE, N.IPA_RFE, N.IPA_COTOVIA, N.IPA_LEXIQUE])
def test_both_forms_agree(values, table):
    assert not clash(table)
    rng = random.Random(1)
    letters = [*table, " ", "#", "é"]
    texts = ["".join(rng.choice(letters) for _ in range(30)) for _ in range(40)]
    assert values(lambda c: transcode(c, table, "x", form="lookup"), *texts) == values(lambda c: transcode(c, table, "x"), *texts)


@pytest.mark.parametrize("table", [T.COTOVIA, N.IPA_RFE, N.IPA_ARPA, N.IPA_LEXIQUE, {"ab": "1", "bc": "2", "abc": "", "a": "xyz", "?": "q"}])
@pytest.mark.parametrize("errors", ["pass", "replace", "ignore"])
def test_cut_form_agrees(values, table, errors):
    rng = random.Random(2)
    letters = [*table, " ", "#", "é", "?", "b", "c"]
    texts = ["".join(rng.choice(letters) for _ in range(25)) for _ in range(60)] + ["", "a"]
    assert values(lambda c: transcode(c, table, "x", errors, "split"), *texts) == values(lambda c: transcode(c, table, "x", errors, "lookup"), *texts)


@pytest.mark.parametrize("errors", ["pass", "replace", "ignore"])
def test_xsampa_against_a_plain_reader(values, errors):
    rng = random.Random(3)
    letters = [*T.XSAMPA, " ", "\\", "_", "_1", "_`", "€", "#"]

    def plain(text):
        out, at = "", 0
        while at < len(text):
            m = N._XS_SYMBOL.match(text, at)
            s = m[0] if m else text[at]
            out += T.XSAMPA.get(s) or (s if s in T.WHITE_SPACE else {"pass": s, "replace": "?", "ignore": ""}[errors])
            at += len(s)
        return out

    texts = ["".join(rng.choice(letters) for _ in range(12)) for _ in range(300)]
    assert values(lambda c: N.xsampa_to_ipa(c, errors), *texts) == [plain(t) for t in texts]


def test_ipa_to_xsampa_short_way(monkeypatch):
    import re

    rng = random.Random(4)
    texts = ["".join(rng.choice([*T.XSAMPA.values(), " ", "€"]) for _ in range(6)) for _ in range(500)]
    short = [N.ipa_to_xsampa_text(t) for t in texts]
    monkeypatch.setattr(N, "_IPA_XS_SPECIAL", re.compile(""))  # now every text goes the long way
    assert short == [N.ipa_to_xsampa_text(t) for t in texts]


def test_xsampa_inventory_round_trip(values):
    once = [v for v in T.XSAMPA.values()]
    back = values(N.ipa_to_xsampa, *once)
    again = values(N.xsampa_to_ipa, *back)
    import unicodedata

    assert [unicodedata.normalize("NFD", a) for a in again] == [unicodedata.normalize("NFD", v) for v in once]


def test_graph():
    E = P.Edge
    toy = P.ConversionGraph([E("a", "c", None, False), E("a", "b", None), E("b", "c", None)])
    assert [e.dst for e in toy.route("a", "c")] == ["b", "c"]
    assert toy.route("a", "a") == [] and toy.can_convert("a", "a") and not toy.can_convert("c", "a")
    with pytest.raises(ValueError, match="reachable from 'c': \\(nothing\\)"):
        toy.route("c", "a")
    more = toy.extend(lambda g: g.register(E("c", "d", None)))
    assert more.can_convert("a", "d") and not toy.can_convert("a", "d")
    assert len(P.DEFAULT_GRAPH.edges) == 23 and len(P.DEFAULT_GRAPH.nodes) == 19
    assert [e.dst for e in P.DEFAULT_GRAPH.route("arpa", "x-sampa")] == ["ipa", "x-sampa"]


def test_convert(values):
    assert values(lambda c: P.convert(c, "ipa", "arpa"), "χ") == ["χ"]  # the facade passes unknown symbols
    assert values(lambda c: P.DEFAULT_GRAPH.convert(c, "ipa", "arpa"), "χ") == ["?"]
    assert values(lambda c: P.convert(c, "arpa", "arpa"), "x") == ["x"]
    assert not P.can_convert("ipa", "ipa") and P.can_convert("arpa", "x-sampa") and not P.can_convert("ipa", "halabi")
    with pytest.raises(ValueError, match="Unsupported"):
        P.convert("t", "ipa", "arabic")
    with pytest.raises(ValueError):
        P.can_convert("ipa", "klingon")


def test_looks_like_ipa(values):
    assert values(N.looks_like_ipa, "pʰɑtʃ", "hello", "", None) == [True, False, False, None]
