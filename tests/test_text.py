import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from glyphlake.functions import chunking as K
from glyphlake.functions import conventions as C
from glyphlake.functions import diacritics as D
from glyphlake.functions import g2p as G
from glyphlake.functions import korean, levantine
from glyphlake.functions import numbers as NU
from glyphlake.functions import translit as L
from glyphlake.functions.arrow import mapped
from glyphlake.operators import frontend, gate


def NFD(text):
    return unicodedata.normalize("NFD", text)


def test_translit(values):
    assert values(L.decompose_hangul, "국민", "값", "hello 한 world", "", None) == ["ㄱㅜㄱㅁㅣㄴ", "ㄱㅏㅄ", "hello ㅎㅏㄴ world", "", None]
    assert values(lambda c: L.decompose_hangul(c, drop_silent_initial=True), "안", "강") == ["ㅏㄴ", "ㄱㅏㅇ"]
    assert values(lambda c: L.decompose_hangul(c, "conjoining"), "국") == [NFD("국")]
    assert values(L.kana_to_hira, "ラーメン", None) == ["らーめん", None]
    assert values(L.hira_to_kana, "らーめん") == ["ラーメン"]
    assert values(lambda c: L.to_cangjie(c, {"我": "hqi", "有": "kb"}), "我有ABC 123!", "") == ["hqi kb ABC 123!", ""]
    with pytest.raises(ValueError):
        L.decompose_hangul("t", "other")


def test_conventions(values):
    assert values(lambda c: C.strip(c, "tashkeel"), "مُحَمَّدٌ", "رحمٰن", None) == ["محمد", "رحمن", None]
    assert values(lambda c: C.strip(c, "niqqud"), "שָׁלוֹם") == ["שלום"]
    assert values(lambda c: C.strip(c, "wakachigaki"), "わたし は がくせい です", "第 3 章") == ["わたしはがくせいです", "第 3 章"]
    assert values(lambda c: C.detect(c, "tashkeel"), "مُحمد", "محمد", None) == ["marked", "none", None]
    assert values(lambda c: C.detect(c, "wakachigaki"), "x") == [None]
    assert C.conventions_for("Arab") == ["tashkeel", "kashida", "quranic-marks"]
    with pytest.raises(ValueError):
        C.strip("t", "jamo-form")
    with pytest.raises(ValueError):
        C.apply("t", "tashkeel")
    with pytest.raises(ValueError):
        C.restyle("t", "pinyin-tone", "letters")


def test_pinyin(values):
    assert values(lambda c: C.restyle(c, "pinyin-tone", "mark", "number"), "lv4 nu:3", "Xi1'an1", "m2", "liu2 gou3 ma5") == ["lǜ nǚ", "Xī'ān", "ḿ", "liú gǒu ma"]
    assert values(lambda c: C.restyle(c, "pinyin-tone", "number", "mark"), "fāngān", "mā ma") == ["fan1gan1", "ma1 ma5"]
    assert values(lambda c: C.strip(c, "pinyin-tone"), "Nǐ hǎo ma5", "di4 3 ceng2") == ["Ni hao ma", "di 3 ceng"]


def test_jamo(values):
    assert values(lambda c: C.detect(c, "jamo-form"), "ㄱㅏ", NFD("가"), "hangul-free") == ["compatibility", "conjoining", None]
    assert values(lambda c: C.restyle(c, "jamo-form", "conjoining"), "ㄱㅜㄱㅁㅣㄴ", NFD("가")) == [NFD("국민"), NFD("가")]
    assert values(lambda c: C.restyle(c, "jamo-form", "compatibility"), NFD("국민"), "ㄱ") == ["ㄱㅜㄱㅁㅣㄴ", "ㄱ"]


def test_diacritics(values):
    assert values(lambda c: D.strip_diacritics(c, "mk"), "к\u0301е г\u0301авол", "г\u0300\u0301 а\u0301", None) == ["\u045cе \u0453авол", "\u0453 а", None]
    assert values(lambda c: D.strip_diacritics(c, "ru"), "г\u0301а к\u0301а") == ["га ка"]
    assert values(lambda c: D.replace_stress_mark(c, "ru", before="+"), "приве\u0301т", "cafe\u0301", "к\u0301") == ["прив+ет", "cafe\u0301", "к\u0301"]
    assert values(lambda c: D.replace_stress_mark(c, "ru", after="'"), "о\u0301") == ["о'"]
    assert D.family("her") is None and D.family("arz") == "ar" and D.family("ar-Latn") is None and D.family("pt-BR") is None
    assert D.is_stress_lang("ru-RU") and not D.is_stress_lang("az") and D.is_stress_lang("uz-Cyrl") and not D.is_stress_lang("ru-Latn")
    with pytest.raises(ValueError):
        D.strip_diacritics("t", "pt")
    assert values(D.hebrew_model_text, "שלום 12–x…", None) == ["שלומ 55-O,", None]


REMOVED = [
    ("10,4 16:30 1139-1185", "10,4 16:30 1139-1185"), ("Sim!Não! talvez", "Sim Não talvez"), ("U.S.A.! go", "USA go"), ("3.º", "3º"), ("Lisboa–Porto.", "Lisboa Porto"), ("COVID-19 chegou.", "COVID 19 chegou"), ("3-D", "3 D"),
    ("Pay 4.50!They go.", "Pay 4.50 They go"), ("16!30", "16!30"), ("don't well‐known", "don't well-known"), ("...", ""), ("", ""), (None, None),
]


def test_remove_punctuation(values):
    assert values(K.remove_punctuation, *(a for a, _ in REMOVED)) == [b for _, b in REMOVED]


def test_chunking(values):
    assert [tuple(x) for x in values(K.chunk_text, "Disse isto: ola")[0]] == [("Disse isto", ":", False), ("ola", ".", True)]
    assert [tuple(x) for x in values(K.chunk_text, "")[0]] == [("", "", True)]
    assert [tuple(x) for x in values(K.split_clauses, "Ola, tudo bem? sim 10,4")[0]] == [("Ola", ","), (" tudo bem", "?"), (" sim 10,4", None)]
    assert values(K.clause_mark, ",", "...", "؟", "-", None) == [",", None, "?", None, None]
    assert values(K.sentences, "Mr. Smith came. He left! Why?") == [["Mr. Smith came.", "He left!", "Why?"]]
    assert values(K.paragraphs, "a\n \nb\nc") == [["a", "b\nc"]]
    assert values(K.graphemes, 'motse-moholo - "x" A;b') == ["motse-moholo x a,b"]
    assert [tuple(x) for x in values(K.inline_blocks, "a [[b]] c")[0]] == [("a ", False), ("[[b]]", True), (" c", False)]


def test_split_clauses_is_linear():
    import time

    began = time.time()
    K.split_clauses_text("!" * 200_000 + " x")
    assert time.time() - began < 5


def test_join_sentences(spark):
    df = spark.createDataFrame([([["a", "."], ["b"], [], ["c"]],)], "t array<array<string>>")
    assert df.select(K.join_sentences("t")).first()[0] == ["a", ".", "b", " ", "c"]
    assert df.select(K.join_sentences("t", False)).first()[0] == ["a", ".", " ", "b", " ", "c"]


def test_russian():
    assert [G.russian_text(w) for w in ("прив+ет", "молок+о", "щука", "тётя", "abc")] == ["p rj i0 vj e1 t", "m o0 l o0 k o1", "sch u0 k a0", "tj o0 tj a0", "a b c"]


STRESSED = [
    ("з+амок", ["z a0 m o1 k", "z a1 m o0 k"], "z a1 m o0 k"), ("з+амок", ["z a1 m o1 k", "z a1 m o0 k"], "z a1 m o0 k"), ("з+амок", ["z a0 m o0 k", "z a1 m o1 k"], "z a1 m o1 k"),
    ("з+амок", ["z a1 m k"], None), ("замок", ["z a1 m o0 k"], None), ("з+мок", ["z a1 m o0 k"], None), ("з+амок", [], None), ("з+амок+", ["z a1 m o0 k"], "z a1 m o0 k"),
]


def test_stressed_entry(spark):
    df = spark.createDataFrame([(w, [v.split() for v in vs]) for w, vs, _ in STRESSED], "w string, v array<array<string>>").coalesce(1)
    got = [r[0] for r in df.select(G.stressed_entry(F.col("w"), F.col("v"))).collect()]
    assert got == [e and e.split() for _, _, e in STRESSED]


def test_numbers():
    assert NU.cardinal(1234) == "one thousand two hundred thirty four" and NU.cardinal(-1_000_000) == "minus one million"
    assert [NU.ordinal(n) for n in (1, 12, 20, 21, 100)] == ["first", "twelfth", "twentieth", "twenty first", "one hundredth"]
    assert [NU.year(n) for n in (1984, 1905, 1900, 2000, 2005, 2026, 1000, 999)] == ["nineteen eighty four", "nineteen oh five", "nineteen hundred", "two thousand", "two thousand five", "twenty twenty six", "one thousand", "nine hundred ninety nine"]
    assert [NU.pairs(n) for n in (4070, 9001, 720, 100)] == ["forty seventy", "ninety oh one", "seven twenty", "one hundred"]
    assert [NU.number_words(t) for t in ("1,234", "3.14", "007", ".5")] == ["one thousand two hundred thirty four", "three point one four", "zero zero seven", " point five"]
    assert NU.duration(2, 3, 45) == "two hours, three minutes and forty five seconds" and NU.duration(0, 0, 0) == "zero seconds" and NU.duration(0, 1, 0) == "one minute"
    assert [NU.fraction_words(1, 2), NU.fraction_words(3, 4), NU.fraction_words(1, 8, True)] == ["one half", "three quarters", "an eighth"]
    assert [NU.chinese(x) for x in ("10", "1010", "10010", "100100", "3.20", ".22", "0", "105", "120000000", "100000001", "1000010", "")] == ["十", "一千零一十", "一万零一十", "十万零一百", "三点二", "零点二二", "零", "一百零五", "一亿二千万", "一亿零一", "一百万零一十", ""]


def test_chinese_text():
    assert NU.chinese_text("涨了50%，占1/3，-5度，3-5天，2024年，13800138000") == "涨了百分之五十，占三分之一，负五度，三到五天，二零二四年，幺三八零零幺三八零零零"
    assert NU.chinese_text("１２３") == NU.chinese_text("123") == "一百二十三"


def test_diacritize(values):
    assert values(lambda c: D.diacritize(c, "en"), "a", None) == ["a", None]
    with pytest.raises(ImportError):
        D.diacritize("t", "he")
    with pytest.raises(ValueError):
        D.diacritize("t", "az")
    D.register_diacritizer("he", lambda c, lang: F.concat(c, F.lit(f"+{lang}")))
    assert values(lambda c: D.diacritize(c, "he-IL"), "a") == ["a+he-IL"]
    D.DIACRITIZERS.clear()


def test_spans():
    assert G.language_spans_text("مرحبا hello 12!") == [("مرحبا", "ar"), ("hello 12!", "en")]
    assert G.language_spans_text("12 abc") == [("12 abc", "en")] and G.language_spans_text("") == []


def test_small_helpers(values):
    assert values(G.english_letters, "Fox 1 a!") == ["fɒks æ"]
    assert values(G.msa_to_levantine, "d͡ʒamal qalb ðˤ") == ["ʒamal ʔalb zˤ"]
    assert values(G.strip_case_endings, "كِتَابٌ مُعَلِّمَةً شُكْرًا") == ["كِتَاب مُعَلِّمَة شُكْرًا"]
    assert values(G.pinyin_initial, "zhong", "an", "shi") == ["zh", "", "sh"]


def test_distance():
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            now = [i]
            for j, y in enumerate(b, 1):
                now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y)))
            row = now
        return row[-1]

    rng = random.Random(3)
    for _ in range(300):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 9))] for _ in range(2))
        assert gate.distance(a, b) == plain(a, b)


def test_gate(spark):
    rows = spark.createDataFrame([("plain", "abc", "abd", "xyz"), ("plain", "ab", "ab", "ab"), ("number", "a", "a", "b")], "category string, expected_ipa string, after string, before string")
    per = {r.category: (r.n_errors, r.n_segments) for r in gate.per_by_category(rows, output="after").collect()}
    assert per == {"plain": (1, 5), "number": (0, 1)}
    found = gate.compare(rows, "before", "after")
    assert {r.category: (round(r.gain, 6), round(r.noise, 6), r.n_segments) for r in found.collect()} == {"plain": (0.4, 0.4, 5), "number": (1.0, 1.0, 1)}
    assert gate.verdict(found, "plain").first().passed is False  # one row carries the whole gain


def test_segments(values):
    assert values(gate.segments, "ˈtʰɑː.t͡ʃ", "") == [["ˈ", "tʰ", "ɑː", "t", "ʃ"], []]


def test_frontend(spark):
    df = spark.createDataFrame([(1, "Olá [[ˈana]], tudo BEM? Sim."), (2, ""), (3, "[[ ]] x"), (4, None), (5, "!!!")], "doc_id long, text string")
    front = frontend.Frontend()
    flat = {r.doc_id: r.phonemes for r in front.flat(df).collect()}
    assert flat[1] == "olá ˈana tudo bem sim" and flat[3] == "x" and flat[2] == "" and flat[4] is None and flat[5] == ""
    assert {r.doc_id: r.unread for r in front.unread(df).collect()} == {1: False, 2: False, 3: False, 4: None, 5: False}
    upper = frontend.Frontend(normalize=F.upper)
    assert df.where("doc_id = 1").select(upper.prepare("text")).first()[0] == "OLÁ [[ˈana]], TUDO BEM? SIM."
    assert frontend.Frontend(normalize=F.upper, owned=frozenset(["normalize"]))._stage("normalize")("t") == "t"
    with pytest.raises(ImportError):
        frontend.backend("espeak")
    with pytest.raises(ValueError):
        frontend.backend("nothing")


PIECES = [
    ("sentence", "Olá mundo. Tudo bem?", ["Olá mundo.", "Tudo bem?"]), ("clause", "Olá, mundo. Tudo bem?", ["Olá,", "mundo.", "Tudo bem?"]), ("paragraph", "Olá mundo. Tudo bem?", ["Olá mundo. Tudo bem?"]),
    ("none", "a\n\nb", ["a\n\nb"]), ("sentence", "Ab [[xy]] cd. Ef.", ["Ab [[xy]]", "cd.", "Ef."]), ("sentence", "a [[x]] b [[y]] c.", ["a [[x]]", "b [[y]]", "c."]), ("clause", "[[ana]].", ["[[ana]]."]),
    ("sentence", "Olá [[ana]], tudo bem?", ["Olá [[ana]],", "tudo bem?"]), ("sentence", "Olá [[ana]]! Tudo bem?", ["Olá [[ana]]!", "Tudo bem?"]), ("sentence", "[[ana]] Olá.", ["[[ana]]", "Olá."]), ("sentence", "", []),
]


@pytest.mark.parametrize("chunk, text, expected", PIECES)
def test_pieces(chunk, text, expected):
    assert [s for _, s in frontend.pieces_text(text, chunk, K.sentences_text)] == expected


def test_rows_stay(spark):
    """Equal and null ids are read each for itself, by a native backend in place and by a Python one through rows; both have no shuffle."""
    rows = [(1, "Ab. Cd, [[x]] e."), (1, "Ef."), (None, "Gh."), (None, None), (2, ""), (3, "Ij. " * 30_000), (1, "Ef.")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    python = mapped(lambda t: re.sub(r"\s+", " ", t.lower()))
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    expected = sorted([(1, "ab cd x e"), (1, "ef"), (1, "ef"), (None, "gh"), (None, None), (2, ""), (3, " ".join(["ij"] * 30_000))], key=key)
    for backend in (K.graphemes, python):
        flat = frontend.Frontend(backend=backend).flat(df)
        assert sorted(map(tuple, flat.collect()), key=key) == expected
        assert "hashpartitioning" not in flat._jdf.queryExecution().executedPlan().toString()
        assert sorted(r.phonemes for r in frontend.spoken_sentences(df.where("doc_id = 1"), backend).collect()) == ["ab.", "cd, x e.", "ef.", "ef."]
        assert frontend.Frontend(backend=backend).flat(df.where("false")).collect() == []


def test_stage_order(spark):
    """Normalised and cased whole, each sentence with its marks, then the backend, without punctuation."""
    add = lambda mark: lambda c: F.concat(F.lit(mark), c)
    front = frontend.Frontend(normalize=add("N"), casing=F.lower, diacritize=add("d"), backend=lambda c: F.concat(c, F.lit("!")))
    df = spark.createDataFrame([(1, "Ab. Cd.")], "doc_id long, text string")
    rows = front.segments(df).orderBy("seg").collect()
    assert [(r.source, r.phonemes) for r in rows] == [("nab. cd.", "dnab cd!")]  # lower case begins no sentence
    rows = frontend.Frontend(normalize=add("N"), diacritize=add("d"), backend=lambda c: c).segments(df).orderBy("seg").collect()
    assert [r.phonemes for r in rows] == ["dNAb", "dCd"]


@pytest.mark.parametrize("text, said", [
    ("It cost $5.50 and £3m, or 20 EUR.", "It cost five dollars and fifty cents and three million pounds, or twenty euros."), ("at 10:30 pm, 20:00, 0:00, 2:03:45", "at ten thirty P M, twenty hundred, midnight, two hours, three minutes and forty five seconds"),
    ("16:9, 1:25,000", "sixteen to nine, one to twenty five thousand"), ("3/4/2021, 25/12/2020, 2021-03-04, 15.11.2026", "March fourth twenty twenty one, December twenty fifth twenty twenty, March fourth twenty twenty one, November fifteenth twenty twenty six"),
    ("22 February 2024 and Jan. 5, 1999", "the twenty second of February twenty twenty four and January fifth nineteen ninety nine"), ("800-555-0199", "eight hundred, five five five, oh one nine nine"),
    ("5 km, 1 kg, 10-20 mph, 120 m²", "five kilometers, one kilogram, ten to twenty miles per hour, one hundred twenty square meters"), ("12% of 3 1/2, 3/4, 24/7, 1½, ½", "twelve percent of three and a half, three quarters, twenty four seven, one and a half, one half"),
    ("the 21st, 1990s and '80s", "the twenty first, nineteen nineties and eighties"), ("RTX 4070 in 1984, 007, 1,234.5", "RTX forty seventy in nineteen eighty four, zero zero seven, one thousand two hundred thirty four point five"), ("no figures", "no figures"), ("", ""),
])
def test_english_verbaliser(text, said):
    from glyphlake.functions.verbalize import english

    assert english(text) == said


@pytest.mark.parametrize("word, letters, ipa", [
    ("맏이", "ㅁㅏㅈㅣ", "mädʑi"), ("북한", "ㅂㅜㅋㅏㄴ", "pukʰän"), ("닭", "ㄷㅏㄱ", "täk"), ("닭도", "ㄷㅏㄱㄸㅗ", "täkt*o"), ("값이", "ㄱㅏㅂㅆㅣ", "käps*i"), ("국물", "ㄱㅜㅇㅁㅜㄹ", "kuŋmul"),
    ("독립", "ㄷㅗㅇㄴㅣㅂ", "toŋnip"), ("신라", "ㅅㅣㄹㄹㅏ", "silla".replace("a", "ä")), ("같이", "ㄱㅏㅊㅣ", "kätɕʰi"), ("학교", "ㅎㅏㄱㄲㅛ", "häkk*jo"), ("나라", "ㄴㅏㄹㅏ", "näɾä"), ("abc", "", ""),
])
def test_korean(word, letters, ipa):
    assert korean.word_letters(word) == letters and korean.ipa_text(word) == ipa


def test_korean_column(values):
    assert values(korean.hangul_to_ipa, "국물  나라", "", None) == ["kuŋmul näɾä", "", None]
    assert values(korean.hangul_to_yale, "닭도") == ["taktto"]


def test_levantine(values):
    words = {"الشَّمْس": "ʔiʃʃams", "كَتَبَ": "kataba", "بَيْت": "beːt", "صَابُون": "sˤɑːbuːn", "القَمَر": "ʔilʔamar", "هذا": "haːda", "مُدير": "mudjer", "كَتَبْتْلَك": "katabtelak"}
    assert {w: levantine.levantine_text(w) for w in words} == words
    assert values(levantine.levantine_to_ipa, "هذا بَيْت", "", None) == ["haːda beːt", "", None]
    assert [levantine.arabic_number(n) for n in (5, 21, 125, 2005, 3000)] == ["خَمسة", "واحَد وْعِشرين", "مية وْخَمسة وْعِشرين", "أَلفين وْخَمسة", "تْلاتة تْلاف"]
    assert levantine.verbalized("It cost $5.50 or 20% at 10:30, 9:00 and -3.5", "en") == "It cost five dollars and fifty cents or twenty percent at ten thirty , nine o'clock and minus three point five"
    assert levantine.english_number(1234) == "one thousand two hundred and thirty-four"
    assert levantine.cleaned("مـرحبا،  ١٢٣ “x”") == 'مرحبا, 123 "x"'


def test_clause_pieces():
    for text in ("Ola, tudo bem?  sim 10,4", "", "a, b", "...! x", "a,"):
        assert "".join(K.clause_pieces_text(text)) == text
    assert K.clause_pieces_text("Ola, tudo bem?  sim 10,4") == ["Ola, ", "tudo bem?  ", "sim 10,4"]


def test_match_lang():
    from glyphlake.plans import languages as P

    assert P.match_lang("ru", ["ru-RU"]) == "ru-RU" and P.match_lang("rus", ["ru-RU"]) == "ru-RU" and P.match_lang("pt-BR", ["pt-PT", "pt-BR"]) == "pt-BR"
    for bad, error in ((None, P.MissingLanguageError), ("und", P.MissingLanguageError), ("xx", P.UnsupportedLanguageError), ("sr-Latn", P.UnsupportedLanguageError)):
        with pytest.raises(error):
            P.match_lang(bad, ["ru-RU", "sr-Cyrl"])
    assert P.differs_from({"a": 1, "b": 2}, {"a": 1, "b": 3, "c": None}) == ["b"]


def test_spoken_sentences(spark):
    df = spark.createDataFrame([(1, "Olá, \"Ana\", tudo bem! Estás pronta? Sim."), (2, ""), (3, "..."), (4, None)], "doc_id long, text string")
    out = [(r.doc_id, r.sentence, r.phonemes) for r in frontend.spoken_sentences(df).orderBy("doc_id", "sentence").collect()]
    assert out == [(1, 0, "olá, ana, tudo bem!"), (1, 1, "estás pronta?"), (1, 2, "sim.")]
    bare = [r.phonemes for r in frontend.spoken_sentences(df, keep_punctuation=False).orderBy("doc_id", "sentence").collect()]
    assert " ".join(bare) == "olá ana tudo bem estás pronta sim"


def test_alignment(spark):
    from glyphlake.operators import alignment

    words = {"thin": "TH IH1 N", "this": "DH IH1 S", "tin": "T IH1 N", "hit": "HH IH1 T", "sit": "S IH1 T", "sin": "S IH1 N", "nit": "N IH1 T", "math": "M AE1 TH", "mat": "M AE1 T", "hat": "HH AE1 T", "path": "P AE1 TH", "pat": "P AE1 T"}
    entries = spark.createDataFrame([(w, p.split()) for w, p in words.items()] + [("toolongaword", ["T"])], "word string, phones array<string>").repartition(3)
    table = alignment.train(entries, 6)
    assert alignment.aligned("thin", ["TH", "IH1", "N"], table) == ["th", "i", "n"]
    assert alignment.aligned("path", ["P", "AE1", "TH"], table) == ["p", "a", "th"]
    assert alignment.aligned("toolongaword", ["T"], table) is None
    by = {}
    for (phone, _), p in table.items():
        by[phone] = by.get(phone, 0) + p
    assert all(abs(v - 1) < 1e-3 for v in by.values())
    got = {r.word: r.a for r in entries.select("word", alignment.align("word", "phones", table).alias("a")).collect()}
    assert got["mat"] == ["m", "a", "t"] and got["toolongaword"] is None
