"""Fixed values of the text functions, stated as text: ranges, symbols and labels that results must equal."""

from __future__ import annotations


def pairs(text: str) -> dict[str, str]:
    """'key value' words, in order."""
    words = text.split()
    return dict(zip(words[::2], words[1::2]))


# Writing systems by ISO 15924 code, with name, direction, type and inclusive ranges of code points.
SCRIPTS_TEXT = """
Latn | Latin | ltr | alphabet | 0041-005A 0061-007A 00C0-024F 0250-02AF 1E00-1EFF 2C60-2C7F A720-A7FF AB30-AB6F 10780-107BF 1DF00-1DFFF
Cyrl | Cyrillic | ltr | alphabet | 0400-04FF 0500-052F 1C80-1C8F 2DE0-2DFF A640-A69F 1E030-1E08F
Arab | Arabic | rtl | abjad | 0600-06FF 0750-077F 0870-089F 08A0-08FF FB50-FDFF FE70-FEFC
Hebr | Hebrew | rtl | abjad | 0590-05FF FB1D-FB4F
Deva | Devanagari | ltr | abugida | 0900-097F A8E0-A8FF
Hang | Hangul | ltr | featural | AC00-D7AF 1100-11FF 3130-318F A960-A97C D7B0-D7FF
Hira | Hiragana | ltr | syllabary | 3040-309F
Kana | Katakana | ltr | syllabary | 30A0-30FF 31F0-31FF
Hani | Han | ltr | logographic | 4E00-9FFF 3400-4DBF F900-FAFF 20000-2A6DF 2A700-2B73F 2B740-2B81F 2B820-2CEAF 2CEB0-2EBEF 2F800-2FA1F 30000-3134F 31350-323AF 323B0-3347F
Grek | Greek | ltr | alphabet | 0370-03FF 1F00-1FFF
Armn | Armenian | ltr | alphabet | 0530-058F
Geor | Georgian | ltr | alphabet | 10A0-10FF 2D00-2D2F 1C90-1CBF
Ethi | Ethiopic | ltr | abugida | 1200-137F 1380-139F 2D80-2DDF AB00-AB2F 1E7E0-1E7FF
Khmr | Khmer | ltr | abugida | 1780-17FF 19E0-19FF
Telu | Telugu | ltr | abugida | 0C00-0C7F
Knda | Kannada | ltr | abugida | 0C80-0CFF
Mlym | Malayalam | ltr | abugida | 0D00-0D7F
Orya | Odia | ltr | abugida | 0B00-0B7F
Cans | Unified Canadian Aboriginal Syllabics | ltr | abugida | 1400-167F 18B0-18FF
Tfng | Tifinagh | ltr | alphabet | 2D30-2D7F
Thai | Thai | ltr | abugida | 0E00-0E7F
Beng | Bengali | ltr | abugida | 0980-09FF
Guru | Gurmukhi | ltr | abugida | 0A00-0A7F
Gujr | Gujarati | ltr | abugida | 0A80-0AFF
Taml | Tamil | ltr | abugida | 0B80-0BFF 11FC0-11FFF
Sinh | Sinhala | ltr | abugida | 0D80-0DFF 111E0-111FF
Mymr | Myanmar | ltr | abugida | 1000-109F A9E0-A9FF AA60-AA7F 116D0-116FF
Tibt | Tibetan | ltr | abugida | 0F00-0FFF
Laoo | Lao | ltr | abugida | 0E80-0EFF
Glag | Glagolitic | ltr | alphabet | 2C00-2C5F
Runr | Runic | ltr | alphabet | 16A0-16FF
Ogam | Ogham | ltr | alphabet | 1681-169C
Cprt | Cypriot | rtl | syllabary | 10800-1083F
Phnx | Phoenician | rtl | abjad | 10900-1091F
"""

# The default script of a language.
LANGUAGES_TEXT = """
Latn: en de fr es pt it nl sv no da fi pl cs sk hr sl ro hu lt lv et mt sq eu ca gl cy ga af sw id ms tl tr az uz la is fo lb oc br ast mwl vi ha ig yo zu xh so om rw tk eo
Cans: crk
Cyrl: ru uk be bg sr mk kk ky tg mn tt ba cv os ce av udm sah bxr kjh xal kbd erz mdf
Arab: ar fa ur ps sd ug ku ckb
Hebr: he yi
Deva: hi mr ne sa kok
Hang: ko
Hira: ja
Hani: zh yue
Grek: el
Armn: hy
Geor: ka
Ethi: am ti
Khmr: km
Telu: te
Tfng: tzm shi
Thai: th
Beng: bn as
Guru: pa
Gujr: gu
Taml: ta
Sinh: si
Knda: kn
Mlym: ml
Orya: or
Mymr: my
Tibt: bo
Laoo: lo
"""

# Three-letter codes of languages above.
ALIASES = pairs("""
rus ru ukr uk bel be bul bg srp sr mkd mk mac mk kaz kk kir ky tgk tg mon mn tat tt bak ba chv cv oss os che ce hye hy arm hy kat ka geo ka
aze az uzb uz tuk tk eng en deu de ger de fra fr fre fr spa es por pt ita it nld nl dut nl ell el gre el ara ar heb he zho zh chi zh jpn ja
kor ko tur tr fas fa per fa urd ur hin hi tha th vie vi pol pl ces cs cze cs slk sk slo sk ron ro rum ro hun hu fin fi swe sv nor no dan da
isl is ice is mya my bur my khm km lao lo amh am tam ta tel te ben bn guj gu kan kn mal ml mar mr pan pa sin si nep ne eus eu baq eu cat ca
glg gl cym cy wel cy gle ga epo eo
""")

# Free-form labels of scripts.
LABELS_TEXT = """
Latn: latin, ipa
Cyrl: cyrillic
Arab: arabic, persian, farsi
Cans: syllabics, cans, unified canadian aboriginal syllabics, canadian syllabics
Tfng: tifinagh
Deva: devanagari, devanagari extended
Ethi: ethiopic
Khmr: khmer
Telu: telugu
Knda: kannada
Mlym: malayalam
Orya: odia, oriya
Hebr: hebrew
Hang: hangul, korean, jamo, hangul jamo, hangeul
Hira: hiragana, japanese
Kana: katakana
Hani: han, hanzi, chinese, kanji, cjk, chinese characters, han characters
Grek: greek
Armn: armenian
Geor: georgian
Thai: thai
Beng: bengali, bangla
Guru: gurmukhi, punjabi
Gujr: gujarati
Taml: tamil
Sinh: sinhala
Mymr: myanmar, burmese
Tibt: tibetan
Laoo: lao
Glag: glagolitic
Runr: runic
Ogam: ogham
Phnx: phoenician
"""

SCRIPTS = {}
for _line in SCRIPTS_TEXT.strip().splitlines():
    _code, _name, _direction, _kind, _ranges = (x.strip() for x in _line.split("|"))
    SCRIPTS[_code] = {"name": _name, "direction": _direction, "type": _kind, "ranges": [tuple(int(v, 16) for v in r.split("-")) for r in _ranges.split()]}
LANG_SCRIPT = {lang: code for code, langs in (line.split(":") for line in LANGUAGES_TEXT.strip().splitlines()) for lang in langs.split()}
LABEL_SCRIPT = {label.strip(): code for code, labels in (line.split(":") for line in LABELS_TEXT.strip().splitlines()) for label in labels.split(",")}

# Characters with the Unicode property White_Space.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "    　"

# ARPABET symbols and IPA.
ARPA = pairs("""
AO ɔ AA ɑ IY i UW u EH ɛ IH ɪ UH ʊ AH ʌ AE æ AX ə IX ɨ UX ʉ EY eɪ AY aɪ OW oʊ AW aʊ OY ɔɪ ER ɝ AXR ɚ
P p B b T t D d K k G ɡ CH tʃ JH dʒ F f V v TH θ DH ð S s Z z SH ʃ ZH ʒ HH h H h
M m EM m̩ N n EN n̩ NG ŋ ENG ŋ̍ L l EL l̩ R ɹ DX ɾ NX ɾ̃ W w WH ʍ Y j Q ʔ
""")
ARPA_VOWELS = "AO AA IY UW EH IH UH AH AE AX IX UX EY AY OW AW OY ER AXR".split()
ARPA_SYLLABIC = "EM EN ENG EL".split()
ARPA_UNSTRESSED = pairs("AH0 ə ER0 ɚ")
ARPA_RESPELT = pairs("AX AH AXR ER")
# IPA spellings that are read besides those above; the tie bar may be above or below.
IPA_ALSO_ARPA = pairs("g G e EH r R ɜr ER ər AXR ɫ̩ EL t͡ʃ CH d͡ʒ JH t͜ʃ CH d͜ʒ JH ɜː ER ɜ ER əʊ OW ɒ AA")

# X-SAMPA and IPA, the main spelling first.
XSAMPA = pairs("""
a a b b c c d d e e f f g ɡ h h i i j j k k l l m m n n o o p p q q r r s s t t u u v v w w x x y y z z
t` ʈ d` ɖ G\\ ɢ ? ʔ F ɱ n` ɳ J ɲ N ŋ N\\ ɴ B\\ ʙ R\\ ʀ 4 ɾ r` ɽ p\\ ɸ B β T θ D ð S ʃ Z ʒ s` ʂ z` ʐ C ç j\\ ʝ G ɣ X χ R ʁ X\\ ħ ?\\ ʕ h\\ ɦ
K ɬ K\\ ɮ P ʋ v\\ ʋ r\\ ɹ r\\` ɻ J\\ ɟ M\\ ɰ l` ɭ L ʎ L\\ ʟ O\\ ʘ |\\ ǀ !\\ ǃ =\\ ǂ |\\|\\ ǁ b_< ɓ d_< ɗ J\\_< ʄ g_< ɠ G\\_< ʛ
M ɯ 1 ɨ } ʉ I ɪ Y ʏ U ʊ I\\ ᵻ U\\ ᵿ 2 ø @\\ ɘ 8 ɵ 7 ɤ @ ə @` ɚ E ɛ 9 œ 3 ɜ 3` ɝ 3\\ ɞ V ʌ O ɔ { æ 6 ɐ & ɶ A ɑ Q ɒ
W ʍ H ɥ H\\ ʜ <\\ ʢ >\\ ʡ s\\ ɕ z\\ ʑ l\\ ɺ x\\ ɧ 5 ɫ _ ͡ " ˈ % ˌ : ː :\\ ˑ _X ̆ . . -\\ ‿ | | || ‖
_T ̋ _H ́ _M ̄ _L ̀ _B ̏ _R ̌ _/ ̌ _F ̂ _\\ ̂ _H_T ᷄ _B_L ᷅ _R_F ᷈ _L_H ̌ _H_L ̂ _M_H_L ᷈ _/_\\ ᷈
<T> ˥ <H> ˦ <M> ˧ <L> ˨ <B> ˩ <BT> ˩˥ <TB> ˥˩ <HT> ˧˥ <BL> ˩˧ <HTH> ˧˥˧ ! ꜜ <!> ꜜ ^ ꜛ <^> ꜛ <R> ↗ </> ↗ <F> ↘ <\\> ↘
_0 ̥ _v ̬ _h ʰ _O ̹ _c ̜ _+ ̟ _- ̠ _" ̈ _x ̽ = ̩ _= ̩ _^ ̯ ` ˞ _t ̤ _k ̰ _N ̼ _w ʷ ' ʲ _j ʲ _G ˠ _?\\ ˤ _d ̪ _a ̺ _m ̻ ~ ̃ _~ ̃
_n ⁿ _l ˡ _} ̚ _e ̴ _r ̝ _o ̞ _A ̘ _q ̙ _> ʼ _? ʼ
""")
# Letters whose voiceless ring may stand above.
DESCENDERS = "jpqyŋɖɟɠɡɣɥɧɭɮɰɱɲɳɸɻɽʂʃʄʈʐʒʝβχ"

# Buckwalter's transliteration of Arabic.
BUCKWALTER = pairs("""
' ء | آ > أ & ؤ < إ } ئ A ا b ب p ة t ت v ث j ج H ح x خ d د * ذ r ر z ز s س $ ش S ص D ض T ط Z ظ E ع g غ f ف q ق k ك l ل m م n ن h ه w و Y ى y ي
a َ u ُ i ِ ~ ّ o ْ F ً N ٌ K ٍ _ ـ { ٱ ` ٰ
""")

# Lexique's codes of French phonemes.
LEXIQUE = pairs("""
a a i i y y u u o o O ɔ e e E ɛ ° ə 2 ø 9 œ 5 ɛ̃ 1 œ̃ @ ɑ̃ § ɔ̃ 3 ə j j 8 ɥ w w
p p b b t t d d k k g ɡ f f v v s s z z S ʃ Z ʒ m m n n N ɲ l l R ʁ x x G ŋ
""")

# Kirshenbaum's ASCII-IPA where a character differs from itself; all others from U+0020 to U+007F stay.
KIRSHENBAUM_CHANGED = pairs("""
# ʰ & æ ' ˈ * ɾ , ˌ 0 ɒ 3 ɜ 8 ɵ : ː ; ʲ ? ʔ @ ə A ɑ B β C ç D ð E ɛ G ɢ H ħ I ɪ J ɟ L ɫ M ɱ N ŋ O ɔ P Φ Q ɣ R ʀ S ʃ T θ U ʊ V ʌ W œ X χ Y ø Z ʒ [ ʪ g ɡ ~ ̃
""")
KIRSHENBAUM = {chr(c): KIRSHENBAUM_CHANGED.get(chr(c), chr(c)) for c in range(0x20, 0x80)}

# Cotovía's and RFE's symbols.
COTOVIA = pairs("""
tS tʃ rr r jj ʎ B β D ð G ɣ J ɲ N ŋ S ʃ T θ Z ʎ L ʎ b b d d f f g ɡ k k l l m m n n p p r ɾ s s t t x x X x E ɛ O ɔ a a e e i i o o u u j j w w
""")
RFE = pairs("""
r̄ r n̮ ɲ l̮ ʎ ĉ tʃ š ʃ ž ʒ ŷ ɟʝ ñ ɲ y ʝ j j ƀ β đ ð ǥ ɣ θ θ x x ł ɫ ŋ ŋ w w h h b b p p t t d d k k g ɡ f f v v s s z z m m n n l l r ɾ a a e e i i o o u u ə ə
""")

# Halabi's symbols of Arabic phonemes.
HALABI_CONSONANTS = pairs("b b t t ^ θ j d͡ʒ H ħ x x d d * ð r r z z s s $ ʃ S sˤ D dˤ T tˤ Z ðˤ E ʕ g ɣ f f q q k k l l m m n n h h w w y j v v")
HALABI_VOWELS = pairs("a a aa aː aaaa aːː i i ii iː u u uu uː A ɑ AA ɑː I ɪ II ɪː U ʊ UU ʊː")
HALABI_LONG = "_dbl_ _+_ _sil_ _eos_ _pad_ aaaa aa ii uu AA II UU".split()
IQRA_CONSONANTS = pairs("b b t t ^ θ j dʒ H ħ x x d d * ð r r z z s s $ ʃ S sˤ D dˤ T tˤ Z ðˤ E ʕ g ɣ f f q q k k l l m m n n h h w w y j < ʔ")
IQRA_VOWELS = pairs("a a aa aː A ɑ AA ɑː i i ii iː I ɪ II ɪː u u uu uː U ʊ UU ʊː")

# Ranges and marks that only IPA has.
IPA_RANGES = [(0x0250, 0x02AF), (0x02B0, 0x02FF), (0x0363, 0x036F), (0x1D00, 0x1D7F), (0x1D80, 0x1DBF)]
IPA_MARKS = "̩̪̥̃̊͜͡"

# What is known of the notations.  notation, lossless to IPA, lossless from IPA, tokens separated, reference.
NOTATIONS = "ipa arpa x-sampa buckwalter arabic lexique kirshenbaum cotovia rfe halabi".split()
NOTATION_INFO = [
    ("arpa", False, False, True, "http://www.speech.cs.cmu.edu/cgi-bin/cmudict; https://en.wikipedia.org/wiki/ARPABET"),
    ("x-sampa", True, True, False, "Wells, Computer-coding the IPA: a proposed extension of SAMPA, https://www.phon.ucl.ac.uk/home/sampa/x-sampa.htm"),
    ("lexique", False, False, False, "New & Pallier, Manuel de Lexique 3 v3.11, Tableau 2 (CC BY-SA 4.0)"),
    ("kirshenbaum", False, False, False, "Kirshenbaum 1993 ASCII-IPA standard (comp.speech)"),
    ("cotovia", False, False, False, "Universidade de Vigo GTM Cotovía TTS (fonemas.cpp)"),
    ("rfe", False, False, False, "RFE phonetic alphabet (Revista de Filología Española, 1915)"),
    ("halabi", False, False, False, "Phonetic alphabet of Nawar Halabi's Arabic-Phonetiser (mantoq G2P inventory); one-directional to IPA"),
    ("buckwalter", False, False, False, "Tim Buckwalter Arabic transliteration scheme"),
]
