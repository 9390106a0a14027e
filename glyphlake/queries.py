"""The queries of the text functions and relational operators, each with the SQL that gives the same rows.

The documents are written in ASCII and a few Latin letters.  `scripted` turns them into seven scripts by id, letter by letter, in both
engines; the whole table and whole texts are read everywhere.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import chunking as K
from .functions import conventions as C
from .functions import diacritics as D
from .functions import g2p as G
from .functions import korean, levantine
from .functions import notation as N
from .functions import numbers as NU
from .functions import scripts as S
from .functions import tables as T
from .functions import translit as L
from .functions import verbalize
from .functions.expressions import alternation, char_class
from .operators import aggregates, alignment, frontend, gate, lookups, runs
from .plans import graph as P
from .sources import tables as sources
from .streaming import transform as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

LOWER = "abcdefghijklmnopqrstuvwxyz"
#: id modulo 7 -> letters that a to z become.
ALPHABETS = {
    1: "абвгдежзийклмнопрстуфхцчшщ", 2: "αβγδεζηθικλμνξοπρςστυφχψωά", 3: "あいうえおかきくけこさしすせそたちつてとなにぬねのは",
    4: "ابتثجحخدذرزسشصضطظعغفقكلمنه", 5: "אבגדהוזחטיכלמנסעפצקרשתךםןף", 6: "가각간갇갈감갑값갓강개객거건게고과교구국권귀그긴길나",
}


def query(name: str, sql: str | None = None):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            """Counts and places are long, as DuckDB has them."""
            df = fn(spark, sf_dir)
            return df.withColumns({c: F.col(c).cast("long") for c, kind in df.dtypes if kind == "int"})

        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return fn

    return register


table = sources.table


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id").select("doc_id", "text", "lang")


def scripted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, text in a script by id."""
    text = F.col("text")
    written = F.when(F.col("doc_id") % 7 == 0, text)
    for k, letters in ALPHABETS.items():
        written = written.when(F.col("doc_id") % 7 == k, F.translate(text, LOWER, letters))
    return documents(spark, sf_dir).select("doc_id", "lang", written.otherwise(text).alias("text"))


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_map(pairs: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in pairs.items()) + "}"


SCRIPTED = "(SELECT doc_id, lang, CASE doc_id % 7 " + " ".join(f"WHEN {k} THEN translate(text, '{LOWER}', {q(v)})" for k, v in ALPHABETS.items()) + " ELSE text END AS text FROM documents)"
SCRIPT_CASE = "CASE " + " ".join(f"WHEN unicode(ch) BETWEEN {lo} AND {hi} THEN '{code}'" for lo, hi, code in S.RANGES) + " END"
#: A row for each character and its script.
CHARS = f"(SELECT doc_id, lang, pos, ch, {SCRIPT_CASE} AS script FROM (SELECT doc_id, lang, unnest(range(length(text))) AS pos, unnest(string_split(text, '')) AS ch FROM {SCRIPTED} WHERE text <> ''))"


def mapped_sql(text: str, pairs: dict[str, str], other: str = "c") -> str:
    return f"array_to_string(list_transform(regexp_extract_all({text}, '(?s){alternation(pairs)}|.'), lambda c: coalesce({sql_map(pairs)}[c], {other})), '')"


# ---- writing systems

@query("documents_by_script", f"""
WITH n AS (SELECT doc_id, lang, script, count(*) AS n FROM {CHARS} WHERE script IS NOT NULL GROUP BY ALL),
best AS (SELECT doc_id, max(struct_pack(n := n, code := script)).code AS script FROM n GROUP BY doc_id)
SELECT d.lang, b.script, count(*) AS n_docs FROM documents d LEFT JOIN best b USING (doc_id) GROUP BY ALL""")
def documents_by_script(spark, sf_dir):
    return aggregates.documents_by_script(scripted(spark, sf_dir))


@query("char_script", f"SELECT ch, {SCRIPT_CASE} AS script, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS ch FROM {SCRIPTED} WHERE text <> '') GROUP BY ALL")
def char_script(spark, sf_dir):
    chars = scripted(spark, sf_dir).select(F.explode(F.split("text", "")).alias("ch")).where("ch <> ''").groupBy("ch").agg(F.count("*").alias("n"))
    return chars.select("ch", S.char_script("ch").alias("script"), "n")


@query("char_script_by_join", SQL["char_script"])
def char_script_by_join(spark, sf_dir):
    chars = scripted(spark, sf_dir).select(F.explode(F.split("text", "")).alias("ch")).where("ch <> ''").groupBy("ch").agg(F.count("*").alias("n"))
    return lookups.script_of_characters(chars, S.registry(spark)).select("ch", F.col("iso15924").alias("script"), "n")


@query("detect_script", f"""
WITH n AS (SELECT doc_id, script, count(*) AS n FROM {CHARS} WHERE script IS NOT NULL GROUP BY ALL)
SELECT d.doc_id, max(struct_pack(n := n, code := script)).code AS script FROM documents d LEFT JOIN n USING (doc_id) GROUP BY d.doc_id""")
def detect_script(spark, sf_dir):
    return scripted(spark, sf_dir).select("doc_id", S.detect_script("text").alias("script"))


@query("script_distribution", f"""
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) - 1 AS place, script, n
FROM (SELECT doc_id, script, count(*) AS n, min(pos) AS first FROM {CHARS} WHERE script IS NOT NULL GROUP BY ALL)""")
def script_distribution(spark, sf_dir):
    return scripted(spark, sf_dir).select("doc_id", F.posexplode(S.script_distribution("text")).alias("place", "s")).select("doc_id", "place", "s.script", F.col("s.count").alias("n"))


RUNS_SQL = f"""
WITH carried AS (SELECT doc_id, pos, ch, last_value(script IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS script FROM {CHARS}),
marked AS (SELECT *, pos > 0 AND script IS DISTINCT FROM lag(script) OVER (PARTITION BY doc_id ORDER BY pos) AS change FROM carried),
numbered AS (SELECT *, sum(change::int) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM marked)
SELECT doc_id, run::bigint AS run, any_value(script) AS script, string_agg(ch, '' ORDER BY pos) AS run_text FROM numbered GROUP BY doc_id, run"""


@query("script_runs", RUNS_SQL)
def script_runs(spark, sf_dir):
    return runs.script_run_rows(scripted(spark, sf_dir))


@query("script_runs_by_window", RUNS_SQL)
def script_runs_by_window(spark, sf_dir):
    return runs.script_runs_by_window(scripted(spark, sf_dir))


DIRECTION = f"""SELECT d.doc_id, CASE WHEN coalesce(rtl, 0) > coalesce(ltr, 0) THEN 'rtl' WHEN coalesce(ltr, 0) > coalesce(rtl, 0) THEN 'ltr' ELSE 'mixed' END AS direction
FROM documents d LEFT JOIN (SELECT doc_id, count(*) FILTER (script IN ('Arab', 'Hebr', 'Cprt', 'Phnx')) AS rtl, count(*) FILTER (script NOT IN ('Arab', 'Hebr', 'Cprt', 'Phnx')) AS ltr FROM {CHARS} GROUP BY doc_id) USING (doc_id)"""


@query("base_direction", DIRECTION)
def base_direction(spark, sf_dir):
    return scripted(spark, sf_dir).select("doc_id", S.base_direction("text").alias("direction"))


@query("direction_totals", f"SELECT direction, count(*) AS n_docs FROM ({DIRECTION}) GROUP BY direction")
def direction_totals(spark, sf_dir):
    return aggregates.direction_totals(scripted(spark, sf_dir))


@query("script_totals", f"SELECT lang, script, count(*) AS n_chars FROM {CHARS} WHERE script IS NOT NULL GROUP BY ALL")
def script_totals(spark, sf_dir):
    return aggregates.script_totals(scripted(spark, sf_dir), by=["lang"])


@query("script_registry", "SELECT * REPLACE (n_ranges::BIGINT AS n_ranges, n_points::BIGINT AS n_points) FROM (VALUES " + ", ".join(f"('{c}', {q(s['name'])}, '{s['direction']}', '{s['type']}', {len(s['ranges'])}, {sum(hi - lo + 1 for lo, hi in s['ranges'])})" for c, s in T.SCRIPTS.items()) + ") v(iso15924, name, direction, script_type, n_ranges, n_points)")
def script_registry(spark, sf_dir):
    return S.registry(spark).groupBy("iso15924", "name", "direction", "script_type").agg(F.count("*").alias("n_ranges"), F.sum(F.expr("hi - lo + 1")).alias("n_points"))


TAG = "lang || CASE doc_id % 6 WHEN 0 THEN '' WHEN 1 THEN '-Cyrl' WHEN 2 THEN '_lat' WHEN 3 THEN '-XX' WHEN 4 THEN '-thai-DE' ELSE '_ZZZZ-CYR' END"


@query("lang_to_script", f"SELECT tag, CASE WHEN tag LIKE '%-Cyrl' OR tag LIKE '%-CYR' THEN 'Cyrl' WHEN tag LIKE '%thai%' THEN 'Thai' ELSE 'Latn' END AS script, count(*) AS n FROM (SELECT {TAG} AS tag FROM documents) GROUP BY ALL")
def lang_to_script(spark, sf_dir):
    tags = documents(spark, sf_dir).select(F.expr(TAG).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))
    return tags.select("tag", S.lang_to_script("tag").alias("script"), "n")


def lang_rows() -> str:
    return ", ".join(f"('{k}', '{v}')" for k, v in T.LANG_SCRIPT.items())


@query("default_scripts", f"SELECT * FROM (VALUES {lang_rows()}) v(lang, script) UNION ALL SELECT a, script FROM (VALUES " + ", ".join(f"('{a}', '{k}')" for a, k in T.ALIASES.items()) + f") x(a, k) JOIN (VALUES {lang_rows()}) v(lang, script) ON k = lang")
def default_scripts(spark, sf_dir):
    langs = spark.createDataFrame([(x,) for x in (*T.LANG_SCRIPT, *T.ALIASES)], "lang string")
    return langs.select("lang", S.lang_to_script("lang").alias("script"))


@query("script_to_langs", f"SELECT script, string_agg(lang, ',' ORDER BY lang) AS langs FROM (VALUES {lang_rows()}) v(lang, script) GROUP BY script UNION ALL SELECT 'Zzzz', ''")
def script_to_langs(spark, sf_dir):
    codes = spark.createDataFrame([(c,) for c in (*sorted(set(T.LANG_SCRIPT.values())), "Zzzz")], "script string")
    return codes.select("script", F.array_join(S.script_to_langs("script"), ",").alias("langs"))


@query("normalize_script_tag", "SELECT label, script FROM (VALUES " + ", ".join(f"({q('  ' + k.upper() + ' ')}, '{v}')" for k, v in (*T.LABEL_SCRIPT.items(), *((c.lower(), c) for c in T.SCRIPTS if c.lower() not in T.LABEL_SCRIPT))) + ", ('nonsense', NULL)) v(label, script)")
def normalize_script_tag(spark, sf_dir):
    labels = [*T.LABEL_SCRIPT, *(c.lower() for c in T.SCRIPTS if c.lower() not in T.LABEL_SCRIPT)]
    df = spark.createDataFrame([(f"  {x.upper()} ",) for x in labels] + [("nonsense",)], "label string")
    return df.select("label", S.normalize_script_tag("label").alias("script"))


# ---- notations

SIMPLE = {
    "buckwalter_to_arabic": T.BUCKWALTER, "lexique_to_ipa": T.LEXIQUE, "ipa_to_lexique": N.IPA_LEXIQUE, "kirshenbaum_to_ipa": T.KIRSHENBAUM, "ipa_to_kirshenbaum": N.IPA_KIRSHENBAUM,
    "cotovia_to_ipa": T.COTOVIA, "ipa_to_cotovia": N.IPA_COTOVIA, "rfe_to_ipa": T.RFE, "ipa_to_rfe": N.IPA_RFE,
}


def _register_simple(name: str, pairs: dict[str, str]) -> None:
    query(name, f"SELECT doc_id, {mapped_sql('text', pairs)} AS out FROM documents")(lambda spark, sf_dir: documents(spark, sf_dir).select("doc_id", getattr(N, name)("text").alias("out")))


for _name, _pairs in SIMPLE.items():
    _register_simple(_name, _pairs)


@query("arabic_to_buckwalter", f"SELECT doc_id, {mapped_sql('text', N._LETTERS)} AS out FROM {SCRIPTED}")
def arabic_to_buckwalter(spark, sf_dir):
    return scripted(spark, sf_dir).select("doc_id", N.arabic_to_buckwalter("text").alias("out"))


WS_SQL = "regexp_full_match(c, " + q(char_class(T.WHITE_SPACE)) + ")"


def _register_policy(errors: str, other: str) -> None:
    query(f"cotovia_to_ipa_{errors}", f"SELECT doc_id, {mapped_sql('text', T.COTOVIA, f'CASE WHEN {WS_SQL} THEN c ELSE {other} END')} AS out FROM documents")(
        lambda spark, sf_dir: documents(spark, sf_dir).select("doc_id", N.cotovia_to_ipa("text", errors).alias("out")))


_register_policy("replace", "'?'")
_register_policy("ignore", "''")


@query("quarantine", f"""
WITH t AS (SELECT doc_id, regexp_extract_all(text, '(?s){alternation(T.COTOVIA)}|.') AS parts FROM documents),
f AS (SELECT doc_id, parts, list_position(list_transform(parts, lambda c: {sql_map(T.COTOVIA)}[c] IS NULL AND NOT {WS_SQL}), true) AS k FROM t)
SELECT doc_id, CASE WHEN k > 0 THEN parts[k] END AS symbol, CASE WHEN k > 0 THEN length(array_to_string(parts[1 : k - 1], '')) END AS position FROM f""")
def quarantine(spark, sf_dir):
    from .functions.transcode import quarantined

    out = documents(spark, sf_dir).select("doc_id", quarantined("text", N.cotovia_to_ipa("text"), T.COTOVIA, "cotovia").alias("r"))
    return out.select("doc_id", "r.error.symbol", "r.error.position")


#: ARPABET by letter: vowels get two letters and a digit, so that words become sequences of tokens.
ARPA_INPUT = "regexp_replace(replace(replace(replace(translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), 'E', 'EH1'), 'A', 'AA2'), 'O', 'OW0'), '([A-Z]{1,2}[012]?)', '\\1 ', 'g')"


def arpa_input(text: str = "text") -> Column:
    t = F.translate(text, LOWER, LOWER.upper())
    for a, b in (("E", "EH1"), ("A", "AA2"), ("O", "OW0")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.regexp_replace(t, "([A-Z]{1,2}[012]?)", "$1 ")


def _arpa_sql(stress: bool) -> str:
    mark = f"CASE WHEN regexp_extract(x, '^(.*)[12]$', 1) IN ({', '.join(map(q, T.ARPA_VOWELS))}) THEN CASE right(x, 1) WHEN '1' THEN 'ˈ' ELSE 'ˌ' END ELSE '' END || " if stress else ""
    found = f"coalesce({sql_map(N.ARPA_IPA)}[x], {sql_map(T.ARPA)}[rtrim(x, '012')])"
    return f"""SELECT doc_id, array_to_string(list_transform(list_filter(string_split_regex({ARPA_INPUT}, {q(char_class(T.WHITE_SPACE) + '+')}), lambda x: x <> ''), lambda x: coalesce({mark}{found}, x)), '') AS out FROM documents"""


@query("arpa_to_ipa", _arpa_sql(False))
def arpa_to_ipa(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", N.arpa_to_ipa(arpa_input()).alias("out"))


@query("arpa_to_ipa_stress", _arpa_sql(True))
def arpa_to_ipa_stress(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", N.arpa_to_ipa(arpa_input(), stress=True).alias("out"))


@query("ipa_to_arpa", f"""
SELECT doc_id, coalesce(array_to_string(list_filter(list_transform(regexp_extract_all(lower(text), '(?s){alternation(N.IPA_ARPA)}|.'),
  lambda c: CASE WHEN {WS_SQL} OR c IN ('^', '`', '´', '¨', '¯', '¸') THEN NULL ELSE coalesce({sql_map(N.IPA_ARPA)}[c], '?') END), lambda c: c IS NOT NULL), ' '), '') AS out FROM documents""")
def ipa_to_arpa(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", N.ipa_to_arpa(F.lower("text")).alias("out"))


@query("ipa_to_arpa_stress")
def ipa_to_arpa_stress(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", N.ipa_to_arpa(N.arpa_to_ipa(arpa_input(), stress=True), stress=True).alias("out"))


_XS = sorted(T.XSAMPA, key=len, reverse=True)
_XS_RE2 = "|".join([alternation([k for k in _XS if len(k) > 2]), "_[1-6]", "_`", alternation([k for k in _XS if len(k) <= 2])])


@query("xsampa_to_ipa", f"SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, '(?s){_XS_RE2}|.'), lambda c: coalesce({sql_map(T.XSAMPA)}[c], c)), '') AS out FROM documents")
def xsampa_to_ipa(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", N.xsampa_to_ipa("text").alias("out"))


@query("ipa_to_xsampa")
def ipa_to_xsampa(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", N.ipa_to_xsampa(N.xsampa_to_ipa("text")).alias("out"))


_HALABI = {**T.HALABI_CONSONANTS, **T.HALABI_VOWELS, "<": "ʔ", "_sil_": " ", "_+_": " ", "_eos_": "", "_pad_": "", "_dbl_": "ː"}
_HALABI_RE2 = "|".join("".join("\\x{%X}" % ord(c) for c in k) for k in T.HALABI_LONG)


@query("halabi_to_ipa", f"SELECT doc_id, array_to_string(list_transform(regexp_extract_all(replace(replace(replace(text, 'ss', 's_dbl_'), 'tt', 't_dbl_'), ' ', '_+_'), '(?s){_HALABI_RE2}|.'), lambda c: coalesce({sql_map(_HALABI)}[c], c)), '') AS out FROM documents")
def halabi_to_ipa(spark, sf_dir):
    t = F.col("text")
    for a, b in (("ss", "s_dbl_"), ("tt", "t_dbl_"), (" ", "_+_")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return documents(spark, sf_dir).select("doc_id", N.halabi_to_ipa(t).alias("out"))


@query("iqra_halabi_to_ipa", f"""
SELECT doc_id, array_to_string(list_transform(list_filter(string_split_regex(regexp_replace(text, '(ss|tt|aa|nn|[a-zA-Z])', '\\1 ', 'g'), {q(char_class(T.WHITE_SPACE) + '+')}), lambda x: x <> ''),
  lambda x: coalesce({sql_map(N.IQRA)}[x], x)), '') AS out FROM documents""")
def iqra_halabi_to_ipa(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", N.iqra_halabi_to_ipa(F.regexp_replace("text", "(ss|tt|aa|nn|[a-zA-Z])", "$1 ")).alias("out"))


_VIA = mapped_sql("text", T.COTOVIA)


@query("convert_cotovia_to_lexique", f"SELECT doc_id, {mapped_sql('t', N.IPA_LEXIQUE)} AS out FROM (SELECT doc_id, {_VIA} AS t FROM documents)")
def convert_cotovia_to_lexique(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", P.convert("text", "cotovia", "lexique").alias("out"))


@query("convert_lines", f"SELECT doc_id, line_no, CASE WHEN text = '' THEN '' ELSE {mapped_sql('text', T.RFE)} END AS out FROM (SELECT doc_id, unnest(range(len(l))) AS line_no, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))")
def convert_lines(spark, sf_dir):
    lines = documents(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "value"))
    return P.convert_lines(lines, "rfe", "ipa").select("doc_id", "line_no", F.col("value").alias("out"))


@query("looks_like_ipa", f"SELECT doc_id, regexp_matches({_VIA}, {q(char_class(T.IPA_MARKS, T.IPA_RANGES))}) AS converted, regexp_matches(text, {q(char_class(T.IPA_MARKS, T.IPA_RANGES))}) AS plain FROM documents")
def looks_like_ipa(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", N.looks_like_ipa(N.cotovia_to_ipa("text")).alias("converted"), N.looks_like_ipa("text").alias("plain"))


@query("notation_info", "SELECT * FROM (VALUES " + ", ".join(f"('{a}', {b}, {c}, {d}, {q(e)})" for a, b, c, d, e in T.NOTATION_INFO) + ") v(notation, lossless_to_ipa, lossless_from_ipa, token_separated, reference)")
def notation_info(spark, sf_dir):
    return N.notation_info(spark)


@query("can_convert", """
WITH n(x) AS (VALUES """ + ", ".join(f"('{n}')" for n in T.NOTATIONS) + """)
SELECT a.x AS src, b.x AS dst, a.x <> b.x AND ((a.x IN ('buckwalter', 'arabic') AND b.x IN ('buckwalter', 'arabic'))
  OR (a.x NOT IN ('buckwalter', 'arabic') AND b.x NOT IN ('buckwalter', 'arabic', 'halabi'))) AS ok FROM n a, n b""")
def can_convert(spark, sf_dir):
    return spark.createDataFrame([(a, b, P.can_convert(a, b)) for a in T.NOTATIONS for b in T.NOTATIONS], "src string, dst string, ok boolean")


@query("routes")
def routes(spark, sf_dir):
    return P.DEFAULT_GRAPH.routes(spark)


@query("representations")
def representations(spark, sf_dir):
    return P.representations(spark)


# ---- transliteration

@query("decompose_hangul", f"""
SELECT doc_id, string_agg(CASE WHEN u BETWEEN 44032 AND 55203 THEN substring('{L.LEADS}', (u - 44032) // 588 + 1, 1) || substring('{L.VOWELS}', (u - 44032) % 588 // 28 + 1, 1)
  || CASE WHEN (u - 44032) % 28 > 0 THEN substring('{L.TAILS}', (u - 44032) % 28, 1) ELSE '' END ELSE ch END, '' ORDER BY pos) AS out
FROM (SELECT *, unicode(ch) AS u FROM {CHARS}) GROUP BY doc_id""")
def decompose_hangul(spark, sf_dir):
    return scripted(spark, sf_dir).where("text <> ''").select("doc_id", L.decompose_hangul("text").alias("out"))


@query("hira_to_kana", f"SELECT doc_id, string_agg(CASE WHEN unicode(ch) BETWEEN 12353 AND 12438 OR unicode(ch) IN (12445, 12446) THEN chr(unicode(ch) + 96) ELSE ch END, '' ORDER BY pos) AS out FROM {CHARS} GROUP BY doc_id")
def hira_to_kana(spark, sf_dir):
    return scripted(spark, sf_dir).where("text <> ''").select("doc_id", L.hira_to_kana("text").alias("out"))


@query("kana_to_hira", f"SELECT doc_id, string_agg(ch, '' ORDER BY pos) AS out FROM {CHARS} GROUP BY doc_id")
def kana_to_hira(spark, sf_dir):
    return scripted(spark, sf_dir).where("text <> ''").select("doc_id", L.kana_to_hira(L.hira_to_kana("text")).alias("out"))


GLYPHS = {"あ": "hqi", "い": "kb", "う": "abm", "え": "ypm", "お": "q"}


@query("to_cangjie", f"SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, '(?s)[あいうえお]|[^あいうえお]+'), lambda c: coalesce({sql_map(GLYPHS)}[c], c)), ' ') AS codes FROM {SCRIPTED}")
def to_cangjie(spark, sf_dir):
    return scripted(spark, sf_dir).select("doc_id", L.to_cangjie("text", GLYPHS).alias("codes"))


@query("cangjie_by_join", SQL["to_cangjie"] + " WHERE text <> ''")
def cangjie_by_join(spark, sf_dir):
    glyphs = spark.createDataFrame(list(GLYPHS.items()), "glyph string, code string")
    return lookups.cangjie_rows(scripted(spark, sf_dir), glyphs)


# ---- conventions

_MARKED = {"tashkeel": "aeiou", "kashida": "aeiou", "quranic-marks": "aeiou", "niqqud": "aeiou", "teamim": "aeiou"}


def _points(id: str) -> str:
    """Five marks of the convention, for the five vowels."""
    every = [chr(c) for lo, hi in C.MARK_RANGES[id] for c in range(lo, hi + 1)]
    return "".join((every * 5)[:5])


def _register_marks(id: str) -> None:
    name, marks, pattern = id.replace("-", "_"), _points(id), char_class(ranges=C.MARK_RANGES[id])
    text = f"translate(text, 'aeiou', {q(marks)})"
    query(f"strip_{name}", f"SELECT doc_id, regexp_replace({text}, {q(pattern)}, '', 'g') AS out, CASE WHEN regexp_matches({text}, {q(pattern)}) THEN 'marked' ELSE 'none' END AS style FROM documents")(
        lambda spark, sf_dir: documents(spark, sf_dir).select("doc_id", C.strip(F.translate("text", "aeiou", marks), id).alias("out"), C.detect(F.translate("text", "aeiou", marks), id).alias("style")))


for _id in _MARKED:
    _register_marks(_id)


@query("jamo_conjoining_to_compatibility", SQL["decompose_hangul"])
def jamo_conjoining_to_compatibility(spark, sf_dir):
    return scripted(spark, sf_dir).where("text <> ''").select("doc_id", C.restyle(L.decompose_hangul("text", "conjoining"), "jamo-form", "compatibility", "conjoining").alias("out"))


@query("jamo_compatibility_to_conjoining")
def jamo_compatibility_to_conjoining(spark, sf_dir):
    return scripted(spark, sf_dir).select("doc_id", C.restyle(L.decompose_hangul("text"), "jamo-form", "conjoining", "compatibility").alias("out"))


@query("detect_jamo_form", f"SELECT doc_id, CASE WHEN doc_id % 7 = 6 AND regexp_matches(text, '[가-힣]') THEN 'compatibility' END AS style FROM {SCRIPTED}")
def detect_jamo_form(spark, sf_dir):
    return scripted(spark, sf_dir).select("doc_id", C.detect(L.decompose_hangul("text"), "jamo-form").alias("style"))


@query("strip_wakachigaki")
def strip_wakachigaki(spark, sf_dir):
    return scripted(spark, sf_dir).select("doc_id", C.strip("text", "wakachigaki").alias("out"))


@query("pinyin_number_to_mark")
def pinyin_number_to_mark(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", C.restyle(F.regexp_replace("text", "([a-z]{2,6})", "$13"), "pinyin-tone", "mark", "number").alias("out"))


@query("pinyin_mark_to_number")
def pinyin_mark_to_number(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", C.restyle(F.translate("text", "éèà", "ēéǎ"), "pinyin-tone", "number", "mark").alias("out"))


@query("strip_pinyin")
def strip_pinyin(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", C.strip("text", "pinyin-tone").alias("out"))


@query("conventions", "SELECT * REPLACE (n_transitions::BIGINT AS n_transitions) FROM (VALUES " + ", ".join(f"('{c.id}', '{','.join(c.scripts)}', '{','.join(c.styles)}', '{c.default}', {len(c.transitions)}, {c.detectable}, {c.strip_lossless})" for c in C.CONVENTIONS.values()) + ") v(id, scripts, styles, default_style, n_transitions, detectable, strip_lossless)")
def conventions(spark, sf_dir):
    return C.conventions_table(spark).select("id", F.array_join("scripts", ",").alias("scripts"), F.array_join("styles", ",").alias("styles"), "default_style", F.size("transitions").alias("n_transitions"), "detectable", "strip_lossless")


# ---- diacritics

@query("strip_stress", "SELECT doc_id, replace(replace(text, 'é', 'е'), 'è', 'и') AS out FROM documents")
def strip_stress(spark, sf_dir):
    t = F.replace(F.replace("text", F.lit("é"), F.lit("е\u0301")), F.lit("è"), F.lit("и\u0300"))
    return documents(spark, sf_dir).select("doc_id", D.strip_diacritics(t, "ru").alias("out"))


@query("replace_stress_mark", "SELECT doc_id, replace(replace(text, 'é', '+е'), 'ç', 'к' || chr(769)) AS out FROM documents")
def replace_stress_mark(spark, sf_dir):
    t = F.replace(F.replace("text", F.lit("é"), F.lit("е\u0301")), F.lit("ç"), F.lit("к\u0301"))
    return documents(spark, sf_dir).select("doc_id", D.replace_stress_mark(t, "ru", before="+").alias("out"))


@query("strip_macedonian", "SELECT doc_id, replace(replace(text, 'é', chr(1107)), 'è', 'а') AS out FROM documents")
def strip_macedonian(spark, sf_dir):
    t = F.replace(F.replace("text", F.lit("é"), F.lit("г\u0301")), F.lit("è"), F.lit("а\u0301"))
    return documents(spark, sf_dir).select("doc_id", D.strip_diacritics(t, "mk").alias("out"))


@query("hebrew_model_text", f"""
SELECT doc_id, regexp_replace(regexp_replace(translate(text, '{LOWER}', {q(ALPHABETS[5])}), '[0-9]', '5', 'g'), '[^ !"''(),\\-.:;?5\\[\\]\\n\\tאבגדהוזחטיכלמנסעפצקרשתךםןףץ]', 'O', 'g').translate('ךםןףץ[]' || chr(10) || chr(9), 'כמנפצ()  ') AS out FROM documents""")
def hebrew_model_text(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", D.hebrew_model_text(F.translate("text", LOWER, ALPHABETS[5])).alias("out"))


@query("remove_niqqud", f"SELECT doc_id, regexp_replace(translate(text, 'aeiou', {q(_points('niqqud'))}), '[\\x{{5B0}}-\\x{{5BC}}\\x{{5BF}}\\x{{5C1}}\\x{{5C2}}\\x{{5C7}}]', '', 'g') AS out FROM documents")
def remove_niqqud(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", D.remove_niqqud(F.translate("text", "aeiou", _points("niqqud"))).alias("out"))


# ---- clauses, sentences, punctuation

@query("remove_punctuation")
def remove_punctuation(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", K.remove_punctuation("text").alias("out"))


@query("split_clauses")
def split_clauses(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.posexplode(K.split_clauses("text")).alias("clause", "c")).select("doc_id", "clause", F.col("c.text").alias("clause_text"), F.col("c.mark").alias("mark"))


@query("chunk_text")
def chunk_text(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.posexplode(K.chunk_text("text")).alias("chunk", "c")).select("doc_id", "chunk", F.col("c.text").alias("chunk_text"), "c.terminator", "c.eos")


@query("paragraphs", r"SELECT doc_id, len(string_split_regex(text, '\n(?:[ \t\r\x0b\f]*\n)+')) AS n_paragraphs FROM documents")
def paragraphs(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.size(K.paragraphs("text")).alias("n_paragraphs"))


@query("clause_mark", "SELECT doc_id, CASE WHEN text LIKE '%..%' OR text LIKE '%…%' THEN NULL ELSE nullif(regexp_extract(text, '[.?!,:;]'), '') END AS mark FROM documents")
def clause_mark(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", K.clause_mark("text").alias("mark"))


@query("without_language_flags", r"SELECT doc_id, regexp_replace(text, '\([^)]+\)', '', 'g') AS out FROM documents")
def without_language_flags(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", K.without_language_flags("text").alias("out"))


@query("clause_breaks_as_spaces", "SELECT doc_id, CASE WHEN contains(text, chr(10)) THEN array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), ' ') ELSE text END AS out FROM documents")
def clause_breaks_as_spaces(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", K.clause_breaks_as_spaces("text").alias("out"))


@query("join_sentences", """
SELECT doc_id, string_agg(w, '' ORDER BY i) AS out FROM (
  SELECT doc_id, i, CASE WHEN i > 1 AND right(lag(s) OVER (PARTITION BY doc_id ORDER BY i), 1) NOT IN ('.', '?', '!', ',', ':', ';', ' ') THEN ' ' || s ELSE s END AS w
  FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS i, s FROM (SELECT doc_id, unnest(range(len(l))) AS k, unnest(l) AS s FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE s <> ''))
GROUP BY doc_id""")
def join_sentences(spark, sf_dir):
    lists = F.transform(F.split("text", "\n"), lambda s: F.filter(F.split(s, ""), lambda c: c != ""))
    return documents(spark, sf_dir).where(F.regexp_replace("text", "\n", "") != "").select("doc_id", F.array_join(K.join_sentences(lists), "").alias("out"))


@query("inline_blocks", r"SELECT doc_id, len(regexp_extract_all(replace(text, ', ', '[[x]]'), '\[\[.*?\]\]')) AS n_blocks, len(regexp_extract_all(replace(text, ', ', '[[x]]'), '\[\[.*?\]\]')) * 2 + 1 AS n_parts FROM documents")
def inline_blocks(spark, sf_dir):
    parts = K.inline_blocks(F.replace("text", F.lit(", "), F.lit("[[x]]")))
    return documents(spark, sf_dir).select("doc_id", F.size(F.filter(parts, lambda p: p["block"])).alias("n_blocks"), F.size(parts).alias("n_parts"))


@query("graphemes")
def graphemes(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", K.graphemes("text").alias("out"))


@query("characters", "SELECT doc_id, length(text) AS n_tokens FROM documents")
def characters(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.size(K.characters("text")).alias("n_tokens"))


@query("normal_form", "SELECT doc_id, nfc_normalize(replace(text, 'o', 'o' || chr(776))) AS out FROM documents")
def normal_form(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", K.normal_form(F.replace("text", F.lit("o"), F.lit("o\u0308")), "NFC").alias("out"))


# ---- front end

@query("frontend_flat")
def frontend_flat(spark, sf_dir):
    front = frontend.Frontend(normalize=K.without_language_flags, casing=F.lower, chunk="sentence")
    return front.flat(documents(spark, sf_dir))


@query("frontend_segments")
def frontend_segments(spark, sf_dir):
    return frontend.Frontend(normalize=verbalize.english_words, casing=F.lower, chunk="clause").segments(documents(spark, sf_dir))


@query("frontend_prepare", "SELECT doc_id, lower(text) AS out FROM documents")
def frontend_prepare(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", frontend.Frontend(casing=F.lower).prepare("text").alias("out"))


@query("frontend_unread", r"SELECT doc_id, false AS unread FROM documents")
def frontend_unread(spark, sf_dir):
    return frontend.Frontend(chunk="none").unread(documents(spark, sf_dir))


@query("spoken_sentences")
def spoken_sentences(spark, sf_dir):
    return frontend.spoken_sentences(documents(spark, sf_dir))


@query("bare_sentences")
def bare_sentences(spark, sf_dir):
    return frontend.spoken_sentences(documents(spark, sf_dir), keep_punctuation=False)


# ---- reading rules and numbers

@query("russian_phonemes")
def russian_phonemes(spark, sf_dir):
    entries = spark.createDataFrame([("и", None, ["i0"], 0), ("на", 0.4, ["n", "a0"], 1), ("на", 0.6, ["n", "a1"], 2)], "word string, prob double, phones array<string>, line long")
    return lookups.russian_phonemes(scripted(spark, sf_dir), entries)


@query("language_spans")
def language_spans(spark, sf_dir):
    return runs.language_span_rows(scripted(spark, sf_dir))


@query("diacritic_ratio", f"""
WITH n AS (SELECT doc_id, len(regexp_extract_all(text, '[\\x{{621}}-\\x{{63A}}\\x{{641}}-\\x{{64A}}]')) AS letters, len(regexp_extract_all(text, '[\\x{{64B}}-\\x{{652}}\\x{{670}}]')) AS marks FROM (SELECT doc_id, {mapped_sql('text', T.BUCKWALTER)} AS text FROM documents))
SELECT doc_id, letters, marks, CASE WHEN letters = 0 THEN true ELSE marks / letters >= 0.35 END AS diacritized FROM n""")
def diacritic_ratio(spark, sf_dir):
    t = N.buckwalter_to_arabic("text")
    d = documents(spark, sf_dir).select("doc_id", t.alias("t"))
    return d.select("doc_id", F.regexp_count("t", F.lit(r"[\x{621}-\x{63A}\x{641}-\x{64A}]")).alias("letters"), F.regexp_count("t", F.lit(G.ARABIC_MARKS)).alias("marks"), G.is_diacritized("t").alias("diacritized"))


@query("strip_case_endings")
def strip_case_endings(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", G.strip_case_endings(N.buckwalter_to_arabic("text")).alias("out"))


@query("hangul_to_ipa")
def hangul_to_ipa(spark, sf_dir):
    return scripted(spark, sf_dir).select("doc_id", korean.hangul_to_ipa("text").alias("out"))


@query("hangul_to_yale")
def hangul_to_yale(spark, sf_dir):
    return scripted(spark, sf_dir).select("doc_id", korean.hangul_to_yale("text").alias("out"))


@query("levantine_to_ipa")
def levantine_to_ipa(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", levantine.levantine_to_ipa(N.buckwalter_to_arabic("text")).alias("out"))


@query("clean_text")
def clean_text(spark, sf_dir):
    return scripted(spark, sf_dir).select("doc_id", levantine.clean_text("text").alias("out"))


@query("verbalize_english")
def verbalize_english(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", levantine.verbalize_english("text").alias("out"))


@query("english_words")
def english_words(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", verbalize.english_words("text").alias("out"))


@query("verbalize_arabic")
def verbalize_arabic(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", levantine.verbalize_arabic("text").alias("out"))


@query("clause_pieces", "SELECT doc_id, text AS joined FROM documents")
def clause_pieces(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.array_join(K.clause_pieces("text"), "").alias("joined"))


@query("retone", "SELECT doc_id, replace(replace(replace(replace(replace(text, 'er', '˧˩˧'), 'th', '˧˥'), 'an', '˥˩'), '˧˩˧', '↓'), '˧˥', '↗').replace('˥˩', '↘') AS out FROM documents")
def retone(spark, sf_dir):
    t = F.replace(F.replace(F.replace("text", F.lit("er"), F.lit("˧˩˧")), F.lit("th"), F.lit("˧˥")), F.lit("an"), F.lit("˥˩"))
    return documents(spark, sf_dir).select("doc_id", G.retone(t).alias("out"))


@query("msa_to_levantine", "SELECT doc_id, replace(replace(replace(text, 'q', 'ʔ'), 'ð', 'd'), 'θ', 't') AS out FROM documents")
def msa_to_levantine(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", G.msa_to_levantine("text").alias("out"))


@query("english_letters", f"""
SELECT doc_id, array_to_string(list_filter(list_transform(regexp_extract_all(lower(text), '[^\\s]+'), lambda w: array_to_string(list_transform(regexp_extract_all(w, '[a-z]'), lambda c: {sql_map(G.ENGLISH_LETTERS)}[c]), '')), lambda w: w <> ''), ' ') AS out FROM documents""")
def english_letters(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", G.english_letters("text").alias("out"))


INVENTORY = ["th", "er", "an", "a", "e", "i", "o", "u", "n", "t"]


@query("inventory", f"SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, 'th|er|an|a|e|i|o|u|n|t'), lambda c: (list_position({INVENTORY}, c) - 1)::varchar), ',') AS ids, array_to_string(regexp_extract_all(text, 'th|er|an|a|e|i|o|u|n|t'), '') AS back FROM documents")
def inventory(spark, sf_dir):
    ids = G.encode_inventory("text", INVENTORY)
    return documents(spark, sf_dir).select("doc_id", F.array_join(ids.cast("array<string>"), ",").alias("ids"), G.decode_inventory(ids, INVENTORY).alias("back"))


_ONES, _TENS = [f"'{x}'" for x in NU.ONES], [f"'{x}'" for x in NU.TENS]
BELOW_100 = "CASE WHEN {n} < 20 THEN [" + ", ".join(_ONES) + "][{n} + 1] ELSE [" + ", ".join(_TENS) + "][{n} // 10 - 1] || CASE WHEN {n} % 10 > 0 THEN ' ' || [" + ", ".join(_ONES) + "][{n} % 10 + 1] ELSE '' END END"
BELOW_10000 = (
    "(CASE WHEN {n} >= 1000 THEN [" + ", ".join(_ONES) + "][{n} // 1000 + 1] || ' thousand' ELSE '' END || CASE WHEN {n} % 1000 >= 100 THEN CASE WHEN {n} >= 1000 THEN ' ' ELSE '' END || [" + ", ".join(_ONES) + "][{n} % 1000 // 100 + 1] || ' hundred' ELSE '' END"
    " || CASE WHEN {n} % 100 > 0 OR {n} = 0 THEN CASE WHEN {n} >= 100 THEN ' ' ELSE '' END || " + BELOW_100.replace("{n}", "({n} % 100)") + " ELSE '' END)")


@query("cardinal_words", f"SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, n, {BELOW_10000.replace('{n}', 'n')} AS words FROM (SELECT l_orderkey, l_linenumber, l_partkey % 10000 AS n FROM lineitem)")
def cardinal_words(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 10000).alias("n"))
    return lookups.number_rows(rows, NU.small_numbers(spark).select("n", "cardinal")).select("l_orderkey", "l_linenumber", "n", F.col("cardinal").alias("words"))


@query("year_words", f"SELECT y, CASE WHEN y >= 2000 THEN 'two thousand' || CASE WHEN y > 2000 THEN ' ' || {BELOW_100.replace('{n}', '(y % 100)')} ELSE '' END ELSE 'nineteen ' || {BELOW_100.replace('{n}', '(y % 100)')} END AS words, count(*) AS n FROM (SELECT year(o_orderdate) AS y FROM orders) GROUP BY ALL")
def year_words(spark, sf_dir):
    years = table(spark, sf_dir, "orders").select(F.year("o_orderdate").cast("long").alias("n")).groupBy("n").agg(F.count("*").alias("k"))
    return lookups.number_rows(years, NU.small_numbers(spark).select("n", "year")).select(F.col("n").alias("y"), F.col("year").alias("words"), F.col("k").alias("n"))


@query("number_words", f"SELECT p_partkey, {BELOW_10000.replace('{n}', 'p_size')} AS words FROM part")
def number_words(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", NU.number_words_of(F.col("p_size").cast("string")).alias("words"))


@query("chinese_numbers")
def chinese_numbers(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", NU.chinese_column(F.format_string("%.2f", "p_retailprice")).alias("words"))


@query("chinese_text")
def chinese_text(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", NU.chinese_text_column("text").alias("out"))


# ---- lookups and evaluation

@query("best_pronunciations", "SELECT word, arg_max(phones, struct_pack(p := prob, l := -line)) AS phones FROM (SELECT p_brand AS word, p_retailprice AS prob, p_name AS phones, p_partkey AS line FROM part) GROUP BY word")
def best_pronunciations(spark, sf_dir):
    entries = table(spark, sf_dir, "part").select(F.col("p_brand").alias("word"), F.col("p_retailprice").alias("prob"), F.split("p_name", " ").alias("phones"), F.col("p_partkey").alias("line"))
    return lookups.best_pronunciations(entries).select("word", F.array_join("phones", " ").alias("phones"))


@query("aligned_letters")
def aligned_letters(spark, sf_dir):
    """Words of part names with their letters as phonemes, each th one phoneme: a table is trained on all and aligns all."""
    words = table(spark, sf_dir, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("word")).where(F.col("word").rlike("^[a-z]+$")).distinct()
    entries = words.withColumn("phones", F.regexp_extract_all("word", F.lit("th|sh|[a-z]"), F.lit(0)))
    return entries.select("word", F.array_join(alignment.align("word", "phones", alignment.train(entries, 3)), "|").alias("letters"))


@query("variants", "SELECT p_brand AS word, string_agg(p_name, '|' ORDER BY p_retailprice DESC, p_partkey) AS variants FROM part GROUP BY p_brand HAVING count(*) > 1")
def variants(spark, sf_dir):
    entries = table(spark, sf_dir, "part").select(F.col("p_brand").alias("word"), F.col("p_retailprice").alias("prob"), F.split("p_name", " ").alias("phones"), F.col("p_partkey").alias("line"))
    return lookups.variants(entries).select("word", F.array_join(F.transform("variants", lambda v: F.array_join(v, " ")), "|").alias("variants"))


@query("reject_duplicates", "SELECT doc_id, text FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1")
def reject_duplicates(spark, sf_dir):
    return lookups.reject_duplicates(documents(spark, sf_dir).select("doc_id", "text"), "text", "doc_id").select("doc_id", "text")


_REF, _HYP = "regexp_replace(text, '[^a-z]', '', 'g')", "replace(regexp_replace(text, '[^a-z]', '', 'g'), 'th', 't')"


def _scored(spark, sf_dir):
    ref = F.regexp_replace("text", "[^a-z]", "")
    return table(spark, sf_dir, "benchmark").select((F.col("item_id") % 3).cast("string").alias("category"), ref.alias("expected_ipa"), F.replace(ref, F.lit("th"), F.lit("t")).alias("ipa"), F.replace(ref, F.lit("er"), F.lit("")).alias("before"))


@query("per_by_category", f"SELECT (item_id % 3)::varchar AS category, sum(levenshtein({_REF}, {_HYP}))::BIGINT AS n_errors, sum(length({_REF}))::BIGINT AS n_segments, sum(levenshtein({_REF}, {_HYP})) / sum(length({_REF})) AS per FROM benchmark GROUP BY 1")
def per_by_category(spark, sf_dir):
    return gate.per_by_category(_scored(spark, sf_dir))


_CHANGE = f"levenshtein({_REF}, replace({_REF}, 'er', '')) - levenshtein({_REF}, {_HYP})"
_COMPARE = f"SELECT (item_id % 3)::varchar AS category, sum(length({_REF}))::BIGINT AS n_segments, sum({_CHANGE}) / sum(length({_REF})) AS gain, max(abs({_CHANGE})) / sum(length({_REF})) AS noise FROM benchmark GROUP BY 1"


@query("compare_outputs", _COMPARE)
def compare_outputs(spark, sf_dir):
    return gate.compare(_scored(spark, sf_dir), "before", "ipa")


@query("verdict", f"SELECT bool_and(CASE WHEN category = '0' THEN gain > noise ELSE gain >= -1 / n_segments END) AS passed FROM ({_COMPARE})")
def verdict(spark, sf_dir):
    return gate.verdict(gate.compare(_scored(spark, sf_dir), "before", "ipa"), "0")


@query("exact_match_rate", "SELECT lang, sum((lower(text) = text)::int)::BIGINT AS n_exact, count(*) AS n, avg((lower(text) = text)::int) AS exact_rate FROM documents GROUP BY lang")
def exact_match_rate(spark, sf_dir):
    return aggregates.exact_match_rate(documents(spark, sf_dir).withColumn("low", F.lower("text")), "low", "text", ["lang"])


@query("most_common_symbols", "SELECT ch AS value, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS ch FROM documents WHERE text <> '') GROUP BY ch ORDER BY n DESC, value LIMIT 20")
def most_common_symbols(spark, sf_dir):
    return aggregates.most_common(documents(spark, sf_dir).select(F.explode(F.split("text", "")).alias("ch")).where("ch <> ''"), "ch")


@query("symbol_counts", f"SELECT lang, symbol, count(*) AS n FROM (SELECT lang, unnest(regexp_extract_all(text, '(?s){alternation(T.COTOVIA)}|.')) AS symbol FROM documents) GROUP BY ALL")
def symbol_counts(spark, sf_dir):
    from .functions.transcode import symbols

    return aggregates.symbol_counts(documents(spark, sf_dir), symbols(F.col("text"), T.COTOVIA), ["lang"])


@query("base64_lines", "SELECT doc_id, unnest(range(len(l))) AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)")
def base64_lines(spark, sf_dir):
    packed = documents(spark, sf_dir).select("doc_id", F.base64(F.col("text").cast("binary")).alias("value"))
    return packed.select("doc_id", F.posexplode(F.split(F.unbase64("value").cast("string"), "\n")).alias("line_no", "line"))


# ---- streams

@query("event_windows", "SELECT time_bucket(INTERVAL 1 hour, ts) AS window_start, event_type AS key, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    return streams.windowed_counts(table(spark, sf_dir, "events"), "ts", F.col("event_type"))


@query("stream_detect_script", SQL["detect_script"].replace(SCRIPTED, "documents"))
def stream_detect_script(spark, sf_dir):
    """Documents as a stream, to its end; the result is read back from the sink."""
    source = f"{sf_dir}/documents.parquet"
    df = streams.read_stream(spark, source + "*", spark.read.parquet(source).schema.simpleString()[7:-1].replace(":", " "))
    base = streams.folder(spark, "stream")
    streams.write_stream(streams.transformed(df, script=S.detect_script("text")).select("doc_id", "script"), f"{base}/out", f"{base}/progress").awaitTermination()
    return spark.read.parquet(f"{base}/out")
