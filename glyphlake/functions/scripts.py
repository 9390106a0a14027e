"""Writing systems: of characters, texts, languages and labels.  All native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .expressions import char_class, col, let, map_literal
from .tables import ALIASES, LABEL_SCRIPT, LANG_SCRIPT, SCRIPTS

#: code -> regular expression class, readable by Java and RE2
CLASSES = {code: char_class(ranges=s["ranges"]) for code, s in SCRIPTS.items()}
RTL = char_class(ranges=[r for s in SCRIPTS.values() if s["direction"] == "rtl" for r in s["ranges"]])
LTR = char_class(ranges=[r for s in SCRIPTS.values() if s["direction"] == "ltr" for r in s["ranges"]])
NEUTRAL = char_class(ranges=[r for s in SCRIPTS.values() for r in s["ranges"]], negate=True)
RANGES = sorted((lo, hi, code) for code, s in SCRIPTS.items() for lo, hi in s["ranges"])


def registry(spark: SparkSession) -> DataFrame:
    """One row per script: iso15924, name, direction, script_type, lo, hi for each range."""
    return spark.createDataFrame([(code, SCRIPTS[code]["name"], SCRIPTS[code]["direction"], SCRIPTS[code]["type"], lo, hi) for lo, hi, code in RANGES],
                                 "iso15924 string, name string, direction string, script_type string, lo int, hi int")


def _of_code_point(point: Column) -> Column:
    """Binary decision over the sorted ranges, so a character costs log2 of their number."""

    def part(a: int, b: int) -> Column:
        if b - a == 1:
            lo, hi, code = RANGES[a]
            return F.when(point.between(lo, hi), F.lit(code))
        m = (a + b) // 2
        return F.when(point < RANGES[m][0], part(a, m)).otherwise(part(m, b))

    return part(0, len(RANGES))


def char_script(ch: str | Column) -> Column:
    """The script of a text of one character; null for longer and empty ones, and for characters of no script."""
    ch = col(ch)
    return F.when(F.length(ch) == 1, _of_code_point(F.ascii(ch)))


#: What most texts are made of, and the part of it that is letters.
COMMON, COMMON_LETTERS = char_class(ranges=[(0, 0x24F)]), char_class(ranges=[(lo, hi) for lo, hi in SCRIPTS["Latn"]["ranges"] if hi <= 0x24F])


def _counts(text: Column) -> Column:
    """array of struct(n, code) of the scripts that the text may have.

    Basic Latin is counted by a small class and cut out; then each script's characters are cut out in turn, until nothing is left: most texts are
    through after one or two steps.
    """
    steps = F.array(*(F.struct(F.lit(c).alias("cls"), F.lit(code).alias("code")) for code, c in CLASSES.items()))

    def step(acc: Column, s: Column) -> Column:
        cut = let(F.regexp_replace(acc["rest"], s["cls"], F.lit("")), lambda left: F.struct(
            left.alias("rest"), F.concat(acc["counts"], F.array(F.struct((F.length(acc["rest"]) - F.length(left)).alias("n"), s["code"].alias("code")))).alias("counts")))
        return F.when(acc["rest"] == "", acc).otherwise(cut)

    nothing = F.array().cast("array<struct<n:int,code:string>>")
    found = F.aggregate(steps, F.struct(F.regexp_replace(text, COMMON, "").alias("rest"), nothing.alias("counts")), step)["counts"]
    # Latin letters beyond the common ones add to those
    return let(found, lambda f: F.concat(
        F.filter(f, lambda x: x["code"] != "Latn"),
        F.array(F.struct((F.regexp_count(text, F.lit(COMMON_LETTERS)) + F.coalesce(F.get(F.filter(f, lambda x: x["code"] == "Latn"), F.lit(0))["n"], F.lit(0))).alias("n"), F.lit("Latn").alias("code")))))


def script_count(text: str | Column, code: str) -> Column:
    return F.regexp_count(col(text), F.lit(CLASSES[code]))


def detect_script(text: str | Column) -> Column:
    """The script of most characters, the greatest code of equals; null where no character has one."""
    return F.array_max(F.filter(_counts(col(text)), lambda s: s["n"] > 0))["code"]


def script_distribution(text: str | Column) -> Column:
    """array<struct<script,count>>, most frequent first, in order of first occurrence among equals."""
    text = col(text)
    # the place of the first character of a script: characters before it
    first = lambda code: F.length(F.regexp_replace(text, F.concat(F.lit("(?s)"), F.element_at(map_literal(CLASSES), code), F.lit(".*")), F.lit("")))
    found = F.filter(_counts(text), lambda s: s["n"] > 0)
    ordered = F.array_sort(F.transform(found, lambda s: F.struct((-s["n"]).alias("m"), first(s["code"]).alias("at"), s["code"].alias("script"))))
    return F.when(text.isNotNull(), F.transform(ordered, lambda s: F.struct(s["script"].alias("script"), (-s["m"]).alias("count"))))


def script_runs(text: str | Column) -> Column:
    """array<struct<script,text>>: a character without a script belongs to the run before; leading ones have a null script."""
    neutral = NEUTRAL[2:-1]
    one = "|".join(f"[{c[1:-1]}][{c[1:-1]}[^{neutral}]]*" for c in CLASSES.values())  # a union of classes, in Java's syntax
    runs = F.regexp_extract_all(col(text), F.lit(f"(?s)^{NEUTRAL}+|{one}"), F.lit(0))
    return F.transform(runs, lambda r: F.struct(char_script(F.substring(r, 1, 1)).alias("script"), r.alias("text")))


def base_direction(text: str | Column) -> Column:
    """ltr or rtl, whichever has more characters; mixed if equal or none."""
    text = col(text)
    counted = let(F.regexp_replace(text, COMMON, ""), lambda rest: F.struct(
        F.regexp_count(rest, F.lit(RTL)).alias("rtl"), (F.regexp_count(text, F.lit(COMMON_LETTERS)) + F.regexp_count(rest, F.lit(LTR))).alias("ltr")))
    decided = let(counted, lambda c: F.when(c["rtl"] > c["ltr"], "rtl").when(c["ltr"] > c["rtl"], "ltr").otherwise("mixed"))
    return F.when(text.isNotNull(), decided)


_LABELS = {code.lower(): code for code in SCRIPTS} | LABEL_SCRIPT
_BLANK = r"[\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def normalize_script_tag(label: str | Column) -> Column:
    """The code that a free-form label or a code in any case stands for, or null."""
    return F.element_at(map_literal(_LABELS), F.lower(F.regexp_replace(col(label), f"^{_BLANK}+|{_BLANK}+$", "")))


def lang_to_script(lang: str | Column) -> Column:
    """The script that a language tag names, or its language's default; null if unknown."""
    parts = F.split(F.replace(col(lang), F.lit("_"), F.lit("-")), "-")
    later = F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1)))
    named = F.transform(later, lambda s: F.when(s.rlike("^[A-Za-z]{4}$"), normalize_script_tag(s)).when(F.lower(s) == "cyr", "Cyrl").when(F.lower(s) == "lat", "Latn"))
    primary = F.lower(parts[0])
    defaults = map_literal({**{a: LANG_SCRIPT[k] for a, k in ALIASES.items() if k in LANG_SCRIPT}, **LANG_SCRIPT})
    return F.coalesce(F.get(F.filter(named, lambda s: s.isNotNull()), F.lit(0)), F.element_at(defaults, primary))


def script_to_langs(code: str | Column) -> Column:
    """Sorted languages whose default script it is; an empty array if there is none."""
    langs: dict[str, list[str]] = {}
    for lang, script in LANG_SCRIPT.items():
        langs.setdefault(script, []).append(lang)
    table = F.map_from_arrays(F.array(*map(F.lit, langs)), F.array(*(F.array(*map(F.lit, sorted(v))) for v in langs.values())))
    return F.when(col(code).isNotNull(), F.coalesce(F.element_at(table, col(code)), F.array().cast("array<string>")))
