"""Symbol-by-symbol transcoding with a table, as native expressions.

Three forms give the same results.  Where no symbol of several characters can begin inside another, such symbols are first replaced by
private-use characters, one translate() maps all characters, and private-use characters become the results that are longer: a few linear
passes in generated code.  Else the text is cut at its long symbols, longest first, which are looked up, and what is between them is translated.  The
plainest form, which the others are tested against, cuts the text into all its symbols and looks each up.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expressions import WS, alternation, char_class, checked, col, looked_up
from .tables import WHITE_SPACE

#: Private-use characters; texts that use these as characters of their own are not supported by the first form.
IN, OUT = 0xE000, 0xE400


def clash(keys) -> bool:
    """Whether one long key can begin inside another."""
    long = [k for k in keys if len(k) > 1]
    return any(a != b and any(a.endswith(b[:n]) for n in range(1, min(len(a), len(b)))) for a in long for b in long)


def error(symbol: Column, position: Column, notation: str) -> Column:
    return F.raise_error(F.concat(F.lit(f"no {notation} mapping for '"), symbol, F.lit("' at position "), position.cast("string")))


def symbols(text: Column, keys, extra: str = "") -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s){extra}{alternation(keys)}|."), F.lit(0))


def first_unknown(text: Column, table: dict[str, str]) -> Column:
    """struct<symbol,position> of the first symbol that the table lacks and that is no white space, or null."""
    parts = symbols(text, table)
    unknown = lambda x: looked_up(table, x).isNull() & ~x.rlike(f"^{WS}$")
    k = F.get(F.filter(F.transform(parts, lambda x, i: F.when(unknown(x), i)), lambda i: i.isNotNull()), F.lit(0))
    return F.when(F.exists(parts, unknown), F.struct(F.get(parts, k).alias("symbol"), F.coalesce(F.length(F.array_join(F.slice(parts, F.lit(1), k), "")), F.lit(0)).alias("position")))


def transcode(text: str | Column, table: dict[str, str], notation: str, errors: str = "pass", form: str | None = None) -> Column:
    """The text with each symbol mapped; `errors` says what becomes of others: pass, replace by ?, ignore, or strict (the job fails).

    White space stays under every policy.
    """
    text, errors = col(text), checked(errors)
    if errors == "strict":
        found = first_unknown(text, table)
        return F.when(found.isNotNull(), error(found["symbol"], found["position"], notation)).otherwise(transcode(text, table, notation, "pass", form))
    if form == "lookup":
        other = {"pass": lambda x: x, "replace": lambda x: F.when(x.rlike(f"^{WS}$"), x).otherwise("?"), "ignore": lambda x: F.when(x.rlike(f"^{WS}$"), x).otherwise("")}[errors]
        return F.array_join(F.transform(symbols(text, table), lambda x: F.coalesce(looked_up(table, x), other(x))), "")
    if form == "split" or (form is None and clash(table)):
        return split_form(text, table, long_pattern(table), errors)
    long = sorted((k for k in table if len(k) > 1), key=len, reverse=True)
    for i, k in enumerate(long):
        text = F.replace(text, F.lit(k), F.lit(chr(IN + i)))
    mapping = {k: table[k] for k in table if len(k) == 1} | {chr(IN + i): table[k] for i, k in enumerate(long)}
    if errors != "pass":
        others = char_class([*mapping, *WHITE_SPACE], negate=True)
        text = F.regexp_replace(text, others, "?" if errors == "replace" else "")
        if errors == "replace" and "?" in mapping:  # a ? that stands for an unknown symbol is not one of the notation
            raise ValueError("use form='lookup'")
    longer = sorted({v for v in mapping.values() if len(v) != 1})
    short = {k: v if len(v) == 1 else chr(OUT + longer.index(v)) for k, v in mapping.items()}
    changed = {k: v for k, v in short.items() if k != v}
    if changed:
        text = F.translate(text, "".join(changed), "".join(changed.values()))
    for i, v in enumerate(longer):
        text = F.replace(text, F.lit(chr(OUT + i)), F.lit(v))
    return text


def long_pattern(keys) -> str:
    """Alternation of the keys of several characters; two classes of characters turn most places down at once."""
    long = [k for k in keys if len(k) > 1]
    return f"(?={char_class(sorted({k[0] for k in long}))}{char_class(sorted({k[1] for k in long}))})(?:{alternation(long)})"


def split_form(text: Column, table: dict[str, str], long: str, errors: str = "pass") -> Column:
    """The text cut at what matches `long`: matches are looked up, the rest is translated character by character.

    A match that the table lacks is an unknown symbol.
    """
    mapping = {k: v for k, v in table.items() if len(k) == 1}
    longer = sorted({v for v in mapping.values() if len(v) != 1})
    changed = {k: v for k, v in ((k, v if len(v) == 1 else chr(OUT + longer.index(v))) for k, v in mapping.items()) if k != v}

    def plain(part: Column) -> Column:
        if errors != "pass":  # marked first, so that a ? for an unknown symbol is not read as one of the notation
            part = F.regexp_replace(part, char_class([*mapping, *WHITE_SPACE], negate=True), chr(OUT - 1) if errors == "replace" else "")
        part = F.translate(part, "".join(changed), "".join(changed.values())) if changed else part
        for i, v in enumerate(longer):
            part = F.replace(part, F.lit(chr(OUT + i)), F.lit(v))
        return F.replace(part, F.lit(chr(OUT - 1)), F.lit("?")) if errors == "replace" else part

    other = {"pass": lambda x: x, "replace": lambda x: F.when(x.isNotNull(), "?"), "ignore": lambda x: F.lit("")}[errors]
    matched = {k: v for k, v in table.items() if len(k) > 1} | {k: v for k, v in table.items() if k == "_"}
    parts, found = F.split(text, long), F.regexp_extract_all(text, F.lit(long), F.lit(0))
    return F.array_join(F.zip_with(parts, found, lambda p, x: F.concat(plain(p), F.coalesce(looked_up(matched, x), other(x), F.lit("")))), "")


def quarantined(text: str | Column, value: Column, table: dict[str, str], notation: str) -> Column:
    """struct<value,error:struct<symbol,position,notation>>: the value, or null and the first unknown symbol; no row fails the job."""
    found = first_unknown(col(text), table)
    return F.struct(F.when(found.isNull(), value).alias("value"), F.when(found.isNotNull(), F.struct(found["symbol"].alias("symbol"), found["position"].cast("int").alias("position"), F.lit(notation).alias("notation"))).alias("error"))
