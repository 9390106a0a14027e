"""Building blocks for native expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .tables import WHITE_SPACE


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body with the value computed once."""
    return F.transform(F.array(value), body)[0]


def escaped(c: str) -> str:
    """A character as Java and RE2 regular expressions both read it."""
    return "\\x{%X}" % ord(c)


def char_class(chars: Iterable[str] = (), ranges: Iterable[tuple[int, int]] = (), negate: bool = False) -> str:
    return "[" + ("^" if negate else "") + "".join(escaped(c) for c in chars) + "".join("\\x{%X}-\\x{%X}" % r for r in ranges) + "]"


def alternation(keys: Iterable[str]) -> str:
    """Keys longest first, in their order; the first that matches is the longest."""
    return "|".join("".join(escaped(c) for c in k) for k in sorted(keys, key=len, reverse=True))


def map_literal(table: dict[str, str]) -> Column:
    return F.map_from_arrays(F.array(*(F.lit(k) for k in table)), F.array(*(F.lit(v) for v in table.values())))


def looked_up(table: dict[str, str], key: Column) -> Column:
    """The key's value, or null.  Spark walks through a map, so a large one is parted by the keys' first characters."""
    if len(table) <= 24:
        return F.element_at(map_literal(table), key)
    groups: dict[str, dict[str, str]] = {}
    for k, v in table.items():
        groups.setdefault(k[:1], {})[k] = v
    parted = F.map_from_arrays(F.array(*map(F.lit, groups)), F.array(*map(map_literal, groups.values())))
    return F.element_at(F.element_at(parted, F.substring(key, 1, 1)), key)


def strip_class(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, pattern, "")


WS = char_class(WHITE_SPACE)
POLICIES = ("pass", "replace", "ignore", "strict")


def checked(errors: str) -> str:
    if errors not in POLICIES:
        raise ValueError(f"errors must be one of {POLICIES}, not {errors!r}")
    return errors
