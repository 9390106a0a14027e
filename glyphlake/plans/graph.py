"""Conversions between representations: the cheapest path over a graph of column functions, preferring those that lose nothing.

Routes are found on the driver, over some twenty nodes; what runs is one projection composed of the path's functions.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import notation as N
from ..functions import translit as T
from ..functions.expressions import checked, col
from ..functions.tables import NOTATIONS


@dataclass(frozen=True)
class Edge:
    """One way from a representation to another; costs 1 if lossless and 10 if not, unless given."""

    src: str
    dst: str
    fn: Callable[..., Column]
    lossless: bool = True
    requires: str | None = None
    cost: float = -1.0

    def __post_init__(self):
        if self.cost < 0:
            object.__setattr__(self, "cost", 1.0 if self.lossless else 10.0)


class ConversionGraph:
    def __init__(self, edges: Iterable[Edge] = ()):
        self.edges: list[Edge] = []
        for e in edges:
            self.register(e)

    def register(self, edge: Edge) -> None:
        self.edges.append(edge)

    def copy(self) -> ConversionGraph:
        return ConversionGraph(self.edges)

    def extend(self, register: Callable[[ConversionGraph], None]) -> ConversionGraph:
        """A copy with what the function registers; this graph stays as it is."""
        out = self.copy()
        register(out)
        return out

    @property
    def nodes(self) -> list[str]:
        return sorted({n for e in self.edges for n in (e.src, e.dst)})

    def _reached(self, src: str) -> dict[str, tuple[float, list[Edge]]]:
        """Cost and path to each reachable node; of equal costs the edge that was registered first, nodes in order of name."""
        ways: dict[str, list[Edge]] = {}
        for e in self.edges:
            ways.setdefault(e.src, []).append(e)
        found: dict[str, tuple[float, list[Edge]]] = {src: (0.0, [])}
        settled: set[str] = set()
        queue = [(0.0, src)]
        while queue:
            cost, node = heapq.heappop(queue)
            if node in settled:
                continue
            settled.add(node)
            for e in ways.get(node, ()):
                if cost + e.cost < found.get(e.dst, (float("inf"),))[0]:
                    found[e.dst] = (cost + e.cost, [*found[node][1], e])
                    heapq.heappush(queue, (cost + e.cost, e.dst))
        return found

    def route(self, src: str, dst: str) -> list[Edge]:
        """The cheapest path; empty from a node to itself.  An error names what can be reached."""
        if src == dst:
            return []
        found = self._reached(src)
        if dst not in found:
            others = ", ".join(sorted(n for n in found if n != src)) or "(nothing)"
            raise ValueError(f"no conversion path {src!r} -> {dst!r}; reachable from {src!r}: {others}")
        return found[dst][1]

    def can_convert(self, src: str, dst: str) -> bool:
        return src == dst or dst in self._reached(src)

    def convert(self, text: str | Column, src: str, dst: str, **context) -> Column:
        out = col(text)
        for e in self.route(src, dst):
            out = e.fn(out, **context)
        return out

    def routes(self, spark: SparkSession) -> DataFrame:
        """All routes as rows: src, dst, path, cost, lossless."""
        rows = [(s, d, ">".join([s, *(e.dst for e in path)]), cost, all(e.lossless for e in path)) for s in self.nodes for d, (cost, path) in self._reached(s).items() if d != s]
        return spark.createDataFrame(rows, "src string, dst string, path string, cost double, lossless boolean")


# Representations that are routed between.
REPRESENTATIONS = [
    ("ipa", "notation", None, None), ("arpa", "notation", None, None), ("x-sampa", "notation", None, None), ("lexique", "notation", None, None), ("kirshenbaum", "notation", None, None),
    ("cotovia", "notation", None, None), ("rfe", "notation", None, None), ("halabi", "notation", None, "halabi"), ("buckwalter", "notation", "Latn", None), ("arabic", "orthography", "Arab", None),
    ("japanese", "orthography", "Jpan", "japanese"), ("hira", "orthography", "Hira", None), ("kana", "orthography", "Kana", None), ("hangul", "orthography", "Hang", None), ("jamo", "orthography", "Hang", None),
    ("hanzi", "orthography", "Hani", None), ("cangjie", "orthography", "Hani", None), ("pinyin", "orthography", "Latn", "pinyin"), ("bopomofo", "orthography", "Bopo", None),
]


def _with_errors(fn):
    """Of a route's context, notations know the policy alone."""
    return lambda text, errors=None, **_: fn(text) if errors is None else fn(text, errors=errors)


def _plain(fn):
    return lambda text, **_: fn(text)


def _absent(name: str, what: str):
    def fn(text, **_):
        raise ImportError(f"{name} needs {what}, which is registered with extend()")

    return fn


DEFAULT_GRAPH = ConversionGraph([
    Edge("arpa", "ipa", _with_errors(N.arpa_to_ipa), False), Edge("x-sampa", "ipa", _with_errors(N.xsampa_to_ipa), True), Edge("lexique", "ipa", _with_errors(N.lexique_to_ipa), False),
    Edge("kirshenbaum", "ipa", _with_errors(N.kirshenbaum_to_ipa), False), Edge("cotovia", "ipa", _with_errors(N.cotovia_to_ipa), False), Edge("rfe", "ipa", _with_errors(N.rfe_to_ipa), False),
    Edge("halabi", "ipa", _with_errors(N.halabi_to_ipa), False),
    Edge("ipa", "arpa", _with_errors(N.ipa_to_arpa), False), Edge("ipa", "x-sampa", _with_errors(N.ipa_to_xsampa), True), Edge("ipa", "lexique", _with_errors(N.ipa_to_lexique), False),
    Edge("ipa", "kirshenbaum", _with_errors(N.ipa_to_kirshenbaum), False), Edge("ipa", "cotovia", _with_errors(N.ipa_to_cotovia), False), Edge("ipa", "rfe", _with_errors(N.ipa_to_rfe), False),
    Edge("buckwalter", "arabic", _with_errors(N.buckwalter_to_arabic), True), Edge("arabic", "buckwalter", _with_errors(N.arabic_to_buckwalter), True),
    Edge("hira", "kana", _plain(T.hira_to_kana), False), Edge("kana", "hira", _plain(T.kana_to_hira), False), Edge("hangul", "jamo", _plain(T.decompose_hangul), False),
    Edge("japanese", "hira", _absent("japanese", "a reading engine"), requires="ja"), Edge("japanese", "kana", _absent("japanese", "a reading engine"), requires="ja"),
    Edge("hanzi", "pinyin", _absent("hanzi", "a phrase dictionary"), requires="zh"), Edge("hanzi", "bopomofo", _absent("hanzi", "a phrase dictionary"), requires="zh"),
    Edge("hanzi", "cangjie", _absent("hanzi", "a glyph table")),
])


def _notation(name: str) -> str:
    if name not in NOTATIONS:
        raise ValueError(f"{name!r} is not a notation; there are {', '.join(NOTATIONS)}")
    return name


def convert(text: str | Column, src: str, dst: str, errors: str = "pass") -> Column:
    """From notation to notation, through IPA where there is no direct way.  The policy holds on every step."""
    src, dst, errors = _notation(src), _notation(dst), checked(errors)
    if src == dst:
        return col(text)
    if not can_convert(src, dst):
        raise ValueError(f"Unsupported conversion: {src} -> {dst}")
    return DEFAULT_GRAPH.convert(text, src, dst, errors=errors)


def can_convert(src: str, dst: str) -> bool:
    """Whether another notation can be reached by way of notations."""
    src, dst = _notation(src), _notation(dst)
    return src != dst and DEFAULT_GRAPH.can_convert(src, dst) and all(e.dst in NOTATIONS for e in DEFAULT_GRAPH.route(src, dst))


def convert_lines(df: DataFrame, src: str, dst: str, column: str = "value") -> DataFrame:
    """Each line converted, without its line end; blank ones stay."""
    line = F.regexp_replace(column, r"[\r\n]+$", "")
    return df.withColumn(column, F.when(line == "", line).otherwise(convert(line, src, dst)))


def representations(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REPRESENTATIONS, "id string, kind string, script string, system string")
