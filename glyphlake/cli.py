"""A command line over the text functions: one text, or the lines of a file.

    python -m glyphlake.cli convert arpa ipa "HH AH0 L OW1"
    spark-submit -m glyphlake.cli convert arpa ipa --file lines.txt --out folder
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import conventions as C
from .functions import scripts as S
from .functions import translit as L
from .operators import frontend
from .plans import graph as P
from .sources.tables import lines

#: verb -> names of its options, and the column function of (text, options)
VERBS = {
    "convert": (("src", "dst"), lambda t, o: _convert(t, o.src, o.dst)),
    "detect": ((), lambda t, o: S.detect_script(t)),
    "distribution": ((), lambda t, o: F.to_json(S.script_distribution(t))),
    "direction": ((), lambda t, o: S.base_direction(t)),
    "decompose": ((), lambda t, o: L.decompose_hangul(t)),
    "lang": ((), lambda t, o: S.lang_to_script(t)),
    "strip": (("convention",), lambda t, o: C.strip(t, o.convention)),
    "restyle": (("convention", "to"), lambda t, o: C.restyle(t, o.convention, o.to)),
    "phonemize": (("backend",), lambda t, o: frontend.backend(o.backend)(t)),
}


def _convert(text, src: str, dst: str):
    """As notations, passing unknown symbols; anything else by the graph, whose error names what can be reached."""
    try:
        return P.convert(text, src, dst)
    except ValueError:
        return P.DEFAULT_GRAPH.convert(text, src, dst)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="glyphlake")
    verbs = parser.add_subparsers(dest="verb", required=True)
    for verb, (options, _) in VERBS.items():
        p = verbs.add_parser(verb)
        for o in options:
            p.add_argument(o)
        p.add_argument("text", nargs="?")
        p.add_argument("--file")
        p.add_argument("--out")
    p = verbs.add_parser("route")
    p.add_argument("src")
    p.add_argument("dst")
    p = verbs.add_parser("conventions")
    p.add_argument("script")
    args = parser.parse_args(argv)
    if args.verb == "route":
        print(" -> ".join([args.src, *(f"{e.dst} ({'lossless' if e.lossless else 'lossy'})" for e in P.DEFAULT_GRAPH.route(args.src, args.dst))]))
        return 0
    if args.verb == "conventions":
        print("\n".join(C.conventions_for(args.script)))
        return 0
    if (args.text is None) == (args.file is None):
        parser.error("give a text, or --file")
    spark = SparkSession.builder.appName("glyphlake").getOrCreate()
    df = lines(spark, args.file) if args.file else spark.createDataFrame([(args.text,)], "value string")
    out = df.select(VERBS[args.verb][1](F.col("value"), args).cast("string").alias("value"))
    if args.out:
        out.write.text(args.out)
    else:
        for row in out.toLocalIterator():
            print("" if row.value is None else row.value)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
