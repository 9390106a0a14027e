"""Aggregations over texts.  Partial sums are made before the shuffle; no text travels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scripts as S
from ..functions.expressions import col


def script_totals(df: DataFrame, text: str = "text", by: list[str | Column] = ()) -> DataFrame:
    """Characters of each script over all rows: by columns, script, n_chars.  Counted per row without cutting texts up."""
    counts = df.select(*by, F.explode(S.script_distribution(text)).alias("s"))
    return counts.groupBy(*[c for c in counts.columns if c != "s"], F.col("s.script").alias("script")).agg(F.sum("s.count").alias("n_chars"))


def documents_by_script(df: DataFrame, text: str | Column = "text", by: list[str] = ("lang",)) -> DataFrame:
    """The flagship: how many texts have each dominant script, by other columns."""
    return df.groupBy(*by, S.detect_script(text).alias("script")).agg(F.count("*").alias("n_docs"))


def direction_totals(df: DataFrame, text: str = "text") -> DataFrame:
    return df.groupBy(S.base_direction(text).alias("direction")).agg(F.count("*").alias("n_docs"))


def exact_match_rate(df: DataFrame, predicted: str, expected: str, by: list[str] = ()) -> DataFrame:
    hit = F.col(predicted).eqNullSafe(F.col(expected)).cast("int")
    return df.groupBy(*by).agg(F.sum(hit).alias("n_exact"), F.count("*").alias("n"), F.avg(hit).alias("exact_rate"))


def most_common(df: DataFrame, value: str | Column, k: int = 20) -> DataFrame:
    """The k values with most rows, in order of value among equals: a partial top-k in each task."""
    return df.groupBy(col(value).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(k)


def symbol_counts(df: DataFrame, tokens: Column, by: list[str] = ()) -> DataFrame:
    """Occurrences of each token of an array column."""
    return df.select(*by, F.explode(tokens).alias("symbol")).groupBy(*by, "symbol").agg(F.count("*").alias("n"))
