"""Evaluation of phoneme outputs against references: error rates, gains, noise and verdicts, as aggregations."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.chunking import normal_form
from ..functions.expressions import col
from ..runtime import ship


def segments(ipa: str | Column) -> Column:
    """array<string>: stress marks, and letters with the marks and modifiers after them; tie bars, breaks and links do not count.

    A letter that a length mark, a superscript or a combining mark follows is one segment with it.
    """
    text = F.regexp_replace(normal_form(ipa, "NFC"), r"[.‿|‖͜͡]", "")
    return F.regexp_extract_all(text, F.lit(r"[ˈˌ]|[^\sˈˌ\p{M}\p{Lm}\p{Sk}][\p{M}\p{Lm}\p{Sk}&&[^ˈˌ]]*"), F.lit(0))


def distance(ref: list[str], hyp: list[str]) -> int:
    """Edits between two sequences; each row of the table is one vector operation."""
    codes = {s: i for i, s in enumerate(dict.fromkeys([*ref, *hyp]))}
    h = np.array([codes[s] for s in hyp], np.int64)
    place = np.arange(len(hyp) + 1)
    row = place.copy()
    for i, s in enumerate(ref, 1):
        best = np.empty(len(hyp) + 1, np.int64)
        best[0] = i
        np.minimum(row[1:] + 1, row[:-1] + (h != codes[s]), out=best[1:])
        # insertions: the least of (value at j) + (distance from j), running
        row = np.minimum.accumulate(best - place) + place
    return int(row[-1])


def edit_distance(ref: str | Column, hyp: str | Column) -> Column:
    """Edits between two arrays of segments."""
    ship(SparkSession.getActiveSession())

    def batch(refs: pd.Series, hyps: pd.Series) -> pd.Series:
        return pd.Series([None if a is None or b is None else distance(list(a), list(b)) for a, b in zip(refs, hyps)], dtype="Int64")

    return F.pandas_udf(batch, "long")(col(ref), col(hyp))


def per_by_category(rows: DataFrame, reference: str = "expected_ipa", output: str = "ipa", category: str = "category") -> DataFrame:
    """category, n_errors, n_segments, per: references without a segment do not count."""
    scored = rows.select(F.col(category).alias("category"), segments(reference).alias("ref"), segments(output).alias("hyp")).where(F.size("ref") > 0)
    return scored.groupBy("category").agg(F.sum(edit_distance("ref", "hyp")).alias("n_errors"), F.sum(F.size("ref")).alias("n_segments")).withColumn("per", F.col("n_errors") / F.col("n_segments"))


def compare(rows: DataFrame, before: str, after: str, reference: str = "expected_ipa", category: str = "category") -> DataFrame:
    """category, gain, noise, n_segments: errors that the second output removes, and the largest change in a row, per reference segment."""
    scored = rows.select(F.col(category).alias("category"), segments(reference).alias("ref"), segments(before).alias("b"), segments(after).alias("a")).where(F.size("ref") > 0)
    changed = scored.select("category", F.size("ref").alias("n"), (edit_distance("ref", "b") - edit_distance("ref", "a")).alias("removed"))
    return changed.groupBy("category").agg(F.sum("n").alias("n_segments"), (F.sum("removed") / F.sum("n")).alias("gain"), (F.max(F.abs("removed")) / F.sum("n")).alias("noise"))


def verdict(comparison: DataFrame, own: str) -> DataFrame:
    """One row, `passed`: the gain in its own category exceeds the noise, and no other loses more than one segment."""
    ok = F.when(F.col("category") == own, F.col("gain") > F.col("noise")).otherwise(F.col("gain") >= -1 / F.col("n_segments"))
    return comparison.agg((F.min(ok.cast("int")) == 1).alias("passed"))


def stage_gain(rows: DataFrame, full: str, ablated: dict[str, str | None]) -> DataFrame:
    """Comparisons of outputs without a stage with the full one, as rows with the stage's name; a stage that can't be left out has none."""
    out = None
    for stage, column in ablated.items():
        if column is not None:
            part = compare(rows, column, full).withColumn("stage", F.lit(stage))
            out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no stage can be left out")
    return out
