"""Runs within texts as rows: script runs by regular expression, and the general form by windows over the characters of a text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import g2p
from ..functions import scripts as S


def script_run_rows(df: DataFrame, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, run, script, run_text: no shuffle, as each text is cut where it is."""
    return df.select(F.col(row_id).alias("doc_id"), F.posexplode(S.script_runs(text)).alias("run", "r")).select("doc_id", "run", F.col("r.script").alias("script"), F.col("r.text").alias("run_text"))


def script_runs_by_window(df: DataFrame, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The same by gaps and islands: characters as rows, the last script carried forward, a running count of changes.

    One shuffle of all characters; kept as the relational definition and for engines that only have windows.
    """
    chars = df.select(F.col(row_id).alias("doc_id"), F.posexplode(F.split(text, "")).alias("pos", "ch")).where("ch <> ''")
    w = Window.partitionBy("doc_id").orderBy("pos")
    carried = chars.withColumn("script", F.last(S.char_script("ch"), ignorenulls=True).over(w))
    marked = carried.withColumn("change", (~F.col("script").eqNullSafe(F.lag("script").over(w))).cast("int"))
    numbered = marked.withColumn("run", F.sum(F.when(F.col("pos") == 0, 0).otherwise(F.col("change"))).over(w))
    return numbered.groupBy("doc_id", "run").agg(F.min("script").alias("script"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "ch"))), lambda x: x["ch"]), "").alias("run_text"))


def language_span_rows(df: DataFrame, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, span, lang, span_text of code-switched Arabic and Latin text."""
    return df.select(F.col(row_id).alias("doc_id"), F.posexplode(g2p.language_spans(text)).alias("span", "s")).select("doc_id", "span", F.col("s.lang").alias("lang"), F.col("s.text").alias("span_text"))
