"""A training corpus from raw documents, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a table with the columns of documents, all but the last, which returns packed pieces.  Each
works on all that the one before it kept, and its decisions take effect.  Decisions are made for rows, not for ids: ids may repeat or be null, and one
row of each group of copies stays.  Null texts count as empty; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphlake.llm import exact_dedup, language_id, near_dedup, packing, toxicity
from glyphlake.llm.common import removed, scratch, table, written
from glyphlake.llm.queries import TOXIC_FROM, ids_crc32, vocabulary

#: Near copies are linked from this percentage of common shingles on; op7_near_dedup alone has 85.
NEAR_PERCENT = 80


def _numbered(docs: DataFrame) -> DataFrame:
    """The rows with a number each, written, so that it is the same for all that read it."""
    return written(docs.withColumn("__place", F.monotonically_increasing_id()), "numbered")[0]


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """Rows of numbered docs that are not among the dropped ones, without their number."""
    gone = written(dropped.select(F.col("place").alias("__gone")), "dropped", narrow=True)[0]
    return docs.join(gone, docs["__place"] == gone["__gone"], "left_anti").drop("__place")


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator scores below its threshold; the model is fitted on the labelled ones among docs.

    Null and empty texts have the score of no evidence and stay; equal texts fare alike.
    """
    model = toxicity.fit_on(docs, table(spark, sf_dir, "labels"))
    return toxicity.with_scores(docs, model, column="__toxicity").where(F.col("__toxicity") < TOXIC_FROM).drop("__toxicity")


def language_in(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; texts that are null, empty or without a letter, or far from all languages, go.  Equal texts fare alike."""
    found = language_id.with_language(docs, language_id.fit_on(docs), columns=("__language", "__cosine", "__accepted"))
    return found.where("__accepted").drop("__language", "__cosine", "__accepted")


def exact_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal without blanks: the longest, then the smallest id, nulls last, then the first."""
    docs = _numbered(docs)
    return _without(docs, exact_dedup.dedup(docs.select("doc_id", "text", "__place"), place="__place").where("not kept"))


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that near-duplicate links join, at a similarity of NEAR_PERCENT: the smallest id, nulls last, then the first.

    Texts without a word have no links and stay.
    """
    docs = _numbered(docs)
    return _without(docs, near_dedup.near_dedup(docs.select("doc_id", "text", "__place"), percent=NEAR_PERCENT, place="__place").where("not stays"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents with their place in sequences; null and empty texts are the closing id alone, repeated rows are packed each."""
    return packing.pack(docs.select("doc_id", "text"), vocabulary("byte_bpe_50k.json"), derive=ids_crc32, derived="ids_crc32 long")


STAGES = [
    ("toxicity", toxic_out),
    ("language", language_in),
    ("exact_dedup", exact_copies_out),
    ("near_dedup", near_copies_out),
    ("packing", packed),
]

#: SQL expresses none of the models, nor packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written to the shared folder before the next one reads it."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch(spark) as made:  # the tables of the operators go with the stage
            docs, path = written(stage(spark, docs, sf_dir), f"stage-{name}")
            made.remove(path)
        if before:
            removed(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
