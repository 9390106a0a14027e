"""Readers: lines, glyph tables, sentence sets, pronunciation dictionaries, column tables, base64 batches.  All through Spark's own readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

COLUMNS = ("id", "lang", "category", "text", "expected_ipa", "source", "tier")
CATEGORIES = ("plain", "number", "date", "abbreviation", "homograph", "contact")
TIERS = ("gold", "silver")


#: Tables of this size in fewer files than there are cores are dealt out; a smaller one isn't worth it, and a larger one has row groups to split.
SPREAD_FROM, SPREAD_TO = 4 << 20, 256 << 20


def spread(df: DataFrame, key: str) -> DataFrame:
    """The table dealt out by a key where a file with one row group would keep a whole machine to one core; else the table as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores, key) if SPREAD_FROM <= size <= SPREAD_TO and len(df.inputFiles()) < cores else df


def table(spark: SparkSession, sf_dir: str, name: str, key: str | None = None) -> DataFrame:
    """A Parquet table of a folder, dealt out by its key if it is one small file."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df, key) if key else df


def lines(spark: SparkSession, path: str) -> DataFrame:
    """value: each line without its end, blank ones as they are."""
    return spark.read.text(path).select(F.regexp_replace("value", r"[\r\n]+$", "").alias("value"))


def glyph_table(spark: SparkSession, path: str) -> DataFrame:
    """glyph, code of a tab-separated file, packed or not; lines that begin with # are comments."""
    parts = F.split("value", "\t", 2)
    return spark.read.text(path).where(~F.col("value").startswith("#") & F.col("value").contains("\t")).select(parts[0].alias("glyph"), parts[1].alias("code"))


def gate_rows(spark: SparkSession, path: str, lang: str) -> tuple[DataFrame, DataFrame]:
    """A sentence set: its usable rows, and (reason, n) for those that are skipped.

    The first line is the header and must be COLUMNS.  A row that is skipped for another reason does not take its id or text; of rows with the
    same id, or the same text, the first stays.
    """
    head = spark.read.option("encoding", "UTF-8").text(path).limit(1).collect()
    names = tuple(head[0][0].removeprefix("﻿").split("\t")) if head else ()
    if names != COLUMNS:
        raise ValueError(f"{path}: header must be {' '.join(COLUMNS)}, got {' '.join(names)}")
    raw = spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), F.split("value", "\t", -1).alias("f")).where(F.regexp_replace(F.array_join("f", "\t"), "^﻿", "") != "\t".join(COLUMNS))
    fields = raw.select("line", "f", *(F.trim(F.get("f", F.lit(i))).alias(c) for i, c in enumerate(COLUMNS)))
    reason = (
        F.when(F.size("f") != len(COLUMNS), "column count").when(F.col("lang") != lang, "other lang").when(~F.col("category").isin(*CATEGORIES), "unknown category")
        .when(~F.col("tier").isin(*TIERS), "unknown tier").when((F.col("text") == "") | (F.col("expected_ipa") == ""), "empty text or expected_ipa"))
    judged = fields.withColumn("reason", reason)
    good = judged.where("reason is null").withColumn("reason", F.when(F.row_number().over(Window.partitionBy("id").orderBy("line")) > 1, "duplicate id"))
    # a duplicate id does not take its text either
    good = good.withColumn("rank", F.row_number().over(Window.partitionBy("text").orderBy(F.col("reason").isNotNull(), "line"))).withColumn("reason", F.coalesce("reason", F.when(F.col("rank") > 1, "duplicate text")))
    skipped = judged.where("reason is not null").select("reason").unionByName(good.where("reason is not null").select("reason")).groupBy("reason").agg(F.count("*").alias("n"))
    return good.where("reason is null").select(*COLUMNS), skipped


def pronunciation_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """word, prob (null where the file has none), phones, line; both layouts, lines without phones left out."""
    parts = F.filter(F.split("value", r"\s+"), lambda x: x != "")
    rows = spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), parts.alias("p")).where(F.size("p") >= 2)
    prob = F.get("p", F.lit(1)).try_cast("double")
    return rows.select(F.get("p", F.lit(0)).alias("word"), prob.alias("prob"), F.when(prob.isNull(), F.slice("p", 2, 1_000_000)).otherwise(F.slice("p", 3, 1_000_000)).alias("phones"), "line").where(F.size("phones") > 0)


def column_table(spark: SparkSession, path: str) -> DataFrame:
    """fields (array): columns apart by a tab or two blanks, comments from # on and empty lines left out."""
    text = F.trim(F.regexp_replace("value", r"#.*$", ""))
    return spark.read.text(path).select(F.split(text, r"\t+|\s{2,}").alias("fields")).where(F.get("fields", F.lit(0)) != "")


def rule_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV conversion table with its header, in file order."""
    return spark.read.option("header", True).csv(path)


def base64_lines(df: DataFrame, column: str | Column = "value") -> DataFrame:
    """line_no, line of base64 texts: decoded, cut into lines."""
    c = F.col(column) if isinstance(column, str) else column
    return df.select(F.posexplode(F.split(F.unbase64(c).cast("string"), "\n")).alias("line_no", "line"))


def text_columns(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Only the named columns of a Parquet table; the scan reads no others."""
    return spark.read.parquet(path).select(*columns)


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.option("sep", "\t").option("header", True).option("quote", "").csv(path)
