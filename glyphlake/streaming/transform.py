"""Streams of texts.  All text functions are stateless, so a stream is a projection in append mode; event-time counts are an extension."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir.  Where that is unset, a local session has one of its own; a cluster is refused."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="glyphlake-stream-")
    return f"{base.rstrip('/')}/glyphlake/{name}-{uuid.uuid4().hex}"


def read_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream of the Parquet files that come into a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def transformed(df: DataFrame, **columns: Column) -> DataFrame:
    """A batch or stream with columns added: the same plan for both."""
    return df.withColumns(columns)


def write_stream(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to Parquet until what is there has been read; progress lies in the checkpoint folder, so a restart goes on exactly where it was."""
    return df.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path)


def windowed_counts(df: DataFrame, time: str, key: Callable[[], Column] | Column, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """window_start, key, n over event time; rows later than the watermark are left out by a stream (an extension of this package)."""
    k = key() if callable(key) else key
    return df.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), k.alias("key")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "key", "n")
