"""Shared plumbing: shipping the package, bounded Arrow batches, written intermediate tables."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship
from ..sources import tables as sources

#: Bytes of one Arrow batch on its way to a Python worker; very long texts then travel in small batches.
BATCH_BYTES = 8 << 20
#: Rows of one Arrow batch.
BATCH_ROWS = 4000

#: Spark's own limit for a batch, which prepare() lowers.
DEFAULT_BATCH_BYTES = "67108864"


def prepare(spark: SparkSession) -> None:
    """Make the package importable on executors and bound the Arrow batches of this session, where it has Spark's defaults."""
    ship(spark)
    for key, default, value in (("maxRecordsPerBatch", "10000", BATCH_ROWS), ("maxBytesPerBatch", DEFAULT_BATCH_BYTES, BATCH_BYTES)):
        if spark.conf.get(f"spark.sql.execution.arrow.{key}").rstrip("b") == default:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(value))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.  Where it is unset, a local session has a folder of its own; a cluster is refused."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = getattr(spark.sparkContext, "_glyphlake_dir", None)
    if own is None:
        own = "file://" + tempfile.mkdtemp(prefix="glyphlake-shared-")
        spark.sparkContext._glyphlake_dir = own
    return own


_SCRATCH: list[list[str]] = []


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/glyphlake/{name}-{uuid.uuid4().hex}"
    for made in _SCRATCH:
        made.append(path)
    return path


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Tables that are written within are removed at the end, but for those taken out of the list."""
    made: list[str] = []
    _SCRATCH.append(made)
    try:
        yield made
    finally:
        _SCRATCH.remove(made)
        removed(spark, *made)


#: A key that holds this share of all rows is joined by broadcast; there are at most so many of them as the share goes into one.
HOT_SHARE = 1000


def spread_join(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """rows LEFT JOIN table, which has one row for each key and in `weight` how many of the `total` rows have it.  No task gets all rows of a hot key.

    Keys of a thousandth of all rows or more, of which there can be a thousand at most, are broadcast.  Their rows then take part in the join of the others
    under keys of their own that nothing matches, dealt out by `row` or all columns.  `weight` is not in the result.
    """
    values = [c for c in table.columns if c not in (*keys, weight)]
    hot = table.where(F.col(weight) * HOT_SHARE >= total).select(*keys, F.lit(True).alias("__hot"), *(F.col(c).alias(f"__hot_{c}") for c in values))
    cold = table.where(F.col(weight) * HOT_SHARE < total).select(*keys, F.lit(0).alias("__part"), *values)
    spread = F.pmod(F.xxhash64("row") if "row" in rows.columns else F.xxhash64(*rows.columns), F.lit(1 << 20)).cast("int") + 1
    marked = rows.join(F.broadcast(hot), keys, "left").withColumn("__part", F.when(F.col("__hot"), spread).otherwise(F.lit(0)))
    joined = marked.join(cold, [*keys, "__part"], "left")
    return joined.select(*rows.columns, *(F.when(F.col("__hot"), F.col(f"__hot_{c}")).otherwise(F.col(c)).alias(c) for c in values))


MERGE_FIRST = "spark.sql.adaptive.coalescePartitions.parallelismFirst"


def written(df: DataFrame, name: str, codec: str = "zstd", narrow: bool = False) -> tuple[DataFrame, str]:
    """The table written to the shared folder and read back, and its path: lineage ends here and survives executors.

    While it is written, Spark merges small partitions up to its advisory size, so that a small table is not spread over many files.  A narrow table, of
    rows of a few integers, is written by two tasks a core at most.
    """
    spark = df.sparkSession
    df = df.coalesce(max(8, 2 * spark.sparkContext.defaultParallelism)) if narrow else df
    path = new_path(spark, name)
    before = spark.conf.get(MERGE_FIRST)
    spark.conf.set(MERGE_FIRST, "false")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.set(MERGE_FIRST, before)
    return spark.read.schema(df.schema).parquet(path), path


def removed(spark: SparkSession, *paths: str) -> None:
    """Delete written tables that nothing reads any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a folder; one small file is dealt out by its key, as all that follows is work on texts."""
    return sources.table(spark, sf_dir, name, {"documents": "doc_id", "pages": "page_id"}.get(name))


def split_remainder(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 4; rows with remainder 2 are held out of every fit.  A null id counts as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4


def task_base() -> int:
    """The first of the integers that this task may hand out: its partition in the high bits, the same if it runs again."""
    context = TaskContext.get()
    return (context.partitionId() if context else 0) << 36


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function for mapInArrow, which gives memory back at its end: worker processes live on, beside a full executor heap."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return task


def trim() -> None:
    """Return freed memory to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without this call
        ctypes.CDLL(None).malloc_trim(0)


def utf8_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a string column back to back, and len+1 offsets into them; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type) and not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_string() if pa.types.is_string(column.type) else pa.large_binary())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def spans_of_bytes(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) of at most about `most` bytes each; one long text is a range of its own."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b
