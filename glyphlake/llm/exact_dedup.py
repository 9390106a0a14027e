"""Exact deduplication by deterministic block naming.

Each text is normalised and cut into fixed-size blocks.  Sorting the distinct blocks gives every one an integer name; then
adjacent pairs of names are named in the same way, level by level, until one integer is left for each document.  Two
documents have the same (number of blocks, last name) exactly if their normalised texts are equal: a name stands for
content that was compared in full during a sort, so no hash collision can join two texts.

Shuffles: block contents travel once, and only once for each map task that has them (a block that a third of all
documents share is one row per task); Spark compresses them on their way.  What comes back is joined by integers.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, prepare, removed, spread_join, task_base, written

#: Bytes of one block.  Levels of naming: log2 of the longest text's blocks.
BLOCK_BYTES = 16384
#: The characters that do not count, [\x20\x09-\x0D].
BLANK = b" \t\n\x0b\x0c\r"
#: Bytes of blocks that a task remembers, to send a repeated one only once.
LOCAL_BYTES = 32 << 20


def _cut(block_bytes: int):
    schema = pa.schema([("row", pa.int64()), ("doc", pa.int64()), ("block", pa.int32()), ("blocks", pa.int32()), ("local", pa.int64()), ("content", pa.binary()), ("chars", pa.int64()), ("sha", pa.string())])

    def run(batches):
        task = task_base()
        seen: dict[bytes, int] = {}
        room, count, row = LOCAL_BYTES, 0, -1
        for batch in batches:
            columns: list[list] = [[] for _ in schema]
            for doc, text, place in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                raw = text.as_buffer().to_pybytes()
                row += 1
                number = task | row if place is None else place
                norm = raw.translate(None, BLANK)
                n = max(1, -(-len(norm) // block_bytes))
                for k in range(n):
                    block = norm[k * block_bytes : (k + 1) * block_bytes]
                    content, local = None, seen.get(block)
                    if local is None:
                        content, local = block, task | count
                        count += 1
                        if len(block) <= room:
                            seen[block] = local
                            room -= len(block)
                    first = k == 0
                    for column, value in zip(columns, (number, doc, k, n, local, content, len(raw.decode()) if first else None, hashlib.sha256(norm).hexdigest() if first else None)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


def _named(sorted_contents: DataFrame) -> DataFrame:
    """Integer names for (content, local) rows that are dealt out and sorted by content: partition and rank in it."""

    def run(batches):
        task = task_base()
        last, rank = None, -1
        for batch in batches:
            names = []
            for content in batch.column(0).to_pylist():
                if content != last:
                    last, rank = content, rank + 1
                names.append(task | rank)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(names, pa.int64())], names=["local", "name"])

    return sorted_contents.mapInArrow(lean(run), "local long, name long")


def identities(df: DataFrame, row_id: Column, text: Column, block_bytes: int = BLOCK_BYTES, place: Column | None = None) -> DataFrame:
    """One row for each input row: row, doc, blocks, name, chars, sha.

    (blocks, name) is equal exactly for equal normalised texts.  row_id is a long; it may repeat or be null, as `row` tells
    rows apart, and is `place` where that is given, a column of distinct longs.  A null text is empty.  chars counts the code points of the original text; sha is the SHA-256 of the
    normalised one.
    """
    prepare(df.sparkSession)
    source = df.select(row_id.cast("long").alias("doc"), F.coalesce(text, F.lit("")).cast("binary").alias("text"), (F.lit(None) if place is None else place).cast("long").alias("place"))
    cut, cut_path = written(source.mapInArrow(lean(_cut(block_bytes)), "row long, doc long, block int, blocks int, local long, content binary, chars long, sha string"), "blocks")

    # Level 0 sorts contents.  Each row is one task's first sight of a block: a common block has one row for each task.
    firsts = cut.where("content is not null").select("content", "local").repartition("content").sortWithinPartitions("content")
    level, _ = written(cut.drop("content").join(_named(firsts), "local").select("row", "doc", "block", "blocks", "name", "chars", "sha"), "names", narrow=True)
    removed(df.sparkSession, cut_path)

    # Each further level sorts pairs of names.
    found = ["row", "doc", "blocks", "name", "chars", "sha"]
    done, rest = level.where("blocks = 1").select(found), level.where("blocks > 1").withColumn("left", F.col("blocks"))
    while rest.take(1):
        pairs, pairs_path = written(
            rest.groupBy("row", "doc", "blocks", "left", F.expr("cast(block div 2 as int)").alias("block")).agg(
                F.min_by("name", "block").alias("a"), F.when(F.count("*") > 1, F.max_by("name", "block")).otherwise(F.lit(-1)).alias("b"), F.min("chars").alias("chars"), F.min("sha").alias("sha")),
            "pairs", narrow=True)
        ranked, ranked_path = written(pairs.select("a", "b").distinct().repartition("a", "b").sortWithinPartitions("a", "b").withColumn("name", F.monotonically_increasing_id()), "ranked", narrow=True)
        rest, _ = written(pairs.join(ranked, ["a", "b"]).select("row", "doc", "block", "blocks", "name", "chars", "sha", F.expr("cast((left + 1) div 2 as int)").alias("left")), "names", narrow=True)
        removed(df.sparkSession, pairs_path, ranked_path)
        done, rest = done.unionByName(rest.where("left = 1").select(found)), rest.where("left > 1")
    return done


def dedup(df: DataFrame, row_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES, place: str | None = None) -> DataFrame:
    """For each input row: doc_id, keep_id, group_size, kept, text_sha256; with `place`, a column of distinct longs that tells rows apart, also place.

    Of rows whose texts are equal without blank characters, the one with the most code points stays, then the smallest id, then
    the first in the input (the lowest place): one row of each group is kept, even if its id repeats.  Null texts are empty and equal to other empty
    ones; a null id sorts last; an empty table gives an empty result.  Other columns of the input are ignored, whatever their names.
    """
    found = identities(df, F.col(row_id), F.col(text), block_bytes, None if place is None else F.col(place))
    best = F.max(F.struct(F.col("chars"), (-F.col("doc")).alias("minus_doc"), (-F.col("row")).alias("minus_row"))).alias("best")
    groups, _ = written(found.groupBy("blocks", "name").agg(best, F.count("*").alias("group_size")).withColumn("weight", F.col("group_size")), "groups", narrow=True)
    joined = spread_join(found, groups, ["blocks", "name"], "weight", found.count())
    return joined.select(
        F.col("doc").alias("doc_id"), (-F.col("best.minus_doc")).alias("keep_id"), "group_size",
        (F.col("row") == -F.col("best.minus_row")).alias("kept"), F.col("sha").alias("text_sha256"), *([F.col("row").alias("place")] if place else []))
