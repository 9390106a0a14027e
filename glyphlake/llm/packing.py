"""Packing token sequences by best-fit decreasing.

Overlong documents are first cut into full windows.  The pieces, longest first, each go into the open window with the least room
that still fits; a segment tree over remaining capacities finds it in log2(window) steps.  Pieces are dealt out by a hash; each task
packs its own share as a stream in descending length, holding nothing but the open windows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .byte_pairs import tokenizer
from .common import lean, prepare, task_base

WINDOW = 1024
#: The id that ends each document.
END = 0

class OpenWindows:
    """Open windows by remaining capacity: a segment tree whose leaf c counts the windows with c tokens left."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, capacity: int, sequence: int) -> None:
        self.open[capacity].append(sequence)
        at = self.leaves + capacity
        while at:
            self.count[at] += 1
            at >>= 1

    def tightest(self, length: int) -> int:
        """The smallest remaining capacity >= length of an open window, or -1."""
        count, at = self.count, self.leaves + length
        if count[at]:
            return length
        while at > 1:  # up to the first subtree on the right that has windows, then down to its leftmost one
            if not at & 1 and count[at + 1]:
                at += 1
                while at < self.leaves:
                    at *= 2
                    if not count[at]:
                        at += 1
                return at - self.leaves
            at >>= 1
        return -1

    def take(self, capacity: int) -> int:
        at = self.leaves + capacity
        while at:
            self.count[at] -= 1
            at >>= 1
        return self.open[capacity].pop()


def cut_pieces(df: DataFrame, vocabulary: str, row_id: str = "doc_id", text: str = "text", window: int = WINDOW, end: int = END,
               derive: Callable[[np.ndarray], list] | None = None, derived: str = "") -> DataFrame:
    """Tokenise whole texts and cut them into pieces of at most `window` tokens: doc_id, start, length, doc_tokens, ids.

    A null text is empty and gives one piece that holds only `end`.  All pieces of a document but the last are full windows.  With
    `derive` and its column definition, e.g. (crc, "ids_crc32 long"), that value of the piece's ids stands in place of the ids, so
    that ids which the caller only digests aren't moved.
    """
    prepare(df.sparkSession)

    def run(batches):
        encode = tokenizer(vocabulary).encode
        for batch in batches:
            texts = batch.column(1).to_pylist()
            docs, starts, lengths, totals, extra = [], [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), texts):
                ids = np.array([*encode(text), end], np.uint32)
                for start in range(0, len(ids), window):
                    piece = ids[start : start + window]
                    docs.append(doc)
                    starts.append(start)
                    lengths.append(len(piece))
                    totals.append(len(ids))
                    extra.append(derive(piece) if derive else piece.astype(np.int32))
            arrays = [pa.array(x, pa.int64()) for x in (docs, starts, lengths, totals)] + [pa.array(extra) if derive else pa.array(extra, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "length", "doc_tokens", derived.split()[0] if derive else "ids"])

    return df.select(F.col(row_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(
        lean(run), "doc_id long, start long, length long, doc_tokens long, " + (derived if derive else "ids array<int>"))


def assign(pieces: DataFrame, length: str = "length", key: list[str | Column] | None = None, window: int = WINDOW) -> DataFrame:
    """Adds sequence_id and offset to pieces of length 1 to `window`: best-fit decreasing within each task's share.

    `key` deals pieces out and breaks ties of length, so it should be unique; other columns travel along.  Each share leaves at most a
    few windows part-filled; Spark merges small shares while it runs.
    """
    prepare(pieces.sparkSession)
    key = key or ["doc_id", "start"]
    names = pieces.columns
    at = names.index(length)

    def run(batches):
        base, count = task_base(), 0
        windows = OpenWindows(window)
        for batch in batches:
            sequences, offsets = [], []
            for n in batch.column(at).to_pylist():
                capacity = windows.tightest(n)
                if capacity < 0:
                    capacity, sequence = window, base | count
                    count += 1
                else:
                    sequence = windows.take(capacity)
                sequences.append(sequence)
                offsets.append(window - capacity)
                if capacity > n:
                    windows.add(capacity - n, sequence)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sequences, pa.int64()), pa.array(offsets, pa.int64())], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return pieces.repartition(*key).sortWithinPartitions(F.desc(length), *key).mapInArrow(lean(run), schema)


def pack(df: DataFrame, vocabulary: str, row_id: str = "doc_id", text: str = "text", window: int = WINDOW, end: int = END, **derive) -> DataFrame:
    """Documents to pieces with their place: doc_id, start, length, doc_tokens, ids (or what is derived), sequence_id, offset.

    Empty and null texts are one piece of one id; repeated rows are packed each; an empty table gives no piece; ids of documents may
    be null.
    """
    return assign(cut_pieces(df, vocabulary, row_id, text, window, end, **derive), window=window)
