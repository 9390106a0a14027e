"""Token counts for the fields or sections of documents, by offset-mapped attribution.

A whole document is encoded once.  Its tokens' character spans, from the bytes that each token stands for, are joined as intervals to the
document's sections, and each token that crosses a boundary goes to one of them by a stated rule:

start  the section that has the token's first character (the default)
end    the section that has its last character
most   the section that has most of its characters, the earlier one of equals
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_pairs import tokenizer
from .common import lean, prepare

RULES = ("start", "end", "most")

def token_spans(ids: np.ndarray, raw: bytes, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and one past the last character (code point) of each token; a token inside a character has that character."""
    ends = np.cumsum(lengths[ids])
    if (ends[-1] if len(ends) else 0) != len(raw):
        raise ValueError("the tokens do not stand for the bytes of the text")
    starts = ends - lengths[ids]
    if raw.isascii():
        return starts, ends
    chars = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
    return chars[starts] - 1, chars[ends - 1]


def attribute(first: np.ndarray, last: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: str = "start") -> np.ndarray:
    """The section of each token [first, last), or -1: interval join with disjoint sections [starts, ends) in ascending order."""
    if not len(starts) or not len(first):
        return np.full(len(first), -1)

    def at(char):
        k = np.searchsorted(starts, char, side="right") - 1
        return np.where((k >= 0) & (char < ends[np.maximum(k, 0)]), k, -1)

    a, b = at(first), at(last - 1)
    if rule == "start":
        return a
    if rule == "end":
        return b
    best, most = a.copy(), np.where(a >= 0, np.minimum(last, ends[np.maximum(a, 0)]) - first, 0)
    for i in np.flatnonzero((a != b) | (a < 0)):  # few tokens cross a boundary
        for k in range(max(0, np.searchsorted(ends, first[i], side="right")), np.searchsorted(starts, last[i], side="left")):
            n = min(last[i], ends[k]) - max(first[i], starts[k])
            if n > most[i]:
                best[i], most[i] = k, n
    return best


def line_sections(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Lines with their line feeds; an empty text is one empty section."""
    ends = np.cumsum([len(x) for x in text.split("\n")]) + np.arange(1, text.count("\n") + 2)
    ends[-1] -= 1
    if len(ends) > 1 and ends[-1] == ends[-2]:
        ends = ends[:-1]
    return np.concatenate([[0], ends[:-1]]), ends


def count_tokens(df: DataFrame, vocabulary: str, row_id: str = "doc_id", text: str = "text", sections: str | None = None, rule: str = "start") -> DataFrame:
    """One row per section: doc_id, section, char_start, char_end, n_tokens, n_crossing, doc_tokens.

    sections: a column of array<struct<start:int,end:int>>, disjoint and ascending character spans (fields that were joined to one text,
    for example); a further row of section -1 then counts the tokens outside of all.  Without it, the lines of the text.  n_crossing counts
    those of the section's tokens that reach beyond it.  Null texts are empty and have one empty section; row ids may repeat or be null.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {', '.join(RULES)}")
    prepare(df.sparkSession)

    def run(batches):
        t = tokenizer(vocabulary)
        for batch in batches:
            docs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            given = batch.column(2).to_pylist() if sections else None
            columns: list[list] = [[] for _ in range(7)]
            for k, (doc, text) in enumerate(zip(docs, texts)):
                ids = np.array(t.encode(text), np.int64)
                first, last = token_spans(ids, text.encode(), t.lengths)
                if given is None:
                    starts, ends = line_sections(text)
                else:
                    starts, ends = (np.array([s[name] for s in given[k] or []], np.int64) for name in ("start", "end"))
                own = attribute(first, last, starts, ends, rule)
                n, held = len(starts), own >= 0
                at = own[held]
                crossing = (last[held] > ends[at]) | (first[held] < starts[at]) if n else np.zeros(0, bool)
                values = [[doc] * n, range(n), starts.tolist(), ends.tolist(), np.bincount(at, minlength=n).tolist(), np.bincount(at[crossing], minlength=n).tolist(), [len(ids)] * n]
                for column, value in zip(columns, values):
                    column.extend(value)
                if given is not None:
                    for column, value in zip(columns, (doc, -1, None, None, int((~held).sum()), 0, len(ids))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "section", "char_start", "char_end", "n_tokens", "n_crossing", "doc_tokens"])

    chosen = [F.col(row_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")] + ([F.col(sections).alias("sections")] if sections else [])
    return df.select(*chosen).mapInArrow(lean(run), "doc_id long, section long, char_start long, char_end long, n_tokens long, n_crossing long, doc_tokens long")
