"""Queries against their SQL on rows that the tables here do not have."""

import duckdb

from glyphlake import queries as core
from glyphlake.functions import chunking as K
from glyphlake.operators import lookups


def same_as_sql(spark, tmp_path, name, rows):
    """Rows of Spark and DuckDB on a table of documents of these (doc_id, text), as multisets."""
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    df = core.QUERIES[name](spark, str(tmp_path))
    ours = sorted((tuple(r) for r in df.collect()), key=str)
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    result = duck.sql(core.SQL[name])
    assert result.columns == df.columns
    assert ours == sorted(result.fetchall(), key=str)
    return ours


def test_clause_breaks_between_wide_blanks(spark, tmp_path):
    texts = [f"{b}a{b}b{b}\n{b}\n{b}c{b}" for b in (*K.BLANKS, "\t", "\r", "\x0b", "\x1c", "\x85", "᠎", "​", " ", "﻿", "\0")]
    texts += [None, "", "\n", " \n\xa0", "\xa0a\xa0", "\n\n　x　\n", " \xa0 a 　\n　 b\xa0 "]
    ours = same_as_sql(spark, tmp_path, "clause_breaks_as_spaces", [*enumerate(texts), (1, "\xa0again\n"), (None, "\xa0no id\n")])
    assert (1, "a\xa0b c") in ours and (len(texts) - 1, "a b") in ours


def test_cangjie_by_join_keeps_rows_apart(spark, tmp_path):
    texts = ["あabcい", "xえ yおz", None, "", "あ", "んあん", "か", "plain\nlines", "😀あ\0", "ああ"]
    rows = [(7 * i + 3, t) for i, t in enumerate(texts)] + [(3, "again う"), (3, "again う"), (None, "no id"), (None, "あ no id"), (-4, "えabc")]
    ours = same_as_sql(spark, tmp_path, "cangjie_by_join", rows)
    assert len(ours) == len(rows) - 2 and (None, "hqi  no id") in ours
    plan = core.QUERIES["cangjie_by_join"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "explode" not in plan  # characters are not rows


def test_cangjie_rows_with_a_large_table(spark):
    every = [(chr(c), f"c{c:x}") for c in (*range(0x4E00, 0x9FFF, 2), *range(0x20000, 0x20100, 3), 0x10FFFF, 0x41)]
    codes, texts = dict(every), ["一丁丂七ABAA", "\U00020000\U00020001\U00020003x", "\U0010ffff", "\n", "鿾鿿ab一", "\U00030000"]

    def plain(text):
        out, after = "", True
        for i, c in enumerate(text):
            out += (" " if i and (c in codes or after) else "") + codes.get(c, c)
            after = c in codes
        return out

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    table = spark.createDataFrame([*every, ("二字", "two"), ("丁", None)], "glyph string, code string")
    assert [r.codes for r in lookups.cangjie_rows(df, table).orderBy("doc_id").collect()] == [plain(t) for t in texts]
    assert [r.codes for r in lookups.cangjie_rows(df, table.where("false")).orderBy("doc_id").collect()] == texts
