import base64
import gzip

import pytest

from glyphlake.functions import scripts as S
from glyphlake.operators import lookups
from glyphlake.sources import tables as sources
from glyphlake.streaming import transform as streams


def test_gate_rows(spark, tmp_path):
    head = "\t".join(sources.COLUMNS)
    rows = ["1\ten\tplain\thello\thəloʊ\tx\tgold", "1\ten\tplain\tother\ta\tx\tgold", "2\ten\tplain\thello\ta\tx\tgold", "3\tfr\tplain\tz\ta\tx\tgold", "4\ten\tnope\tz\ta\tx\tgold", "5\ten\tplain\tother\ta\tx\tsilver", "6\ten\tplain", "7\ten\tplain\t\ta\tx\tgold"]
    path = tmp_path / "set.tsv"
    path.write_text("﻿" + "\n".join([head, *rows]) + "\n", encoding="utf-8")
    good, skipped = sources.gate_rows(spark, str(path), "en")
    assert sorted(r.id for r in good.collect()) == ["1", "5"]
    assert {r.reason: r.n for r in skipped.collect()} == {"duplicate id": 1, "duplicate text": 1, "other lang": 1, "unknown category": 1, "column count": 1, "empty text or expected_ipa": 1}
    path.write_text("id\ttext\n")
    with pytest.raises(ValueError, match="header"):
        sources.gate_rows(spark, str(path), "en")


def test_dictionary(spark, tmp_path):
    path = tmp_path / "dictionary"
    path.write_text("на 0.4 n a0\nна 0.6 n a1\nи i0\nx\nдом 0.5\n", encoding="utf-8")
    entries = sources.pronunciation_dictionary(spark, str(path))
    assert {r.word: r.phones for r in lookups.best_pronunciations(entries).collect()} == {"на": ["n", "a1"], "и": ["i0"]}
    assert [(r.word, r.variants) for r in lookups.variants(entries).collect()] == [("на", [["n", "a1"], ["n", "a0"]])]
    df = spark.createDataFrame([(1, "И на дом, на!")], "doc_id long, text string")
    assert lookups.russian_phonemes(df, entries).first().phonemes == ["i0", " ", "n", "a1", " ", "d", "o0", "m", ",", " ", "n", "a1", "!"]


def test_glyphs_and_columns(spark, tmp_path):
    with gzip.open(tmp_path / "glyphs.tsv.gz", "wt", encoding="utf-8") as f:
        f.write("# glyphs\n我\thqi\n有\tkb\n")
    table = sources.glyph_table(spark, str(tmp_path / "glyphs.tsv.gz"))
    df = spark.createDataFrame([(1, "我有ABC 123!"), (2, "x")], "doc_id long, text string")
    assert {r.doc_id: r.codes for r in lookups.cangjie_rows(df, table).collect()} == {1: "hqi kb ABC 123!", 2: "x"}
    (tmp_path / "rules.txt").write_text("a  b c\td # note\n\n# all\n")
    assert [r.fields for r in sources.column_table(spark, str(tmp_path / "rules.txt")).collect()] == [["a", "b c", "d"]]
    packed = spark.createDataFrame([(base64.b64encode("a\nb".encode()).decode(),)], "value string")
    assert [(r.line_no, r.line) for r in sources.base64_lines(packed).collect()] == [(0, "a"), (1, "b")]


def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([(1, "hello"), (2, "привет"), (3, None)], "doc_id long, text string")
    df.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = streams.transformed(streams.read_stream(spark, str(tmp_path / "in"), "doc_id long, text string"), script=S.detect_script("text"))
    streams.write_stream(stream, str(tmp_path / "out"), str(tmp_path / "progress")).awaitTermination()
    streams.write_stream(stream, str(tmp_path / "out"), str(tmp_path / "progress")).awaitTermination()  # nothing new
    assert sorted((r.doc_id, r.script) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, "Latn"), (2, "Cyrl"), (3, None)]
