"""The pipeline's stages against plain versions of themselves, on small tables."""

import random

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402

from . import edge  # noqa: E402
from .test_dedup import brute_exact, brute_near  # noqa: E402
from .test_text_models import corpus  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    rows = corpus(seed=12, n=400)
    clean = [r for r in rows if not r[3] and len(r[1].split()) > 60]
    docs = [(r[0], r[1], r[2], "s", len(r[1])) for r in rows]
    docs += [(1000 + i, r[1] + " " * (i % 2), r[2], "s", 1) for i, r in enumerate(clean[:20])]  # exact copies
    docs += [(2000 + i, " ".join([*r[1].split(), "tail"]), r[2], "s", 1) for i, r in enumerate(clean[20:40])]  # near copies
    docs += [(3000, None, None, None, None), (3001, "", "aa", "s", 0), (3002, "12 !", "aa", "s", 4), docs[0], docs[0]]
    rng.shuffle(docs)
    base = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(docs, edge.DOCS).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(r[0], 1, r[3]) for r in rows], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    return str(base), rows


def test_stages(spark, folder, tmp_path):
    base, rows = folder
    docs, before = spark.read.parquet(f"{base}/documents.parquet"), None
    toxic = {r[0] for r in rows if r[3]}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        had = [(r.doc_id, r.text) for r in docs.collect()]
        out = stage(spark, docs, base)
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        has = [(r.doc_id, r.text) for r in docs.collect()] if k < 4 else None
        if name == "toxicity":
            gone = {d for d, _ in had} - {d for d, _ in has}
            assert len(gone - toxic) <= 0.02 * len(had) and len(gone & toxic) > 0.95 * len(toxic)
        elif name == "language":
            assert {d for d, _ in had} - {d for d, _ in has} == {3000, 3001, 3002}
        elif name == "exact_dedup":
            assert {d for d, _ in has} == {d for d, _, _, kept, _ in brute_exact(had) if kept} and len(has) == len({d for d, _ in has})
        elif name == "near_dedup":
            assert {d for d, _ in has} == {d for d, _, c in brute_near(had) if d == c}
            before = {d for d, _ in has}
        else:
            assert {r.doc_id for r in docs.collect()} == before


def test_near_copies_from_eighty_percent(spark):
    """Copies with a similarity of 0.80 to below 0.85 go as well."""
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(104))) for i in range(12)]  # 100 shingles each
    for i in range(12):  # k last words changed: (100 - k) of 100 + k shingles are common
        k = (8, 9, 10, 11, 12, 20)[i % 6]
        rows.append((100 + i, " ".join([*rows[i][1].split()[:-k], *(f"y{i}x{j}" for j in range(k))])))
    rows += [(200, None), (201, "")]
    docs = spark.createDataFrame([(d, t, "aa", "s", 1) for d, t in rows], edge.DOCS)
    has = {r.doc_id for r in corpus_pipeline.near_copies_out(spark, docs, "").collect()}
    expected, strict = ({d for d, _, c in brute_near(rows, p) if d == c} for p in (80, 85))
    assert has == expected and len(strict - expected) == 6


def test_decisions_are_for_rows(spark):
    """An id of several texts, and null ids: one row of each group stays, whatever the others with its id do."""
    a, b, c = ("one two three four five six seven " + " ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    rows = [(1, a), (2, b), (2, a), (None, c), (None, a), (None, c + " "), (3, b), (2, b), (4, None), (5, ""), (6, " ")]
    docs = spark.createDataFrame([(d, t, "aa", "s", 1) for d, t in rows], edge.DOCS).repartition(3)
    out = corpus_pipeline.exact_copies_out(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted([(1, a), (2, b), (None, c + " "), (6, " ")], key=str)
    near = [(1, a), (2, a + " tail"), (2, b), (None, b + " tail"), (None, c), (None, c + " tail"), (7, None), (8, ""), (None, "")]
    docs = spark.createDataFrame([(d, t, "aa", "s", 1) for d, t in near], edge.DOCS).coalesce(1)
    out = corpus_pipeline.near_copies_out(spark, docs, "")
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted([(1, a), (2, b), (None, c), (7, None), (8, ""), (None, "")], key=str)


def test_scratch_tables_go(spark, folder):
    import os

    from glyphlake.llm import common

    base, _ = folder
    shared = f"{common.shared_dir(spark)}/glyphlake".removeprefix("file://")
    before = set(os.listdir(shared)) if os.path.exists(shared) else set()
    corpus_pipeline.run(spark, base).count()
    left = {x.rsplit("-", 1)[0] for x in set(os.listdir(shared)) - before}
    assert "numbered" not in left and "blocks" not in left and "stage-near_dedup" in left and "stage-exact_dedup" not in left


def test_run(spark, folder):
    base, _ = folder
    out = corpus_pipeline.run(spark, base)
    assert out.columns == ["doc_id", "start", "length", "doc_tokens", "ids_crc32", "sequence_id", "offset"] and out.count() > 100


def test_edge(spark, tmp_path):
    edge.docs(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (7, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    edge.empty(spark).write.parquet(f"{tmp_path}/e/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/e/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/e").count() == 0
