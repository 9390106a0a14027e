import hashlib
import random

import numpy as np
import pytest

from glyphlake.llm import exact_dedup, near_dedup

from . import edge


def normalised(t):
    return "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")


def brute_exact(rows):
    groups = {}
    for i, (doc, text) in enumerate(rows):
        groups.setdefault(normalised(text), []).append((-len(text or ""), float("inf") if doc is None else doc, i))
    out = []
    for i, (doc, text) in enumerate(rows):
        best = min(groups[normalised(text)])
        out.append((doc, None if best[1] == float("inf") else best[1], len(groups[normalised(text)]), best[2] == i, hashlib.sha256(normalised(text).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [4, 64, exact_dedup.BLOCK_BYTES])
def test_exact_against_brute_force(spark, block):
    rng = random.Random(block)
    rows = [(i, "".join(rng.choice("ab ") for _ in range(rng.choice([0, 1, 5, 9, 30])))) for i in range(200)]
    rows += [(1000 + i, "abcd" * 5 + "x" * (i % 3)) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.dedup(df, block_bytes=block).collect()), key=str)
    assert got == brute_exact(rows)


@pytest.mark.parametrize("extra", [False, True])
def test_exact_edge(spark, extra):
    rows = [(r[0], r[1]) for r in edge.ROWS]
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in exact_dedup.dedup(edge.docs(spark, extra=extra)).collect()), key=str)
    assert got == sorted(((a, b, c, e) for a, b, c, _, e in brute_exact(rows)), key=str)
    kept = exact_dedup.dedup(edge.docs(spark)).where("kept").groupBy("text_sha256").count().collect()
    assert all(r["count"] == 1 for r in kept)
    assert exact_dedup.dedup(edge.empty(spark)).collect() == []


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, now = [], ""
    for c in low + " ":
        if c in " \t\n\x0b\x0c\r":
            if now:
                words.append(now)
            now = ""
        else:
            now += c
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_near(rows, percent=85):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    return sorted(((doc, len(sets[i]), least.get(root(i))) for i, (doc, _) in enumerate(rows)), key=str)


def near_rows(seed, groups=12, n=180):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    bases = [[rng.choice(words) for _ in range(rng.choice([3, 5, 30, 80, 200]))] for _ in range(groups)]
    rows = []
    for i in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((i * 3 % 541, " ".join(x.upper() if rng.random() < 0.1 else x for x in w)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_near_against_brute_force(spark, seed):
    rows = near_rows(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.near_dedup(df).collect()), key=str)
    assert got == brute_near(rows)


@pytest.mark.parametrize("huge", [False, True])
def test_near_in_blocks(spark, monkeypatch, huge):
    """Groups beyond the limits of a block: bands of size, blocks by hash; and huge groups by bucket."""
    monkeypatch.setattr(near_dedup, "BLOCK_DOCS", 7)
    monkeypatch.setattr(near_dedup, "HUGE_DOCS", 30 if huge else 10**6)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    base = [rng.choice(words) for _ in range(150)]
    rows = []
    for i in range(160):
        w = list(base[: rng.choice([150, 150, 140, 120, 90])])
        for _ in range(rng.choice([0, 1, 1, 2, 4, 8])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.near_dedup(df).collect()), key=str)
    assert got == brute_near(rows)


@pytest.mark.parametrize("extra", [False, True])
def test_near_edge(spark, extra):
    rows = [(r[0], r[1]) for r in edge.ROWS]
    found = near_dedup.near_dedup(edge.docs(spark, extra=extra)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=str) == brute_near(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)
    assert near_dedup.near_dedup(edge.empty(spark)).collect() == []


def test_shingle_sets_do_not_depend_on_neighbours():
    texts = ["", "a b c d e f", " a b  c d E f ", "a", "b\n\n", "ä ö ü ß é x y", "a b c d", "a b c d e"]
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    h, o = near_dedup.shingle_sets(np.frombuffer(b"".join(raw), np.uint8), offsets)
    for i, r in enumerate(raw):
        alone, _ = near_dedup.shingle_sets(np.frombuffer(r, np.uint8), np.array([0, len(r)]))
        assert list(alone) == list(h[o[i] : o[i + 1]]) and len(alone) == len(shingles(texts[i]))


def test_signatures_estimate_similarity():
    rng = np.random.Generator(np.random.PCG64(1))
    common, a, b = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (850, 75, 75))
    sets = [np.sort(np.concatenate([common, x])) for x in (a, b)]
    s = near_dedup.signatures(np.concatenate(sets), np.array([0, 925, 1850]))
    assert abs((s[0] == s[1]).mean() - 0.85) < 0.08
    assert (near_dedup.signatures(np.empty(0, np.uint64), np.array([0, 0])) == near_dedup.UNIVERSE).all()


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (103, 101), (200, 200)]
    found = {r.id: r.component for r in near_dedup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: 1 for i in range(1, 61)} | {100: 100, 101: 100, 103: 100}


def test_long_texts_in_pieces(monkeypatch):
    """The set of a text that is hashed in pieces is that of the whole text."""
    import random

    rng = random.Random(1)
    texts = ["a b c d e f g " * 200, "x" * 3000 + " y z w v u" + " q" * 50, "one two", " " * 1000 + "a b c"] + [" ".join(rng.choice(["aa", "b" * rng.randint(1, 400), "Cc"]) for _ in range(300)) for _ in range(9)]
    for size in (64, 300, 5000):
        monkeypatch.setattr(near_dedup, "CHUNK", size)
        for t in texts:
            data = np.frombuffer(t.encode(), np.uint8)
            assert (near_dedup.long_set(data) == near_dedup.shingle_sets(data, np.array([0, len(data)]))[0]).all()


def test_spread_join(spark):
    """The same rows as a plain left join, with hot keys, null keys and keys that one side lacks."""
    from pyspark.sql import functions as F

    from glyphlake.llm import common

    rows = spark.range(3000).select(F.col("id").alias("row"), F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 50 == 1, None).otherwise(F.col("id")).alias("k"))
    table = rows.where("k is not null and k % 5 <> 3").groupBy("k").agg(F.count("*").alias("n"), F.min("row").alias("v"))
    got = {(r.row, r.k, r.v) for r in common.spread_join(rows, table, ["k"], "n", 3000).collect()}
    assert got == {(r.row, r.k, r.v) for r in rows.join(table.drop("n"), "k", "left").select("row", "k", "v").collect()} and len(got) == 3000
    few = common.spread_join(rows, table, ["k"], "n", 3_000_000).collect()
    assert {(r.row, r.k, r.v) for r in few} == got
