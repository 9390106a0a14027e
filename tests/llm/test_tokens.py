import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")

from glyphlake.llm import byte_pairs, packing, pieces, token_counts  # noqa: E402

from . import edge  # noqa: E402

BYTES, PIECES = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BYTES)


def random_texts(n, seed, make):
    rng = random.Random(seed)
    parts = [" ", "  ", "\n", "\t", "é", "ß", "😀", "12", "3", ".", ",", "'s", "ing", "tion", "<|endoftext|>", "日本", "a", "\x00", "\r\n", "▁", "ﬁ", "the", "<s>", "   ", "Zz"]
    return ["".join(rng.choice(parts) if rng.random() < 0.5 else make(rng) for _ in range(rng.randint(0, 12))) for _ in range(n)]


def test_byte_tokenizer_equals_the_library(library):
    t = byte_pairs.ByteTokenizer(BYTES)
    assert t.fast is not None
    for text in random_texts(6000, 1, lambda r: library.decode([r.randrange(50256)])):
        assert t.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_every_token_merges_to_itself(library):
    """Then ranks and listed merges give the same ids: what covers a token's text exactly is always its own pair."""
    import json

    spec = json.load(open(BYTES, encoding="utf-8"))
    vocabulary = spec["model"]["vocab"]
    rank = {tuple(m.split(" ") if isinstance(m, str) else m): i for i, m in enumerate(spec["model"]["merges"])}
    for token in vocabulary:
        parts = list(token)
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: rank.get((parts[i], parts[i + 1]), 1 << 30))
            if (parts[best], parts[best + 1]) not in rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        assert parts == [token]


def test_open_windows():
    rng = random.Random(2)
    windows, plain = packing.OpenWindows(1024), []
    for k in range(3000):
        n = rng.randint(1, 1024)
        best = min((c for c in plain if c >= n), default=-1)
        assert windows.tightest(n) == best
        if best >= 0 and rng.random() < 0.7:
            windows.take(best)
            plain.remove(best)
        c = rng.randint(1, 1024)
        windows.add(c, k)
        plain.append(c)


@pytest.mark.parametrize("extra", [False, True])
def test_packing(spark, library, extra):
    rows = packing.pack(edge.docs(spark, extra=extra), BYTES).collect()
    by_doc = defaultdict(list)
    for r in rows:
        assert len(r.ids) == r.length <= 1024
        by_doc[r.doc_id].append(r)
    for doc, text in {(r[0], r[1]) for r in edge.ROWS}:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        got = sorted(by_doc[doc], key=lambda r: r.start)
        copies = sum((r[0], r[1]) == (doc, text) for r in edge.ROWS)
        assert [i for r in got[::copies] for i in r.ids] == ids and all(r.doc_tokens == len(ids) for r in got) and len(got) == copies * -(-len(ids) // 1024)
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack(edge.empty(spark), BYTES).collect() == []


def test_packing_is_tight(spark):
    rng = random.Random(4)
    rows = [(i, 0, min(1024, 1 + int(rng.expovariate(1 / 300)))) for i in range(5000)]
    out = packing.assign(spark.createDataFrame(rows, "doc_id long, start long, length long").coalesce(1)).collect()
    tokens, sequences = sum(r[2] for r in rows), len({r.sequence_id for r in out})
    assert sequences * 1024 < 1.01 * tokens + 4 * 1024


def test_derived_digest(spark, library):
    rows = packing.pack(edge.docs(spark), BYTES, derive=lambda ids: zlib.crc32(ids.astype("<u4").tobytes()), derived="ids_crc32 long").where("doc_id = 8").collect()
    assert [r.ids_crc32 for r in rows] == [zlib.crc32(np.array([*library.encode("one", add_special_tokens=False).ids, 0], "<u4").tobytes())]


@pytest.fixture(scope="module")
def model():
    return pieces.PieceModel(PIECES)


def test_pieces_equal_the_library(model):
    every = list(model.ids)
    for text in random_texts(8000, 5, lambda r: r.choice(every)) + [edge.LONG]:
        ids = model.encode(text)
        assert ids == model.processor.encode(text)
        assert model.decode(ids) == model.processor.decode(ids)


def test_backtracking_equals_merging(model):
    rng = random.Random(6)
    letters = "aeionrst▁hdlzß"
    for _ in range(3000):
        s = "".join(rng.choice(letters) for _ in range(rng.randint(1, 20)))
        if "▁▁" not in s:
            assert model.stretch(s) == model.merged(s)


@pytest.mark.parametrize("extra", [False, True])
def test_pieces_edge(spark, model, extra):
    out = pieces.encode(edge.docs(spark, extra=extra), PIECES).collect()
    want = sorted(((r[0], model.processor.encode(r[1] or "")) for r in edge.ROWS), key=str)
    assert sorted(((r.doc_id, list(r.ids)) for r in out), key=str) == want
    assert all(r.decoded == model.processor.decode(list(r.ids)) for r in out)
    assert pieces.encode(edge.empty(spark), PIECES).collect() == []


def brute_attribution(library, text, spans, rule):
    """Character by character, from the library's tokens."""
    ids = library.encode(text, add_special_tokens=False).ids
    t = byte_pairs.tokenizer(BYTES)
    char_of = [k for k, c in enumerate(text) for _ in c.encode()]
    at, counts, outside = 0, [0] * len(spans), 0
    for i in ids:
        held = char_of[at : at + t.lengths[i]]
        at += t.lengths[i]
        first, last = held[0], held[-1] + 1
        share = [max(0, min(last, e) - max(first, s)) for s, e in spans]
        if rule == "most":
            k = share.index(max(share)) if spans and max(share) else None
        else:
            c = first if rule == "start" else last - 1
            k = next((n for n, (s, e) in enumerate(spans) if s <= c < e), None)
        if k is None:
            outside += 1
        else:
            counts[k] += 1
    return counts, outside


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_attribution_against_brute_force(spark, library, rule):
    rng = random.Random(8)
    rows = []
    for i, text in enumerate(random_texts(120, 9, lambda r: r.choice(["hello", " world", "naïve", "übertrieben", "12345"]))):
        cuts = sorted(rng.sample(range(len(text) + 1), min(len(text) + 1, 6)))
        rows.append((i, text, [{"start": a, "end": b} for a, b in zip(cuts[::2], cuts[1::2])]))
    df = spark.createDataFrame(rows, "doc_id long, text string, parts array<struct<start:int,end:int>>")
    got = defaultdict(dict)
    for r in token_counts.count_tokens(df, BYTES, sections="parts", rule=rule).collect():
        got[r.doc_id][r.section] = r.n_tokens
    for i, text, spans in rows:
        counts, outside = brute_attribution(library, text, [(s["start"], s["end"]) for s in spans], rule)
        assert got[i] == {**dict(enumerate(counts)), -1: outside}


@pytest.mark.parametrize("extra", [False, True])
def test_lines(spark, library, extra):
    out = defaultdict(list)
    for r in token_counts.count_tokens(edge.docs(spark, extra=extra), BYTES).collect():
        out[r.doc_id].append(r)
    for doc, text in {(r[0], r[1]) for r in edge.ROWS if r[0] != 2}:
        rows = sorted(out[doc], key=lambda r: r.section)
        assert sum(r.n_tokens for r in rows) == rows[0].doc_tokens == len(library.encode(text or "", add_special_tokens=False).ids)
        assert "".join((text or "")[r.char_start : r.char_end] for r in rows) == (text or "")
    assert [list(map(list, zip(*token_counts.line_sections(t)))) for t in ("", "a", "a\n", "a\n\nb")] == [[[0, 0]], [[0, 1]], [[0, 2]], [[0, 2], [2, 3], [3, 4]]]
    assert token_counts.count_tokens(edge.empty(spark), BYTES).collect() == []
    with pytest.raises(ValueError):
        token_counts.count_tokens(edge.docs(spark), BYTES, rule="none")
