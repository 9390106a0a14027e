import random
import zlib

import pytest

from glyphlake.llm import language_id, toxicity

from . import edge


def corpus(seed=3, n=600):
    rng = random.Random(seed)
    languages = {"aa": "the er on an re is".split(), "bb": "sch ich und ein lich ung".split()}
    bad = {"aa": ["grolk", "snarv"], "bb": ["pfuhtz", "mekdrach"]}
    rows = []
    for i in range(n):
        lang = rng.choice(["aa", "bb"])
        words = ["".join(rng.choice(languages[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(20, 120))]
        toxic = int(rng.random() < 0.25)
        for _ in range(toxic * 3):
            words.insert(rng.randrange(len(words)), rng.choice(bad[lang]) + rng.choice(["", "er", "ung"]))
        rows.append((i, " ".join(words), lang, toxic))
    return rows


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_toxicity_held_out(spark):
    rows = corpus()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], 1, r[3]) for r in rows] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit_on(docs, labels)
    scored = {r.doc_id: r.toxicity for r in toxicity.with_scores(docs, model).collect()}
    test = [(scored[r[0]] >= 0.3, r[3] == 1) for r in rows if held(r[0])]
    assert sum(a == b for a, b in test) / len(test) > 0.97 and len(test) > 80


def test_toxicity_ignores_held_out_labels(spark):
    rows = corpus()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    one, other = (spark.createDataFrame([(r[0], (1 - r[3]) if flip and held(r[0]) else r[3]) for r in rows], "doc_id long, toxic int") for flip in (False, True))
    a, b = toxicity.fit_on(docs, one), toxicity.fit_on(docs, other)
    assert (a.ordinary, a.toxic, a.threshold, a.weights) == (b.ordinary, b.toxic, b.threshold, b.weights)


def test_toxicity_edge(spark):
    model = toxicity.fit([t for _, t, _, y in corpus() if y], [t for _, t, _, y in corpus() if not y])
    out = toxicity.with_scores(edge.docs(spark, extra=True), model).collect()
    assert len(out) == len(edge.ROWS) and all(0 <= r.toxicity <= 1 for r in out) and {r.doc_id for r in out if r.toxicity >= 0.3} == set()
    assert toxicity.with_scores(edge.empty(spark), model).collect() == []
    with pytest.raises(ValueError):
        toxicity.with_scores(edge.docs(spark, extra=True), model, column="score")
    nothing = toxicity.fit([], [])
    assert nothing.score("a text") == 0.0 and nothing.score(None) == 0.0
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.fit_on(edge.docs(spark), labels).score("x") == 0.0


def test_toxicity_reads_whole_texts():
    rows = corpus()
    model = toxicity.fit([t for _, t, _, y in rows if y], [t for _, t, _, y in rows if not y])
    clean = next(t for _, t, _, y in rows if not y)
    assert model.score(clean * 50) < 0.3 <= model.score(clean * 20 + " grolk snarv grolker snarv grolk")


def plain_score(model, text):
    """The score by a loop over pairs of words, each compressed on its own."""
    import math

    raw = "".join(c if c.isascii() and c.isalpha() or ord(c) > 127 else " " for c in text.lower()).split()
    raw = [w for i, w in enumerate(raw) if i == 0 or w != raw[i - 1]]
    pairs = [raw[i : i + 2] for i in range(max(1, len(raw) - 1))] if raw else []
    lengths = [[len(toxicity.compressor(d).compress(toxicity.CARRIER + b"".join(b"\0\1" + w.encode() for w in pair) + b"\0\1")) for d in (model.ordinary, model.toxic)] for pair in pairs]
    over = [a - b for a, b in lengths if a - b >= model.threshold]
    x = (1, math.log1p(sum(over)), math.log1p(max(over, default=0)), math.log1p(len(pairs)) if over else 0)
    return 1 / (1 + math.exp(-sum(a * b for a, b in zip(x, model.weights))))


def test_toxicity_against_plain_zstandard():
    rows = corpus()
    model = toxicity.fit([t for _, t, _, y in rows if y], [t for _, t, _, y in rows if not y])
    texts = [t for _, t, _, _ in rows[:60]] + ["", "grolk", "grolk grolk grolk", "12 3", "Über SNARV, grolker!", "the er " * 3000 + "snarvung snarv er grolk"]
    for found, text in zip(model.scores(texts), texts):
        assert found == pytest.approx(plain_score(model, text), abs=1e-12)


def test_toxicity_in_pieces(monkeypatch):
    rows = corpus()
    model = toxicity.fit([t for _, t, _, y in rows if y], [t for _, t, _, y in rows if not y])
    texts = [" ".join(t for _, t, _, _ in rows[k : k + 9]) for k in range(0, 90, 9)] + ["the the the grolk grolk the"]
    whole = model.scores(texts)
    monkeypatch.setattr(toxicity, "PIECE", 64)
    monkeypatch.setattr(toxicity, "AT_ONCE", 17)
    assert (model.scores(texts) == whole).all()


def test_toxic_passages_are_runs_of_bytes():
    """Parts of words, words and phrases of words that ordinary documents have as well: nothing is looked up in a list."""
    rng = random.Random(5)
    plain = ["".join(rng.choice("the er on an re is sch und".split()) for _ in range(rng.randint(1, 3))) for _ in range(400)] + ["bad", "apple"]
    documents = [[rng.choice(plain) for _ in range(80)] for _ in range(800)]
    toxic = [[*d, "bad", "apple", *d[:9], "zorgling" + rng.choice(plain)] for d in documents[:200]]
    found = {p for p in toxicity.passages([[w.encode() for w in d] for d in toxic], [[w.encode() for w in d] for d in documents[200:]])}
    assert any(b"zorgling" in p for p in found) and any(b"bad apple" in p for p in found)


def test_toxicity_fit_is_bounded(spark):
    """However often an id repeats, with one text or with many."""
    rows = corpus()
    docs = spark.createDataFrame([r[:2] for r in rows] + [(1, f"many texts {k}") for k in range(3000)] + [(3, "x y z")] * 500 + [(None, f"none {k}") for k in range(500)], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int")
    seen = []
    real, toxicity.fit = toxicity.fit, lambda a, b: seen.append((len(a), len(b)))
    try:
        toxicity.fit_on(docs, labels, sample=50)
    finally:
        toxicity.fit = real
    assert max(seen[0]) <= 50 and min(seen[0]) > 0


def test_language_held_out(spark):
    rows = corpus()
    docs = spark.createDataFrame([r[:3] for r in rows] + [(9001, None, "aa"), (9002, "the er", None)], "doc_id long, text string, lang string")
    model = language_id.fit_on(docs)
    found = {r.doc_id: r for r in language_id.with_language(docs.drop("lang"), model).collect()}
    assert all(found[r[0]].language == r[2] and found[r[0]].accepted for r in rows if held(r[0]))
    assert found[9001].language == "und" and not found[9001].accepted


def test_language_fit_is_bounded(spark):
    """Null ids, an id of many texts and a row that repeats don't widen the sample."""
    rows = corpus()
    docs = spark.createDataFrame(
        [r[:3] for r in rows] + [(None, f"the er on {k}", "aa") for k in range(2000)] + [(1, f"sch und {k}", "bb") for k in range(1000)] + [(3, "the same", "aa")] * 1000, "doc_id long, text string, lang string")
    seen = []
    real, language_id.fit = language_id.fit, lambda texts, langs: seen.append((texts, langs))
    try:
        language_id.fit_on(docs, sample=50)
    finally:
        language_id.fit = real
    texts, langs = seen[0]
    assert langs.count("aa") == langs.count("bb") == 50 and len(set(zip(texts, langs))) >= 98


def plain_language(model, text):
    """The nearest centroid of a text, n-gram by n-gram."""
    import math

    raw = [b if b >= 128 or 97 <= b <= 122 else 32 for b in text.lower().encode()]
    place = {}
    for n in (1, 2, 3):
        for i in range(len(raw) - n + 1):
            gram = raw[i : i + n]
            if all(b == 32 for b in gram):
                continue
            value = 0
            for b in gram:
                value = value * 257 + b if value else b
            at = value if n == 1 else 256 + ((value * 0x9E3779B1 >> 7) & 0xFFFFFFFF) % (language_id.DIMENSIONS - 256)
            place[at] = place.get(at, 0) + float(model.idf[at])
    norm = math.sqrt(sum(v * v for v in place.values())) or 1.0
    cosines = [sum(v * float(c[k]) for k, v in place.items()) / norm for c in model.centroids]
    best = max(range(len(cosines)), key=cosines.__getitem__)
    return model.languages[best], cosines[best]


def test_language_against_plain_vectors():
    rows = corpus(n=200)
    model = language_id.fit([r[1] for r in rows], [r[2] for r in rows])
    texts = [r[1] for r in rows[:25]] + ["x", "Ärger, the er!", "schön und the", "q" * 300]
    for (lang, cosine, _), text in zip(model.predict(texts), texts):
        plain, near = plain_language(model, text)
        assert lang == plain and cosine == pytest.approx(near, abs=1e-4)


def test_language_edge(spark):
    rows = corpus()
    model = language_id.fit([r[1] for r in rows], [r[2] for r in rows])
    out = {r.doc_id: r for r in language_id.with_language(edge.docs(spark), model, columns=("l", "c", "a")).collect()}
    assert {out[k].l for k in (3, 4, 5, 9)} == {"und"} and all(0 <= r.c <= 1 for r in out.values())
    assert out[6].l in ("aa", "bb") and out[7].l in ("aa", "bb")
    assert language_id.with_language(edge.empty(spark), model).collect() == []
    with pytest.raises(ValueError):
        language_id.with_language(edge.docs(spark, extra=True), model)
    assert language_id.fit_on(edge.empty(spark)).predict(["x", None]) == [("und", 0.0, False)] * 2
    assert model.predict(["zz qq ww"])[0][2] in (True, False)


def test_language_vectors_do_not_depend_on_neighbours():
    texts = ["abc", "", "the end", "Über", "a" * 3000]
    together = language_id.counts(texts)
    for i, t in enumerate(texts):
        assert (language_id.counts([t])[0] == together[i]).all()


def test_language_rejects_by_distance():
    """A Latin-script language that no fit has seen, and random letters, go; held-out texts and short ones stay."""
    rng = random.Random(8)
    rows = corpus(n=900)
    odd = [(t, lang) for lang in ("aa", "bb") for t in ("zq", "xk jv", "qqqq")]  # a few training texts of junk don't open the door
    model = language_id.fit([r[1] for r in rows if not held(r[0])] + [t for t, _ in odd], [r[2] for r in rows if not held(r[0])] + [x for _, x in odd])
    italian = "nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura che la diritta via era smarrita ahi quanto a dir qual era cosa dura".split()
    foreign = [" ".join(rng.choice(italian) for _ in range(100)) for _ in range(50)]
    noise = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(100)) for _ in range(50)]
    assert not any(ok for _, _, ok in model.predict(foreign)) and not any(ok for _, _, ok in model.predict(noise))
    clean = [r[1] for r in rows if held(r[0])]
    assert all(ok for _, _, ok in model.predict(clean))
    assert sum(ok for _, _, ok in model.predict([t[:40] for t in clean])) >= 0.98 * len(clean)
