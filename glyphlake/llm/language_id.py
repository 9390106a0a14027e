"""Language identification by the nearest of several centroids per language.

A text becomes a normalised TF-IDF vector of its byte 1-, 2- and 3-grams (letters, lower-cased; all else is a blank), hashed to DIMENSIONS.
Spherical k-means gives each language a few centroids; the prediction is the language of the centroid with the greatest cosine.  A text is
rejected if it is farther from it than nearly all training texts of its length are from centroids made without them.  Cosines grow with length, so
training texts count whole and cut to several lengths, and limits are interpolated between these.

The fit reads at most SAMPLE texts of each language, those with the lowest hashes of id and text; prediction reads whole texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, prepare, spans_of_bytes, split_remainder, trim

DIMENSIONS = 4096
CENTROIDS = 4
#: Texts of each language, and of all, that a fit reads at most, and characters of all of them; longer texts than SAMPLE_CHARS are not among them.
SAMPLE, SAMPLE_ALL, SAMPLE_BYTES, SAMPLE_CHARS = 600, 4000, 24 << 20, 50_000
#: Languages that a fit learns at most, those with most texts: the model holds CENTROIDS vectors for each.
LANGUAGES = 400
#: A text is rejected below MARGIN of this quantile of the cosines that training texts of its length have to a centroid made without them.
QUANTILE, MARGIN = 0.01, 0.85
#: Letters, in bytes, at which there are limits; training texts are cut to as many characters.
LENGTHS = 4 ** np.arange(1, 8)
#: A centroid has its own limit at a length where so many texts tell it, else its language's; a language of fewer texts has no limit.
LEAST_TEXTS = 100
LEAST_OF_LANGUAGE = 20
UNKNOWN = "und"

#: Letters and bytes beyond ASCII; all other bytes are blanks.
KEPT = np.array([b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)


def counts(texts: list[str]) -> np.ndarray:
    """n-gram counts, one row for each text.  N-grams don't reach across texts, and those of blanks alone don't count."""
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    raw = [t.lower().encode("utf-8", "replace") for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    for a, b in spans_of_bytes(offsets, 1 << 20):
        for a in range(a, b, 256):
            c = min(a + 256, b)
            x = KEPT[np.frombuffer(b"".join(raw[a:c]), np.uint8)]
            if not len(x):
                continue
            owner = np.repeat(np.arange(c - a), np.diff(offsets[a : c + 1]))
            letter = x != 32
            x = x.astype(np.int64)
            total = np.bincount(owner[letter] * DIMENSIONS + x[letter], minlength=(c - a) * DIMENSIONS)
            gram, some = x, letter
            for n in (2, 3):
                gram = gram[:-1] * 257 + x[n - 1 :]
                some = some[:-1] | letter[n - 1 :]
                keep = some & (owner[: len(gram)] == owner[n - 1 :])
                place = 256 + ((gram * 0x9E3779B1 >> 7) & 0xFFFFFFFF) % (DIMENSIONS - 256)
                total += np.bincount(owner[: len(gram)][keep] * DIMENSIONS + place[keep], minlength=(c - a) * DIMENSIONS)
            out[a:c] = total.reshape(c - a, DIMENSIONS)
    return out


def normalised(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)


def clustered(v: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from k vectors drawn with a fixed seed."""
    c = v[np.sort(np.random.Generator(np.random.PCG64(5)).permutation(len(v))[:k])]
    for _ in range(rounds):
        own = (v @ c.T).argmax(axis=1)
        c = normalised(np.array([v[own == i].sum(axis=0) if (own == i).any() else c[i] for i in range(len(c))]))
    return c


class Model:
    def __init__(self, languages: list[str], idf: np.ndarray, centroids: np.ndarray, least: np.ndarray):
        self.languages, self.idf, self.centroids, self.least = languages, idf, centroids, least

    def limits(self, best: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """The least cosine at which texts of so many letters are accepted by their nearest centroids."""
        at = np.clip(np.log(np.maximum(letters, 1)) / np.log(4) - 1, 0, len(LENGTHS) - 1)
        low = np.minimum(at.astype(np.int64), len(LENGTHS) - 2)
        return self.least[best, low] * (low + 1 - at) + self.least[best, low + 1] * (at - low)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """Language, cosine (0 to 1) and whether the distance is accepted; `und`, 0 and not for texts that are null or have no letter."""
        out: list[tuple[str, float, bool]] = []
        for at in range(0, len(texts), 512):
            some = [t or "" for t in texts[at : at + 512]]
            if not self.languages:
                out += [(UNKNOWN, 0.0, False)] * len(some)
                continue
            n = counts(some)
            cosine = normalised(n * self.idf) @ self.centroids.T
            best, near = cosine.argmax(axis=1), cosine.max(axis=1)
            for t, k, c, ok in zip(some, best.tolist(), near.tolist(), near >= self.limits(best, letters(n))):
                if any(map(str.isalpha, t)):
                    out.append((self.languages[k], min(1.0, max(0.0, c)), bool(ok)))
                else:
                    out.append((UNKNOWN, 0.0, False))
        return out


def letters(n: np.ndarray) -> np.ndarray:
    """Bytes of letters of texts, from their n-gram counts."""
    return n[:, :256].sum(axis=1)


def limits_of(texts: list[str], v: np.ndarray, idf: np.ndarray, group: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Least cosines, one row for each of a language's centroids and a column for each of LENGTHS, from its texts and their vectors.

    Pieces nearer to one of the other languages' centroids, such as a quotation, tell nothing about this one.
    """
    if len(texts) < LEAST_OF_LANGUAGE:
        return np.zeros((len(group), len(LENGTHS)))
    own = (v @ group.T).argmax(axis=1)
    sums = np.array([v[own == k].sum(axis=0) for k in range(len(group))])
    size, near, nearest = [], [], []
    for cut in (*LENGTHS.tolist(), None):
        longer = np.array([i for i, t in enumerate(texts) if cut is None or len(t) > cut], np.int64)
        for at in range(0, len(longer), 256):
            some = longer[at : at + 256]
            n = counts([texts[i][:cut] for i in some])
            u = normalised(n * idf)
            cosine = u @ group.T
            rest = sums[own[some]] - v[some]  # a text's own centroid, without the text
            norm = np.linalg.norm(rest, axis=1)
            cosine[np.arange(len(some)), own[some]] = np.where(norm > 1e-3, (u * rest).sum(axis=1) / np.maximum(norm, 1e-3), -1)
            told = (letters(n) > 0) & (cosine.max(axis=1) >= (u @ others.T).max(axis=1, initial=0))
            size.append(letters(n)[told])
            near.append(cosine.max(axis=1)[told])
            nearest.append(cosine.argmax(axis=1)[told])
    size, near, nearest = map(np.concatenate, (size, near, nearest))
    place = np.clip(np.rint(np.log(np.maximum(size, 1)) / np.log(4)) - 1, 0, len(LENGTHS) - 1)
    out = np.full((len(group), len(LENGTHS)), np.nan)
    for p in range(len(LENGTHS)):
        for k in range(len(group)):
            for x in (near[(place == p) & (nearest == k)], near[place == p]):
                if len(x) >= LEAST_TEXTS:
                    out[k, p] = MARGIN * np.quantile(x, QUANTILE)
                    break
        # lengths that too few texts have are held to the limit of the length before
        if p and np.isnan(out[:, p]).any():
            out[:, p] = np.where(np.isnan(out[:, p]), out[:, p - 1], out[:, p])
    return np.maximum(np.nan_to_num(out), 0)


def fit(texts: list[str], languages: list[str]) -> Model:
    known = sorted(set(languages))
    if not known:
        return Model([], np.ones(DIMENSIONS, np.float32), np.zeros((0, DIMENSIONS), np.float32), np.zeros((0, len(LENGTHS))))
    c = counts(texts)
    idf = (np.log((1 + len(texts)) / (1 + np.count_nonzero(c, axis=0))) + 1).astype(np.float32)
    v = normalised(c * idf)
    del c
    names, centroids, groups = [], [], []
    labels = np.array(languages)
    for name in known:
        own = np.flatnonzero((labels == name) & (np.linalg.norm(v, axis=1) > 0.5))
        if not len(own):
            continue
        group = clustered(v[own], CENTROIDS)
        names += [name] * len(group)
        centroids += list(group)
        groups.append((name, own, group))
    centroids = np.array(centroids, np.float32).reshape(-1, DIMENSIONS)
    # texts nearer to another language are not of the label's
    found = np.array(names)[(v @ centroids.T).argmax(axis=1)] if names else labels
    least = []
    for name, own, group in groups:
        own = own[found[own] == name]
        least.append(limits_of([texts[i] for i in own], v[own], idf, group, centroids[np.array(names) != name]))
    return Model(names, idf, centroids, np.concatenate(least) if least else np.zeros((0, len(LENGTHS))))


def fit_on(documents: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on (doc_id, text, lang) with non-null text and lang and crc32(doc_id) mod 4 other than 2.

    At most `sample` texts a language, and so many that all stay below SAMPLE_ALL and SAMPLE_BYTES; empty texts and those above SAMPLE_CHARS characters are
    left out, and equal rows count once.  Ids may repeat or be null: rows are drawn by the hash of id and text, so the bounds hold for them as well.  Without
    any such text the model knows no language.
    """
    usable = documents.select("doc_id", "text", "lang").where("text is not null and lang is not null").where(split_remainder(F.col("doc_id")) != 2).where(F.length("text").between(1, SAMPLE_CHARS))
    keyed = usable.withColumn("draw", F.xxhash64("doc_id", "text", "lang"))
    # what is collected of languages is a row for each that the fit knows
    sizes = {r["lang"]: r["n"] for r in keyed.groupBy("lang").agg(F.approx_count_distinct("draw").alias("n"), F.count("*").alias("rows")).orderBy(F.desc("rows"), "lang").limit(LANGUAGES).collect()}
    sample = min(sample, max(1, SAMPLE_ALL // max(1, len(sizes))))
    # twice as many as are wanted come through, by a share of the hashes of each language; which rows these are, without their texts, then the texts
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, (2 * sample + 20) / max(1, n)))).otherwise(share)
    sized = keyed.where(F.pmod("draw", F.lit(1_000_003)) / 1_000_003 <= share).groupBy("lang", "draw").agg(F.first(F.length("text")).alias("size"))
    ranked = sized.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("draw"))).where(F.col("rank") <= sample)
    drawn = sorted((r["draw"], r["size"], r["lang"]) for r in ranked.collect())
    room = dict.fromkeys(sizes, SAMPLE_BYTES // max(1, len(sizes)))
    chosen = []
    for draw, size, lang in drawn:
        if size <= room[lang]:
            room[lang] -= size
            chosen.append((draw,))
    chosen = documents.sparkSession.createDataFrame(chosen, "draw long")
    rows = keyed.join(F.broadcast(chosen), "draw").select("draw", "text", "lang").dropDuplicates(["draw"]).collect()
    rows.sort(key=lambda r: r.draw)
    model = fit([r.text for r in rows], [r.lang for r in rows])
    del rows
    trim()
    return model


def with_language(df: DataFrame, model: Model, text: str = "text", columns: tuple[str, str, str] = ("language", "cosine", "accepted")) -> DataFrame:
    """The table with language, cosine and acceptance appended; all rows and other columns as they are.

    Texts that are null, empty or without a letter are `und`, 0 and not accepted; repeated rows get the same; very long texts are read whole; an empty table
    stays empty.  A table that has one of the columns is refused.
    """
    prepare(df.sparkSession)
    if set(columns) & set(df.columns):
        raise ValueError(f"the table has a column of {', '.join(columns)}")
    at, names = df.columns.index(text), [*df.columns, *columns]

    def run(batches):
        for batch in batches:
            found = model.predict(batch.column(at).to_pylist())
            arrays = [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(lean(run), f"{schema}, `{columns[0]}` string, `{columns[1]}` double, `{columns[2]}` boolean")
