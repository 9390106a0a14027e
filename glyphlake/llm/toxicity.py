"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on passages of toxic documents and one on ordinary running text.  Every window of WINDOW words of a
document is compressed with each of them; the second length less the first is how much more like toxic text the window is.  Differences that
reach a calibrated threshold add up to the document's evidence, which a logistic curve, fitted on documents that neither dictionary has seen,
turns into a score.

Nearly all text of a toxic document is ordinary.  So the trainer gets, for the toxic dictionary, the stretches that set toxic documents apart:
bytes of runs (GRAMS bytes long) that so many more toxic than ordinary documents hold that chance can't explain it over all runs seen.  There is no
list of words: stretches are runs of bytes, which may be a part of a word, a word or several, and zstandard chooses the dictionary among them.

The fit reads at most SAMPLE labelled documents and SAMPLE_BYTES of text of each class; scoring reads every window of every whole text.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, prepare, split_remainder, trim

#: Labelled documents of each class, and characters of all of them, that a fit reads at most; longer texts than SAMPLE_CHARS are not among them.
SAMPLE, SAMPLE_BYTES, SAMPLE_CHARS = 2000, 8 << 20, 50_000
#: Bytes of each dictionary, and of the segments that the trainer puts into it.
DICTIONARY_BYTES, SEGMENT_BYTES = 2304, 64
#: Windows of ordinary text that the trainer gets, at most; drawn evenly over all of the sample.
TRAINED_WINDOWS = 100_000
#: Words of a window; a window begins at each word.
WINDOW = 2
#: Lengths of the runs of bytes whose documents are counted.
GRAMS = (5, 8)
#: A run sets toxic documents apart if it is in so many times the share of them, beyond chance.
RATIO = 8
#: Stands in front of each word, in windows and dictionaries: a match from a word's beginning is longer than one inside a word.
START = b"\0\1"
#: In front of each window and at the end of both dictionaries: a block that doesn't shrink is stored as it is, and would show no difference.
CARRIER = bytes(range(4, 28))
#: Matches are at least so long, so that common syllables don't count.
MATCH = 6
#: Characters of a text, and windows, that are worked on at once.
PIECE, AT_ONCE = 1 << 20, 20_000

#: A-Z to a-z; other letters and bytes beyond ASCII stay; the rest are spaces.
LETTERS = bytes((b + 32 if 65 <= b <= 90 else b) if 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str) -> list[bytes]:
    """Lower-cased words; one that follows itself counts once, as a window that repeats itself shortens without any dictionary."""
    return [w for w, _ in itertools.groupby(text.lower().encode("utf-8", "replace").translate(LETTERS).split())]


def windows(w: list[bytes]) -> list[bytes]:
    """Each run of WINDOW words, all of them where there are fewer, with a mark in front of each word and at the end."""
    return [START + START.join(w[i : i + WINDOW]) + START for i in range(max(1, len(w) - WINDOW + 1))] if w else []


def pieces(text: str) -> Iterator[list[bytes]]:
    """The words of a text, a piece at a time; each piece but the first begins with the last WINDOW - 1 words of the one before.

    Pieces are cut at white space; a word beyond PIECE characters is cut as well.
    """
    at, carried = 0, []
    while at < len(text):
        end = min(len(text), at + PIECE)
        if end < len(text):
            cut = max(text.rfind(" ", at, end), text.rfind("\n", at, end))
            end = cut + 1 if cut > at else end
        w = words(text[at:end])
        if carried and w[:1] == carried[-1:]:
            w = w[1:]
        if w:
            yield carried + w
            carried = (carried + w)[1 - WINDOW :] if WINDOW > 1 else []
        at = end


def distinct(documents: list[list[bytes]]) -> list[list[bytes]]:
    """Without copies and near copies: those that share one of their eight lowest shingle hashes with an earlier one."""
    seen: set[int] = set()
    out = []
    for w in documents:
        low = sorted({zlib.crc32(b" ".join(w[i : i + 5])) for i in range(max(1, len(w) - 4))})[:8]
        if not seen.intersection(low):
            out.append(w)
        seen.update(low)
    return out


def runs(raw: bytes, length: int) -> np.ndarray:
    """A hash for each run of so many bytes."""
    a = np.frombuffer(raw, np.uint8).astype(np.uint64)
    n = max(0, len(a) - length + 1)
    h = np.full(n, length, np.uint64)
    for k in range(length):
        h = h * np.uint64(0x9E3779B97F4A7C15) + a[k : k + n] + np.uint64(1)
        h ^= h >> np.uint64(29)
    return (h >> np.uint64(32)).astype(np.uint32)


def typical(toxic: list[bytes], ordinary: list[bytes], length: int) -> np.ndarray:
    """Hashes of the runs that set toxic documents apart.

    A run counts once for a document.  Its share of toxic documents is RATIO times that of ordinary ones, and the likelihood ratio of two shares against
    one common share is greater than the number of different runs, so that less than one of them is expected to be here by chance.
    """
    (a, held), (b, other) = (np.unique(np.concatenate([np.unique(runs(d, length)) for d in documents]), return_counts=True) for documents in (toxic, ordinary))
    at = np.minimum(np.searchsorted(b, a), max(0, len(b) - 1))
    against = np.where(b[at] == a, other[at], 0) if len(b) else np.zeros(len(a), np.int64)
    n, m = len(toxic), len(ordinary)

    def likelihood(k, of, p):
        p = np.clip(p, 1e-9, 1 - 1e-9)
        return k * np.log(p) + (of - k) * np.log(1 - p)

    common = (held + against) / (n + m)
    gain = likelihood(held, n, held / n) + likelihood(against, m, against / m) - likelihood(held, n, common) - likelihood(against, m, common)
    return a[(gain > np.log(max(2, len(a)))) & (held / n > RATIO * against / m)]


def passages(toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> list[bytes]:
    """The stretches of toxic documents that runs which set them apart cover: those that runs within words cover, else those that runs over several words do."""
    mine, others = ([b"".join(b" " + x for x in w) + b" " for w in documents] for documents in (toxic, ordinary))
    covered = [np.zeros((2, len(d)), bool) for d in mine]
    for length in GRAMS:
        apart = typical(mine, others, length)
        for d, cover in zip(mine, covered):
            at = np.flatnonzero(np.isin(runs(d, length), apart))
            if len(at):
                blanks = np.cumsum(np.frombuffer(d, np.uint8) == 32)
                inner = blanks[at + length - 2] == blanks[at]  # no blank but at the ends
                for k in range(length):
                    cover[0, at + k] = True
                    cover[1, at[inner] + k] = True
    out = []
    for d, cover in zip(mine, covered):
        whole, inner = ([(int(a), int(b)) for a, b in zip(np.flatnonzero(e == 1), np.flatnonzero(e == -1))] for e in (np.diff(np.pad(c.astype(np.int8), 1)) for c in cover))
        starts = np.array([a for a, _ in inner])
        for a, b in whole:
            within = inner[slice(*np.searchsorted(starts, [a, b]))]
            out += [d[x:y] for x, y in within or [(a, b)] if len(d[x:y].strip()) > 2]
    return out


def trained(samples: list[bytes]) -> bytes:
    """A zstandard dictionary of samples, cut to DICTIONARY_BYTES; the samples themselves where they are too few to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=SEGMENT_BYTES, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    content = dictionary + CARRIER
    settings = zstandard.ZstdCompressionParameters(
        window_log=12, hash_log=12, chain_log=12, search_log=4, strategy=zstandard.STRATEGY_GREEDY, min_match=MATCH,
        format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False)
    return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=settings)


class Distance:
    """The two dictionaries, and the differences of windows' compressed lengths."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.pair = compressor(ordinary), compressor(toxic)

    def of(self, some: list[bytes]) -> np.ndarray:
        """For each window, the bytes that the toxic dictionary saves over the ordinary one."""
        out = np.empty(len(some), np.int64)
        for a in range(0, len(some), AT_ONCE):
            held = [CARRIER + x for x in some[a : a + AT_ONCE]]
            one, other = (c.multi_compress_to_buffer(held, threads=1) for c in self.pair)
            out[a : a + len(held)] = [len(x) - len(y) for x, y in zip(one, other)]
        return out


class Model:
    def __init__(self, ordinary: bytes, toxic: bytes, threshold: int = MATCH, weights: tuple[float, ...] = (-3.0, 1.0, 0.0, 0.0)):
        self.ordinary, self.toxic, self.threshold, self.weights = ordinary, toxic, threshold, tuple(weights)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """0 to 1 for each text.  A text without a window, or without one that the toxic dictionary shortens, has the score of no evidence."""
        if not self.toxic:
            return np.zeros(len(texts))
        count, found, owner, held, room = np.zeros(len(texts), np.int64), [], [], [], 0
        distance = shared_distance(self.ordinary, self.toxic)

        def flush():
            if held:
                d = distance.of(held)
                on = np.flatnonzero(d >= self.threshold)
                found.append(np.stack([np.repeat([o for o, _ in owner], [n for _, n in owner])[on], d[on]]))
                owner.clear()
                held.clear()

        for i, text in enumerate(texts):
            for w in pieces(text or ""):
                some = windows(w)
                count[i] += len(some)
                owner.append((i, len(some)))
                held += some
                if len(held) >= AT_ONCE:
                    flush()
        flush()
        at, d = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
        total, most = np.zeros(len(texts)), np.zeros(len(texts))
        np.add.at(total, at, d)
        np.maximum.at(most, at, d)
        return 1 / (1 + np.exp(-(inputs(total, most, count) @ np.array(self.weights))))

    def score(self, text: str | None) -> float:
        return float(self.scores([text])[0])


def inputs(total: np.ndarray, most: np.ndarray, count: np.ndarray) -> np.ndarray:
    """What the curve sees of documents: sum and greatest of the differences at or above the threshold, and the number of windows."""
    return np.stack([np.ones(len(total)), np.log1p(total), np.log1p(most), np.where(total > 0, np.log1p(count), 0)], axis=1)


_DISTANCES: dict[tuple[bytes, bytes], Distance] = {}


def shared_distance(ordinary: bytes, toxic: bytes) -> Distance:
    key = (ordinary, toxic)
    if key not in _DISTANCES:
        _DISTANCES.clear()
        _DISTANCES[key] = Distance(ordinary, toxic)
    return _DISTANCES[key]


def fit(toxic_texts: list[str], ordinary_texts: list[str]) -> Model:
    """Dictionaries from one half of each class, threshold and curve from the other half.  Without a toxic passage all scores are 0."""
    toxic, ordinary = (distinct([w for w in map(words, texts) if w]) for texts in (toxic_texts, ordinary_texts))
    if not toxic or not ordinary:
        return Model(b"", b"")
    seen, kept = ([x[k::2] if len(x) > 3 else x for x in (toxic, ordinary)] for k in (0, 1))
    samples = passages(*seen)
    if not samples:
        return Model(b"", b"")
    everyday = sum(max(1, len(w) - WINDOW + 1) for w in seen[1])
    plain = list(itertools.islice((x for w in seen[1] for x in windows(w)), 0, None, max(1, -(-everyday // TRAINED_WINDOWS))))
    model = Model(trained(plain), trained([p.replace(b" ", START) for p in samples]))

    labels = np.repeat([1.0, 0.0], [len(kept[0]), len(kept[1])])
    distance = shared_distance(model.ordinary, model.toxic)
    documents = [distance.of(windows(w)) for w in itertools.chain(*kept)]
    count = np.array([len(d) for d in documents])
    best = None
    # the threshold on a window's difference that tells the kept texts apart best
    for threshold in range(1, 10):
        over = [d[d >= threshold] for d in documents]
        x = inputs(np.array([d.sum() for d in over], float), np.array([d.max(initial=0) for d in over], float), count)
        weights = logistic(x, labels)
        p = 1 / (1 + np.exp(-(x @ weights)))
        loss = -np.mean(labels * np.log(p + 1e-9) + (1 - labels) * np.log(1 - p + 1e-9))
        if best is None or loss < best[0] - 1e-6:
            best = (loss, threshold, weights)
    model.threshold, model.weights = best[1], tuple(map(float, best[2]))
    return model


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 60) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit_on(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on labelled documents (doc_id, text; doc_id, toxic 0/1) whose crc32(doc_id) mod 4 is not 2, at most `sample` of each class.

    Null labels, ids and texts, empty texts and those above SAMPLE_CHARS characters are left out; a document with several labels counts by the highest.  The
    sample has the lowest hashes of id and text, up to SAMPLE_BYTES characters of a class, and equal rows once: its bounds hold however often an
    id repeats.  Without documents of both classes all scores are 0.
    """
    usable = labels.where("toxic in (0, 1) and doc_id is not null").where(split_remainder(F.col("doc_id")) != 2).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = None
    for y in (0, 1):
        # a few thousand ids at most, whatever the size of the tables
        some = usable.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        ids = some if ids is None else ids.unionByName(some)
    ids = documents.sparkSession.createDataFrame([(int(r.doc_id), int(r.toxic)) for r in ids.collect()], "doc_id long, toxic int")
    found = documents.select("doc_id", "text").where(F.length("text").between(1, SAMPLE_CHARS)).join(F.broadcast(ids), "doc_id").select(
        "toxic", "text", F.xxhash64("doc_id", "text").alias("draw"), F.length("text").alias("size"))
    rows = []
    for y in (0, 1):
        # which rows, without their texts; then the texts of these
        drawn = found.where(F.col("toxic") == y).groupBy("draw").agg(F.first("size").alias("size")).orderBy("draw").limit(sample).collect()
        sizes = np.cumsum([r["size"] for r in drawn])
        rows += [(r["draw"],) for r, upto in zip(drawn, sizes) if upto <= SAMPLE_BYTES]
    chosen = documents.sparkSession.createDataFrame(rows, "draw long")
    texts = found.join(F.broadcast(chosen), "draw").select("draw", "toxic", "text").dropDuplicates(["draw"]).collect()
    texts.sort(key=lambda r: r.draw)
    model = fit([r.text for r in texts if r.toxic == 1], [r.text for r in texts if r.toxic == 0])
    del texts
    trim()
    return model


def with_scores(df: DataFrame, model: Model, text: str = "text", column: str = "toxicity") -> DataFrame:
    """The table with a score column appended; all rows and other columns as they are.  Null and empty texts score as without evidence.

    Repeated rows score alike, an empty table stays empty, and a very long text is read whole, a piece at a time.  A table that has the column is refused.
    """
    prepare(df.sparkSession)
    if column in df.columns:
        raise ValueError(f"the table has a column {column}")
    at = df.columns.index(text)
    names = [*df.columns, column]

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.scores(batch.column(at).to_pylist()), pa.float64())], names=names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(lean(run), f"{schema}, `{column}` double")
