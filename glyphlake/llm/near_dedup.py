"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

1. Every document becomes its set of distinct 5-word shingles, as 64-bit hashes.  Documents with equal sets are one from here on.
2. Circulant MinHash: a first permutation scatters the hashed shingles over a fixed universe; a second one, circularly shifted by
   1 to K, gives the K coordinates of the signature, each the minimum over the set.
3. K = bands x rows; documents that agree in a whole band share a bucket.  Each bucket links its members to its first one; these links
   join documents to candidate groups.  No pair is emitted: a bucket of n members gives n - 1 links.
4. Within each candidate group all sets are compared exactly, blocked by set size and hash, as products of incidence matrices; what leaves a
   block is a spanning forest of its true links.  In a group of more than HUGE_DOCS different sets, those that share a bucket are compared.
5. Connected components of the true links, by star contraction over written tables.

With 45 bands of 7 rows a pair at similarity 0.85 is missed by the buckets with probability 3e-8, one at 0.80 with 2.5e-5, while one at 0.1 comes
together with 5e-6.  Step 4 also compares pairs that share no bucket but only a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, prepare, removed, spans_of_bytes, spread_join, task_base, utf8_buffers, written

WORDS = 5
BANDS, ROWS = 45, 7
#: Linked with 100 * intersection >= PERCENT * union.
PERCENT = 85
#: Elements of the universe that shingles are hashed to for signatures; exact sets keep all 64 bits.
UNIVERSE = 1 << 20
#: Most documents, and most shingles, of one block in the exact comparison.
BLOCK_DOCS, BLOCK_SHINGLES = 512, 1_000_000
#: Candidate groups of more documents than this are compared bucket by bucket.
HUGE_DOCS = 20_000
#: Bytes of text that are hashed at once.
CHUNK = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2^64
_TABLES: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE to the powers 0..n and its inverse likewise, modulo 2^64."""
    if "powers" not in _TABLES or len(_TABLES["powers"]) <= n:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for name, base in (("powers", _BASE), ("inverse", inverse)):
            x = np.full(n + 1, base, np.uint64)
            x[0] = 1
            _TABLES[name] = np.multiply.accumulate(x)
        _TABLES["letters"] = np.random.Generator(np.random.PCG64(71)).integers(0, 1 << 64, 256, dtype=np.uint64)
        lower = np.arange(256, dtype=np.uint8)
        lower[65:91] += 32
        _TABLES["letters"] = _TABLES["letters"][lower]
        blank = np.zeros(256, bool)
        blank[[9, 10, 11, 12, 13, 32]] = True
        _TABLES["blank"] = blank
    return _TABLES["powers"], _TABLES["inverse"]


def _mixed(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts back to back, and offsets of each text's.

    Words are runs without [\x20\x09-\x0D], A-Z lower-cased.  Fewer words than `words` are one shingle; no word, no shingle.
    """
    docs = len(offsets) - 1
    powers, inverse = _powers(max(CHUNK, len(data) + 1))
    if not len(data):
        return np.empty(0, np.uint64), np.zeros(docs + 1, np.int64)
    solid = ~_TABLES["blank"][data]
    before = np.empty_like(solid)
    before[0] = False
    before[1:] = solid[:-1]
    inner = offsets[1:-1]
    before[inner[inner < len(data)]] = False  # a text begins
    starts = np.flatnonzero(solid & ~before)
    after = np.empty_like(solid)
    after[-1] = False
    after[:-1] = solid[1:] & before[1:]
    ends = np.flatnonzero(solid & ~after) + 1
    prefix = np.empty(len(data) + 1, np.uint64)
    prefix[0] = 0
    np.cumsum(_TABLES["letters"][data] * powers[: len(data)], out=prefix[1:])
    word = _mixed((prefix[ends] - prefix[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    first = np.searchsorted(starts, offsets)  # words before each text
    counts = np.diff(first)
    doc_of_word = np.repeat(np.arange(docs), counts)
    if len(word) >= words:
        h = word[: len(word) - words + 1].copy()
        for k in range(1, words):
            h = _mixed(h * _BASE + word[k : len(word) - words + 1 + k])
        same = doc_of_word[: len(h)] == doc_of_word[words - 1 :]
        h, owner = h[same], doc_of_word[: len(same)][same]
    else:
        h, owner = np.empty(0, np.uint64), np.empty(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < words))
    if len(short):
        # word by word with the texts that still have one
        extra = word[first[short]]
        for k in range(1, words - 1):
            more = counts[short] > k
            extra[more] = _mixed(extra[more] * _BASE + word[first[short[more]] + k])
        h, owner = np.concatenate([h, extra ^ counts[short].astype(np.uint64)]), np.concatenate([owner, short])
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    if len(h):
        fresh = np.empty(len(h), bool)
        fresh[0] = True
        fresh[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
        h, owner = h[fresh], owner[fresh]
    return h, np.searchsorted(owner, np.arange(docs + 1))


def _permutations(k: int) -> tuple[np.ndarray, np.ndarray]:
    if "scatter" not in _TABLES:
        rng = np.random.Generator(np.random.PCG64(72))
        _TABLES["scatter"] = rng.permutation(UNIVERSE).astype(np.int32)
        _TABLES["circle"] = rng.permutation(UNIVERSE).astype(np.int32)
    circle = _TABLES["circle"]
    return _TABLES["scatter"], np.lib.stride_tricks.sliding_window_view(np.concatenate([circle, circle[:k]]), k)


def signatures(hashes: np.ndarray, offsets: np.ndarray, k: int = BANDS * ROWS) -> np.ndarray:
    """Circulant MinHash, one row of k coordinates per set; empty sets have the universe's size in each."""
    scatter, windows = _permutations(k)
    out = np.full((len(offsets) - 1, k), UNIVERSE, np.int32)
    at = scatter[(hashes >> np.uint64(20)).astype(np.int64) & (UNIVERSE - 1)]
    step = 4096
    sizes = np.diff(offsets)
    # coordinate c of an element at place p of the circle is circle[p + c]: a row of the sliding windows
    a, n = 0, len(sizes)
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + step, side="right")) - 1)
        lo, hi = offsets[a], offsets[b]
        if b == a + 1:
            for x in range(lo, hi, step):
                np.minimum(out[a], windows[at[x : min(x + step, hi)]].min(axis=0), out=out[a])
        else:
            full = np.flatnonzero(sizes[a:b]) + a
            if len(full):
                out[full] = np.minimum.reduceat(windows[at[lo:hi]], offsets[full] - lo, axis=0)
        a = b
    return out


def band_keys(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    s = signature.reshape(len(signature), bands, rows).astype(np.uint64)
    h = np.broadcast_to(np.arange(bands, dtype=np.uint64), s.shape[:2]).copy()
    for r in range(rows):
        h = _mixed(h * _BASE + s[:, :, r] + np.uint64(1))
    return h.view(np.int64)


def long_set(data: np.ndarray, words: int = WORDS) -> np.ndarray:
    """The set of one long text: pieces that end at blanks and begin with the last words of the one before, so that memory is that of a piece and of the set."""
    _powers(CHUNK)
    found, at = [], 0
    while True:
        end = at + CHUNK
        while True:
            end = min(end, len(data))
            blank = np.flatnonzero(_TABLES["blank"][data[end : end + 4096]]) if end < len(data) else [0]
            solid = ~_TABLES["blank"][data[at:end]]
            starts = np.flatnonzero(solid & ~np.concatenate([[False], solid[:-1]]))
            if len(blank) and (len(starts) >= words or end == len(data)):
                break
            end += CHUNK if len(blank) else 4096
        end += int(blank[0])
        found.append(shingle_sets(data[at:end], np.array([0, end - at]), words)[0])
        if end == len(data):
            return np.unique(np.concatenate(found))
        at += int(starts[1 - words])


def sets_of(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, hashes, offsets) of spans of texts: about CHUNK bytes together, or one long text."""
    for a, b in spans_of_bytes(offsets, CHUNK):
        if b == a + 1 and offsets[b] - offsets[a] > CHUNK:
            hashes = long_set(data[offsets[a] : offsets[b]])
            yield a, b, hashes, np.array([0, len(hashes)])
        else:
            yield a, b, *shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


SIGNED = "row long, id long, size long, sum1 long, sum2 long, bands array<long>, packed binary"


def _signed(batches):
    """(id, text) to a numbered row with the set's size, two sums that name it, its band keys and its text, compressed."""
    row = task_base()
    z = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        data, whole = utf8_buffers(batch.column(1))
        for a, b, hashes, offsets in sets_of(data, whole):
            sizes = np.diff(offsets)
            keys = band_keys(signatures(hashes, offsets)).ravel()
            bands = pa.ListArray.from_arrays(pa.array(np.arange(0, len(keys) + 1, BANDS, dtype=np.int32)), pa.array(keys))
            sums = [(np.add.reduceat(np.append(x, np.uint64(0)), offsets[:-1]) * (sizes > 0)).view(np.int64) for x in (hashes, _mixed(hashes ^ _BASE))]
            packed = [z.compress(data[whole[i] : whole[i + 1]]) for i in range(a, b)]
            numbers = batch.column(2).slice(a, b - a)
            yield pa.RecordBatch.from_arrays(
                [numbers if not numbers.null_count else pa.array(np.arange(row, row + b - a)), batch.column(0).slice(a, b - a), pa.array(sizes), *map(pa.array, sums), bands, pa.array(packed, pa.binary())],
                names=["row", "id", "size", "sum1", "sum2", "bands", "packed"])
            row += b - a


def _bucket_links(batches):
    """Rows (key, id) sorted by key and id: each id to the first of its key."""
    key, head = None, None
    for batch in batches:
        keys, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        fresh = np.empty(len(keys), bool)
        fresh[0] = key is None or keys[0] != key
        fresh[1:] = keys[1:] != keys[:-1]
        heads = np.where(fresh, np.arange(len(keys)), -1)
        heads = np.maximum.accumulate(heads)
        first = np.where(heads >= 0, ids[np.maximum(heads, 0)], head if head is not None else 0)
        key, head = keys[-1], first[-1]
        link = ~fresh & (ids != first)
        if link.any():
            pairs = np.unique(np.stack([ids[link], first[link]]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])


def components(links: DataFrame, name: str = "links") -> DataFrame:
    """Connected components of links (a, b): one row (id, component) for each linked id, component its smallest member.

    Alternating large-star and small-star contraction; each round is an aggregation and a join by key, written to the shared folder.
    """
    spark = links.sparkSession
    now, path = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name, narrow=True)
    if not now.take(1):
        return now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: greater neighbours go to the least of the neighbourhood
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: each id and its smaller neighbours go to the least of these
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        fresh = large.join(small, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct()
        fresh, fresh_path = written(fresh, name, narrow=True)
        # done when each id has one link, to an id that has none itself
        heads = fresh.select(F.col("b").alias("a")).distinct()
        open_ = fresh.groupBy("a").agg(F.count("*").alias("n")).join(heads.withColumn("head", F.lit(True)), "a", "left").where("n > 1 or head")
        finished = not open_.take(1)
        removed(spark, path)
        now, path = fresh, fresh_path
        if finished:
            heads = now.select("b").distinct().select(F.col("b").alias("id"), F.col("b").alias("component"))
            return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(heads)


def linked(sets: list[np.ndarray], side: np.ndarray, percent: int = PERCENT) -> list[tuple[int, int]]:
    """A spanning forest of the true links among the sets; only between sides 0 and 1 if both are there and all if just one."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    if n < 2:
        return []
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    fresh = np.empty(len(flat), bool)
    fresh[0] = True
    fresh[1:] = flat[1:] != flat[:-1]
    column = np.cumsum(fresh) - 1
    shared = np.bincount(column) > 1
    keep = shared[column]
    number = np.cumsum(shared) - 1
    owner, column = owner[keep], number[column[keep]]
    width = int(shared.sum())
    a, b = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if 0 < side.sum() < n else (np.arange(n), np.arange(n))
    common = np.zeros((len(a), len(b)), np.float64)
    step = max(256, (1 << 22) // n)
    for at in range(0, width, step):  # columns are in ascending order
        lo, hi = np.searchsorted(column, [at, at + step])
        m = np.zeros((n, min(step, width - at)), np.float32)
        m[owner[lo:hi], column[lo:hi] - at] = 1
        common += m[a] @ m[b].T
    union = sizes[a][:, None] + sizes[b][None, :] - common
    x, y = np.nonzero(100 * common >= percent * union)
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    for i, j in zip(a[x].tolist(), b[y].tolist()):
        p, q = root(i), root(j)
        if p != q:
            parent[q] = p
            out.append((i, j))
    return out


def _sets(batches):
    """(row, packed, units) to (row, units, hashes): the sets again."""
    z = zstandard.ZstdDecompressor()
    for batch in batches:
        texts = [z.decompress(p.as_buffer()) for p in batch.column(1)]
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        for a, b, hashes, ends in sets_of(np.frombuffer(b"".join(texts), np.uint8), offsets):
            sets = [hashes[ends[i] : ends[i + 1]].tobytes() for i in range(b - a)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(sets, pa.binary())], names=["row", "units", "hashes"])


def _verified(percent: int):
    def run(batches):
        """Rows (unit, side, row, hashes) sorted by unit to the spanning links of each unit."""
        unit, rows, sides, sets = None, [], [], []

        def links():
            found = linked(sets, np.array(sides), percent) if len(sets) > 1 else []
            return [(rows[i], rows[j]) for i, j in found]

        def batch_of(done):
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            done = []
            for u, side, row, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                if u != unit:
                    done += links()
                    unit, rows, sides, sets = u, [], [], []
                rows.append(row)
                sides.append(side)
                sets.append(np.frombuffer(packed.as_buffer().to_pybytes(), np.uint64))
            if done:
                yield batch_of(done)
        if done := links():
            yield batch_of(done)

    return run


def _units(candidates: DataFrame, percent: int) -> DataFrame:
    """(row, component, size) to (row, units): the comparisons in which a document takes part.

    A group within the limits of a block is one unit.  A larger one is cut by set size into bands, of which only the same and the next can
    hold links, and each band by a hash into blocks; a unit is a pair of blocks.
    """
    totals = candidates.groupBy("component").agg(F.count("*").alias("n"), F.sum("size").alias("t"))
    sized = candidates.join(totals, "component").withColumn("whole", (F.col("n") <= BLOCK_DOCS) & (F.col("t") <= BLOCK_SHINGLES))
    small = sized.where("whole").select("row", F.array(F.struct(F.xxhash64("component").alias("unit"), F.lit(0).alias("side"))).alias("units"))

    # a little wider than the ratio, so that rounding can't put two linked sets two bands apart
    band = F.floor(F.log(F.col("size").cast("double")) / (np.log(100 / percent) * 1.0001))
    large = sized.where("not whole").select("row", "component", "size", band.alias("band"))
    blocks = large.groupBy("component", "band").agg(F.greatest(F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum("size") / BLOCK_SHINGLES)).alias("blocks"))
    around = large.join(blocks, ["component", "band"])
    for step, name in ((-1, "before"), (1, "after")):
        around = around.join(blocks.select("component", (F.col("band") - step).alias("band"), F.col("blocks").alias(name)), ["component", "band"], "left")
    own = F.pmod(F.xxhash64("row"), F.col("blocks"))
    many = lambda n, f: F.when(F.coalesce(n, F.lit(0)) > 0, F.transform(F.sequence(F.lit(0).cast("long"), n - 1), f)).otherwise(F.array())
    unit = lambda band, i, j, side: F.struct(F.xxhash64("component", band, i, j).alias("unit"), side.cast("int").alias("side"))
    # the same band has units (i, j) with i <= j; the next band's are told from these by a key below zero
    same = many(F.col("blocks"), lambda j: unit(F.col("band"), F.least(own, j), F.greatest(own, j), F.when(own <= j, 0).otherwise(1)))
    upward = many(F.col("after"), lambda j: unit(F.col("band"), -own - 1, j, F.lit(0)))
    downward = many(F.col("before"), lambda j: unit(F.col("band") - 1, -j - 1, own, F.lit(1)))
    return small.unionByName(around.select("row", F.concat(same, upward, downward).alias("units")))


def _compared(signed: DataFrame, candidates: DataFrame, percent: int) -> DataFrame:
    """The units of all candidates.  In a huge group only documents that share a bucket are compared, a bucket standing for a group."""
    huge = candidates.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > HUGE_DOCS).select("component")
    if not huge.take(1):
        return _units(candidates, percent)
    within = candidates.join(huge, "component", "left_semi").select("row", "size")
    keyed = signed.select("row", "bands").join(within, "row").select("row", F.explode("bands").alias("component"), "size")
    shared = keyed.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component")
    split = candidates.join(huge, "component", "left_anti").select("row", "component", "size").unionByName(keyed.join(shared, "component", "left_semi").select("row", "component", "size"))
    return _units(split, percent).groupBy("row").agg(F.flatten(F.collect_list("units")).alias("units"))


def near_dedup(df: DataFrame, row_id: str = "doc_id", text: str = "text", percent: int = PERCENT, place: str | None = None) -> DataFrame:
    """For each input row: doc_id, n_shingles, component_id, kept; with `place`, a column of distinct longs that tells rows apart, also place and stays.

    component_id is the smallest id that links reach; kept where it is the row's own, so several rows of one id are all kept; stays for one row of
    each component, the one with the smallest id, then the lowest place.  Null, empty and blank texts have no shingle and no link.  Repeated rows are linked
    with each other; null ids take part, and stand for a component only if it has no other.  Texts of any length are hashed whole, a piece at a time.  Other
    columns are ignored.  An empty table gives an empty result.
    """
    spark = df.sparkSession
    prepare(spark)
    number = F.lit(None) if place is None else F.col(place)
    source = df.select(F.col(row_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), number.cast("long").alias("place"))
    signed, signed_path = written(source.mapInArrow(lean(_signed), SIGNED), "signed", "none")
    rows, _ = written(signed.select("row", "id", "size", "sum1", "sum2"), "rows", narrow=True)
    total = rows.count()

    # equal sets are one: the first row stands for them
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first")
    classes, _ = written(rows.where("size > 0").groupBy("size", "sum1", "sum2").agg(F.min("row").alias("head"), first, F.count("*").alias("n")), "classes", narrow=True)
    heads = classes.select(F.col("head").alias("row"), "size")

    buckets = signed.select("row", "bands").join(heads.select("row"), "row").select(F.explode("bands").alias("key"), "row")
    grouped = components(buckets.repartition("key").sortWithinPartitions("key", "row").mapInArrow(lean(_bucket_links), "a long, b long"), "buckets")
    units, units_path = written(_compared(signed, grouped.withColumnRenamed("id", "row").join(heads, "row"), percent), "units", narrow=True)
    sets = signed.select("row", "packed").join(units, "row").mapInArrow(lean(_sets), f"row long, units {dict(units.dtypes)['units']}, hashes binary")
    dealt = sets.select(F.explode("units").alias("u"), "row", "hashes").select("u.unit", "u.side", "row", "hashes").repartition("unit").sortWithinPartitions("unit")
    joined = components(dealt.mapInArrow(lean(_verified(percent)), "a long, b long"), "links")
    removed(spark, signed_path, units_path)

    # components are told to the classes, and classes to the rows; a class or component of many rows or classes is joined by broadcast
    placed, _ = written(classes.join(joined.withColumnRenamed("id", "head"), "head", "left").withColumn("component", F.coalesce("component", "head")).withColumnRenamed("head", "row"), "placed", narrow=True)
    named, _ = written(placed.groupBy("component").agg(F.min("first").alias("best"), F.count("*").alias("weight")), "named", narrow=True)
    known, _ = written(spread_join(placed.select("size", "sum1", "sum2", "component", "row", "n"), named, ["component"], "weight", placed.count()).select("size", "sum1", "sum2", "best", "n"), "known", narrow=True)
    found = spread_join(rows, known, ["size", "sum1", "sum2"], "n", total)
    component = F.coalesce(F.col("best.id"), F.col("id"))
    extra = [F.col("row").alias("place"), F.coalesce(F.col("row") == F.col("best.row"), F.lit(True)).alias("stays")] if place else []
    return found.select(F.col("id").alias("doc_id"), F.col("size").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"), *extra)
