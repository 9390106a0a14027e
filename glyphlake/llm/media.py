"""Media columns as content-defined chunks.

A payload becomes a media file (mono 8-bit PCM in a WAV container).  A rolling gear hash cuts the file where its content says so; each chunk
is named by a digest.  A document's row holds the ordered list of its digests.  Spark counts the digests of the whole corpus: a chunk that comes once
is kept in its row, and one that comes again, in whatever task, is a row of the directory, once.  So each different chunk is stored once.  Reading joins
the digests that rows only name to the directory and rebuilds the files.  Rows that hold all their chunks, the great majority, are
read back without a shuffle.  Rebuilt files are checked against the digest that was noted when they were written.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, prepare, removed, spread_join, task_base, written

#: Chunks are cut at 2,048 bytes on average (11 bits of the hash), 512 at least, 8,192 at most.
LEAST, BITS, MOST = 512, 11, 8192
#: Payloads are padded with spaces to a positive multiple of this.
UNIT = 192
#: Digests that a writing task remembers so as not to send a chunk twice; Spark makes those of all tasks, remembered or not, one.
REMEMBERED = 1_000_000
#: Bits of a filter for each repeated digest, as a power of two, and the most bits of a filter, likewise.
ROOM, WIDEST = 4, 26
RATE = 8000
GEAR = np.random.Generator(np.random.PCG64(20240607)).integers(0, 1 << 32, 256, dtype=np.uint32)


def padded(raw: bytes, unit: int = UNIT) -> bytes:
    return raw + b" " * (max(1, -(-len(raw) // unit)) * unit - len(raw))


def to_media(payload: bytes) -> bytes:
    """A WAV file whose samples are the payload's bytes."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload))
    return head + payload + b"\0" * (len(payload) % 2)


def from_media(media: bytes) -> bytes:
    """The samples of a WAV file with 8-bit samples."""
    if media[:4] != b"RIFF" or media[8:16] != b"WAVEfmt " or media[36:40] != b"data" or struct.unpack_from("<H", media, 34)[0] != 8:
        raise ValueError("not an 8-bit PCM file")
    n = struct.unpack_from("<I", media, 40)[0]
    if len(media) < 44 + n:
        raise ValueError("the file is cut short")
    return media[44 : 44 + n]


def gear_cuts(data: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Ends of possible chunks: after each byte where the top bits of the gear hash of the last 32 bytes are zero.

    The gear hash h = (h << 1) + gear[byte] in 32 bits forgets a byte after 32 steps, so it is a sum of shifted values, here built by
    doubling the window five times.
    """
    h = GEAR[data]
    for k in range(5):
        step = 1 << k
        if len(h) <= step:
            break
        more = h[:-step] << np.uint32(step)
        h = h.copy() if k == 0 else h
        h[step:] += more
    return np.flatnonzero(h >> np.uint32(32 - bits) == 0) + 1


def chunks(media: bytes, least: int = LEAST, most: int = MOST, bits: int = BITS) -> list[bytes]:
    """The file in order, cut where its content says so.  Cuts depend on the 32 bytes before them alone: an insertion moves few of them."""
    possible = gear_cuts(np.frombuffer(media, np.uint8), bits)
    out, at, n = [], 0, len(media)
    while n - at > least:
        k = np.searchsorted(possible, at + least)
        end = int(possible[k]) if k < len(possible) and possible[k] <= at + most else min(at + most, n)
        out.append(media[at:end])
        at = end
    if at < n:
        out.append(media[at:])
    return out


def features(payload: bytes) -> str:
    """Mean, root mean square and sign changes of the samples around their middle."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    return f"mean={x.mean():.6f};rms={np.sqrt((x * x).mean()):.6f};crossings={int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))};peak={int(np.abs(x).max())}"


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=20).digest()


#: A row of a document has all but the last three, a row of the directory only these.
STORE = "row long, doc_id long, n_bytes long, media_sha256 string, missing int, digests array<binary>, inline array<binary>, digest binary, bytes binary, uses long"


def _repeated(digests: DataFrame) -> tuple[DataFrame, str]:
    """digest, uses: the digests that come more than once; written, and its path."""
    return written(digests.groupBy("digest").agg(F.count("*").alias("uses")).where("uses > 1"), "repeated", narrow=True)


def _filter(repeated: DataFrame) -> tuple[bytes, int]:
    """A bit for each value of the leading bits of a digest, set where a repeated digest has it, and how many bits lead.

    Digests are random, so they are their own hash.  A digest that comes once and meets a set bit goes to the directory like a repeated one, which costs
    a join for its row and changes nothing else; so the filter can stay small, 8 MB at most.
    """
    width = min(WIDEST, max(10, repeated.count().bit_length() + ROOM))
    bit = F.shiftright(F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long"), 32 - width)
    words = repeated.select(bit.alias("bit")).groupBy(F.expr("bit div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("bits")).toArrow()
    out = np.zeros(1 << (width - 6), "<i8")
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out.tobytes(), width


def _cut(column: pa.Array):
    """Of each text of a column: its bytes, its media file, and (digest, chunk) in order."""
    for text in column:
        raw = text.as_buffer().to_pybytes()
        media = to_media(padded(raw))
        yield raw, media, [(digest(c), c) for c in chunks(media)]


def store(df: DataFrame, row_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, str]:
    """Write the media store of a text column's UTF-8 bytes; null is empty.  Returns it as read back, and its path.

    Texts are read and cut three times: for the digests, for the rows and for the directory.  They must be the same each time.
    """
    spark = df.sparkSession
    prepare(spark)
    source = df.select(F.col(row_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))

    def name(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([d for _, _, cut in _cut(batch.column(1)) for d, _ in cut], pa.binary())], names=["digest"])

    repeated, path = _repeated(source.mapInArrow(lean(name), "digest binary"))
    bits, width = _filter(repeated)
    sent = spark.sparkContext.broadcast(bits)

    def apart():
        """Whether a chunk belongs to the directory, by its digest."""
        bits, shift = sent.value, 32 - width

        def test(name: bytes) -> int:
            at = int.from_bytes(name[:4], "big") >> shift
            return bits[at >> 3] >> (at & 7) & 1

        return test

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.list_(pa.binary()), pa.list_(pa.binary())]
    parts = STORE.split(", ")
    names = [c.split()[0] for c in parts[: len(kinds)]]

    def rows(batches):
        task, row, shared = task_base(), -1, apart()
        for batch in batches:
            columns: list[list] = [[] for _ in names]
            held = 0
            for doc, (raw, media, cut) in zip(batch.column(0).to_pylist(), _cut(batch.column(1))):
                row += 1
                inline = [None if shared(d) else c for d, c in cut]
                for column, value in zip(columns, (task | row, doc, len(raw), hashlib.sha256(media).hexdigest(), inline.count(None), [d for d, _ in cut], inline)):
                    column.append(value)
                held += len(media)
                if held > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)
                    columns, held = [[] for _ in names], 0
            if columns[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    def several(batches):
        shared, seen = apart(), set()
        for batch in batches:
            found = []
            for _, _, cut in _cut(batch.column(1)):
                for d, c in cut:
                    if shared(d) and d not in seen:
                        if len(seen) < REMEMBERED:
                            seen.add(d)
                        found.append((d, c))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*found)], names=["digest", "bytes"])

    directory = source.mapInArrow(lean(several), "digest binary, bytes binary").dropDuplicates(["digest"]).join(repeated, "digest", "left")
    documents = source.mapInArrow(lean(rows), ", ".join(parts[: len(kinds)]))
    both = documents.unionByName(directory.withColumn("uses", F.coalesce("uses", F.lit(1))), allowMissingColumns=True)
    out = written(both, "media")
    removed(spark, path)
    sent.destroy()
    return out


def _reader(derive: Callable[[int, bytes], tuple], names: list[str], fetched: bool):
    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                parts = r["inline"]
                if fetched:
                    for f in r["fetched"]:
                        parts[f["pos"]] = f["bytes"]
                media = None if None in parts else b"".join(parts)
                if media is None or hashlib.sha256(media).hexdigest() != r["media_sha256"]:
                    raise ValueError(f"the media of {r['doc_id']} were not rebuilt")
                rows.append((r["doc_id"], *derive(r["n_bytes"], media)))
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *map(pa.array, columns[1:])], names=["doc_id", *names])

    return run


def read(stored: DataFrame, derive: Callable[[int, bytes], tuple] | None = None, derived: str = "") -> DataFrame:
    """Rebuild the media of a store: doc_id, n_bytes, media; with `derive` what it makes of (n_bytes, media), as columns `derived`."""
    derive, derived = derive or (lambda n, media: (n, media)), derived or "n_bytes long, media binary"
    names = [c.split()[0] for c in derived.split(",")]
    schema = "doc_id long, " + derived
    whole = stored.where("missing = 0").select("doc_id", "n_bytes", "media_sha256", "inline").mapInArrow(lean(_reader(derive, names, False)), schema)

    naming = stored.where("missing > 0")
    directory = stored.where("digest is not null").select("digest", "bytes", "uses")
    wanted = naming.select("row", F.posexplode(F.arrays_zip("digests", F.transform("inline", lambda x: x.isNull()).alias("gone"))).alias("pos", "c")).where("c.gone").select("row", "pos", F.col("c.digests").alias("digest"))
    total = stored.agg(F.sum("missing")).first()[0] or 0
    fetched = spread_join(wanted, directory, ["digest"], "uses", total).groupBy("row").agg(F.collect_list(F.struct("pos", "bytes")).alias("fetched"))
    rebuilt = naming.select("row", "doc_id", "n_bytes", "media_sha256", "inline").join(fetched, "row").select("doc_id", "n_bytes", "media_sha256", "inline", "fetched").mapInArrow(lean(_reader(derive, names, True)), schema)
    return whole.unionByName(rebuilt)
