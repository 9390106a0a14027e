"""WARC archives as seekable Zstandard bundles.

A bundle is a complete .warc.zst file: records in groups, each group an independent frame, and at the end a skippable frame with the seek table
(compressed and decompressed size of each frame, number of frames, magic number).  Each record has an index entry: frame, offset in the
decompressed frame, length.  Bundles are rows of a table, as only Spark's writers reach every store; export() gives files.

Of records with equal payloads of at least REVISIT_BYTES the one with the smallest id is the response; the others are revisits that refer to
it and hold no payload.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, prepare, task_base, written

REVISIT_BYTES = 100
#: Decompressed bytes of a frame and of a bundle, about.
FRAME_BYTES, BUNDLE_BYTES = 256 << 10, 16 << 20
LEVEL = 3
#: Fixed values of the format: the skippable frame that holds a seek table, and the seek table's own magic number.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
DATE = "2000-01-01T00:00:00Z"


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; with refers_to a revisit without payload."""
    head = [
        b"WARC/1.1", b"WARC-Type: " + (b"response" if refers_to is None else b"revisit"), b"WARC-Record-ID: " + record_id(page_id).encode(), b"WARC-Date: " + DATE.encode(),
        b"WARC-Target-URI: " + " ".join((url or "").split()).encode("utf-8", "replace"), b"WARC-Payload-Digest: sha256:" + digest.encode(), b"X-Page-ID: " + (b"" if page_id is None else str(page_id).encode()),
        b"X-Payload-Length: " + str(len(payload)).encode(), b"Content-Type: text/html; charset=utf-8"]
    if refers_to is not None:
        head += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", b"WARC-Refers-To: " + record_id(refers_to).encode(), b"X-Refers-To-Page: " + str(refers_to).encode()]
        payload = b""
    head.append(b"Content-Length: " + str(len(payload)).encode())
    return b"\r\n".join(head) + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields, in lower case, and content of a record."""
    end = raw.index(b"\r\n\r\n")
    first, *lines = raw[:end].decode("utf-8").split("\r\n")
    if first != "WARC/1.1":
        raise ValueError("not a record")
    fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    n = int(fields["content-length"])
    if raw[end + 4 + n :] != b"\r\n\r\n":
        raise ValueError("the record's length is wrong")
    return fields, raw[end + 4 : end + 4 + n]


class Bundle:
    """Writes records to frames and closes with the seek table."""

    def __init__(self):
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.open: list[bytes] = []
        self.held = self.total = 0
        self.index: list[dict] = []
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)

    def add(self, page_id: int | None, raw: bytes) -> None:
        self.index.append({"record_id": record_id(page_id), "frame": len(self.frames), "offset": self.held, "length": len(raw)})
        self.open.append(raw)
        self.held += len(raw)
        self.total += len(raw)
        if self.held >= FRAME_BYTES:
            self.cut()

    def cut(self) -> None:
        if self.open:
            frame = self.compressor.compress(b"".join(self.open))
            self.frames.append(frame)
            self.sizes.append((len(frame), self.held))
            self.open, self.held = [], 0

    def closed(self) -> bytes:
        self.cut()
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        return b"".join(self.frames) + struct.pack("<II", SKIPPABLE, len(table)) + table


def seek_table(archive: bytes) -> list[tuple[int, int, int]]:
    """Offset, compressed and decompressed size of each frame, from the footer."""
    n, flags, magic = struct.unpack_from("<IBI", archive, len(archive) - 9)
    start = len(archive) - 9 - 8 * n
    if magic != SEEKABLE or flags & 0x80 or struct.unpack_from("<II", archive, start - 8) != (SKIPPABLE, 8 * n + 9):
        raise ValueError("no seek table")
    out, at = [], 0
    for k in range(n):
        packed, plain = struct.unpack_from("<II", archive, start + 8 * k)
        out.append((at, packed, plain))
        at += packed
    if at != start - 8:
        raise ValueError("the seek table doesn't match the frames")
    return out


def read_record(archive: bytes, frame: int, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """One record by its index entry: decompresses its frame alone."""
    at, packed, plain = seek_table(archive)[frame]
    return parsed(zstandard.ZstdDecompressor().decompress(archive[at : at + packed], max_output_size=plain)[offset : offset + length])


def read_records(archive: bytes, index: list[dict]) -> Iterator[tuple[dict[str, str], bytes]]:
    """All records, in index order, each frame decompressed once."""
    frames, z = seek_table(archive), zstandard.ZstdDecompressor()
    now, content = None, b""
    for entry in index:
        if entry["frame"] != now:
            now = entry["frame"]
            at, packed, plain = frames[now]
            content = z.decompress(archive[at : at + packed], max_output_size=plain)
        yield parsed(content[entry["offset"] : entry["offset"] + entry["length"]])


BUNDLES = "bundle long, records long, archive binary, index array<struct<record_id:string,frame:int,offset:long,length:long>>"


def _bundled(batches):
    names = ["bundle", "records", "archive", "index"]
    index_type = pa.list_(pa.struct([("record_id", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())]))
    base, count, bundle = task_base(), 0, Bundle()

    def row():
        archive = bundle.closed()
        return pa.RecordBatch.from_arrays([pa.array([base | count]), pa.array([len(bundle.index)]), pa.array([archive], pa.binary()), pa.array([bundle.index], index_type)], names=names)

    for batch in batches:
        for page, url, html, digest, refers in zip(*(batch.column(k).to_pylist() for k in range(5))):
            bundle.add(page, record(page, url, html or b"", digest, refers))
            if bundle.total >= BUNDLE_BYTES:
                yield row()
                count, bundle = count + 1, Bundle()
    if bundle.index:
        yield row()


def write(df: DataFrame, row_id: str = "page_id", url: str = "url", payload: str = "html") -> tuple[DataFrame, str]:
    """Write one record per row to bundles in the shared folder; returns the bundles as read back, and their path.

    A null payload is empty.  Ids may repeat: rows with the smallest id of equal payloads are all responses; a null id is never referred to
    while another has the payload.  Digests alone are grouped, so that equal payloads, however many, meet as ids.
    """
    prepare(df.sparkSession)
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    pages = df.select(F.col(row_id).cast("long").alias("page"), F.col(url).cast("string").alias("url"), body.alias("body"), F.sha2(body, 256).alias("digest"))
    long_ones = df.select(F.col(row_id).cast("long").alias("page"), F.sha2(body, 256).alias("digest")).where(F.octet_length(body) >= REVISIT_BYTES)
    # written, so that its size is known before the pages are read again: broadcast where small, else joined by a shuffle
    repeated, _ = written(long_ones.groupBy("digest").agg(F.min("page").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", "first"), "repeated", narrow=True)
    marked = pages.join(repeated, "digest", "left").select("page", "url", "body", "digest", F.when(~F.col("first").eqNullSafe(F.col("page")), F.col("first")).alias("refers"))
    return written(marked.mapInArrow(lean(_bundled), BUNDLES), "warc", "none")


def read(bundles: DataFrame) -> DataFrame:
    """Records of bundles: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (null for revisits).

    Lengths and digests of responses are computed from the content that was read and held against the header's.
    """
    prepare(bundles.sparkSession)
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]

    def run(batches):
        for batch in batches:
            for archive, index in zip(batch.column(0), batch.column(1)):
                rows, held = [], 0
                for fields, content in read_records(archive.as_buffer().to_pybytes(), index.as_py()):
                    kind, digest, length = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha256:"), int(fields["x-payload-length"])
                    if kind == "response" and (hashlib.sha256(content).hexdigest() != digest or len(content) != length):
                        raise ValueError(f"the payload of page {fields['x-page-id']} is damaged")
                    page, refers = fields["x-page-id"], fields.get("x-refers-to-page")
                    rows.append((int(page) if page else None, fields["warc-target-uri"], length, digest, kind, int(refers) if refers else None, content if kind == "response" else None))
                    held += len(content)
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return bundles.select("archive", "index").mapInArrow(lean(run), "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def index(bundles: DataFrame) -> DataFrame:
    """record_id to bundle, frame, offset, length."""
    return bundles.select("bundle", F.explode("index").alias("i")).select("i.record_id", "bundle", "i.frame", "i.offset", "i.length")


def export(bundles: DataFrame, folder: str) -> DataFrame:
    """Write each bundle as folder/<bundle>.warc.zst, a folder that all executors mount; returns path and size of each."""
    prepare(bundles.sparkSession)

    def run(batches):
        import os

        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            made = []
            for b, archive in zip(batch.column(0).to_pylist(), batch.column(1)):
                path = os.path.join(folder, f"{b}.warc.zst")
                with open(f"{path}.{os.getpid()}", "wb") as f:  # a task that runs again replaces the file as a whole
                    f.write(archive.as_buffer())
                os.replace(f.name, path)
                made.append((path, len(archive.as_buffer())))
            yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made]), pa.array([m[1] for m in made], pa.int64())], names=["path", "bytes"])

    return bundles.select("bundle", "archive").mapInArrow(lean(run), "path string, bytes long")
