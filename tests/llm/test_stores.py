import hashlib
import random
import subprocess

import pytest
import zstandard

from glyphlake.llm import media, warc

from . import edge

PAGES = "page_id long, url string, html string"


def page_rows():
    same, big = "<p>" + "same " * 40, "x" * 700_000
    return [(5, "http://a/1", same), (3, "http://a/2", same), (9, None, same), (1, "u", "short"), (2, "u", "short"), (4, "u", None), (6, "u", ""), (7, "u\r\nWARC-Type: x", big), (8, "ü", big), (None, "n", same), (11, "u", "é" * 50), (10, "u", "é" * 50)]


def brute(rows):
    out = []
    for page, _, html in rows:
        raw = (html or "").encode()
        first = min((p for p, _, h in rows if h == html and p is not None), default=None)
        refers = first if len(raw) >= 100 and first != page else None
        out.append((page, len(raw), hashlib.sha256(raw).hexdigest(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


def test_warc_round_trip(spark):
    rows = page_rows()
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], PAGES + ", digest string, refers string")
    bundles, _ = warc.write(df)
    got = warc.read(bundles).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == brute(rows)
    texts = {r[0]: (r[2] or "").encode() for r in rows}
    assert all(bytes(r.payload) == texts[r.page_id] for r in got if r.record_type == "response") and all(r.payload is None for r in got if r.record_type == "revisit")


def test_seek_table_and_index(spark):
    rows = [(i, "u", f"<p>{i} " + "text " * 9000) for i in range(60)]
    bundles, _ = warc.write(spark.createDataFrame(rows, PAGES).coalesce(1))
    b = bundles.collect()
    assert len(b) == 1 and len(warc.seek_table(bytes(b[0].archive))) > 5
    archive = bytes(b[0].archive)
    places = {r.record_id: r for r in warc.index(bundles).collect()}
    for i in (0, 7, 59):
        p = places[warc.record_id(i)]
        fields, content = warc.read_record(archive, p.frame, p.offset, p.length)
        assert content.decode() == rows[i][2] and fields["x-page-id"] == str(i)
    # any reader of the format gets all records in order, the seek table is skipped
    whole = zstandard.ZstdDecompressor().stream_reader(archive, read_across_frames=True).read()
    assert whole.count(b"WARC/1.1\r\n") == 60
    with pytest.raises(ValueError):
        warc.seek_table(archive[:-1])


def test_export(spark, tmp_path):
    bundles, _ = warc.write(spark.createDataFrame(page_rows(), PAGES))
    files = warc.export(bundles, str(tmp_path / "w")).collect()
    assert files and all((tmp_path / "w").joinpath(r.path.rsplit("/", 1)[1]).stat().st_size == r.bytes for r in files)


def test_warc_empty(spark):
    bundles, _ = warc.write(spark.createDataFrame([], PAGES))
    assert warc.read(bundles).collect() == []


def plain_gear(data):
    h, out = 0, []
    for i, b in enumerate(data):
        h = ((h << 1) + int(media.GEAR[b])) & 0xFFFFFFFF
        if h >> (32 - media.BITS) == 0:
            out.append(i + 1)
    return out


def test_gear_is_the_rolling_hash():
    import numpy as np

    for n in (0, 1, 2, 31, 33, 50_000):
        data = random.Random(n).randbytes(n)
        assert list(media.gear_cuts(np.frombuffer(data, np.uint8))) == plain_gear(data)


def test_chunks():
    data = random.Random(1).randbytes(300_000)
    parts = media.chunks(data)
    assert b"".join(parts) == data and all(media.LEAST <= len(p) <= media.MOST for p in parts[:-1]) and 80 < len(parts) < 300
    moved = media.chunks(data[:1000] + b"inserted" + data[1000:])
    assert len(set(parts) & set(moved)) > 0.9 * len(parts)
    assert media.chunks(b"") == [] and media.chunks(b"abc") == [b"abc"]


@pytest.mark.parametrize("extra", [False, True])
def test_media_round_trip(spark, extra):
    shared = random.Random(3).randbytes(40_000).hex()
    rows = [*edge.ROWS, *[(100 + i, shared[: 30_000 + 7000 * (i % 3)] + "x" * i, "en", "s", 1) for i in range(12)], *[(200 + i, shared, "en", "s", 1) for i in range(6)]]
    stored, _ = media.store(edge.docs(spark, rows, extra).repartition(3))
    assert stored.where("missing > 0").count() > 0
    got = media.read(stored).collect()
    want = sorted(((r[0], len((r[1] or "").encode()), media.to_media(media.padded((r[1] or "").encode()))) for r in rows), key=str)
    assert sorted(((r.doc_id, r.n_bytes, bytes(r.media)) for r in got), key=str) == want
    assert all(media.from_media(m)[:n] == (next(r[1] for r in rows if r[0] == d) or "").encode() for d, n, m in want)


def test_media_edge(spark):
    stored, _ = media.store(edge.empty(spark))
    assert media.read(stored).collect() == []
    assert media.padded(b"") == b" " * 192 and len(media.padded(b"a" * 192)) == 192 and len(media.padded(b"a" * 193)) == 384
    with pytest.raises(ValueError):
        media.from_media(b"RIFFxxxx")


def test_damage_is_noticed(spark):
    from pyspark.sql import functions as F

    stored, _ = media.store(edge.docs(spark))
    with pytest.raises(Exception, match="not rebuilt"):
        media.read(stored.withColumn("media_sha256", F.lit("0"))).collect()


def test_media_chunks_are_stored_once(spark, monkeypatch):
    """Over all tasks, whatever these remember; a filter that is full, and one with a hot digest, lose nothing."""
    from pyspark.sql import functions as F

    shared = random.Random(5).randbytes(20_000).hex()
    rows = [(i, (shared if i % 3 else f"{random.Random(i).randbytes(3000).hex()}{shared[:9000]}") + "y" * (i % 5), "en", "s", 1) for i in range(40)]
    every = [media.digest(c) for r in rows for c in media.chunks(media.to_media(media.padded(r[1].encode())))]
    for remembered, widest in ((media.REMEMBERED, media.WIDEST), (2, 6)):
        monkeypatch.setattr(media, "REMEMBERED", remembered)
        monkeypatch.setattr(media, "WIDEST", widest)
        stored, _ = media.store(edge.docs(spark, rows).repartition(8))
        inline = [bytes(c) for r in stored.where("row is not null").collect() for c in r.inline if c is not None]
        directory = {bytes(r.digest): bytes(r.bytes) for r in stored.where("digest is not null").collect()}
        assert stored.where("digest is not null").count() == len(directory) and all(media.digest(b) == d for d, b in directory.items())
        kept = [*directory, *map(media.digest, inline)]
        assert len(kept) == len(set(kept)) and set(kept) == set(every)
        assert sorted((r.doc_id, bytes(r.media)) for r in media.read(stored).collect()) == [(r[0], media.to_media(media.padded(r[1].encode()))) for r in rows]
    with pytest.raises(Exception, match="not rebuilt"):  # a chunk that the directory lacks
        media.read(stored.where(F.col("digest").isNull())).collect()


def test_file_is_audio(tmp_path):
    import wave

    (tmp_path / "a.wav").write_bytes(media.to_media(media.padded(b"hello")))
    with wave.open(str(tmp_path / "a.wav")) as w:
        assert w.getsampwidth() == 1 and w.readframes(w.getnframes())[:5] == b"hello"
    assert subprocess is not None
