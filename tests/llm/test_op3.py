import hashlib
import zlib

import numpy as np
import pytest

from neurograph.llm import media, queries

SF = "/root/testdata/sf0.01"


def padded(text):
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % 64 or (0 if raw else 64))


def test_query_round_trip(spark, documents):
    rows = {r.doc_id: r for r in queries.op3_media_columns(spark, SF).collect()}
    assert len(rows) == len(documents)
    for d, text in documents:
        r, p = rows[d], padded(text)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((text or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))


@pytest.mark.parametrize("units", [1, 2, 31, 32, 33, 64, 65, 1000])
def test_tables(units):
    payload = np.random.default_rng(units).bytes(units * 64)
    file = media.wrap(payload)
    (t,) = media.probe(file)
    assert (t.codec, t.handler, len(t.sizes), t.duration) == ("raw ", "soun", units, units * 64)
    assert media.samples(file, t) == payload
    assert t.key_ranges() == [(file.index(b"mdat") + 4 + 64 * k, 64) for k in range(0, units, 64)]


def test_foreign_layout():
    """Samples of several sizes, chunks out of order, a 64-bit time table and no sync table."""
    import struct

    stbl = media.box(
        b"stbl", media.full(b"stsd", struct.pack(">I", 1), media.box(b"avc1", bytes(78))), media.full(b"stts", struct.pack(">III", 1, 3, 10)), media.full(b"stsc", struct.pack(">I", 2), struct.pack(">6I", 1, 2, 1, 2, 1, 1)),
        media.full(b"stsz", struct.pack(">5I", 0, 3, 2, 3, 4)), media.full(b"co64", struct.pack(">IQQ", 2, 12, 8)),
    )
    mdhd = media.box(b"mdhd", struct.pack(">IQQIQHH", 1 << 24, 0, 0, 90, 30, 0, 0))
    moov = media.box(b"moov", media.box(b"trak", media.box(b"mdia", mdhd, media.box(b"minf", stbl))))
    file = media.box(b"mdat", b"DDDDAABBB") + moov
    (t,) = media.probe(file)
    assert (t.codec, t.timescale, t.duration) == ("avc1", 90, 30)
    assert media.samples(file, t) == b"AABBBDDDD" and t.key_ranges() == [(12, 2), (14, 3), (8, 4)]


def test_damage_never_crashes(spark):
    file = media.store(b"x" * 5000)
    for k in range(0, len(file), 37):
        with pytest.raises(ValueError):
            media.probe(file[:k])
    rng = np.random.default_rng(1)
    for _ in range(300):
        bad = bytearray(file)
        bad[int(rng.integers(700))] = int(rng.integers(256))
        try:
            media.probe(bytes(bad))
        except ValueError:
            pass
    df = spark.createDataFrame([(1, file), (2, None), (3, b"junk"), (3, b"junk")], "id bigint, media binary")
    got = sorted(media.probe_column(df, "id", "media").collect(), key=lambda r: r.id)
    assert got[0].codec == "raw " and got[0].n_samples == 79 and [r.codec for r in got[1:]] == [None] * 3


def test_edges(spark, edges, nothing):
    rows = media.media_digest(edges).collect()
    assert len(rows) == edges.count() and media.media_digest(nothing).count() == 0
    same = [r for r in rows if r.n_bytes == 0]
    assert len({tuple(r)[1:] for r in same}) == 1 and same[0].payload_bytes == 64
    stored = media.store_column(edges, "doc_id", "text").join(edges.select("doc_id", "text").distinct(), "doc_id").collect()
    assert all(media.samples(r.media, media.probe(r.media)[0]) == padded(r.text) for r in stored)


def changed(data, kind, at, new):
    """``data`` with ``new`` at ``at`` bytes into the body of its first box of that kind."""
    k = data.index(kind) + 4 + at
    return data[:k] + new + data[k + len(new) :]


def test_damaged_files_are_nulls(spark):
    """Every contradiction is a row of nulls of the column function, whatever the damage; none crashes or asks for memory beyond the file's size."""
    good = media.store(b"text " * 2000)
    huge = (2**32 - 1).to_bytes(4, "big")
    deep = b""
    for _ in range(3000):
        deep = media.box(b"moov", deep)
    bad = [
        changed(good, b"stss", 8, (10**6).to_bytes(4, "big")), changed(good, b"stss", 8, bytes(4)), changed(good, b"stsz", 8, huge), changed(good, b"stsc", 12, huge), changed(good, b"stsc", 8, huge),
        changed(good, b"stco", 8, huge), changed(good, b"stts", 8, huge), changed(good, b"mdhd", 0, b"\x01"), deep, media.box(b"ftyp") + deep, good[:60], good[:200], b"", b"\x00" * 100, media.box(b"ftyp", b"isom"), None,
    ]
    rng = np.random.default_rng(2)
    for _ in range(400):
        k = int(rng.integers(0, len(good) - len(b"text " * 2000)))
        bad.append(good[:k] + rng.bytes(int(rng.integers(1, 9))) + good[k + 4 :])
    df = spark.createDataFrame([(k, x) for k, x in enumerate([good, *bad])], "doc_id bigint, media binary")
    rows = {r.doc_id: r for r in media.probe_column(df, "doc_id", "media").collect()}
    assert len(rows) == len(bad) + 1 and rows[0].codec.strip() == "raw" and rows[0].keyframes
    assert all(rows[k + 1].codec is None and rows[k + 1].keyframes is None for k, x in enumerate(bad[:16]) if k not in (7,))
    for r in rows.values():
        assert r.keyframes is None or all(0 <= x.offset and x.offset + x.size <= 20_000 for x in r.keyframes)
