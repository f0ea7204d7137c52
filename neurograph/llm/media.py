"""Operator 3, media columns: ISO base media containers.

``wrap`` puts a payload into a file of one track (``ftyp``, ``moov`` with its sample tables, ``mdat``); ``probe`` walks the nested boxes
of any such file, decodes the sample tables and gives codec, duration, sample byte ranges and key frames' byte ranges. Payloads are
never decoded; ``samples`` reads them back by the tables alone.

Defined results: a null text is an empty payload, padded to one unit of zeros; a file that isn't a container, is cut short, lacks a
table, or whose tables contradict one another or the file's size raises ``ValueError`` in ``probe`` and gives nulls in ``probe_column``. Equal payloads give equal files.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from neurograph.llm.common import map_batches, raw_bytes

UNIT, UNITS_A_CHUNK, KEY_EVERY, TIMESCALE = 64, 32, 64, 8000
#: Deepest nesting of boxes that is read; sample tables lie five deep.
MOST_NESTED = 32
#: Boxes that hold boxes.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf"}


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", flags), *parts)


def wrap(payload: bytes) -> bytes:
    """A container whose track holds ``payload`` as units of 64 bytes; its length must be a multiple of that."""
    n = len(payload) // UNIT
    if n * UNIT != len(payload) or not n:
        raise ValueError("the payload must be a positive multiple of 64 bytes")
    chunks = -(-n // UNITS_A_CHUNK)
    last = n - (chunks - 1) * UNITS_A_CHUNK
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    keys = np.arange(1, n + 1, KEY_EVERY, dtype=">u4")
    runs = [(1, UNITS_A_CHUNK, 1)] if last == UNITS_A_CHUNK else [*[(1, UNITS_A_CHUNK, 1)] * (chunks > 1), (chunks, last, 1)]
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, TIMESCALE << 16))

    def moov(base: int) -> bytes:
        offsets = base + np.arange(chunks, dtype=np.int64) * (UNITS_A_CHUNK * UNIT)
        table = full(b"co64", struct.pack(">I", chunks), offsets.astype(">u8").tobytes()) if base + len(payload) > 0xFFFFFFFF else full(b"stco", struct.pack(">I", chunks), offsets.astype(">u4").tobytes())
        stbl = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, n, UNIT)),
            full(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
            full(b"stsc", struct.pack(">I", len(runs)), *[struct.pack(">III", *r) for r in runs]),
            full(b"stsz", struct.pack(">II", UNIT, n)),
            table,
        )
        minf = box(b"minf", full(b"smhd", bytes(4)), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), stbl)
        mdia = box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, TIMESCALE, n * UNIT, 0x55C4, 0)), full(b"hdlr", bytes(4), b"soun", bytes(13)), minf)
        trak = box(b"trak", full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, n * UNIT), bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), matrix, bytes(8), flags=7), mdia)
        return box(b"moov", full(b"mvhd", struct.pack(">IIIIIH", 0, 0, TIMESCALE, n * UNIT, 0x10000, 0x100), bytes(10), matrix, bytes(24), struct.pack(">I", 2)), trak)

    head = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")
    base = len(head) + len(moov(0)) + 8
    if base + len(payload) > 0xFFFFFFFF:
        base = len(head) + len(moov(1 << 33)) + 16
        return head + moov(base) + struct.pack(">I4sQ", 1, b"mdat", 16 + len(payload)) + payload
    return head + moov(base) + box(b"mdat", payload)


def boxes(data: bytes) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path, first byte of the body, end) of each box, outer ones first. Bodies of ``mdat`` aren't looked into; boxes nested over MOST_NESTED deep are an error."""
    open_boxes: list[tuple[tuple[bytes, ...], int, int]] = [((), 0, len(data))]
    while open_boxes:
        above, start, end = open_boxes.pop()
        if start == end:
            continue
        if start + 8 > end:
            raise ValueError("cut short within a box's head")
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if start + 16 > end:
                raise ValueError("cut short within a box's head")
            size, body = struct.unpack_from(">Q", data, body)[0], start + 16
        stop = end if size == 0 else start + size
        if stop > end or stop < body:
            raise ValueError(f"box {kind!r} reaches beyond its parent")
        yield (*above, kind), body, stop
        open_boxes.append((above, stop, end))
        if kind in CONTAINERS:
            if len(above) >= MOST_NESTED:
                raise ValueError("boxes are nested too deeply")
            open_boxes.append(((*above, kind), body, stop))


@dataclass
class Track:
    codec: str
    handler: str
    timescale: int
    duration: int
    offsets: np.ndarray
    sizes: np.ndarray
    keys: np.ndarray

    def key_ranges(self) -> list[tuple[int, int]]:
        return [(int(self.offsets[k]), int(self.sizes[k])) for k in self.keys]


def _table(data: bytes, at: int, end: int, kind: str, columns: int, skip: int = 4) -> np.ndarray:
    (count,) = struct.unpack_from(">I", data, at + skip)
    if at + skip + 4 + count * columns * np.dtype(kind).itemsize > end:
        raise ValueError("a table is longer than its box")
    return np.frombuffer(data, kind, count * columns, at + skip + 4).reshape(count, columns).astype(np.int64)


def _track(data: bytes, own: dict[bytes, tuple[int, int]]) -> Track:
    missing = {b"mdhd", b"stsd", b"stts", b"stsc", b"stsz"} - own.keys()
    if missing or not {b"stco", b"co64"} & own.keys():
        raise ValueError(f"a track lacks {sorted(missing) or 'chunk offsets'}")
    at, _ = own[b"mdhd"]
    timescale, duration = struct.unpack_from(">IQ", data, at + 20) if data[at] == 1 else struct.unpack_from(">II", data, at + 12)
    codec = data[own[b"stsd"][0] + 12 : own[b"stsd"][0] + 16].decode("latin-1")
    handler = data[own[b"hdlr"][0] + 8 : own[b"hdlr"][0] + 12].decode("latin-1") if b"hdlr" in own else ""
    at, end = own[b"stsz"]
    fixed, count = struct.unpack_from(">II", data, at + 4)
    if count * fixed > len(data):
        raise ValueError("the samples are larger than the file")
    sizes = np.full(count, fixed, np.int64) if fixed else _table(data, at, end, ">u4", 1, 8)[:, 0]
    chunk = _table(data, *own[b"co64"], ">u8", 1)[:, 0] if b"co64" in own else _table(data, *own[b"stco"], ">u4", 1)[:, 0]
    runs = _table(data, *own[b"stsc"], ">u4", 3)
    per = np.repeat(runs[:, 1], np.diff(np.append(runs[:, 0], len(chunk) + 1))) if len(runs) else np.zeros(0, np.int64)
    if len(per) != len(chunk) or per.sum() != count or len(runs) and runs[0, 0] != 1:
        raise ValueError("the chunk table doesn't hold as many samples as the size table")
    if len(chunk) and not 0 <= int(chunk.min()) <= int(chunk.max()) <= len(data):
        raise ValueError("a chunk lies beyond the file")
    before = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if count else np.zeros(0, np.int64)
    first = np.concatenate([[0], np.cumsum(per)[:-1]]) if len(per) else np.zeros(0, np.int64)
    offsets = before + np.repeat(chunk - (before[np.minimum(first, max(count - 1, 0))] if count else 0), per)
    if count and int((offsets + sizes).max()) > len(data):
        raise ValueError("a sample lies beyond the file")
    keys = _table(data, *own[b"stss"], ">u4", 1)[:, 0] - 1 if b"stss" in own else np.arange(count)
    if len(keys) and not 0 <= int(keys.min()) <= int(keys.max()) < count:
        raise ValueError("a key frame lies beyond the size table")
    timed = _table(data, *own[b"stts"], ">u4", 2)
    if int(timed[:, 0].sum()) != count:
        raise ValueError("the time table doesn't hold as many samples as the size table")
    return Track(codec, handler, timescale, duration, offsets, sizes, keys)


def probe(data: bytes) -> list[Track]:
    """The tracks of a container, by its boxes and sample tables."""
    found, tracks = False, []
    for where, start, end in boxes(data):
        found |= where == (b"ftyp",) or where == (b"moov",)
        if where == (b"moov", b"trak"):
            tracks.append({})
        elif len(where) > 2 and where[:2] == (b"moov", b"trak"):
            tracks[-1].setdefault(where[-1], (start, end))
    if not found:
        raise ValueError("not an ISO media file")
    try:
        return [_track(data, t) for t in tracks]
    except (struct.error, IndexError) as e:
        raise ValueError(f"a box is cut short: {e}") from e


def samples(data: bytes, track: Track) -> bytes:
    """A track's stored bytes; neighbouring samples are read at once."""
    ends = track.offsets + track.sizes
    cut = np.flatnonzero(track.offsets[1:] != ends[:-1]) + 1
    starts, stops = np.concatenate([[0], cut]).astype(int), np.concatenate([cut, [len(ends)]]).astype(int)
    return b"".join(data[track.offsets[a] : ends[b - 1]] for a, b in zip(starts, stops, strict=True) if b > a)


def store(payload: bytes) -> bytes:
    """``payload`` with zeros up to a positive multiple of 64 bytes, as a file."""
    return wrap(payload + bytes(-len(payload) % UNIT or UNIT * (not payload)))


def digest(raw: bytes) -> tuple:
    """Stores one text, reads it back by the tables, and gives the columns of ``media_digest``."""
    file = store(raw)
    (track,) = probe(file)
    back = samples(file, track)
    ranges = ",".join(f"{a}+{b}" for a, b in track.key_ranges())
    feature = f"codec={track.codec.strip()};handler={track.handler};ms={track.duration * 1000 // track.timescale};samples={len(track.sizes)};keys={ranges}"
    return len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(file), hashlib.sha256(file).hexdigest(), feature


def _map(df: DataFrame, column: str, fn, names: list[str], kinds: list[pa.DataType], sql: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [fn(x) for x in raw_bytes(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]], [b.schema.names[0], *names])

    return map_batches(df, run, f"`{df.columns[0]}` {df.schema[0].dataType.simpleString()}, {sql}", 256)


def media_digest(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    sql = "n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    return _map(df.select(key, text), text, lambda x: digest(x or b""), names, kinds, sql)


def store_column(df: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, media binary): each payload stored as a file."""
    return _map(df.select(key, payload), payload, lambda x: (store(x or b""),), ["media"], [pa.binary()], "media binary")


def probe_column(df: DataFrame, key: str, media: str) -> DataFrame:
    """(key, codec, duration_s, n_samples, keyframes array<struct<offset,size>>) of the first track; nulls where there is none."""

    def one(x: bytes | None) -> tuple:
        try:
            tracks = probe(x or b"")
        except ValueError:
            tracks = []
        if not tracks:
            return None, None, None, None
        t = tracks[0]
        return t.codec, t.duration / max(t.timescale, 1), len(t.sizes), [{"offset": a, "size": b} for a, b in t.key_ranges()]

    key_type = pa.list_(pa.struct([("offset", pa.int64()), ("size", pa.int64())]))
    return _map(df.select(key, media), media, one, ["codec", "duration_s", "n_samples", "keyframes"], [pa.string(), pa.float64(), pa.int64(), key_type], "codec string, duration_s double, n_samples bigint, keyframes array<struct<offset:bigint,size:bigint>>")
