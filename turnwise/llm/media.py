"""Operator 4. Media columns in ISO media containers.

``write_container`` stores bytes as 8-bit samples in an ISO base media file (nested boxes with full sample tables);
``walk`` reads nested boxes, ``describe`` decodes the sample tables into codec, duration and keyframe byte ranges without
touching the payload, and ``read_payload`` fetches the stored bytes by those ranges. Everything is one pass per row: no
shuffle, and memory is that of one text and its container.

Defined results: a null text counts as empty; the payload is padded by zero bytes to a positive multiple of 64; repeated
rows give repeated results; equal texts give equal values; columns other than the id and the text are not read. Of media
that others wrote, each track is decoded by its own tables and the first whole one counts; null media give nulls; empty or
malformed ones (no box, a cut or missing table, ranges outside the file) have no track: codec none, no samples, an empty payload.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.llm.common import columns, short_batches

FRAME = 64  # 8-bit samples of a frame
KEY_EVERY = 16  # frames from one sync frame to the next
CHUNK_FRAMES = 256
RATE = 8000
_NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl"}


def _box(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I4s", 8 + len(body), kind) + body


def _full(kind: bytes, body: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", flags) + body)


def write_container(payload: bytes) -> bytes:
    """An ISO media file whose one track holds the payload, a positive multiple of 64 bytes, as 8-bit samples."""
    frames = len(payload) // FRAME
    chunks = -(-frames // CHUNK_FRAMES)
    runs = [(1, CHUNK_FRAMES)] if frames % CHUNK_FRAMES == 0 else [(1, CHUNK_FRAMES), (chunks, frames % CHUNK_FRAMES)][chunks == 1 :]
    keys = np.arange(1, frames + 1, KEY_EVERY, dtype=">u4")
    ticks = frames * FRAME
    matrix = struct.pack(">9i", 1 << 16, 0, 0, 0, 1 << 16, 0, 0, 0, 1 << 30)
    large = len(payload) + 8 >= 1 << 32
    head = _box(b"ftyp", b"isom" + struct.pack(">I", 512) + b"isomiso2mp41")

    def moov(offsets: np.ndarray) -> bytes:
        entry = _box(b"raw ", bytes(6) + struct.pack(">HIIHHHHI", 1, 0, 0, 1, 8, 0, 0, RATE << 16))
        stbl = _full(b"stsd", struct.pack(">I", 1) + entry)
        stbl += _full(b"stts", struct.pack(">III", 1, frames, FRAME))
        stbl += _full(b"stss", struct.pack(">I", len(keys)) + keys.tobytes())
        stbl += _full(b"stsc", struct.pack(">I", len(runs)) + b"".join(struct.pack(">III", f, n, 1) for f, n in runs))
        stbl += _full(b"stsz", struct.pack(">II", FRAME, frames))
        stbl += _full(b"co64" if large else b"stco", struct.pack(">I", chunks) + offsets.astype(">u8" if large else ">u4").tobytes())
        reference = _box(b"dinf", _full(b"dref", struct.pack(">I", 1) + _full(b"url ", b"", 1)))
        minf = _box(b"minf", _full(b"smhd", bytes(4)) + reference + _box(b"stbl", stbl))
        mdia = _box(b"mdia", _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, ticks & 0xFFFFFFFF, 0x55C4, 0)) + _full(b"hdlr", bytes(4) + b"soun" + bytes(12) + b"samples\0") + minf)
        tkhd = _full(b"tkhd", struct.pack(">IIIII8xHHHH", 0, 0, 1, 0, ticks & 0xFFFFFFFF, 0, 0, 0x100, 0) + matrix + bytes(8), 7)
        mvhd = _full(b"mvhd", struct.pack(">IIIIIH10x", 0, 0, RATE, ticks & 0xFFFFFFFF, 1 << 16, 0x100) + matrix + bytes(24) + struct.pack(">I", 2))
        return _box(b"moov", mvhd + _box(b"trak", tkhd + mdia))

    relative = np.arange(chunks, dtype=np.int64) * CHUNK_FRAMES * FRAME
    at = len(head) + len(moov(relative)) + (16 if large else 8)
    mdat = struct.pack(">I4sQ", 1, b"mdat", len(payload) + 16) if large else struct.pack(">I4s", 8 + len(payload), b"mdat")
    return head + moov(relative + at) + mdat + payload


def walk(data: memoryview) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path, start, end of the body) of every box, containers entered; bodies are not read. A broken size ends its container."""
    open_: list[tuple[tuple[bytes, ...], int, int]] = [((), 0, len(data))]
    while open_:
        path, start, end = open_.pop()
        if start + 8 > end:
            continue
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1 and start + 16 <= end:
            size, body = struct.unpack_from(">Q", data, body)[0], body + 8
        stop = end if size == 0 else start + size
        if stop < body or stop > end:
            continue
        yield (*path, kind), body, stop
        open_.append((path, stop, end))
        if kind in _NESTED and len(path) < len(_NESTED):
            open_.append(((*path, kind), body, stop))


#: What is known of bytes without a sample table that can be decoded.
NO_TRACK = {"codec": "none", "timescale": 0, "duration": 0, "samples": 0, "key_ranges": np.zeros((0, 2), np.int64), "chunk_ranges": np.zeros((0, 2), np.int64)}


def _decode(data: memoryview, boxes: dict[bytes, tuple[int, int]]) -> dict:
    """The tables of one track; a ValueError if one is missing, cut, or points outside the file."""

    def field(kind: bytes, form: str, skip: int) -> tuple:
        if kind not in boxes or boxes[kind][0] + skip + struct.calcsize(form) > boxes[kind][1]:
            raise ValueError(f"no field of {kind!r}")
        return struct.unpack_from(form, data, boxes[kind][0] + skip)

    def table(kind: bytes, dtype: str, width: int, skip: int = 8) -> np.ndarray:
        n = field(kind, ">I", skip - 4)[0]
        if n * width * np.dtype(dtype).itemsize > boxes[kind][1] - boxes[kind][0] - skip:
            raise ValueError(f"a cut table {kind!r}")
        return np.frombuffer(data, dtype, n * width, boxes[kind][0] + skip).reshape(n, width).astype(np.int64)

    codec = bytes(field(b"stsd", ">4s", 12)[0]).decode("latin-1")
    scale = field(b"mdhd", ">I", 20 if field(b"mdhd", ">B", 0)[0] == 1 else 12)[0]  # version 1 has wider times
    times = table(b"stts", ">u4", 2)
    each, count = field(b"stsz", ">II", 4)
    if each * count > len(data):
        raise ValueError("more samples than bytes")
    sizes = np.full(count, each, np.int64) if each else table(b"stsz", ">u4", 1, 12)[:, 0]
    offsets = table(b"co64", ">u8", 1)[:, 0] if b"co64" in boxes else table(b"stco", ">u4", 1)[:, 0]
    runs = table(b"stsc", ">u4", 3)
    per = np.zeros(len(offsets), np.int64)
    for first, n, _ in runs.tolist():
        if not first:
            raise ValueError("chunks count from one")
        per[first - 1 :] = min(n, count)
    if per.sum() < count:
        raise ValueError("samples without a chunk")
    chunk = np.repeat(np.arange(len(offsets)), per)[:count]
    before = np.concatenate([[0], np.cumsum(sizes)])
    first = np.minimum(np.concatenate([[0], np.cumsum(per)])[:-1], count)
    starts = offsets[chunk] + before[:count] - before[first][chunk]
    sync = table(b"stss", ">u4", 1)[:, 0] - 1 if b"stss" in boxes else np.arange(count)
    stop = np.minimum(first + per, count)
    chunks = np.stack([offsets, offsets + before[stop] - before[first]], 1)
    if len(sync) and (sync.min() < 0 or sync.max() >= count) or len(chunks) and (chunks.min() < 0 or chunks.max() > len(data)):
        raise ValueError("a table points outside the file")
    return {"codec": codec, "timescale": scale, "duration": int((times[:, 0] * times[:, 1]).sum()), "samples": int(count), "key_ranges": np.stack([starts[sync], starts[sync] + sizes[sync]], 1), "chunk_ranges": chunks}


def tracks(media: bytes | None) -> list[dict]:
    """Codec, time scale, duration, samples and byte ranges of keyframes and chunks of each track that can be decoded."""
    data, found = memoryview(media or b""), []
    for path, start, stop in walk(data):
        if path[-1] == b"trak":
            found.append({})
        elif found and b"trak" in path:
            found[-1].setdefault(path[-1], (start, stop))
    out = []
    for boxes in found:
        try:
            out.append(_decode(data, boxes))
        except ValueError:  # a track without whole tables is none
            continue
    return out


def describe(media: bytes | None) -> dict:
    """The first track that can be decoded, or ``NO_TRACK``; the payload is not read."""
    return next(iter(tracks(media)), NO_TRACK)


def read_payload(media: bytes, ranges: np.ndarray) -> bytes:
    """The stored bytes, by range reads."""
    return b"".join(media[a:b] for a, b in ranges.tolist())


def feature(info: dict, payload: bytes) -> str:
    """Container facts and simple features of the samples, from the read-back bytes."""
    x = np.frombuffer(payload, np.uint8)
    d = x.astype(np.int64)
    crossing = int(np.count_nonzero((x[1:] >= 128) != (x[:-1] >= 128)))
    first = info["key_ranges"][0].tolist() if len(info["key_ranges"]) else [0, 0]
    ms = 1000 * info["duration"] // max(info["timescale"], 1)
    return f"codec={info['codec'].strip()};ms={ms};frames={info['samples']};keys={len(info['key_ranges'])};key0={first[0]}-{first[1]};sum={int(d.sum())};square={int((d * d).sum())};crossings={crossing}"


def padded(text: bytes) -> bytes:
    return text + bytes(-len(text) % FRAME or (0 if text else FRAME))


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each text in a container of its own, in a binary column."""
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()]
            for i in range(0, len(texts), 128):
                part = texts[i : i + 128]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 128), pa.array(map(len, part), pa.int64()), pa.array([write_container(padded(t)) for t in part], pa.binary())], names=[id_col, "n_bytes", "media"])

    return columns(docs, id_col, text_col).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, n_bytes bigint, media binary")


def read_media(table: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per row of ``to_media``: container facts, digests of the payload read back and of the stored form, features."""
    short_batches(table.sparkSession)
    names = [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "codec", "duration_ms", "key_starts", "key_ends"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for media in b.column(2).to_pylist():
                if media is None:
                    rows.append((None,) * len(kinds))
                    continue
                info = describe(media)
                payload = read_payload(media, info["chunk_ranges"])
                keys = info["key_ranges"]
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(info, payload), info["codec"], 1000 * info["duration"] // max(1, info["timescale"]), keys[:, 0], keys[:, 1]))
            made = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *made], names=names)

    schema = f"`{id_col}` {dict(table.dtypes)[id_col]}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, codec string, duration_ms bigint, key_starts array<bigint>, key_ends array<bigint>"
    return columns(table, id_col, "n_bytes", "media").mapInArrow(run, schema)


def digest(read: DataFrame) -> DataFrame:
    return read.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", F.size("key_starts").cast("bigint").alias("n_keyframes"))
