"""Operator 10, media columns: ISO media containers without decoding of payloads.

`probe()` walks nested boxes of an ISO base media file, decodes its sample tables
and returns codec, duration and the byte ranges of keyframes. `mux()` stores raw
8-bit frames losslessly in such a file, so that stored columns can be made and read
back. `add_media()` does both for a binary or string column.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

#: A frame is 24 x 24 samples of 8 bits; every 8th frame is a keyframe; 16 frames make a chunk.
WIDTH = HEIGHT = 24
FRAME = WIDTH * HEIGHT
KEY_EVERY, CHUNK, RATE = 8, 16, 24
#: Boxes that hold boxes, with the bytes of fields before them.
NESTED = {b"moov": 0, b"trak": 0, b"mdia": 0, b"minf": 0, b"stbl": 0, b"dinf": 0, b"edts": 0, b"udta": 0}


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 > 0xFFFFFFFF:
        return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body
    return struct.pack(">I4s", len(body) + 8, kind) + body


def full(kind: bytes, *parts: bytes) -> bytes:
    return box(kind, b"\0\0\0\0", *parts)


def table_of(code: str, rows: list) -> bytes:
    return struct.pack(">I", len(rows)) + b"".join(struct.pack(code, *r) for r in rows)


def mux(payload: bytes) -> bytes:
    """An ISO media file whose one track has payload's frames as uncompressed samples."""
    n = len(payload) // FRAME
    assert n and len(payload) == n * FRAME
    starts = range(0, n, CHUNK)
    rest = n % CHUNK
    runs = [(1, CHUNK, 1)] if n >= CHUNK else []
    if rest:
        runs.append((len(starts), rest, 1))
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    entry = box(
        b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", WIDTH, HEIGHT, 0x480000, 0x480000, 0, 1), bytes(32), struct.pack(">Hh", 8, -1)
    )
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")
    far = len(payload) + (1 << 16) > 0xFFFFFFFF

    def moov(first: int) -> bytes:
        offsets = [(first + s * FRAME,) for s in starts]
        stbl = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", table_of(">II", [(n, 1)])),
            full(b"stss", table_of(">I", [(i,) for i in range(1, n + 1, KEY_EVERY)])),
            full(b"stsc", table_of(">III", runs)),
            full(b"stsz", struct.pack(">II", FRAME, n)),
            full(b"co64", table_of(">Q", offsets)) if far else full(b"stco", table_of(">I", offsets)),
        )
        return box(
            b"moov",
            full(b"mvhd", struct.pack(">IIIIIH", 0, 0, RATE, n, 0x10000, 0x100), bytes(10), matrix, bytes(24), struct.pack(">I", 2)),
            box(
                b"trak",
                box(b"tkhd", b"\0\0\0\7", struct.pack(">IIIII", 0, 0, 1, 0, n), bytes(16), matrix, struct.pack(">II", WIDTH << 16, HEIGHT << 16)),
                box(
                    b"mdia",
                    full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, n, 0x55C4, 0)),
                    full(b"hdlr", struct.pack(">I4s", 0, b"vide"), bytes(12), b"frames\0"),
                    box(b"minf", box(b"vmhd", b"\0\0\0\1", bytes(8)), box(b"dinf", full(b"dref", struct.pack(">I", 1), box(b"url ", b"\0\0\0\1"))), stbl),
                ),
            ),
        )

    head = 16 if len(payload) + 8 > 0xFFFFFFFF else 8
    return ftyp + (moov(len(ftyp) + len(moov(0)) + head)) + box(b"mdat", payload)


def boxes(data: memoryview, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """Kind, start and end of the body of each box between two offsets."""
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if body + 8 > end:
                raise ValueError("a box is cut off")
            size, body = struct.unpack_from(">Q", data, body)[0], body + 8
        stop = start + size if size else end
        if stop < body or stop > end:
            raise ValueError("a box is cut off")
        yield kind, body, stop
        start = stop


def rows_at(data: memoryview, body: int, stop: int, code: str) -> list[tuple]:
    count = struct.unpack_from(">I", data, body + 4)[0]
    step = struct.calcsize(code)
    if body + 8 + count * step > stop:
        raise ValueError("a sample table is cut off")
    return list(struct.iter_unpack(code, data[body + 8 : body + 8 + count * step]))


def probe(data: bytes) -> list[dict]:
    """Per track: codec, handler, timescale, duration, sizes and offsets of samples, keyframes.

    Bodies of mdat are stepped over, never read. Raises ValueError or struct.error on
    bytes that are no such file.
    """
    view, tracks = memoryview(data), []

    def walk(start: int, end: int, track: dict | None) -> None:
        for kind, body, stop in boxes(view, start, end):
            if kind == b"trak":
                track = {"samples": [], "keyframes": []}
                tracks.append(track)
            if kind in NESTED:
                walk(body + NESTED[kind], stop, track)
            elif track is None:
                continue
            elif kind == b"mdhd":
                if view[body]:
                    track["timescale"], track["duration"] = struct.unpack_from(">IQ", view, body + 20)
                else:
                    track["timescale"], track["duration"] = struct.unpack_from(">II", view, body + 12)
            elif kind == b"hdlr":
                track["handler"] = bytes(view[body + 8 : body + 12]).decode("latin-1")
            elif kind == b"stsd":
                track["codec"] = bytes(view[body + 12 : body + 16]).decode("latin-1")
            elif kind == b"stts":
                track["stts"] = rows_at(view, body, stop, ">II")
            elif kind == b"stss":
                track["stss"] = [i for (i,) in rows_at(view, body, stop, ">I")]
            elif kind == b"stsc":
                track["stsc"] = rows_at(view, body, stop, ">III")
            elif kind == b"stsz":
                size, count = struct.unpack_from(">II", view, body + 4)
                track["sizes"] = [size] * count if size else [s for (s,) in struct.iter_unpack(">I", view[body + 12 : body + 12 + 4 * count])]
            elif kind in (b"stco", b"co64"):
                track["chunks"] = [o for (o,) in rows_at(view, body, stop, ">I" if kind == b"stco" else ">Q")]

    walk(0, len(view), None)
    for track in tracks:
        sizes, chunks, runs = track.get("sizes", []), track.get("chunks", []), track.get("stsc", [])
        ends = [r[0] - 1 for r in runs[1:]] + [len(chunks)]
        at = 0
        for (first, per, _), end in zip(runs, ends):
            for offset in chunks[first - 1 : end]:
                for size in sizes[at : at + per]:
                    track["samples"].append((offset, size))
                    offset += size
                at += per
        if any(o + s > len(view) for o, s in track["samples"]):
            raise ValueError("a sample lies outside the file")
        keys = track.get("stss")
        track["keyframes"] = track["samples"] if keys is None else [track["samples"][i - 1] for i in keys if i <= len(track["samples"])]
    return tracks


def demux(data: bytes) -> bytes:
    """The stored samples of the first track, in order."""
    view, parts, run = memoryview(data), [], None
    for offset, size in probe(data)[0]["samples"]:
        if run and run[1] == offset:
            run[1] += size
        else:
            parts.append(run := [offset, offset + size])
    return b"".join(view[a:b] for a, b in parts)


def feature(data: bytes) -> str:
    """A track's codec, duration in ticks, sample count and the byte ranges of its keyframes."""
    t = probe(data)[0]
    ranges = ",".join(f"{o}-{o + s - 1}" for o, s in t["keyframes"])
    return f"codec={t['codec'].strip()};duration={t['duration']}/{t['timescale']};samples={len(t['samples'])};keyframes={len(t['keyframes'])};ranges={ranges}"


SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
)


def padded(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw.ljust(max(FRAME, -(-len(raw) // FRAME) * FRAME), b"\xff")


def _media_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
            rows = []
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                media = mux(padded(text))
                back = demux(media)
                rows.append(
                    {
                        "doc_id": doc_id, "n_bytes": len((text or "").encode("utf-8", "surrogatepass")), "payload_bytes": len(back), "payload_sha256": hashlib.sha256(back).hexdigest(),
                        "tail_crc32": zlib.crc32(back[-32:]), "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "feature": feature(media),
                    }
                )
            yield pa.RecordBatch.from_pylist(rows, SCHEMA)


def add_media(docs: DataFrame) -> DataFrame:
    """One row per document: its text stored as ISO media, read back and probed.

    Null and empty texts make one frame of 255s; equal texts give equal values;
    repeated rows stay repeated; other columns of docs are not looked at. One pass,
    no shuffle; memory is bounded by 512 texts and their files.
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return docs.select("doc_id", "text").mapInArrow(_media_rows, schema)


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return add_media(table(spark, sf_dir, "documents"))
