"""Media columns: payloads as AVI motion-JPEG files, read back through their RIFF index, and timed clips.

A payload byte is one 8x8 block of constant grey, which baseline JPEG stores without loss as a DC coefficient with
quantiser 8. The DC Huffman table gives category c a code of 9 - c bits (the Kraft sum is 511/512), so a difference
with its amplitude always takes 9 bits and a block 10 with the one-bit end of block; frames are coded and decoded as
arrays. A frame is 64 blocks wide and at most 64 high; the last frame of a long payload is filled with zeros, and the
chunk "pbyt" keeps the payload's length. Every frame is intra coded and stands in "idx1".

Shots end where the histogram difference of neighbouring frames exceeds the mean of the recent differences by three
standard deviations, and a floor. Null and empty texts have a payload of 64 zero bytes.
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

from docloom.llm.common import column, prepare, rows, utf8

UNIT = 64
FRAME = 4096
FRAME_MS = 40
HISTORY = 8
FLOOR = 0.1


def padded(data: bytes | None) -> bytes:
    data = data or b""
    return data + bytes(max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def _block_codes() -> np.ndarray:
    """The 10 bits of each difference -255..255: Huffman code, amplitude, end of block."""
    out = np.zeros(511, dtype=np.uint64)
    for diff in range(-255, 256):
        category = abs(diff).bit_length()
        code = (1 << (9 - category)) - 2  # lengths 1..9 for categories 8..0: 0, 10, 110, ...
        amplitude = diff if diff >= 0 else diff + (1 << category) - 1
        out[diff + 255] = ((code << category) | amplitude) << 1
    return out


_CODES = _block_codes()
_DIFFS = np.full(1024, -999, dtype=np.int16)
_DIFFS[_CODES.astype(np.int64)] = np.arange(-255, 256)
_LENGTHS, _CATEGORIES = bytes([1] * 9 + [0] * 7), bytes(range(8, -1, -1))


def _segment(mark: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, mark, len(body) + 2) + body


def jpeg_head(width: int, height: int) -> bytes:
    """Everything before a frame's entropy-coded bytes (DQT, SOF0, DHT for DC and AC, SOS)."""
    return b"".join(
        [
            b"\xff\xd8",
            _segment(0xDB, b"\x00" + b"\x08" + b"\x01" * 63),
            _segment(0xC0, struct.pack(">BHHB", 8, height, width, 1) + b"\x01\x11\x00"),
            _segment(0xC4, b"\x00" + _LENGTHS + _CATEGORIES + b"\x10" + bytes([1] + [0] * 15) + b"\x00"),
            _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00"),
        ]
    )


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """One JPEG for each row of samples (n, k * 64)."""
    head = jpeg_head(8 * UNIT, 8 * (samples.shape[1] // UNIT))
    grey = samples.astype(np.int16) - 128
    diffs = np.diff(grey, axis=1, prepend=np.int16(0))
    codes = _CODES[diffs + 255].reshape(len(samples), -1, 4)
    packed = (codes[..., 0] << np.uint64(30)) | (codes[..., 1] << np.uint64(20)) | (codes[..., 2] << np.uint64(10)) | codes[..., 3]
    raw = np.ascontiguousarray(packed.astype(">u8").view(np.uint8).reshape(len(samples), -1, 8)[..., 3:])
    return [head + row.tobytes().replace(b"\xff", b"\xff\x00") + b"\xff\xd9" for row in raw]


def decode_frame(frame: bytes) -> np.ndarray:
    """The grey value of each block of a frame written as above; other codings are refused."""
    at, width, height, tables = 2, 0, 0, []
    while True:
        mark, size = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
        body = frame[at + 4 : at + 2 + size]
        at += 2 + size
        if mark == 0xC0:
            _, height, width, parts = struct.unpack_from(">BHHB", body)
            if parts != 1:
                raise ValueError("not a grey frame")
        elif mark == 0xDB and (body[0], body[1]) != (0, 8):
            raise ValueError("not a lossless DC quantiser")
        elif mark == 0xC4:
            tables.append(body)
        elif mark == 0xDA:
            break
    if tables != [b"\x00" + _LENGTHS + _CATEGORIES + b"\x10" + bytes([1] + [0] * 15) + b"\x00"]:
        raise ValueError("unknown Huffman tables")
    blocks = (width // 8) * (height // 8)
    scan = np.frombuffer(frame[at:-2].replace(b"\xff\x00", b"\xff"), dtype=np.uint8).reshape(-1, 5)
    wide = np.zeros((len(scan), 8), dtype=np.uint8)
    wide[:, 3:] = scan
    packed = wide.view(">u8").ravel().astype(np.uint64)
    codes = np.stack([(packed >> np.uint64(s)) & np.uint64(1023) for s in (30, 20, 10, 0)], axis=1).ravel().astype(np.int64)
    if len(codes) != blocks:
        raise ValueError("damaged frame")
    return (np.cumsum(_DIFFS[codes], dtype=np.int64) + 128).astype(np.uint8)


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\x00" * (len(body) % 2)


def avi(payload: bytes) -> bytes:
    """An AVI file of a payload whose length is a positive multiple of 64."""
    own = min(len(payload), FRAME)
    count = -(-len(payload) // own)
    samples = np.frombuffer(payload + bytes(count * own - len(payload)), dtype=np.uint8).reshape(count, own)
    frames = encode_frames(samples)
    width, height, most = 8 * UNIT, 8 * (own // UNIT), max(map(len, frames))
    main = struct.pack("<14I", FRAME_MS * 1000, most * 1000 // FRAME_MS, 0, 0x10, count, 0, 1, most, width, height, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<IHHIIIIIIiI4H", 0, 0, 0, 0, FRAME_MS, 1000, 0, count, most, -1, 0, 0, 0, width, height)
    form = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    header = b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", form)) + _chunk(b"pbyt", struct.pack("<Q", len(payload)))
    movie, index, at = [], [], 4
    for frame in frames:
        part = _chunk(b"00dc", frame)
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(frame)))
        movie.append(part)
        at += len(part)
    body = b"AVI " + _chunk(b"LIST", header) + _chunk(b"LIST", b"movi" + b"".join(movie)) + _chunk(b"idx1", b"".join(index))
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_avi(data: bytes) -> tuple[np.ndarray, int, int]:
    """Frames (n, samples), payload length and milliseconds a frame, by way of the index."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    at, movie, length, ms, places = 12, 0, None, FRAME_MS, []
    stop = 8 + struct.unpack_from("<I", data, 4)[0]
    todo = [(at, stop)]
    while todo:
        at, stop = todo.pop()
        while at + 8 <= stop:
            name, size = struct.unpack_from("<4sI", data, at)
            if name == b"LIST" and data[at + 8 : at + 12] == b"movi":
                movie = at + 8
            elif name == b"LIST":
                todo.append((at + 12, at + 8 + size))
            elif name == b"avih":
                ms = struct.unpack_from("<I", data, at + 8)[0] // 1000
            elif name == b"pbyt":
                length = struct.unpack_from("<Q", data, at + 8)[0]
            elif name == b"idx1":
                places = [struct.unpack_from("<4sIII", data, at + 8 + k)[2:] for k in range(0, size, 16)]
            at += 8 + size + size % 2
    frames = np.stack([decode_frame(data[movie + o + 8 : movie + o + 8 + n]) for o, n in places])
    return frames, frames.size if length is None else length, ms


def clips(frames: np.ndarray, ms: int) -> list[tuple[int, int]]:
    """Start and end in milliseconds of each shot."""
    bins = np.stack([np.bincount(f >> 4, minlength=16) for f in frames]) / frames.shape[1]
    changes = 0.5 * np.abs(np.diff(bins, axis=0)).sum(axis=1)
    cuts = [0]
    for k, change in enumerate(changes):
        recent = changes[max(0, k - HISTORY, cuts[-1]) : k]
        if change > FLOOR and (not len(recent) or change > recent.mean() + 3 * recent.std()) and (len(recent) or change > 3 * FLOOR):
            cuts.append(k + 1)
    return [(a * ms, b * ms) for a, b in zip(cuts, [*cuts[1:], len(frames)], strict=True)]


def stored(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text as a file in a binary column."""
    prepare(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                texts = utf8(part, "text")
                yield rows(schema, doc_id=column(part, "doc_id"), n_bytes=[len(t or b"") for t in texts], media=[avi(padded(t)) for t in texts])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, n_bytes long, media binary")


_SEEN = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64())]
    + [("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
)


def media_features(media: DataFrame) -> DataFrame:
    """Digests and shots of media files (doc_id, n_bytes, media), from the bytes read back."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, size, value in zip(column(batch, "doc_id").to_pylist(), column(batch, "n_bytes").to_pylist(), column(batch, "media"), strict=True):
                data = value.as_buffer().to_pybytes()
                frames, length, ms = read_avi(data)
                payload = frames.tobytes()[:length]
                shots = clips(frames, ms)
                feature = f"frames={len(frames)};shots={len(shots)};clips=" + ",".join(f"{a}-{b}" for a, b in shots)
                out.append((key, size, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), feature))
            if out:
                yield rows(_SEEN, **dict(zip(_SEEN.names, zip(*out, strict=True), strict=True)))

    return media.mapInArrow(work, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def clip_rows(media: DataFrame) -> DataFrame:
    """doc_id, clip, start_ms, end_ms: one row for each shot of a media file."""
    seen = media_features(media).select("doc_id", F.split(F.substring_index("feature", "clips=", -1), ",").alias("clips"))
    each = seen.select("doc_id", F.posexplode("clips").alias("clip", "span"))
    return each.select("doc_id", "clip", F.split("span", "-")[0].cast("long").alias("start_ms"), F.split("span", "-")[1].cast("long").alias("end_ms"))
