"""Bytes as PNG images in binary columns: zlib chunks with checksums, numpy unfiltering, low-frequency cosine hashes."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gondola.llm.common import small_batches, take_worker

#: Samples in an image row; payloads are filled with bytes 255 to a positive multiple of it.
WIDTH = 576
CHUNK_BYTES = 1 << 16
LEVEL = 6
#: Low frequencies in each direction that a hash holds.
FREQUENCIES = 8
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def padded(data: bytes, width: int = WIDTH) -> bytes:
    """Data with bytes 255 up to a positive multiple of width."""
    return data + b"\xff" * (-len(data) % width or (0 if data else width))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def _entropy(samples: np.ndarray) -> float:
    n = np.bincount(samples.ravel(), minlength=256)
    p = n[n > 0] / samples.size
    return float(-(p * np.log2(p)).sum())


def encode_png(samples: np.ndarray) -> bytes:
    """An 8-bit grey image; rows go unfiltered, or by the Sub or Up filter where that lowers the entropy of the bytes."""
    height, width = samples.shape
    left, up = samples.copy(), samples.copy()
    left[:, 1:] -= samples[:, :-1]
    up[1:] -= samples[:-1]
    kind, rows = min(enumerate((samples, left, up)), key=lambda x: (_entropy(x[1]), x[0]))
    lines = np.empty((height, width + 1), np.uint8)
    lines[:, 0], lines[:, 1:] = kind, rows
    packed = zlib.compress(lines.tobytes(), LEVEL)
    parts = [_chunk(b"IDAT", packed[k : k + CHUNK_BYTES]) for k in range(0, len(packed), CHUNK_BYTES)]
    return b"".join([SIGNATURE, _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)), *parts, _chunk(b"IEND", b"")])


def unfilter(lines: np.ndarray) -> np.ndarray:
    """Undo the five row filters for one sample a pixel. Runs of rows with None, Sub or Up go at once."""
    kinds, rows = lines[:, 0], lines[:, 1:].copy()
    if kinds.size and kinds.max() > 4:
        raise ValueError(f"unknown filter {kinds.max()}")
    cuts = [0, *(np.flatnonzero(np.diff(kinds)) + 1).tolist(), len(kinds)]
    for a, e in zip(cuts[:-1], cuts[1:], strict=True):
        kind = kinds[a] if a < e else 0
        if kind == 1:
            np.cumsum(rows[a:e], axis=1, dtype=np.uint8, out=rows[a:e])
        elif kind == 2:
            if a:
                rows[a] += rows[a - 1]
            np.cumsum(rows[a:e], axis=0, dtype=np.uint8, out=rows[a:e])
        elif kind:
            for y in range(a, e):
                above = rows[y - 1].astype(int) if y else np.zeros(rows.shape[1], int)
                b = c = 0
                row = rows[y].astype(int)
                for x in range(len(row)):
                    up = int(above[x])
                    if kind == 3:
                        guess = (b + up) // 2
                    else:
                        p = b + up - c
                        guess = min((abs(p - b), 0, b), (abs(p - up), 1, up), (abs(p - c), 2, c))[2]
                    b, c = (int(row[x]) + guess) & 255, up
                    row[x] = b
                rows[y] = row
    return rows


def decode_png(data: bytes) -> np.ndarray:
    """Samples of an 8-bit grey image without interlace; ValueError says which test failed."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, head, parts, ended = 8, None, [], False
    while not ended:
        if at + 12 > len(data):
            raise ValueError("cut short")
        (n,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        body, crc = data[at + 8 : at + 8 + n], data[at + 8 + n : at + 12 + n]
        if len(crc) < 4 or struct.unpack(">I", crc)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError(f"checksum of chunk {kind!r}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            parts.append(body)
        ended = kind == b"IEND"
        at += 12 + n
    if head is None or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not 8-bit grey without interlace")
    width, height = head[:2]
    try:
        raw = zlib.decompress(b"".join(parts))
    except zlib.error as e:
        raise ValueError(f"zlib: {e}") from e
    if len(raw) != height * (width + 1):
        raise ValueError("wrong number of samples")
    return unfilter(np.frombuffer(raw, np.uint8).reshape(height, width + 1))


@lru_cache(maxsize=4096)
def _cosines(n: int, frequencies: int) -> np.ndarray:
    return np.cos(np.pi / n * (np.arange(n) + 0.5)[None] * np.arange(frequencies)[:, None]) / n


def cosine_hash(samples: np.ndarray, frequencies: int = FREQUENCIES) -> bytes:
    """Low-frequency cosine-transform coefficients, each as one bit: above the median of all but the mean."""
    height, width = samples.shape
    c = (_cosines(height, frequencies) @ (samples.astype(np.float64) @ _cosines(width, frequencies).T)).ravel()
    c = np.round(c, 9)
    return np.packbits(c > np.median(c[1:])).tobytes()


_MEDIA = "doc_id long, n_bytes long, media binary"
_READ = "doc_id long, n_bytes long, media_bytes long, media_sha256 string, payload binary, hash binary, error string"


def _write(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker("media")
        for b in batches:
            raw = [(t or "").encode() for t in b.column("text").to_pylist()]
            media = [encode_png(np.frombuffer(padded(r, width), np.uint8).reshape(-1, width)) for r in raw]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(r) for r in raw], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return run


def to_media(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_bytes and the PNG of each whole text as UTF-8, filled up with bytes 255. Null texts are empty and give one
    row of 255; equal texts give equal images; rows without doc_id keep a null, repeated rows an image each; an empty table
    gives an empty one; other columns are left out."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_write(width), _MEDIA)


def _read_one(media: bytes | None) -> tuple:
    if media is None:
        return None, None, None, None, "no image"
    form = len(media), hashlib.sha256(media).hexdigest()
    try:
        samples = decode_png(media)
    except ValueError as e:
        return *form, None, None, str(e)
    return *form, samples.tobytes(), cosine_hash(samples), None


def read_media(media: DataFrame) -> DataFrame:
    """The payload and hash of each stored image. A damaged image gives null for both and the failed test in `error`."""
    small_batches(media.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker("media")
        for b in batches:
            found = [_read_one(m) for m in b.column("media").to_pylist()]
            columns = list(zip(*found, strict=True)) if found else [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "n_bytes", "media_bytes", "media_sha256", "payload", "hash", "error"])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, _READ)
