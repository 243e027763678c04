"""What the corpus operators share: written tables, text batches as byte arrays, hashing."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that a task turns into arrays at once; one longer text is taken whole.
SLICE_BYTES = 2 << 20
#: Rows of an Arrow batch, so that a batch of long texts stays small.
BATCH_ROWS = 1000

U64 = np.uint64

#: What operators keep in a Python worker, as functions that drop it; Spark uses a worker for one operator after another.
CACHES: list[Callable[[], None]] = []
_OWNER = ""


def take_worker(operator: str) -> None:
    """Drop what other operators keep in this worker, so that their caches don't add up in an executor's memory."""
    global _OWNER
    if operator != _OWNER:
        for drop in CACHES:
            drop()
        give_back()
        _OWNER = operator


def give_back() -> None:
    """Hand freed memory back to the system: an executor's heap has no use for what an idle Python worker keeps."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of batches that gives its memory back when its task ends."""

    @functools.wraps(run)
    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return kept


def work_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; where it is unset, one of our own in local mode (tests), and an error
    on a cluster, whose executors see no folder of the driver's."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
    return at.rstrip("/")


def write_table(df: DataFrame, name: str = "t", **options: str) -> tuple[DataFrame, str]:
    """Write a table in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def saved(df: DataFrame, name: str = "t") -> DataFrame:
    return write_table(df, name)[0]


def drop_table(spark: SparkSession, path: str) -> None:
    """Remove a table that write_table made and that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of texts small enough for an executor's Python share."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a text column, null as empty, without a copy of each text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    n = len(column)
    if n == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return at - at[0], raw[at[0] : at[-1]]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `limit` bytes each."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1
        b = min(n, max(b, a + 1))
        yield a, b
        a = b


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def odd_numbers(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed)) | U64(1)


#: A random 64-bit value for each byte, and the base of the polynomial hash with its inverse modulo 2**64.
BYTE_VALUE = mix(np.arange(256, dtype=U64) + U64(0x5851F42D4C957F2D))
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}
CACHES.append(_POWERS.clear)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64; kept, and grown by doubling."""
    have = _POWERS.get(base)
    if have is None:
        have = np.ones(1, U64)
    while len(have) < n:
        step = U64(pow(base, len(have), 1 << 64))
        have = np.concatenate([have, have * step])
    if len(have) <= 1 << 23:
        _POWERS[base] = have
    return have[:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """P with (P[e] - P[s]) * INVERSE**s the polynomial hash of data[s:e], modulo 2**64."""
    out = np.zeros(len(data) + 1, U64)
    np.cumsum(BYTE_VALUE[data] * powers(BASE, len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((prefix[end] - prefix[start]) * powers(INVERSE, len(prefix))[start])


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; other bytes stay."""
    return data + ((data >= 65) & (data <= 90)).view(np.uint8) * np.uint8(32)


#: Separators of words: space and \x09 to \x0D.
WHITE = np.isin(np.arange(256), [0x20, 9, 10, 11, 12, 13])


def word_spans(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each word of the texts in data; offsets are the texts' limits in it."""
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~separators[data]
    first = np.zeros(n + 2, bool)
    first[1 + offsets[:-1][offsets[:-1] < n]] = True
    start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | first[1:-1]))
    end = np.flatnonzero(inside[1:-1] & (~inside[2:] | first[2:])) + 1
    text = np.searchsorted(offsets, start, "right") - 1
    return start, end, text


def word_hashes(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash and the text number of each word."""
    start, end, text = word_spans(data, offsets, separators)
    return span_hash(prefix_hash(data), start, end), text


def run_starts(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))


SHINGLE_WORDS = 5
_PLACE = odd_numbers(SHINGLE_WORDS + 1, 11)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word-shingle hashes, sorted in each text, and their text numbers; texts of fewer words give one shingle of all."""
    words, text = word_hashes(lower_ascii(data), offsets)
    place = odd_numbers(size + 1, 11)
    n, count = len(words), np.bincount(text, minlength=len(offsets) - 1)
    m = max(0, n - size + 1)
    whole = np.flatnonzero(text[:m] == text[size - 1 : size - 1 + m]) if m else np.zeros(0, np.int64)
    h = np.zeros(len(whole), U64)
    for k in range(size):
        h += words[whole + k] * place[k]
    of = text[whole]
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        at = np.cumsum(count) - count
        more = np.zeros(len(short), U64)
        for k in range(size - 1):
            has = count[short] > k
            more[has] += words[at[short[has]] + k] * place[k]
        more += count[short].astype(U64) * place[size]
        h, of = np.concatenate([h, more]), np.concatenate([of, short])
    h = mix(h)
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    return h[keep], of[keep]
