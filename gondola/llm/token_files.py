"""Token ids in Parquet list columns: range-sorted files, dictionary ids, delta positions, small pages with indexes."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gondola.llm.common import small_batches, take_worker
from gondola.llm.tokens import END_ID, encoded

VOCABULARY = "word_bpe_49k.json"
#: Row groups of 32 MB and pages of 128 KB: a reader of a few documents touches few pages; page indexes are always written.
ROW_GROUP_BYTES, PAGE_BYTES = 32 << 20, 128 << 10
_FILE_SCHEMA = "doc_id long, part int, local_start long, n_tokens int, ids array<int>"


def _encode(vocabulary: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker("token_files")
        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            for a, e, ids, limits in encoded(b, vocabulary, end_id):
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id").slice(a, e - a),
                        pa.array(np.full(e - a, part, np.int32)),
                        pa.array(at + limits[:-1]),
                        pa.array(np.diff(limits).astype(np.int32)),
                        pa.ListArray.from_arrays(pa.array(limits.astype(np.int32)), pa.array(ids)),
                    ],
                    names=["doc_id", "part", "local_start", "n_tokens", "ids"],
                )
                at += int(limits[-1])

    return run


def write_token_files(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> None:
    """Write one row per document in ascending doc_id: its place in its file, its length and its ids with the end id.

    Null texts are empty and give the end id alone; an empty table gives files without rows; repeated doc_ids give a row
    each, in any order among themselves; rows without doc_id stand first, with a null; other columns of `docs` are left out. Files hold disjoint ranges of doc_id in the order of `part`. doc_id and
    positions are delta coded, ids dictionary coded.
    """
    small_batches(docs.sparkSession)
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    options = {
        "parquet.writer.version": "v2",
        "parquet.block.size": str(ROW_GROUP_BYTES),
        "parquet.page.size": str(PAGE_BYTES),
        "parquet.enable.dictionary": "true",
        **{f"parquet.enable.dictionary#{c}": "false" for c in ("doc_id", "local_start", "n_tokens")},
        "compression": "zstd",
    }
    ordered.mapInArrow(_encode(vocabulary, end_id), _FILE_SCHEMA).write.options(**options).parquet(path)


def part_starts(spark: SparkSession, path: str) -> DataFrame:
    """(part, part_start): ids in all files before each file; reads the length column only, one row per file."""
    sums = spark.read.schema(_FILE_SCHEMA).parquet(path).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    return sums.selectExpr("part", "sum(n) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n AS part_start")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start and n_tokens of every document, without touching the ids."""
    files = spark.read.schema(_FILE_SCHEMA).parquet(path).select("doc_id", "part", "local_start", "n_tokens")
    return files.join(F.broadcast(part_starts(spark, path)), "part").select("doc_id", (F.col("part_start") + F.col("local_start")).alias("start"), "n_tokens")


def read_tokens(spark: SparkSession, path: str, first_id: int | None = None, last_id: int | None = None) -> DataFrame:
    """doc_id and ids of a range of documents; the range reaches the scan, where row groups and pages outside it are skipped."""
    files = spark.read.schema(_FILE_SCHEMA).parquet(path)
    if first_id is not None:
        files = files.filter(F.col("doc_id") >= first_id)
    if last_id is not None:
        files = files.filter(F.col("doc_id") <= last_id)
    return files.select("doc_id", "ids")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = b.column("ids")
        limits, values = np.asarray(ids.offsets), np.asarray(ids.values).astype("<u4")
        crc = [zlib.crc32(values[a:e]) for a, e in zip(limits[:-1], limits[1:], strict=True)]
        n = np.diff(limits).astype(np.int64)
        if len(n) and not np.array_equal(n, np.asarray(b.column("n_tokens"))):
            raise ValueError("a stored length differs from the stored ids")
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("part"), b.column("local_start"), pa.array(n), pa.array(crc, pa.int64())], names=["doc_id", "part", "local_start", "n_tokens", "ids_crc32"])


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens and the crc32 of its ids."""
    read = spark.read.schema(_FILE_SCHEMA).parquet(path).mapInArrow(_digest, "doc_id long, part int, local_start long, n_tokens long, ids_crc32 long")
    return read.join(F.broadcast(part_starts(spark, path)), "part").select("doc_id", (F.col("part_start") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
