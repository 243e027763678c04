"""Exact duplicates with the heavy hitters split off: Misra-Gries finds digests that hold a large share of all rows, their
verified winners are broadcast and decide in the map tasks; all other digests meet in an ordinary shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gondola.llm.common import saved, take_worker

#: A digest with at least this share of all rows (1 / HEAVY) is found for certain; at most 2 * HEAVY winners are broadcast.
HEAVY = 256
ROW, DIGEST = "__row", "__digest"


class MisraGries:
    """At most k counters: each is its value's count less at most (values seen) / (k + 1)."""

    def __init__(self, k: int) -> None:
        self.k, self.n, self.counters = k, 0, {}

    def add(self, counts: dict[bytes, int]) -> None:
        """Counts of values, added at once; then the (k + 1)-th largest counter comes off all."""
        held = self.counters
        for value, c in counts.items():
            held[value] = held.get(value, 0) + c
        self.n += sum(counts.values())
        if len(held) > self.k:
            off = sorted(held.values(), reverse=True)[self.k]
            self.counters = {v: c - off for v, c in held.items() if c > off}


def _frequent(heavy: int):
    """Per task: counters of at least 1 / (4 * heavy) of its rows. With 4 * heavy counters, a value's sum over all tasks is
    its count less at most 1 / (2 * heavy) of all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker("exact")
        found = MisraGries(4 * heavy)
        for b in batches:
            counted = b.column(0).value_counts()
            found.add(dict(zip(counted.field("values").to_pylist(), counted.field("counts").to_pylist(), strict=True)))
        rows = [(v, c) for v, c in found.counters.items() if 4 * heavy * c >= found.n]
        yield pa.RecordBatch.from_arrays([pa.array([v for v, _ in rows], pa.binary()), pa.array([c for _, c in rows], pa.int64())], names=[DIGEST, "n"])

    return run


def heavy_winners(digests: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """Digest, best (doc_id and row that stay), group_size of at most 2 * heavy digests, among them each one that at least
    1 / heavy of all rows hold. The candidates' counts and winners are exact: a second pass takes them."""
    rows = digests.count()
    summed = digests.select(DIGEST).mapInArrow(_frequent(heavy), f"{DIGEST} binary, n long").groupBy(DIGEST).agg(F.sum("n").alias("n"))
    candidates = saved(summed.filter((F.col("n") > 1) & (2 * heavy * F.col("n") >= rows)).select(DIGEST), "frequent")
    own = digests.join(F.broadcast(candidates), DIGEST, "left_semi")
    return saved(own.groupBy(DIGEST).agg(F.max(F.struct("doc_id", ROW)).alias("best"), F.count("*").alias("group_size")), "winners")


def _decided(digests: DataFrame, heavy: int) -> DataFrame:
    """All rows of (doc_id, row, digest) with best and group_size."""
    winners = F.broadcast(heavy_winners(digests, heavy))
    group = Window.partitionBy(DIGEST)
    rest = digests.join(winners, DIGEST, "left_anti").withColumns({"best": F.max(F.struct("doc_id", ROW)).over(group), "group_size": F.count("*").over(group)})
    return digests.join(winners, DIGEST).unionByName(rest)


def _digested(docs: DataFrame, *more: str) -> DataFrame:
    text = F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))
    return saved(docs.select(*more, text.alias(DIGEST), F.monotonically_increasing_id().alias(ROW)), "digests")


def exact_duplicates(docs: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of each row: of equal texts the row with the largest doc_id stays.

    Texts are equal when they are identical (by SHA-256 of their UTF-8); null counts as empty. Of rows that repeat both doc_id
    and text one stays. Rows without doc_id come after all others; a group of nothing else keeps one of them, with a null
    keep_id. An empty table gives an empty one; other columns are left out. Texts themselves are never shuffled.
    """
    digests = _digested(docs, "doc_id")
    out = _decided(digests, heavy)
    return out.select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col(ROW) == F.col(f"best.{ROW}")).alias("kept"), F.lower(F.hex(DIGEST)).alias("text_sha256"))


def remove_exact_duplicates(docs: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """The rows of docs that exact_duplicates keeps, with all their columns."""
    whole = _digested(docs, *docs.columns)
    lost = _decided(whole.select("doc_id", ROW, DIGEST), heavy).filter(F.col(ROW) != F.col(f"best.{ROW}")).select(ROW)
    return whole.join(lost, ROW, "left_anti").select(*docs.columns)
