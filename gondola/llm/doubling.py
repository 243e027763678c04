"""Prefix doubling over all byte positions: the plain form of finding repeated strings, for corpora whose position rank pairs fit.

repeats.py finds the same strings from one position in about 65; this module is held against it in tests.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gondola.llm.common import prefix_hash, saved, slices, small_batches, span_hash, take_worker, text_bytes
from gondola.llm.repeats import LENGTH

#: Bytes that the first ranks stand for; each round doubles them until LENGTH.
FIRST = 25


def _first_ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every position with FIRST bytes behind it, and the hash of these as its first rank."""
    take_worker("doubling")
    for b in batches:
        offsets, data = text_bytes(b.column("text"))
        for a, e in slices(offsets):
            limits, own = offsets[a : e + 1] - offsets[a], data[offsets[a] : offsets[e]]
            of = np.repeat(np.arange(e - a), np.diff(limits))
            start = np.flatnonzero(np.arange(len(own)) + FIRST <= limits[of + 1])
            rank = span_hash(prefix_hash(own), start, start + FIRST)
            yield pa.RecordBatch.from_arrays([b.column("row").take(pa.array(a + of[start])), pa.array((start - limits[of[start]]).astype(np.int32)), pa.array(rank.view(np.int64))], names=["row", "at", "rank"])


def _repeated(positions: DataFrame, *key: str) -> DataFrame:
    """The positions whose key occurs twice or more, ranked anew by its order; ranks grow with the key, gaps included."""
    twice = positions.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1").select(*key)
    ranks = saved(twice.repartitionByRange(*key).sortWithinPartitions(*key).withColumn("new", F.monotonically_increasing_id()), "ranks")
    return saved(positions.join(ranks, list(key)).select("row", "at", F.col("new").alias("rank")), "ranked")


def repeated_positions(docs: DataFrame) -> DataFrame:
    """(doc_id, at): each byte position of a text at which a string of LENGTH bytes starts that starts anywhere else too.

    A round pairs each position's rank with that of the position as far behind it as the rank reaches, sorts the pairs and
    ranks them; positions of unique pairs leave. Null texts have no positions; an empty table gives an empty one; rows
    without doc_id take part.
    """
    small_batches(docs.sparkSession)
    texts = saved(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text"), "texts")
    alive, reach = _repeated(texts.select("row", "text").mapInArrow(_first_ranks, "row long, at int, rank long"), "rank"), FIRST
    while reach < LENGTH:
        step = min(reach, LENGTH - reach)
        behind = alive.select("row", (F.col("at") - step).alias("at"), F.col("rank").alias("next"))
        alive, reach = _repeated(alive.join(behind, ["row", "at"]), "rank", "next"), reach + step
    return alive.join(texts.select("row", "doc_id"), "row").select("doc_id", "at")
