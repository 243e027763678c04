"""Bytes in long strings that occur more than once: strings at shared anchors, refined by hashes of growing strings.

Not every position starts a comparison, but one anchor in about 65 bytes, chosen by the text itself, and each round ranks
anchors by the pair (rank so far, hash of the string grown to either side). Strings whose rank is unique leave; what reaches
the full length is a repeat. This stands in for prefix doubling over all positions; the README says why. Equality rests on
64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gondola.llm.common import U64, drop_table, mix, prefix_hash, saved, slices, small_batches, span_hash, take_worker, text_bytes, write_table

#: Length of a repeated string, and of an anchor's string; a window of LENGTH bytes holds REACH + 1 candidate anchors.
LENGTH, ANCHOR = 200, 72
REACH = LENGTH - ANCHOR
#: Widths of blocks of window starts in the rounds; the last compares single windows.
WIDTHS = (32, 8, 1)

_ITEM = "doc_id long, text_key long, at int, low int, high int, rank long, done boolean"


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Text number, position, least and greatest distance to its windows' starts, and string hash of each anchor.

    A window's anchor is the first of the least hashes among the strings of ANCHOR bytes in it, so equal windows have equal
    anchors at equal distances.
    """
    n = len(data) - ANCHOR + 1
    size = np.diff(offsets)
    if not (size >= LENGTH).any():
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, U64),)
    at = np.arange(n)
    h = span_hash(prefix_hash(data), at, at + ANCHOR)
    bits = U64(max(1, int(n).bit_length()))
    least = (h >> bits << bits) | at.astype(U64)
    # Least of REACH + 1 neighbours by doubling: spans of 1, 2, 4 ... then one overlapping step.
    span = 1
    while span * 2 <= REACH + 1:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    rest = REACH + 1 - span
    if rest:
        least = np.minimum(least[:-rest], least[rest:])
    text = np.repeat(np.arange(len(size)), size)
    starts = np.flatnonzero(text[: len(least)] == text[LENGTH - 1 : LENGTH - 1 + len(least)])
    chosen = (least[starts] & ((U64(1) << bits) - U64(1))).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (text[starts[1:]] != text[starts[:-1]])]))
    last = np.append(new[1:], len(chosen)) - 1
    where = chosen[new]
    return text[where], where - offsets[text[where]], where - starts[last], where - starts[new], h[where]


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    take_worker("repeats")
    for b in batches:
        offsets, data = text_bytes(b.column("text"))
        ids, keys = b.column("doc_id"), b.column("text_key")
        for a, e in slices(offsets):
            of, at, low, high, h = anchors(data[offsets[a] : offsets[e]], offsets[a : e + 1] - offsets[a])
            pick = pa.array(a + of)
            yield pa.RecordBatch.from_arrays([ids.take(pick), keys.take(pick), *(pa.array(x.astype(np.int32)) for x in (at, low, high)), pa.array(h.view(np.int64)), pa.array(np.zeros(len(at), bool))], names=["doc_id", "text_key", "at", "low", "high", "rank", "done"])


def _grow(width: int):
    """Blocks of `width` window starts around each item's anchor: the string common to a whole block's windows, and the
    string that they span (null where it leaves the text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker("repeats")
        for b in batches:
            offsets, data = text_bytes(b.column("text"))
            lists = b.column("items")
            limits, flat = np.asarray(lists.offsets).astype(np.int64), lists.values
            at, low, high = (np.asarray(flat.field(c)).astype(np.int64) for c in ("at", "low", "high"))
            rank, done = np.asarray(flat.field("rank")), np.asarray(flat.field("done").to_numpy(zero_copy_only=False), bool)
            ids, keys = b.column("doc_id"), b.column("text_key")
            for a, e in slices(offsets):
                base = offsets[a]
                prefix = prefix_hash(data[base : offsets[e]])
                i = np.arange(limits[a], limits[e])
                of = np.repeat(np.arange(a, e), np.diff(limits[a : e + 1]))
                blocks = high[i] // width - low[i] // width + 1
                item, of = np.repeat(i, blocks), np.repeat(of, blocks)
                number = np.arange(len(item)) - np.repeat(np.cumsum(blocks) - blocks, blocks) + low[item] // width
                near, far = number * width, np.minimum(number * width + width - 1, REACH)
                begin = offsets[of] - base
                here = begin + at[item]
                inner = span_hash(prefix, here - near, here - far + LENGTH)
                inside = (at[item] >= far) & (here - near + LENGTH <= offsets[of + 1] - base)
                outer = np.zeros(len(item), U64)
                outer[inside] = span_hash(prefix, (here - far)[inside], (here - near + LENGTH)[inside])
                salt = mix(number.astype(U64) + U64(width << 16))
                pick = pa.array(of)
                columns = [at[item], np.maximum(low[item], near), np.minimum(high[item], far)]
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pick), keys.take(pick), *(pa.array(x.astype(np.int32)) for x in columns), pa.array(rank[item]), pa.array(done[item]), pa.array((inner ^ salt).view(np.int64)), pa.array((outer ^ salt).view(np.int64), mask=~inside)],
                    names=["doc_id", "text_key", "at", "low", "high", "rank", "done", "inner", "outer"],
                )

    return run


def _release(df: DataFrame) -> None:
    """Let Spark's cleaner drop the shuffle files of finished rounds."""
    df.sparkSession._jvm.System.gc()


def _repeated(rows: DataFrame, *rank: str) -> DataFrame:
    return rows.groupBy(*rank).agg(F.count("*").alias("n")).filter("n > 1").select(*rank)


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, start, end): byte ranges covered by strings of LENGTH bytes that start anywhere else too; ranges
    may overlap. docs: doc_id, text, text_key."""
    spark = docs.sparkSession
    found, path = write_table(docs.mapInArrow(_find, _ITEM), "anchors")
    items, used = write_table(found.join(_repeated(found, "rank"), "rank", "left_semi").select(*found.columns), "items")
    drop_table(spark, path)
    _release(docs)
    out = None
    for width in WIDTHS:
        by_text = items.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("at", "low", "high", "rank", "done")).alias("items"))
        grown, path = write_table(docs.join(by_text, ["doc_id", "text_key"]).select("doc_id", "text_key", "text", "items").mapInArrow(_grow(width), _ITEM + ", inner long, outer long"), "grown")
        drop_table(spark, used)
        _release(docs)
        alive = grown.join(_repeated(grown, "rank", "inner"), ["rank", "inner"], "left_semi")
        if width > 1:
            alive = saved(alive, "alive")
            twice = _repeated(alive.filter("outer IS NOT NULL"), "rank", "outer").withColumn("whole", F.lit(True))
            alive = saved(alive.join(twice, ["rank", "outer"], "left").withColumn("whole", F.coalesce("whole", F.lit(False))), "alive")
        else:
            alive = alive.withColumn("whole", F.lit(True))
        ranges = saved(alive.filter("whole AND NOT done").select("doc_id", "text_key", (F.col("at") - F.col("high")).alias("start"), (F.col("at") - F.col("low") + LENGTH).alias("end")), "ranges")
        out = ranges if out is None else out.unionByName(ranges)
        if width > 1:
            rest = alive.filter("NOT whole AND NOT done")
            # What is settled stays on as a partner of what isn't, once for each string that its block spans.
            place = F.struct("doc_id", "text_key", "at", "low", "high")
            partners = alive.filter("whole OR done").join(rest.select("rank", "inner").distinct(), ["rank", "inner"], "left_semi").groupBy("rank", "inner", "outer").agg(F.min(place).alias("p"))
            rank = F.xxhash64("rank", "inner").alias("rank")
            rest = rest.select("doc_id", "text_key", "at", "low", "high", rank, "done").unionByName(partners.select("p.*", rank, F.lit(True).alias("done")))
            items, used = write_table(rest, "items")
        drop_table(spark, path)
        _release(docs)
    return out


_KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, starts array<int>, ends array<int>"


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n bytes lie in any of the ranges."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, np.minimum(starts, n), 1)
    np.add.at(change, np.minimum(ends, n), -1)
    return np.cumsum(change[:n]) > 0


def _cut(digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker("repeats")
        for b in batches:
            offsets, data = text_bytes(b.column("text"))
            out = []
            for k, spans in enumerate(b.column("ranges")):
                own = data[offsets[k] : offsets[k + 1]]
                n = len(own)
                if spans.is_valid:
                    where = spans.values
                    gone = covered(n, np.asarray(where.field("start")), np.asarray(where.field("end")))
                    edge = np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))
                    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                    kept = own[~gone].tobytes()
                else:
                    starts = ends = np.zeros(0, np.int64)
                    kept = own.tobytes()
                out.append((n, n - len(kept), len(starts), hashlib.sha256(kept).digest() if digest else kept, starts, ends))
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "starts", "ends"])

    return run


def remove_repeats(docs: DataFrame, digest: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the bytes that stay, or their sha256 if digest), and the removed runs.

    A byte goes if a string of LENGTH bytes that covers it starts anywhere else too, in this or another document; strings
    never cross documents, overlaps count, and all are judged on the input. Null texts are empty; texts shorter than LENGTH
    lose nothing; repeated rows repeat each other; an empty table gives an empty one; rows without doc_id keep their bytes,
    though others may repeat them; other columns are left out.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("text_key", F.xxhash64("text"))
    ranges = repeated_ranges(docs).distinct().groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))
    return docs.join(ranges, ["doc_id", "text_key"], "left").select("doc_id", "text", "ranges").mapInArrow(_cut(digest), _KEPT)
