"""Best-fit packing of token pieces into sequences, improved by swaps between underfull sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gondola.llm.common import lean, saved, small_batches, take_worker
from gondola.llm.tokens import END_ID, encoded

VOCABULARY = "byte_bpe_50k.json"
CAPACITY = 1024
#: Pieces that are packed together in a task, in every round.
BLOCK_PIECES = 4096
#: A bound on the passes of the local search over a block's underfull sequences, a parameter of swap_search and pack_pieces.
#: Each step raises the sum of squared fills, so the search ends by itself: within 3 passes on blocks of several kinds of sizes.
SEARCH_PASSES = 1000


def _cut(vocabulary: str, end_id: int, capacity: int, keep_ids: bool):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker("packing")
        for b in batches:
            for a, e, ids, limits in encoded(b, vocabulary, end_id):
                n = np.diff(limits)
                pieces = -(-n // capacity)
                doc = np.repeat(np.arange(e - a), pieces)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                first = (n[doc] - 1) % capacity + 1
                start = np.where(piece > 0, first + (piece - 1) * capacity, 0)
                length = np.where(piece > 0, capacity, first)
                at = limits[doc] + start
                raw = memoryview(ids.astype("<i4", copy=False)).cast("B")
                crc = [zlib.crc32(raw[4 * x : 4 * (x + k)]) for x, k in zip(at.tolist(), length.tolist(), strict=True)]
                columns = [b.column("doc_id").slice(a, e - a).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    # The pieces of all texts stand one after the other.
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(at, len(ids)).astype(np.int32)), pa.array(ids)))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids of each document's pieces.

    A document with its end id that is longer than the capacity is cut so that all pieces but the first are full. Null and
    empty texts give one piece with the end id alone; rows without doc_id keep a null, repeated rows give their pieces each;
    an empty table gives an empty one; other columns are left out.
    """
    small_batches(docs.sparkSession)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_cut(vocabulary, end_id, capacity, keep_ids), schema)


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Items into bins: largest first, each into the fullest bin that holds it. Returns the items of each bin."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms = 0  # bit r: some bin has room r
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        fits = open_rooms >> s
        if fits:
            room = s + (fits & -fits).bit_length() - 1
            k = by_room[room].pop()
            if not by_room[room]:
                open_rooms ^= 1 << room
            bins[k].append(i)
        else:
            k, room = len(bins), capacity
            bins.append([i])
        left = room - s
        if left:
            if not by_room[left]:
                open_rooms |= 1 << left
            by_room[left].append(k)
    return bins


def swap_search(sizes: np.ndarray, bins: list[list[int]], capacity: int, passes: int = SEARCH_PASSES) -> list[list[int]]:
    """Local search over the underfull bins: moves, one-for-one and two-for-one exchanges that raise the sum of squared
    fills by taking from the emptier bin, until a pass changes nothing. Emptied bins go."""
    fill = np.array([int(sizes[b].sum()) for b in bins])
    under = np.flatnonzero(fill < capacity)
    if len(under) < 2:
        return bins
    item = np.array([i for k in under for i in bins[k]])
    at = np.array([n for n, k in enumerate(under) for _ in bins[k]])
    size, fill = sizes[item].astype(np.int64), fill[under].astype(np.int64)

    def give(takes: list[int], back: int | None, source: int, target: int) -> None:
        d = int(size[takes].sum()) - (int(size[back]) if back is not None else 0)
        at[takes] = target
        if back is not None:
            at[back] = source
        fill[source] -= d
        fill[target] += d

    def improve(source: int) -> bool:
        """One step that empties `source` further: the largest transfer that a fuller bin can take."""
        own = np.flatnonzero(at == source)
        room = capacity - fill
        room[source] = -1
        fuller = fill >= fill[source]
        values, first, count = np.unique(size[own], return_index=True, return_counts=True)
        for v, i in zip(values[::-1].tolist(), own[first][::-1].tolist(), strict=True):
            ok = np.flatnonzero((room >= v) & (fill + v > fill[source]))
            if len(ok):
                give([i], None, source, int(ok[np.argmin(room[ok])]))
                return True
        there = np.flatnonzero((at != source) & fuller[at] & (room[at] > 0))
        if not len(there):
            return False
        # One or two items of the source by their sum, and of the others' items of each size the one with most room.
        x, y = np.triu_indices(len(values))
        two = (x != y) | (count[x] > 1)
        x, y = np.concatenate([np.arange(len(values)), x[two]]), np.concatenate([np.full(len(values), -1), y[two]])
        sums, pick = np.unique(values[x] + np.where(y >= 0, values[y], 0), return_index=True)
        most = np.zeros(capacity + 1, np.int64)
        np.maximum.at(most, size[there], room[at[there]])
        backs = np.flatnonzero(most)
        k = np.searchsorted(sums, backs + most[backs], "right") - 1
        gain = np.where(k >= 0, sums[k] - backs, 0)
        j = int(np.argmax(gain))
        if gain[j] <= 0:
            return False
        v, w = x[pick[k[j]]], y[pick[k[j]]]
        takes = [int(own[first[v]])] if w < 0 else [int(i) for i in (own[size[own] == values[v]][:2] if v == w else own[first[[v, w]]])]
        mine = there[size[there] == backs[j]]
        back = int(mine[np.argmax(room[at[mine]])])
        give(takes, back, source, int(at[back]))
        return True

    for _ in range(passes):
        changed = False
        for source in np.argsort(fill, kind="stable").tolist():
            while fill[source] and improve(source):
                changed = True
        if not changed:
            break
    kept = [b for k, b in enumerate(bins) if k not in set(under.tolist())]
    order = np.argsort(at, kind="stable")
    cuts = np.flatnonzero(np.diff(at[order])) + 1
    return [*kept, *([x.tolist() for x in np.split(item[order], cuts)])]


_PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, room long"


def _pack_block(capacity: int, turn: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece", "start"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        sizes = rows["length"].to_numpy()
        bins = swap_search(sizes, best_fit(sizes, capacity), capacity)
        order = np.array([i for b in bins for i in b])
        number = np.repeat(np.arange(len(bins)), [len(b) for b in bins])
        s = sizes[order]
        before = np.cumsum(s) - s
        first = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
        out = rows.loc[order, ["doc_id", "piece", "start", "length", "ids_crc32"]].reset_index(drop=True)
        out["sequence_id"] = (int(key[0]) << 32 | turn << 20) + number
        out["offset"] = before - before[first][number]
        out["room"] = capacity - np.bincount(number, weights=s).astype(np.int64)[number]
        return out

    return run


def _ranked(pieces: DataFrame) -> DataFrame:
    """Pieces with `rank`, their place from 0 by falling length: places within sorted parts, plus the parts before."""
    rows = saved(pieces.orderBy(F.col("length").desc(), "doc_id", "piece", "start", "ids_crc32").withColumn("place", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("place", 33).cast("int")
    sizes = {r["part"]: r["count"] for r in rows.groupBy(part.alias("part")).count().collect()}
    before = np.concatenate([[0], np.cumsum([sizes.get(k, 0) for k in range(max(sizes, default=0) + 1)])]).tolist()
    return rows.withColumn("rank", F.get(F.lit(before), part) + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))).drop("place")


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """Give each piece (doc_id, piece, start, length, ids_crc32) a sequence and its place there.

    Pieces are dealt by their rank by length into blocks of block_pieces at most, so that all blocks have much the same
    lengths; each is packed best-fit-decreasing and then by swap search. What lies in underfull sequences is dealt anew into
    as many blocks as its pieces fill and packed once more, until a round doesn't lower the number of sequences or one
    block was left. So a block has a bounded size in every round, whatever the lengths are. Equal lengths and repeated rows
    are packed like any others; an empty table gives an empty one.
    """
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def packed_in(rows: DataFrame, blocks: int, turn: int) -> DataFrame:
        rows = _ranked(rows.select(*columns)) if blocks > 1 else rows.select(*columns, F.lit(0).cast("long").alias("rank"))
        block = F.pmod(F.col("rank"), F.lit(blocks)).alias("block")
        return saved(rows.select(*columns, block).groupBy("block").applyInPandas(_pack_block(capacity, turn), _PACKED), "packed")

    def counts(packed: DataFrame) -> tuple[int, int, int]:
        """All sequences, underfull ones, and pieces in those."""
        return tuple(packed.select(F.count_if(F.col("offset") == 0), F.count_if((F.col("offset") == 0) & (F.col("room") > 0)), F.count_if(F.col("room") > 0)).first())

    pieces = saved(pieces, "pieces")
    blocks = max(1, -(-pieces.count() // block_pieces))
    packed = packed_in(pieces, blocks, 0)
    _, sequences, left = counts(packed)
    done, turn = [], 0
    while blocks > 1 and left:
        turn, blocks = turn + 1, -(-left // block_pieces)
        again = packed_in(packed.filter("room > 0"), blocks, turn)
        now, underfull, left = counts(again)
        if now >= sequences:
            break
        done.append(packed.filter("room = 0"))
        packed, sequences = again, underfull
    for part in done:
        packed = packed.unionByName(part)
    return packed.drop("room")


def packed_ids(pieces: DataFrame, packed: DataFrame) -> DataFrame:
    """sequence_id, doc_ids and ids of each sequence, from pieces with ids; a sequence has at most the capacity of ids."""
    rows = packed.join(pieces.select("doc_id", "piece", "ids"), ["doc_id", "piece"])
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return rows.groupBy("sequence_id").agg(parts.alias("p")).selectExpr("sequence_id", "transform(p, x -> x.doc_id) AS doc_ids", "flatten(transform(p, x -> x.ids)) AS ids")
