"""Ranked lexical search by Block-Max MaxScore over an inverted index in shards of documents.

A shard is one row of arrays: its terms with their lists, each list in blocks of postings that are packed by themselves, each
block with its last document and its largest impact. Queries meet every shard; a task carries each query's heap from one
shard to the next, and the heaps of all tasks are merged by one window.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gondola.llm.common import U64, lower_ascii, prefix_hash, run_starts, saved, slices, small_batches, span_hash, take_worker, text_bytes, word_spans, write_table

#: Terms are runs of ASCII letters and digits and of all characters beyond ASCII.
_SEPARATORS = np.array([not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128) for c in range(256)])
#: Results of a query, postings of a block, bytes of text of a shard, shards of a file (which one task searches).
TOP, BLOCK, SHARD_BYTES, SHARDS_PER_FILE = 20, 128, 8 << 20, 8
#: Bits of the broadcast filter of query terms: 8 MB however many queries there are. A false hit only costs an unused list.
FILTER_BITS = 26
#: Terms of the queries that one search broadcasts, about 24 MB; more queries are searched in several passes.
BATCH_TERMS = 1_000_000


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash and the text number of each term, A-Z lowered."""
    start, end, of = word_spans(data, offsets, _SEPARATORS)
    return span_hash(prefix_hash(lower_ascii(data)), start, end), of


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term that stands tf times in a document of length factor m adds, before its weight; integers, rounded down."""
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def corpus_size(docs: DataFrame) -> tuple[int, int]:
    """Documents with at least one term, and terms of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker("search")
        for b in batches:
            offsets, data = text_bytes(b.column(0))
            for x, y in slices(offsets):
                _, _, of = word_spans(data[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x], _SEPARATORS)
                yield pa.RecordBatch.from_arrays([pa.array([len(np.unique(of))], pa.int64()), pa.array([len(of)], pa.int64())], names=["docs", "terms"])

    r = docs.select("text").mapInArrow(run, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    return r[0] or 0, r[1] or 0


def query_terms(items: DataFrame) -> DataFrame:
    """item_id, term, times: the distinct terms of each item; rows that repeat an item_id are one item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            offsets, data = text_bytes(b.column("text"))
            h, of = terms(data, offsets)
            yield pa.RecordBatch.from_arrays([b.column("item_id").take(pa.array(of)), pa.array(h.view(np.int64))], names=["item_id", "term"])

    return items.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(run, "item_id long, term long").groupBy("item_id", "term").agg(F.count("*").alias("times"))


def _term_filter(queries: DataFrame) -> np.ndarray:
    place = F.col("term").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    words = queries.select(F.shiftright(place, 5).alias("word"), F.expr("shiftleft(1L, CAST(term & 31 AS INT))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 5), np.uint32)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().astype(np.uint32)
    return out


def _width(top: int) -> type:
    return np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32


def pack_block(docs: np.ndarray, tf: np.ndarray) -> bytes:
    """Postings of one block: first document, widths, gaps and counts in as few bytes as the largest of each needs."""
    gaps = np.diff(docs)
    wide = [_width(int(x.max(initial=0))) for x in (gaps, tf)]
    head = np.array([docs[0], len(docs)], "<u4").tobytes() + bytes(np.dtype(w).itemsize for w in wide)
    return head + gaps.astype(wide[0]).tobytes() + tf.astype(wide[1]).tobytes()


def unpack_block(raw: memoryview) -> tuple[np.ndarray, np.ndarray]:
    first, n = np.frombuffer(raw, "<u4", 2)
    gap, count = (np.dtype(f"<u{raw[k]}") for k in (8, 9))
    gaps = np.frombuffer(raw, gap, int(n) - 1, 10)
    docs = np.empty(int(n), np.int64)
    docs[0] = first
    np.cumsum(gaps, out=docs[1:])
    docs[1:] += int(first)
    return docs, np.frombuffer(raw, count, int(n), 10 + (int(n) - 1) * gap.itemsize).astype(np.int64)


_SHARD = "shard long, doc_ids array<long>, m array<int>, terms array<long>, counts array<int>, most array<int>, list_at array<int>, block_last array<int>, block_most array<int>, block_at array<int>, data binary"


def _shard_row(number: int, ids: pa.Array, length: np.ndarray, h: np.ndarray, of: np.ndarray, size: tuple[int, int]) -> pa.RecordBatch:
    """The index of one shard: h and of are its terms that some query holds; length counts all terms of each document."""
    m = 75 + (25 * length * size[0]) // max(1, size[1])
    h = h.view(np.int64)
    order = np.lexsort((of, h))
    h, of = h[order], of[order]
    pair = run_starts(h) if not len(h) else np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (of[1:] != of[:-1])]))
    tf = np.diff(np.append(pair, len(h)))
    h, of = h[pair], of[pair]
    q = impact(tf, m[of])
    lists = np.append(run_starts(h), len(h))
    data, last, most, at, list_at = [], [], [], [0], [0]
    for x, y in zip(lists[:-1], lists[1:], strict=True):
        for k in range(x, y, BLOCK):
            e = min(k + BLOCK, y)
            data.append(pack_block(of[k:e], tf[k:e]))
            last.append(of[e - 1])
            most.append(q[k:e].max())
            at.append(at[-1] + len(data[-1]))
        list_at.append(len(last))
    full = np.maximum.reduceat(q, lists[:-1]) if len(h) else np.zeros(0, np.int64)
    columns: list = [h[lists[:-1]], np.diff(lists), full, list_at, last, most, at]
    one = lambda values, t: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, t))
    arrays = [pa.array([number]), one(ids, pa.int64()), one(m.astype(np.int32), pa.int32()), one(columns[0], pa.int64()), *(one(np.asarray(c, np.int32), pa.int32()) for c in columns[1:]), pa.array([b"".join(data)], pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in _SHARD.split(", ")])


def _shards(size: tuple[int, int], bits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker("search")
        table, number = bits.value, TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        room = 0

        def shard() -> pa.RecordBatch:
            first = np.concatenate([[0], np.cumsum([len(x[0]) for x in held])])
            of = np.concatenate([x[3] + f for x, f in zip(held, first, strict=False)])
            return _shard_row(number, pa.concat_arrays([x[0] for x in held]), np.concatenate([x[1] for x in held]), np.concatenate([x[2] for x in held]), of, size)

        for b in batches:
            offsets, data = text_bytes(b.column("text"))
            for x, y in slices(offsets):
                h, of = terms(data[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x])
                length = np.bincount(of, minlength=y - x)
                place = h & U64((1 << FILTER_BITS) - 1)
                asked = ((table[(place >> U64(5)).astype(np.int64)] >> (place & U64(31)).astype(np.uint32)) & 1).astype(bool)
                held.append((b.column("doc_id").slice(x, y - x), length, h[asked], of[asked]))
                room += int(offsets[y] - offsets[x])
                if room >= SHARD_BYTES:
                    yield shard()
                    number, room, held = number + 1, 0, []
        if held:
            yield shard()

    return run


def build_index(docs: DataFrame, queries: DataFrame) -> tuple[DataFrame, int]:
    """The shards of all documents, written to the shared folder, with lists for the terms that some query holds; and how
    many documents have terms."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    bits = spark.sparkContext.broadcast(_term_filter(queries))
    size = corpus_size(docs)
    return write_table(docs.mapInArrow(_shards(size, bits), _SHARD), "index", maxRecordsPerFile=str(SHARDS_PER_FILE))[0], size[0]


def term_weight(n: Column, df: Column) -> Column:
    return F.floor(F.lit(1000.0) * F.log((n * 2 + 2).cast("double") / (df * 2 + 1).cast("double")))


def weighted(queries: DataFrame, index: DataFrame, n: int) -> DataFrame:
    """item_id, term, weight (the term's, by its times in the item), most (largest impact in any document)."""
    held = index.select(F.explode(F.arrays_zip("terms", "counts", "most")).alias("x")).groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.counts").alias("df"), F.max("x.most").cast("long").alias("most"))
    return queries.join(held, "term").select("item_id", "term", (F.col("times") * term_weight(F.lit(n), F.col("df"))).alias("weight"), "most").filter("weight > 0")


@dataclass
class Shard:
    """One row of the index; blocks are unpacked when asked for and kept while the shard is searched."""

    ids: np.ndarray
    has_id: np.ndarray
    m: np.ndarray
    terms: np.ndarray
    list_at: np.ndarray
    last: np.ndarray
    most: np.ndarray
    at: np.ndarray
    data: memoryview
    unpacked: dict = field(default_factory=dict)

    @classmethod
    def of(cls, batch: pa.RecordBatch, row: int) -> Shard:
        get = lambda c: batch.column(c)[row].values
        ids = get("doc_ids")
        arrays = [get(c).to_numpy(zero_copy_only=False) for c in ("m", "terms", "list_at", "block_last", "block_most", "block_at")]
        return cls(ids.fill_null(0).to_numpy(zero_copy_only=False), ~ids.is_null().to_numpy(zero_copy_only=False), arrays[0].astype(np.int64), *arrays[1:3], arrays[3], arrays[4].astype(np.int64), arrays[5], memoryview(batch.column("data")[row].as_py()))

    def block(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts of a block."""
        if k not in self.unpacked:
            docs, tf = unpack_block(self.data[self.at[k] : self.at[k + 1]])
            self.unpacked[k] = docs, impact(tf, self.m[docs])
        return self.unpacked[k]


class Heap:
    """The best documents so far: highest score first, then smallest doc_id; documents without id come last."""

    def __init__(self, top: int) -> None:
        self.top, self.rows = top, []

    @property
    def least(self) -> int:
        """The score that a document must reach."""
        return self.rows[-1][0] if len(self.rows) == self.top else 1

    def add(self, scores: np.ndarray, ids: np.ndarray, has_id: np.ndarray) -> None:
        best = np.lexsort((ids, ~has_id, -scores))[: self.top]
        more = zip(scores[best].tolist(), has_id[best].tolist(), ids[best].tolist(), strict=True)
        self.rows = sorted([*self.rows, *more], key=lambda r: (-r[0], not r[1], r[2]))[: self.top]


class Query:
    """Terms by ascending bound: weight times the largest impact anywhere. `below` sums the bounds up to each term."""

    def __init__(self, names: np.ndarray, weights: np.ndarray, most: np.ndarray) -> None:
        order = np.argsort(weights * most, kind="stable")
        self.terms, self.weights, self.below = names[order], weights[order], np.cumsum((weights * most)[order])


def search_shard(shard: Shard, query: Query, heap: Heap) -> None:
    """Add the shard's documents that may belong to the query's best.

    Lists whose bounds together stay under the heap's least score aren't essential: a document in no other list can't enter.
    The essential lists give candidates; the maxima of the blocks that candidates lie in, over the other lists, reject most
    of them before any of those blocks is unpacked. Equal scores are kept, as the smaller doc_id wins.
    """
    at = np.searchsorted(shard.terms, query.terms)
    held = at < len(shard.terms)
    held[held] = shard.terms[at[held]] == query.terms[held]
    least = heap.least
    essential = held & (query.below >= least)
    if not essential.any():
        return
    score = np.zeros(len(shard.m), np.int64)
    for k in np.flatnonzero(essential):
        for block in range(shard.list_at[at[k]], shard.list_at[at[k] + 1]):
            docs, q = shard.block(block)
            score[docs] += query.weights[k] * q
    docs = np.flatnonzero(score)
    rest = np.flatnonzero(held & ~essential)[::-1]
    # Where a candidate stands in each other list: its block, or none beyond the list's end, and that block's bound.
    blocks, bounds = np.empty((len(rest), len(docs)), np.int64), np.zeros((len(rest), len(docs)), np.int64)
    for j, k in enumerate(rest):
        x, y = shard.list_at[at[k]], shard.list_at[at[k] + 1]
        blocks[j] = x + np.searchsorted(shard.last[x:y], docs)
        inside = blocks[j] < y
        bounds[j, inside] = query.weights[k] * shard.most[blocks[j, inside]]
    total = score[docs] + bounds.sum(0)
    alive = np.flatnonzero(total >= least)
    for j, k in enumerate(rest):
        asked = alive[bounds[j, alive] > 0]
        total[asked] -= bounds[j, asked]
        for block in np.unique(blocks[j, asked]):
            mine = asked[blocks[j, asked] == block]
            own, q = shard.block(int(block))
            place = np.minimum(np.searchsorted(own, docs[mine]), len(own) - 1)
            total[mine] += np.where(own[place] == docs[mine], query.weights[k] * q[place], 0)
        alive = alive[total[alive] >= least]
    heap.add(total[alive], shard.ids[docs[alive]], shard.has_id[docs[alive]])


def _searched(batch, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker("search")
        items, limits, names, weights, most = batch.value
        queries = [Query(names[x:y], weights[x:y], most[x:y]) for x, y in zip(limits[:-1], limits[1:], strict=True)]
        heaps = [Heap(top) for _ in queries]
        for b in batches:
            for row in range(len(b)):
                shard = Shard.of(b, row)
                for query, heap in zip(queries, heaps, strict=True):
                    search_shard(shard, query, heap)
        rows = [(k, i if has else None, s) for k, heap in enumerate(heaps) for s, has, i in heap.rows]
        yield pa.RecordBatch.from_arrays([pa.array([items[k] for k, _, _ in rows], pa.int64()), pa.array([i for _, i, _ in rows], pa.int64()), pa.array([s for _, _, s in rows], pa.int64())], names=["item_id", "doc_id", "score"])

    return run


def _pass(spark, wanted: DataFrame, index: DataFrame, top: int) -> DataFrame:
    """The best documents of each task's shards for the queries of wanted."""
    t = wanted.orderBy("item_id", "term").toArrow()
    items = t["item_id"].to_pylist()
    starts = [k for k, i in enumerate(items) if k == 0 or i != items[k - 1]]
    arrays = [t[c].to_numpy() for c in ("term", "weight", "most")]
    batch = spark.sparkContext.broadcast(([items[k] for k in starts], [*starts, len(items)], *arrays))
    return index.drop("counts").mapInArrow(_searched(batch, top), "item_id long, doc_id long, score long")


def ranked_search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the `top` documents of highest score above 0 for each item, ties by smaller doc_id.

    With N documents that have terms, L terms in all, n a document's terms, df the documents of a term and tf its count in
    one: a term's weight is floor(1000 ln((2 N + 2) / (2 df + 1))), a document's m is 75 + (25 n N) div L, and the score
    sums weight * ((10^9 tf) div (1000 tf + 12 m)) over the item's terms, repeats included. Exact but for collisions of
    64-bit term hashes. Null and empty texts have no terms: such documents are never found and such items have no rows.
    Every row is a document of its own, rows without doc_id come last among equal scores; rows that repeat an item_id are
    one item. Without documents or items the result is empty.
    """
    queries = saved(query_terms(items), "queries")
    index, n = build_index(docs, queries)
    return search_index(saved(weighted(queries, index, n), "weights"), index, top)


def search_index(wanted: DataFrame, index: DataFrame, top: int = TOP) -> DataFrame:
    """Search an index for all weighted queries, in passes of bounded size, and rank what the tasks found."""
    spark = wanted.sparkSession
    passes = -(-wanted.count() // BATCH_TERMS)
    found = None
    for k in range(passes):
        own = wanted if passes == 1 else wanted.filter(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k)
        one = _pass(spark, own, index, top)
        found = one if found is None else found.unionByName(one)
    if found is None:
        found = spark.createDataFrame([], "item_id long, doc_id long, score long")
    best = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")
