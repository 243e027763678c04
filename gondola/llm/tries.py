"""Which filters of a set remove what, alone and in every order. Equal texts are found by radix tries: texts are dealt by
adaptive prefixes, whole texts go into compressed tries with the least id at each terminal, and a traverse flags the rest."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gondola.llm.common import saved, small_batches, take_worker

#: Prefix lengths in bytes double from the first; a text goes by its shortest prefix that isn't heavy.
FIRST_PREFIX = 8
#: Bytes of text that a task's tries should hold, and the most tasks; a prefix is heavy with a quarter of a task's share.
TASK_BYTES, MAX_TASKS = 64 << 20, 1 << 16
#: Prefixes that a map task counts at once, and heavy ones that are broadcast (16 bytes each): the heaviest. They only
#: balance the tasks, so beyond these bounds a task may grow, but no result changes.
COUNTED_PREFIXES, HEAVY_PREFIXES = 200_000, 100_000
#: A map task's own trie, which takes repeated texts out before the shuffle, starts anew at so many bytes.
LOCAL_BYTES = 32 << 20

FILTERS = "ABCDE"
MIN_WORDS, DISTINCT_PERCENT, UPPER_PERCENT = 50, 65, 5
_MARKS = re.compile(rb"[#$%&*|]")
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"


class _Node:
    __slots__ = ("edges", "ids", "rows")

    def __init__(self) -> None:
        self.edges: dict[int, tuple[bytes, _Node]] = {}
        self.ids: list | None = None
        self.rows: list | None = None


class RadixTrie:
    """A compressed trie of whole texts; a terminal holds the ids of its text's rows and what goes with them."""

    def __init__(self) -> None:
        self.root, self.size = _Node(), 0

    def insert(self, text: bytes, doc_id, row) -> None:
        node, at = self.root, 0
        while at < len(text):
            edge = node.edges.get(text[at])
            if edge is None:
                leaf = _Node()
                node.edges[text[at]] = (text[at:], leaf)
                self.size += len(text) - at
                node = leaf
                break
            label, child = edge
            if not text.startswith(label, at):
                k = len(os.path.commonprefix((label, text[at : at + len(label)])))
                middle = _Node()
                middle.edges[label[k]] = (label[k:], child)
                node.edges[text[at]] = (label[:k], middle)
                label, child = label[:k], middle
            node, at = child, at + len(label)
        if node.ids is None:
            node.ids, node.rows = [], []
        node.ids.append(doc_id)
        node.rows.append(row)

    def terminals(self) -> Iterator[tuple[bytes, list, list]]:
        """Text, ids and rows of each terminal."""
        todo: list[tuple[_Node, tuple]] = [(self.root, ())]
        while todo:
            node, path = todo.pop()
            if node.ids is not None:
                yield b"".join(path), node.ids, node.rows
            todo += [(child, (*path, label)) for label, child in node.edges.values()]

    def flags(self) -> Iterator[tuple[object, bool]]:
        """Each row, and whether a row with a smaller id has the same text; rows without id neither are nor have copies."""
        todo = [self.root]
        while todo:
            node = todo.pop()
            if node.ids is not None:
                least = min((i for i in node.ids if i is not None), default=None)
                yield from ((row, i is not None and i > least) for i, row in zip(node.ids, node.rows, strict=True))
            todo += [child for _, child in node.edges.values()]


def text_faults(text: bytes, code_points: int) -> int:
    """Bits of the filters A to D (the text's own) that it fails; words are runs of bytes other than ASCII white space."""
    words = text.split()
    few = len(words) < MIN_WORDS
    repeated = 100 * len(set(words)) < DISTINCT_PERCENT * len(words)
    loud = 100 * (len(text) - len(text.translate(None, _UPPER))) > UPPER_PERCENT * code_points
    return few | repeated << 1 | loud << 2 | (_MARKS.search(text) is not None) << 3


def _prefixes(text: bytes) -> Iterator[tuple[int, int]]:
    """Length and hash of each prefix of a length of the ladder, as long as the text reaches beyond it."""
    n = FIRST_PREFIX
    while n < len(text):
        yield n, xxhash.xxh3_64_intdigest(text[:n]) >> 1
        n *= 2


def _prefix_weights(share: int):
    """Bytes of text under each prefix, less those below 1 / share of the task's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker("tries")
        weights: dict[tuple[int, int], int] = {}
        total = 0
        for b in batches:
            for text in b.column(0).cast(pa.binary()).to_pylist():
                text = text or b""
                total += len(text)
                for key in _prefixes(text):
                    weights[key] = weights.get(key, 0) + len(text)
            if len(weights) > COUNTED_PREFIXES:
                least = sorted(weights.values(), reverse=True)[COUNTED_PREFIXES // 2]
                weights = {k: w for k, w in weights.items() if w > least}
        kept = [(n, h, w) for (n, h), w in weights.items() if share * w >= total]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in kept], pa.int64()) for k in range(3)], names=["length", "prefix", "weight"])

    return run


def heavy_prefixes(docs: DataFrame, tasks: int) -> set[tuple[int, int]]:
    """(length, hash) of prefixes under which about a quarter of a task's share of all text lies, by a lossy count."""
    share = 4 * tasks
    summed = docs.select("text").mapInArrow(_prefix_weights(4 * share), "length long, prefix long, weight long").groupBy("length", "prefix").agg(F.sum("weight").alias("weight"))
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return {(r["length"], r["prefix"]) for r in summed.filter(F.col("weight") * 2 * share >= total).orderBy(F.col("weight").desc(), "length", "prefix").limit(HEAVY_PREFIXES).collect()}


_DEALT = "doc_id long, part string, mask int, text binary, lead binary, prefix long"


def _faulty_rows(heavy):
    """Masks of the texts' own filters; of rows that repeat a text within a task those with the least id go on with the text,
    the others are flagged here. lead and prefix: the adaptive prefix's first bytes and hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker("tries")
        known = heavy.value

        def route(text: bytes) -> tuple[bytes, int]:
            for key in _prefixes(text):
                if key not in known:
                    return text[:FIRST_PREFIX], key[1]
            return text[:FIRST_PREFIX], xxhash.xxh3_64_intdigest(text) >> 1

        def emptied(trie: RadixTrie) -> Iterator[pa.RecordBatch]:
            rows = []
            for text, ids, own in trie.terminals():
                least = min((i for i in ids if i is not None), default=None)
                lead, prefix = route(text)
                for i, (part, mask) in zip(ids, own, strict=True):
                    again = i is not None and i > least
                    whole = not again and i is not None
                    rows.append((i, part, mask | again << 4, text if whole else None, lead if whole else None, prefix if whole else None))
                if len(rows) >= 1000:
                    yield _batch(rows)
                    rows = []
            yield _batch(rows)

        trie = RadixTrie()
        for b in batches:
            texts = pc.fill_null(b.column("text"), "")
            points = pc.utf8_length(texts).to_pylist()
            for i, part, text, n in zip(b.column("doc_id").to_pylist(), b.column("part").to_pylist(), texts.cast(pa.binary()).to_pylist(), points, strict=True):
                trie.insert(text, i, (part, text_faults(text, n)))
                if trie.size > LOCAL_BYTES:
                    yield from emptied(trie)
                    trie = RadixTrie()
        yield from emptied(trie)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["doc_id", "part", "mask", "text", "lead", "prefix"])


def _flagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One trie a task: all rows of a text are here, so its least id is the least of all."""
    take_worker("tries")
    trie = RadixTrie()
    for b in batches:
        for i, part, mask, text in zip(*(b.column(c).to_pylist() for c in ("doc_id", "part", "mask", "text")), strict=True):
            trie.insert(text, i, (i, part, mask))
    rows: list[tuple] = []
    for (i, part, mask), again in trie.flags():
        rows.append((i, part, mask | again << 4))
    for k in range(0, max(1, len(rows)), 10_000):
        own = rows[k : k + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in own], t) for c, t in enumerate((pa.int64(), pa.string(), pa.int32()))], names=["doc_id", "part", "mask"])


def filter_masks(docs: DataFrame, part: str = "source") -> DataFrame:
    """doc_id, part, mask of each row: bit k of the mask is set if the row fails the k-th of FILTERS.

    A: fewer than 50 words; B: fewer than 65 % distinct words; C: more than 5 % capitals; D: a mark of #$%&*|; E: the text of
    a row with a smaller doc_id, wherever that is. Null texts are empty, null parts an empty string; rows without doc_id fail
    E never and make no other row fail it, nor do rows that repeat a doc_id each other.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), "text")
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    tasks = min(MAX_TASKS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_BYTES)))
    heavy = spark.sparkContext.broadcast(heavy_prefixes(rows, tasks))
    dealt = rows.mapInArrow(_faulty_rows(heavy), _DEALT)
    dealt = saved(dealt, "texts")
    alone = dealt.filter("text IS NULL").select("doc_id", "part", "mask")
    met = dealt.filter("text IS NOT NULL").repartitionByRange(tasks, "lead", "prefix").select("doc_id", "part", "mask", "text")
    return alone.unionByName(met.mapInArrow(_flagged, "doc_id long, part string, mask int"))


def _steps() -> list[tuple[str, int, int, int]]:
    """Order, step, mask of the filters before it and bit of its filter, for all orders."""
    out = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for k, f in enumerate(order):
            out.append(("".join(FILTERS[x] for x in order), k + 1, before, 1 << f))
            before |= 1 << f
    return out


def filter_interactions(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of FILTERS and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Masks are counted per part first, and all orders are sums over these counts. Labels that repeat a doc_id count once, as
    1 if one of them is 1; rows without label are neither good nor toxic; without rows there are no parts.
    """
    n = 1 << len(FILTERS)
    marks = labels.groupBy("doc_id").agg(*(F.max((F.col(c) == 1).cast("int")).alias(f"{c}_1") for c in ("quality", "toxic")))
    counted = masks.join(marks, "doc_id", "left").groupBy("part", "mask").agg(F.count("*").alias("n"), F.coalesce(F.sum("quality_1"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic_1"), F.lit(0)).alias("toxic"))
    arrays = counted.groupBy("part").agg(*(F.array(*(F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(c))), F.lit(0)) for m in range(n))).alias(c) for c in ("n", "good", "toxic")))
    spark = masks.sparkSession
    steps = spark.createDataFrame([(k, *x) for k, x in enumerate(_steps())], "at int, filter_order string, step int, before int, own int")

    def total(counts: str, keep) -> Column:
        at = F.sequence(F.lit(0), F.lit(n - 1))
        return F.aggregate(F.zip_with(counts, at, lambda c, m: F.when(keep(m), c).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, c: a + c)

    before, own = F.col("before"), F.col("own")
    fails = lambda m: m.bitwiseAND(own) != 0
    reaches = lambda m: m.bitwiseAND(before) == 0
    lost = lambda m: fails(m) & reaches(m)

    def shapley(m_own: int) -> Column:
        """Removed by one filter over all orders: a row that fails it and j others goes there in 120 / (j + 1) of them."""
        share = [factorial(len(FILTERS)) // m.bit_count() if m & m_own else 0 for m in range(n)]
        return F.aggregate(F.zip_with("n", F.lit(share), lambda c, w: c * w), F.lit(0).cast("long"), lambda a, c: a + c)

    by_filter = F.map_from_arrays(F.array(*(F.lit(1 << k) for k in range(len(FILTERS)))), F.array(*(shapley(1 << k) for k in range(len(FILTERS)))))
    places = F.explode(F.sequence(F.lit(0), F.lit(factorial(len(FILTERS)) * len(FILTERS) - 1))).alias("at")
    rows = arrays.withColumn("by_filter", by_filter).select("*", places).join(F.broadcast(steps), "at")
    return rows.select(
        "part", "filter_order", "step",
        total("n", lambda m: m.bitwiseAND(before.bitwiseOR(own)) == 0).alias("kept"), total("n", lost).alias("removed"), total("n", lambda m: fails(m) & ~reaches(m)).alias("redundant"),
        total("n", lambda m: m == own).alias("unique_fails"), total("good", lost).alias("good_lost"), total("toxic", lost).alias("toxic_lost"), F.element_at("by_filter", own).alias("shapley"),
    )
