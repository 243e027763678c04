"""Passages of benchmark items in documents: spaced-seed hashes find them, aligned comparison around hits confirms them."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gondola.llm.common import U64, lean, mix, odd_numbers, prefix_hash, saved, slices, small_batches, span_hash, take_worker, text_bytes, word_spans

#: Fixed masks: 1 counts, 0 is ignored, so a hit survives substitutions at ignored places. Together they lose nothing: a
#: stretch of 12 or more tokens with 75 % equal holds one of 12, 16 or 20 tokens with at most 3, 4 or 5 changed, and every
#: choice of the changed places there leaves some mask a window whose counted places are all equal.
MASKS = ("11101011", "111111", "1101000111", "1100011011", "11010111", "111001011", "110100100011", "101000100111")
#: A confirmed overlap has at least so many aligned tokens (or all of a shorter item) and this share of equal ones.
MIN_OVERLAP, MIN_IDENTITY = 12, 0.75
#: Bits of the broadcast filter of benchmark hashes: 8 MB at any size of the benchmark.
FILTER_BITS = 26
#: Bytes of text that are hashed at once.
SLICE = 1 << 20
_PROBES = (64 - FILTER_BITS, 64 - 2 * FILTER_BITS)

#: Words are runs of ASCII letters and digits and of bytes beyond ASCII.
_SEPARATORS = np.array([not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128) for c in range(256)])
_PLACE = odd_numbers(64, 77)


def tokens(column: pa.Array, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of texts a to b, and the limits of each text's words."""
    offsets, data = text_bytes(pc.utf8_lower(pc.fill_null(column.slice(a, b - a), "")))
    start, end, of = word_spans(data, offsets, _SEPARATORS)
    h = span_hash(prefix_hash(data), start, end)
    return h, np.concatenate([[0], np.cumsum(np.bincount(of, minlength=b - a))])


def seeds(h: np.ndarray, limits: np.ndarray, mask: str, number: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each window of len(mask) tokens inside one text, over the places where the mask is 1; and its position."""
    span = len(mask)
    n = len(h) - span + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(limits) - 1), np.diff(limits))
    at = np.flatnonzero(text[:n] == text[span - 1 : span - 1 + n])
    out = np.full(n, number * 1000 + span, U64)
    for k, c in enumerate(mask):
        if c == "1":
            out += h[k : k + n] * _PLACE[k % 64]
    return mix(out[at]), at


def _item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        h, limits = tokens(b.column("text"), 0, len(b))
        yield pa.RecordBatch.from_arrays([b.column("item_id"), pa.ListArray.from_arrays(pa.array(limits.astype(np.int32)), pa.array(h.view(np.int64)))], names=["item_id", "tokens"])


def _masks(short: list[int]) -> list[tuple[int, str]]:
    """The masks, and for each length of items shorter than MIN_OVERLAP masks over the whole item (at most 16 a length)."""
    return [*enumerate(MASKS), *((100 * n + k, m) for n in short for k, m in enumerate(item_masks(n)))]


def item_masks(n: int) -> list[str]:
    """Masks over n < MIN_OVERLAP tokens of which one ignores every choice of n // 4 changed places: greedily, each the
    mask that ignores most of the choices that are left."""
    changes = n // 4
    left = set(combinations(range(n), changes))
    blocks = list(combinations(range(n), max(0, n - min(6, n - changes * (changes + 1) // 2))))
    out = []
    while left:
        best = max(blocks, key=lambda b: sum(c in left for c in combinations(b, changes)))
        left.difference_update(combinations(best, changes))
        out.append("".join("0" if k in best else "1" for k in range(n)))
    return out


def _item_seeds(masks: list[tuple[int, str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("tokens")
            limits = np.asarray(lists.offsets).astype(np.int64)
            h = np.asarray(lists.values)[limits[0] : limits[-1]].view(U64)
            limits = limits - limits[0]
            ids, size = np.asarray(b.column("item_id")), np.diff(limits)
            for number, mask in masks:
                key, at = seeds(h, limits, mask, number)
                of = np.searchsorted(limits, at, "right") - 1
                if number >= len(MASKS):
                    fits = size[of] == len(mask)
                    key, at, of = key[fits], at[fits], of[fits]
                yield pa.RecordBatch.from_arrays([pa.array(ids[of]), pa.array(key.view(np.int64)), pa.array(at - limits[of])], names=["item_id", "seed", "item_at"])

    return run


def _filter_bits(item_seeds: DataFrame) -> np.ndarray:
    """A bitmap of two runs of bits of all benchmark seeds; 2**FILTER_BITS bits however many seeds there are."""
    places = F.explode(F.array(*(F.shiftrightunsigned("seed", s).bitwiseAND(F.lit((1 << FILTER_BITS) - 1)) for s in _PROBES))).alias("p")
    rows = item_seeds.select(places).select(F.shiftrightunsigned("p", 5).alias("w"), F.col("p").bitwiseAND(F.lit(31)).cast("int").alias("b")).selectExpr("w", "shiftleft(1L, b) AS v").groupBy("w").agg(F.expr("bit_or(v)").alias("v")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 5), np.uint32)
    out[rows["w"].to_numpy()] = rows["v"].to_numpy().astype(np.uint32)
    return out


def _doc_seeds(masks: list[tuple[int, str]], bits):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker("decontam")
        table = bits.value
        for b in batches:
            offsets, _ = text_bytes(b.column("text"))
            ids = np.asarray(b.column("doc_id"))
            for a, e in slices(offsets, SLICE):
                h, limits = tokens(b.column("text"), a, e)
                for number, mask in masks:
                    key, at = seeds(h, limits, mask, number)
                    hit = np.arange(len(key))
                    for shift in _PROBES:
                        p = (key[hit] >> U64(shift)).astype(np.int64) & ((1 << FILTER_BITS) - 1)
                        hit = hit[((table[p >> 5] >> (p & 31).astype(np.uint32)) & 1).astype(bool)]
                    if len(hit):
                        of = np.searchsorted(limits, at[hit], "right") - 1
                        yield pa.RecordBatch.from_arrays([pa.array(ids[a + of]), pa.array(key[hit].view(np.int64)), pa.array(at[hit] - limits[of])], names=["doc_id", "seed", "doc_at"])

    return run


@lean
def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens of a document that face each item on each diagonal; the item's place 0 stands at doc_at."""
    for b in batches:
        for k in range(len(b)):
            hits = b.column("hits")[k].as_py()
            h, _ = tokens(b.column("text"), k, k + 1)
            rows = [(x["item_id"], x["diagonal"], h[max(0, x["diagonal"]) : max(0, x["diagonal"] + x["n_item"])].view(np.int64)) for x in hits]
            yield pa.RecordBatch.from_arrays(
                [pa.array([b.column("doc_id")[k].as_py()] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.int64()))],
                names=["doc_id", "item_id", "diagonal", "segment"],
            )


def longest_overlap(equal: np.ndarray, min_identity: float) -> tuple[int, int, int]:
    """The longest stretch of aligned places of which min_identity are equal: first place, length, equal tokens."""
    count = np.concatenate([[0], np.cumsum(equal)])
    level = count - min_identity * np.arange(len(count))
    # The last place that is no lower than each start is the stretch's farthest end.
    highest = np.maximum.accumulate(level[::-1])[::-1]
    length = np.searchsorted(-highest, 1e-9 - level, "right") - 1 - np.arange(len(level))
    start = int(np.argmax(length))
    end = start + int(length[start])
    return start, end - start, int(count[end] - count[start])


def _confirm(min_overlap: int, min_identity: float):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, item, diagonal, segment, words in zip(*(b.column(c).to_pylist() for c in ("doc_id", "item_id", "diagonal", "segment", "tokens")), strict=True):
                first = max(0, -diagonal)
                mine, theirs = np.array(segment, np.int64), np.array(words, np.int64)[first:]
                n = min(len(mine), len(theirs))
                start, length, same = longest_overlap(mine[:n] == theirs[:n], min_identity)
                if length >= max(1, min(min_overlap, len(words))):
                    out.append((doc, item, max(0, diagonal) + start, first + start, length, same, len(words)))
            columns = list(zip(*out, strict=True)) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "item_id", "doc_start", "item_start", "n_tokens", "n_equal", "item_tokens"])

    return run


_FOUND = "doc_id long, item_id long, doc_start long, item_start long, n_tokens long, n_equal long, item_tokens long"


def contaminated(docs: DataFrame, benchmark: DataFrame, min_overlap: int = MIN_OVERLAP, min_identity: float = MIN_IDENTITY) -> DataFrame:
    """One row for each document and benchmark item with a confirmed overlap: the longest one, in tokens of lower-case
    letters and digits.

    An overlap is a stretch of aligned tokens, at least min_overlap long (or a whole shorter item), of which min_identity
    are equal. No such overlap is missed from min_overlap 12 and min_identity 0.75 on; below that only those around a place
    where a masked window is equal are found. Documents without one have no row; null and empty texts
    match nothing; items without words neither; repeated doc_ids or item_ids count as one; an empty table on either side
    gives an empty result; other columns are left out. Only documents with a hit are read a second time.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id IS NOT NULL")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id IS NOT NULL").dropDuplicates(["item_id"])
    items = saved(items.mapInArrow(_item_rows, "item_id long, tokens array<long>").filter("size(tokens) > 0"), "items")
    short = [r["n"] for r in items.select(F.size("tokens").alias("n")).filter(f"n < {MIN_OVERLAP}").distinct().collect()]
    masks = _masks(sorted(short))
    item_seeds = saved(items.mapInArrow(_item_seeds(masks), "item_id long, seed long, item_at long"), "seeds")
    bits = spark.sparkContext.broadcast(_filter_bits(item_seeds))
    hits = docs.mapInArrow(_doc_seeds(masks, bits), "doc_id long, seed long, doc_at long").join(item_seeds, "seed")
    sizes = items.select("item_id", F.size("tokens").alias("n_item"))
    diagonals = hits.select("doc_id", "item_id", (F.col("doc_at") - F.col("item_at")).alias("diagonal")).distinct().join(sizes, "item_id")
    by_doc = saved(diagonals.groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "diagonal", "n_item")).alias("hits")), "hits")
    segments = docs.join(by_doc, "doc_id").mapInArrow(_segments, "doc_id long, item_id long, diagonal long, segment array<long>")
    found = segments.join(items, "item_id").mapInArrow(_confirm(min_overlap, min_identity), _FOUND)
    rest = F.struct("n_equal", "n_tokens", -F.col("doc_start"), -F.col("item_start"), "doc_start", "item_start", "item_tokens")
    best = found.groupBy("doc_id", "item_id").agg(F.max(rest).alias("b"))
    return best.select("doc_id", "item_id", "b.doc_start", "b.item_start", "b.n_tokens", "b.n_equal", "b.item_tokens")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any confirmed overlap, with all their columns."""
    bad = contaminated(docs, benchmark).select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(*docs.columns)
