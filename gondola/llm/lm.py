"""Cross-entropy difference of documents under a target and a background model of words and their spelling.

A token is a word with the white space after it. Both models mix how often they saw the word with how likely its bytes are
after the two bytes before each, in the manner of Witten and Bell: P(w) = (count(w) + kinds * spelled(w)) / (words + kinds).
So they share one vocabulary, all byte strings, and learn new words for as long as the corpus grows. After a word, its
followers' counts are mixed with P(w) in the same manner, for all pairs of words that follow each other. Blocks of neighbouring
documents list their distinct pairs, buckets of pairs sum what all blocks listed, and each block gets the sums back in the order
of its list, so that no pair is named twice; texts meet their block's sums there. A document of the target is scored without its
own words and pairs in the target's counts. CONTEXT_WORDS can bound the words whose followers count, for a smaller model; then
followers that aren't frequent are one class, whose share P(w) divides.
"""

from __future__ import annotations

import contextlib
import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gondola.llm.common import U64, drop_table, lean, mix, odd_numbers, prefix_hash, run_starts, saved, slices, small_batches, span_hash, take_worker, text_bytes, word_spans, write_table

#: Spelling: n-grams of ORDER bytes of UTF-8 (values 1 to 256; 0 stands before a text), TOKEN_BITS each. There are at most
#: 257**ORDER of them, 16 bytes each, however large the corpus is.
ORDER, TOKEN_BITS = 3, 9
#: Distinct n-grams, or words, that a task gathers before it hands them on.
HELD_GRAMS = 2_000_000
#: At most so many words, the most frequent ones, are broadcast with their counts; blocks list all others.
HEAD_WORDS = 1_000_000
#: Bytes of text in a block, and occurrences of pairs in a bucket, about. A word with more followers has several buckets.
BLOCK_BYTES, BUCKET_PAIRS = 2 << 20, 500_000
#: Bytes of text that are turned into arrays at once; one longer text is taken whole.
PART_BYTES = 1 << 18
#: None: all pairs are counted. A number n: only those after the n most frequent words, n * (n + 1) cells for each model.
CONTEXT_WORDS: int | None = None
#: Bits of the filter of target ids that spares all other texts the join: 8 MB at any size.
ID_BITS = 26
MODELS = ("target", "background")
_PAIR = odd_numbers(2, 57)


def gram_keys(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The n-gram that ends at each byte, packed; places before a text's start hold 0."""
    token = data.astype(np.int64) + 1
    place = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    key = token.copy()
    for back in range(1, ORDER):
        key[back:] |= np.where(place[back:] >= back, token[:-back], 0) << (TOKEN_BITS * back)
    return key


def words_of(data: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text number, and first and last byte of each token; a text's first token begins where the text does."""
    start, end, text = word_spans(data, limits)
    key = span_hash(prefix_hash(data), start, end).view(np.int64)
    begin = np.where(np.diff(text, prepend=-1) > 0, limits[text], start)
    stop = np.where(np.diff(text, append=len(limits)) > 0, limits[text + 1], np.append(begin[1:], 0))
    return key, text, begin, stop


Counts = tuple[np.ndarray, np.ndarray, np.ndarray]


def _occurrences(keys: np.ndarray, target: bool) -> Counts:
    """Each key's occurrences, all of them in texts of the target or none."""
    ordered = np.sort(keys)
    starts = run_starts(ordered)
    n = np.diff(np.append(starts, len(keys)))
    return ordered[starts], n * target, n * (not target)


def _summed(keys: np.ndarray, target: np.ndarray, background: np.ndarray) -> Counts:
    order = np.argsort(keys)
    starts = run_starts(keys[order])
    return keys[order][starts], np.add.reduceat(target[order], starts), np.add.reduceat(background[order], starts)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, key, target, background): occurrences of byte n-grams (word is false) and of words."""
    take_worker("lm")
    held: dict[bool, list[Counts]] = {False: [], True: []}

    def merged(word: bool) -> Counts:
        return _summed(*(np.concatenate(x) for x in zip(*held[word], strict=True)))

    def batch(word: bool, x: Counts) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(x[0]), word)), *(pa.array(v) for v in x)], names=["word", "key", "target", "background"])

    for b in batches:
        offsets, data = text_bytes(b.column("text"))
        chosen = np.asarray(b.column("target").fill_null(False).to_numpy(zero_copy_only=False), np.int64)
        for a, e in slices(offsets, PART_BYTES):
            limits, own = offsets[a : e + 1] - offsets[a], data[offsets[a] : offsets[e]]
            words, text, _, _ = words_of(own, limits)
            for word, keys, mine in ((False, gram_keys(own, limits), np.repeat(chosen[a:e], np.diff(limits))), (True, words, chosen[a:e][text])):
                held[word] += [_occurrences(keys[mine == target], bool(target)) for target in (0, 1) if np.any(mine == target)]
                if sum(len(h[0]) for h in held[word]) > HELD_GRAMS:
                    held[word] = [merged(word)]
                    if len(held[word][0][0]) > HELD_GRAMS // 2:
                        yield batch(word, held[word].pop())
    for word, parts in held.items():
        if parts:
            yield batch(word, merged(word))


def target_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts of the documents whose doc_id is among ids. A filter of fixed size lets go of most others before the join."""
    spark = docs.sparkSession
    place = lambda: F.pmod(F.xxhash64("doc_id"), F.lit(1 << ID_BITS))
    words = ids.select(place().alias("p")).select(F.shiftright("p", 5).alias("w"), F.expr("shiftleft(1L, CAST(p & 31 AS INT))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    table = np.zeros(1 << (ID_BITS - 5), np.uint32)
    table[words["w"].to_numpy()] = words["b"].to_numpy().astype(np.uint32)
    bits = spark.sparkContext.broadcast(table)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = b.column("p").to_numpy()
            yield b.filter(pa.array(((bits.value[p >> 5] >> (p & 31).astype(np.uint32)) & 1).astype(bool))).select(["doc_id", "text"])

    some = docs.filter("doc_id IS NOT NULL").select("doc_id", "text", place().alias("p")).mapInArrow(keep, "doc_id long, text string")
    return some.join(ids, "doc_id", "left_semi").select("text")


def marked(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """(text, target): all documents for the background model, and those of the target once more for its own."""
    return docs.select("text", F.lit(False).alias("target")).unionByName(chosen.select("text", F.lit(True).alias("target")))


def count_grams(docs: DataFrame) -> DataFrame:
    """(word, key, target, background) over rows of (text, target): summed in tasks first, then by key."""
    small_batches(docs.sparkSession)
    parts = docs.select("text", "target").mapInArrow(lean(_count), "word boolean, key long, target long, background long")
    return parts.groupBy("word", "key").agg(*(F.sum(m).alias(m) for m in MODELS))


def _pairs(top: np.ndarray):
    """(cell, target, background): how often each word of top (sorted keys) is followed by each other, or by any word besides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker("lm")
        width = len(top) + 1
        counts = [np.zeros(len(top) * width, np.int64) for _ in MODELS]
        for b in batches:
            offsets, data = text_bytes(b.column("text"))
            chosen = np.asarray(b.column("target").to_numpy(zero_copy_only=False), bool)
            for a, e in slices(offsets, PART_BYTES):
                key, text, _, _ = words_of(data[offsets[a] : offsets[e]], offsets[a : e + 1] - offsets[a])
                before, cell = pair_cells(key, text, top)
                at = np.flatnonzero(before >= 0)
                for k, mine in enumerate((chosen[a:e], ~chosen[a:e])):
                    own = cell[at[mine[text[at]]]]
                    counts[k] += np.bincount(own, minlength=len(counts[k]))
        some = np.flatnonzero(counts[0] + counts[1])
        yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(c[some]) for c in counts)], names=["cell", *MODELS])

    return run


def pair_cells(key: np.ndarray, text: np.ndarray, top: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word the place in top of the word before it in its text (-1: none, or not there), and the pair's cell."""
    place = np.minimum(np.searchsorted(top, key), max(0, len(top) - 1))
    place = np.where(top[place] == key, place, -1) if len(top) else np.full(len(key), -1)
    before = np.full(len(key), -1)
    before[1:] = np.where(text[1:] == text[:-1], place[:-1], -1)
    return before, before * (len(top) + 1) + np.where(place >= 0, place, len(top))


def count_pairs(docs: DataFrame, top: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both models' tables of pairs, top by top and one column for all other followers."""
    cells = docs.mapInArrow(_pairs(top), "cell long, target long, background long").groupBy("cell").agg(*(F.sum(m).alias(m) for m in MODELS)).toArrow()
    out = []
    for m in MODELS:
        table = np.zeros(len(top) * (len(top) + 1))
        table[cells["cell"].to_numpy()] = cells[m].to_numpy()
        out.append(table.reshape(len(top), len(top) + 1))
    return out[0], out[1]


#: Follows each word that isn't broadcast in the lists, for its own occurrences; above all numbers of frequent words.
ITSELF = 1 << 32
_RARE = np.int64(-1 << 63)
_LISTED = "bucket int, block long, check long, befores binary, sizes binary, afters binary, counts binary"
_RETURNED = "bucket int, block long, check long, befores binary, seen_target binary, seen_background binary"
_RETURNED += ", followed_target binary, followed_background binary, kinds_target binary, kinds_background binary"


def _packed(x: np.ndarray) -> bytes:
    """How many bytes the numbers need, and these, equal ones side by side, which compress well."""
    x = x.astype(np.int64)
    wide = 8 if x.min(initial=0) < 0 else max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    return bytes([wide]) + np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T[:wide]).tobytes()


def _unpacked(raw: list[bytes]) -> np.ndarray:
    sizes = [(len(r) - 1) // r[0] for r in raw]
    out = np.zeros((sum(sizes), 8), np.uint8)
    for r, n, at in zip(raw, sizes, np.cumsum([0, *sizes]), strict=False):
        out[at : at + n, : r[0]] = np.frombuffer(r, np.uint8, offset=1).reshape(r[0], n).T
    return out.view(np.int64).ravel()


def _batch(schema: str, columns: list) -> pa.RecordBatch:
    types = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary(), "string": pa.string()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(v, types[t]) for v, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


class Lists:
    """How a block lists its pairs: frequent words by their number (the most frequent is 0), others by a negative hash."""

    def __init__(self, keys: np.ndarray, often: np.ndarray, words: int, pairs: bool):
        self.head, self.pairs = GramTable(keys), pairs
        self.parts = often[: np.count_nonzero(often >= BUCKET_PAIRS)] // BUCKET_PAIRS + 1
        self.buckets = words // BUCKET_PAIRS + 1

    def codes(self, key: np.ndarray) -> np.ndarray:
        at = self.head.find(key)
        return np.where(at >= 0, at, key | _RARE)

    def entries(self, key: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, ...]:
        """Bucket, first word, follower and count of each distinct pair, by bucket; where each pair's second word is, then where
        each word is that isn't broadcast, and which entry is theirs; each word's number, from 0, and these words' codes."""
        at = np.flatnonzero(text[1:] == text[:-1]) + 1 if self.pairs else np.zeros(0, np.int64)
        own, number = np.unique(key, return_inverse=True)
        own = self.codes(own)
        rare = np.flatnonzero(own[number] < 0)
        width = len(own) + 1
        cells, of, count = np.unique(np.concatenate([number[at - 1] * width + number[at], number[rare] * width + len(own)]), return_inverse=True, return_counts=True)
        before, after = own[cells // width], np.append(own, ITSELF)[cells % width]
        parts = np.ones(len(before), np.int64)
        several = (before >= 0) & (before < len(self.parts))
        parts[several] = self.parts[before[several]]
        part = mix(after.view(U64) * _PAIR[1]) % parts.view(U64)
        bucket = (mix(before.view(U64) * _PAIR[0] + part) % U64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        return bucket[order], before[order], after[order], count[order], at, rare, place[of], number, own


def _runs(bucket: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Where another first word's entries, or another bucket's, begin."""
    new = np.ones(len(before), bool)
    new[1:] = (before[1:] != before[:-1]) | (bucket[1:] != bucket[:-1])
    return np.flatnonzero(new)


def _lists(bucket: np.ndarray, before: np.ndarray, after: np.ndarray) -> Iterator[tuple[slice, int, bytes, bytes, bytes, int]]:
    """For each bucket its entries, number, first words, how many followers each has, followers, and a checksum of all."""
    ends = np.append(run_starts(bucket), len(bucket))
    for a, e in zip(ends[:-1], ends[1:], strict=True):
        runs = _runs(bucket[a:e], before[a:e])
        befores, sizes, afters = _packed(before[a:e][runs]), _packed(np.diff(np.append(runs, e - a))), _packed(after[a:e])
        yield slice(a, e), int(bucket[a]), befores, sizes, afters, zlib.crc32(afters, zlib.crc32(sizes, zlib.crc32(befores)))


def in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows of a task's (row_id, text), with offsets and bytes of their texts and their block, which bears its first row's id."""
    block, size = -1, BLOCK_BYTES
    for b in batches:
        offsets, data = text_bytes(b.column("text"))
        for a, e in slices(offsets, PART_BYTES):
            if size >= BLOCK_BYTES:
                block, size = b.column("row_id")[a].as_py(), 0
            size += int(offsets[e] - offsets[a]) + 16 * (e - a)
            yield block, b.slice(a, e - a), offsets[a : e + 1] - offsets[a], data[offsets[a] : offsets[e]]


def _with_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block, b, _, _ in in_blocks(batches):
        yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, block)), *b.columns], names=["block", *b.schema.names])


def _list_blocks(shared, target: bool) -> Callable:
    """The lists of each block's distinct pairs and rare words; those of the target's texts bear no block."""

    def listed(block: int, parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        bucket, before, after, count, *_ = shared.value.entries(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        rows = [(n, None if target else block, check, befores, sizes, afters, _packed(count[at])) for at, n, befores, sizes, afters, check in _lists(bucket, before, after)]
        return _batch(_LISTED, list(zip(*rows, strict=True)) or [[]] * 7)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker("lm")
        now, held, texts = -1, [], 0
        for block, b, limits, own in in_blocks(batches):
            if block != now and held:
                yield listed(now, held)
                held = []
            key, text, _, _ = words_of(own, limits)
            held.append((key, (text + texts).astype(np.int32)))
            now, texts = block, texts + b.num_rows
        if held:
            yield listed(now, held)

    return lean(run)


def _sum_bucket(table: pa.Table) -> pa.Table:
    """For each block's list the sums over all lists, in its order: how often each pair was seen, and of first words that aren't
    broadcast how often they were followed and by how many kinds. A last row without block has these of broadcast words."""
    take_worker("lm")
    raw = table.to_pydict()
    sizes, starts = [_unpacked([x]) for x in raw["sizes"]], [_unpacked([x]) for x in raw["befores"]]
    first = np.concatenate([np.cumsum(x) - x + k for x, k in zip(sizes, np.cumsum([0, *(x.sum() for x in sizes)]), strict=False)])
    before = np.repeat(np.concatenate(starts), np.concatenate(sizes))
    after, count = _unpacked(raw["afters"]), _unpacked(raw["counts"])
    own = np.repeat([b is None for b in raw["block"]], [x.sum() for x in sizes])
    key = np.repeat(np.unique(np.concatenate(starts), return_inverse=True)[1], np.concatenate(sizes)) << 34
    key[after >= 0] |= after[after >= 0]
    key[after < 0] |= np.unique(after[after < 0], return_inverse=True)[1] + ITSELF + 1
    order = np.argsort(key)
    runs = run_starts(key[order])
    pair = np.empty(len(order), np.int64)
    pair[order] = np.repeat(np.arange(len(runs)), np.diff(np.append(runs, len(order))))
    seen = [np.add.reduceat(np.where(mine, count, 0)[order], runs) for mine in (own, ~own)]
    words, follows = before[order][runs], after[order][runs] != ITSELF
    kept = run_starts(words)
    word = np.repeat(np.arange(len(kept)), np.diff(np.append(kept, len(words))))
    sums = [*(np.add.reduceat(s * follows, kept) for s in seen), *(np.add.reduceat((s > 0) & follows, kept, dtype=np.int64) for s in seen)]
    rows, at, runs_before = [], 0, 0
    for k, block in enumerate(raw["block"]):
        n, m = int(sizes[k].sum()), len(sizes[k])
        if block is not None:
            mine = pair[at : at + n]
            rare = word[pair[first[runs_before : runs_before + m][starts[k] < 0]]]
            rows.append((raw["bucket"][k], block, raw["check"][k], None, *(_packed(s[mine]) for s in seen), *(_packed(s[rare]) for s in sums)))
        at, runs_before = at + n, runs_before + m
    head = words[kept] >= 0
    rows.append((raw["bucket"][0], None, None, _packed(words[kept][head]), None, None, *(_packed(s[head]) for s in sums)))
    return pa.Table.from_batches([_batch(_RETURNED, list(zip(*rows, strict=True)))])


def _head_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield _batch(_HEAD, [_unpacked(b.column(c).to_pylist()) for c in ("befores", *_SUMS)])


_SUMS = tuple(f"{n}_{m}" for n in ("followed", "kinds") for m in MODELS)
_HEAD = ", ".join(f"{c} long" for c in ("word", *_SUMS))


def block_sums(docs: DataFrame, target: DataFrame, lists: Lists) -> tuple[DataFrame, pa.Table]:
    """What _sum_bucket gives back to the blocks of docs (row_id, text), and for broadcast words (number, followed_*, kinds_*)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(lists)
    listed = docs.mapInArrow(_list_blocks(shared, False), _LISTED).unionByName(target.select(F.monotonically_increasing_id().alias("row_id"), "text").mapInArrow(_list_blocks(shared, True), _LISTED))
    returned = saved(listed.groupBy("bucket").applyInArrow(_sum_bucket, _RETURNED), "sums")
    head = returned.filter("block IS NULL").mapInArrow(_head_rows, _HEAD).groupBy("word").agg(*(F.sum(c).alias(c) for c in _SUMS)).toArrow()
    return returned.filter("block IS NOT NULL").drop("befores"), head


def _low(key: Column, n: int) -> Column:
    return key.bitwiseAND(F.lit((1 << (TOKEN_BITS * n)) - 1))


def losses(grams: DataFrame) -> DataFrame:
    """(gram, loss_target, loss_background): negative natural logs of both models' probabilities of the last token.

    Both are interpolated in the manner of Witten and Bell down to a uniform distribution over the tokens seen in the
    corpus; a context that a model hasn't seen passes on the shorter context's probability.
    """
    models = MODELS
    tokens = grams.select(_low(F.col("gram"), 1).alias("t")).distinct().count()
    lower = None
    for n in range(1, ORDER + 1):
        these = grams if n == ORDER else grams.groupBy(_low(F.col("gram"), n).alias("gram")).agg(*(F.sum(m).alias(m) for m in models))
        these = these.withColumn("context", F.shiftrightunsigned("gram", TOKEN_BITS))
        contexts = these.groupBy("context").agg(*(F.sum(m).alias(f"sum_{m}") for m in models), *(F.count_if(F.col(m) > 0).alias(f"kinds_{m}") for m in models))
        these = these.join(contexts, "context")
        if lower is None:
            these = these.select("*", *(F.lit(1.0 / max(tokens, 1)).alias(f"lower_{m}") for m in models))
        else:
            these = these.withColumn("rest", _low(F.col("gram"), n - 1)).join(lower, "rest")
        p = [F.when(F.col(f"sum_{m}") == 0, F.col(f"lower_{m}")).otherwise((F.col(m) + F.col(f"kinds_{m}") * F.col(f"lower_{m}")) / (F.col(f"sum_{m}") + F.col(f"kinds_{m}"))).alias(f"lower_{m}") for m in models]
        lower = these.select(F.col("gram").alias("rest"), *p)
    return lower.select(F.col("rest").alias("gram"), *((-F.log(f"lower_{m}")).cast("float").alias(f"loss_{m}") for m in models))


class GramTable:
    """Open addressing over sorted arrays' worth of keys: vectors of keys to rows, every key being there."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(len(keys) * 2 - 1).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int64)
        self.rows = np.zeros(1 << self.bits, np.int32)
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.slots[at] == -1
            self.rows[at[free]] = left[free]
            self.slots[at[free]] = keys[left[free]]
            placed = self.slots[at] == keys[left]
            self.rows[at[placed]] = left[placed]
            left, at = left[~placed], (at[~placed] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(U64) * U64(0x9E3779B97F4A7C15)) >> U64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Each key's row, -1 if it has none."""
        at = self._slot(keys)
        out = self.rows[at].astype(np.int64)
        left = np.flatnonzero(self.slots[at] != keys)
        at = at[left]
        while len(left):
            free = self.slots[at] == -1
            out[left[free]] = -1
            left, at = left[~free], (at[~free] + 1) & ((1 << self.bits) - 1)
            out[left] = self.rows[at]
            missed = self.slots[at] != keys[left]
            left, at = left[missed], at[missed]
        return out


def _narrow(x: np.ndarray) -> np.ndarray:
    return x.astype(np.int32) if x.max(initial=0) < 1 << 31 else x


class WordModel:
    """What scoring needs of both models: losses of byte n-grams, counts of frequent words, kinds of words and all words, and
    either how often frequent words are followed and by how many kinds (the pairs come with each block), or dense counts of
    pairs after top. A model without words has only its spelling."""

    def __init__(self, grams: pa.Table, head: pa.Table, totals: dict[str, tuple[int, int]], lists: Lists, contexts: pa.Table, top: np.ndarray, pairs: tuple[np.ndarray, np.ndarray]):
        self.lists, self.grams = lists, GramTable(grams["gram"].to_numpy())
        self.losses = [grams[f"loss_{m}"].to_numpy() for m in MODELS]
        self.counts = [_narrow(head[m].to_numpy()) for m in MODELS]
        self.words, self.kinds = [totals[m][0] for m in MODELS], [totals[m][1] for m in MODELS]
        self.contexts = [np.zeros(len(head), np.int64) for _ in _SUMS]
        for c, x in zip(_SUMS, self.contexts, strict=True):
            x[contexts["word"].to_numpy()] = contexts[c].to_numpy()
        self.contexts = [_narrow(x) for x in self.contexts]
        self.top, self.pairs = top, [t.ravel() for t in pairs]
        self.followed, self.followers = [t.sum(axis=1) for t in pairs], [(t > 0).sum(axis=1).astype(float) for t in pairs]
        in_top = np.isin(head["key"].to_numpy(), top)
        self.outside = [(self.words[k] - self.counts[k][in_top].sum() + self.kinds[k]) / (self.words[k] + self.kinds[k]) if self.kinds[k] else 1.0 for k in range(2)]

    def log_kinds(self, k: int) -> float:
        return math.log(self.kinds[k]) if self.kinds[k] else 0.0


def _times(keys: np.ndarray, text: np.ndarray) -> np.ndarray:
    """How often each row's key, a number from 0, occurs in its text."""
    if not len(keys):
        return np.zeros(0, np.int64)
    _, of, times = np.unique(text * (int(keys.max()) + 1) + keys, return_inverse=True, return_counts=True)
    return times[of]


#: Above it, exp of a log is near the end of doubles, and kinds of followers no longer add to it.
MOST_LOG = 600.0
#: What is scored: the target model, the background model, and the target model without the document's own counts.
SCORES = ("target", "background", "own")
_SCORED = "doc_id long, n_tokens long, sum_target double, sum_background double, sum_own double"


REREAD = "the documents' rows, or their order, differ when they are read again"


def _block_counts(bucket: np.ndarray, before: np.ndarray, after: np.ndarray, contexts: list[np.ndarray], returned: pa.Table) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For a block's entries how often each is seen, and its first word's sums (followed by, kinds of followers), for both models."""
    sums = returned.sort_by("bucket")
    if [x[-1] for x in _lists(bucket, before, after)] != sums["check"].to_pylist():
        raise RuntimeError(REREAD)
    seen = [_unpacked(sums[f"seen_{m}"].to_pylist()) for m in MODELS]
    runs = _runs(bucket, before)
    rare = np.zeros(len(before), bool)
    rare[runs] = before[runs] < 0
    nth, out = np.cumsum(rare) - 1, []
    for c, of_head in zip(_SUMS, contexts, strict=True):
        own = _unpacked(sums[c].to_pylist())
        x = np.empty(len(before), np.int64)
        x[before < 0], x[before >= 0] = own[nth[before < 0]], of_head[before[before >= 0]]
        out.append(x)
    return seen, out


def _score_block(model) -> Callable:
    """A row for each text of a block with its summed losses under each of SCORES."""

    def run(docs: pa.Table, returned: pa.Table) -> pa.Table:
        take_worker("lm")
        m: WordModel = model.value
        offsets, data = text_bytes(docs["text"])
        n = len(offsets) - 1
        if not n:
            raise RuntimeError(REREAD)
        parts = []
        for a, e in slices(offsets, PART_BYTES):
            limits, own = offsets[a : e + 1] - offsets[a], data[offsets[a] : offsets[e]]
            gram = m.grams.find(gram_keys(own, limits))
            key, text, begin, stop = words_of(own, limits)
            upto = [np.concatenate([[0.0], np.cumsum(m.losses[k][gram], dtype=np.float64)]) for k in range(2)]
            parts.append((key, text + a, *(u[stop] - u[begin] for u in upto)))
        key, text, *spelled = (np.concatenate(x) for x in zip(*parts, strict=True))
        del data, parts, gram, upto
        size = np.bincount(text, minlength=n)
        bucket, before, after, _, at, rare, entry, word, code = m.lists.entries(key, text)
        seen, contexts = _block_counts(bucket, before, after, m.contexts, returned)
        pair, known = entry[: len(at)], code >= 0
        count = [np.zeros(len(code), np.int64) for _ in MODELS]
        for k in range(2):
            count[k][known], count[k][word[rare]] = m.counts[k][code[known]], seen[k][entry[len(at) :]]
            count[k] = count[k][word]
        times, pair_times = _times(word, text), _times(pair, text[at])
        last = word[np.cumsum(size) - 1] if len(word) else word
        context_times = times[at - 1] - (word[at - 1] == last[text[at]])
        preceding, cell = pair_cells(key, text, m.top)
        dense = np.flatnonzero(preceding >= 0)
        dense_times, dense_context = _times(cell[dense], text[dense]), _times(preceding[dense], text[dense])
        other = cell[dense] % (len(m.top) + 1) == len(m.top)
        sums = []
        for k, without in ((0, False), (1, False), (0, True)):
            if m.kinds[k]:
                seen_word, rest = np.maximum(0.0, count[k] - without * times), m.log_kinds(k) - spelled[k]
                logs = np.where(seen_word > 0, np.log(np.exp(rest) + np.where(seen_word > 0, seen_word, 1.0)), rest)
                logs -= np.log(np.maximum(0.0, m.words[k] - without * size[text]) + m.kinds[k])
            else:
                logs = -spelled[k]
            # log(seen / P(w) + kinds), in logs: P(w) of a long word may be too small for a double.
            followed, kinds = contexts[k][pair], contexts[2 + k][pair].astype(float)
            learnt = kinds > 0
            kinds[~learnt] = 1.0
            with np.errstate(divide="ignore"):
                ratio = np.log(np.maximum(0.0, seen[k][pair] - without * pair_times)) - logs[at]
            share = np.where(ratio < MOST_LOG, np.log(np.exp(np.minimum(ratio, MOST_LOG)) + kinds), ratio)
            logs[at] += np.where(learnt, share - np.log(np.maximum(0.0, followed - without * context_times) + kinds), 0.0)
            if len(dense):
                had = np.maximum(0.0, m.pairs[k][cell[dense]] - without * dense_times)
                context, kinds = np.maximum(0.0, m.followed[k][preceding[dense]] - without * dense_context), m.followers[k][preceding[dense]]
                learnt = kinds > 0
                # A frequent follower has its own count; others share their class's by their own probability.
                share = np.where(other, np.log(np.where(learnt, had / m.outside[k] + kinds, 1.0)), np.log(np.where(learnt, had * np.exp(-logs[dense]) + kinds, 1.0)))
                logs[dense] += np.where(learnt, share - np.log(np.where(learnt, context + kinds, 1.0)), 0.0)
            sums.append(-np.bincount(text, weights=logs, minlength=n))
        return pa.Table.from_batches([_batch(_SCORED, [docs["doc_id"].combine_chunks(), size, *sums])])

    return run


def _least_frequent(words: DataFrame, most: int) -> int:
    """The least count such that at most `most` words have it or more. Counts are gathered by steps of 1/16 of a doubling, a
    few hundred rows for any corpus."""
    step = F.floor(F.log2("background") * 16)
    least, have = 1 << 62, 0
    for r in words.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.min("background").alias("least")).orderBy(F.col("step").desc()).collect():
        have += r["n"]
        if have > most:
            break
        least = r["least"]
    return least


@contextlib.contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Spark drops each query's shuffle files when it ends, instead of when the driver collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def cross_entropy_difference(docs: DataFrame, target_ids: DataFrame, head_words: int = HEAD_WORDS) -> DataFrame:
    """doc_id, n_tokens, ce_target, ce_background and ce_difference (target less background; lower is more like the
    target), in nats a word, of every whole text.

    The target model counts the documents whose doc_id is in target_ids, the background model all documents; smoothing and
    vocabulary are the same. Of a target document the target model leaves the document's own words and pairs out (not its
    spelling, nor its kinds of words). Null and empty texts, and texts without words, have 0 tokens and null scores; repeated
    doc_ids and rows without one stay; without target documents the target model spells words uniformly; an empty table gives
    an empty one; other columns are left out. head_words bounds what is broadcast; the scores don't depend on it. All pairs
    count, unless CONTEXT_WORDS bounds the words whose followers do. Texts are read three times, the last time to be shuffled
    to what their block got back; if rows or their order then differ (not those of a table's files), all is done again from a
    written copy.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with _shuffles_dropped(spark):
        try:
            return _scores(docs, target_ids, head_words)
        except Exception as e:  # Spark's error holds the worker's
            if REREAD not in str(e):
                raise
        return _scores(saved(docs, "documents"), target_ids, head_words)


def _scores(docs: DataFrame, target_ids: DataFrame, head_words: int) -> DataFrame:
    spark = docs.sparkSession
    ids = target_ids.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id IS NOT NULL").distinct()
    target, target_path = write_table(target_texts(docs, ids), "target")
    both = marked(docs, target)
    counts, counts_path = write_table(count_grams(both), "counts")
    grams = losses(counts.filter("NOT word").select(F.col("key").alias("gram"), *MODELS)).toArrow()
    words = counts.filter("word").select("key", *MODELS)
    totals = words.agg(*(f(m).alias(f"{n}_{m}") for m in MODELS for n, f in (("n", F.sum), ("kinds", lambda c: F.count_if(F.col(c) > 0))))).first()
    totals = {m: (totals[f"n_{m}"] or 0, totals[f"kinds_{m}"]) for m in MODELS}
    top = np.sort(words.orderBy(F.col("background").desc(), "key").limit(CONTEXT_WORDS or 0).select("key").toArrow()["key"].to_numpy())
    frequent = (F.col("background") >= _least_frequent(words, head_words)) | F.col("key").isin(top.tolist())
    head = words.filter(frequent).toArrow().sort_by([("background", "descending"), ("key", "ascending")])
    drop_table(spark, counts_path)
    lists = Lists(head["key"].to_numpy(), head["background"].to_numpy(), totals["background"][0] + totals["target"][0], CONTEXT_WORDS is None)
    numbered = docs.withColumn("row_id", F.monotonically_increasing_id())
    returned, contexts = block_sums(numbered.select("row_id", "doc_id", "text"), target, lists)
    dense = count_pairs(both, top) if len(top) else (np.zeros((0, 1)), np.zeros((0, 1)))
    drop_table(spark, target_path)
    model = spark.sparkContext.broadcast(WordModel(grams, head, totals, lists, contexts, top, dense))
    blocks = numbered.select("row_id", "doc_id", "text").mapInArrow(_with_block, "block long, row_id long, doc_id long, text string").drop("row_id")
    scored = saved(blocks.groupBy("block").cogroup(returned.groupBy("block")).applyInArrow(_score_block(model), _SCORED), "scored")
    rows = scored.join(ids.withColumn("in_target", F.lit(True)), "doc_id", "left")
    n = F.when(F.col("n_tokens") > 0, F.col("n_tokens"))
    ce = [F.when(F.col("in_target"), F.col("sum_own")).otherwise(F.col("sum_target")) / n, F.col("sum_background") / n]
    return rows.select("doc_id", "n_tokens", *(c.alias(f"ce_{m}") for c, m in zip(ce, MODELS, strict=True)), (ce[0] - ce[1]).alias("ce_difference"))
