"""Near duplicates by b-bit MinHash: bands propose, packed signatures estimate, full shingle sets confirm."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gondola.llm.common import U64, mix, odd_numbers, saved, shingle_sets, slices, small_batches, take_worker, text_bytes

#: Two documents with 75 % of their shingles in common miss all bands with probability (1 - 0.75**4)**32 < 6e-6.
BANDS, ROWS = 32, 4
#: Minima that a candidate's signature holds, bits kept of each, and how many fill a long.
HASHES, BITS = 512, 4
PER_LONG = 64 // BITS
PERCENT = 75
#: A pair goes on to its full sets unless its estimate lies five standard deviations (0.02 each) under the threshold.
MARGIN = 0.10
#: Bits of a set's bitmap, one for each value of 12 bits of a shingle's hash; it bounds what two sets can share.
BITMAP_BITS = 4096
#: Rounds in which each bucket's members meet one member of another component; then the pairs that are left meet.
HUB_ROUNDS = 2

_FACTORS, _MASKS = odd_numbers(BANDS * ROWS + HASHES, 101), odd_numbers(BANDS * ROWS + HASHES, 202)
_BAND_FACTORS = odd_numbers(ROWS, 303)
_SIGNED = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>"
_SETS = "doc_id long, n_shingles long, signature array<long>, bitmap array<long>, shingles array<long>"


def _lists(values: np.ndarray) -> pa.ListArray:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(values).view(np.int64).ravel()))


def minima(h: np.ndarray, starts: np.ndarray, first: int = BANDS * ROWS, n: int = HASHES) -> np.ndarray:
    """The minimum of each of n hash functions, from the first on, over each run of shingle hashes. Bands use the functions
    before those of the signatures, so an estimate doesn't depend on a shared band."""
    out = np.empty((n, len(starts)), U64)
    for k in range(n):
        out[k] = np.minimum.reduceat((h ^ _MASKS[first + k]) * _FACTORS[first + k], starts)
    return out


def pack_bits(least: np.ndarray) -> np.ndarray:
    """The low bits of mixed minima, PER_LONG of them in each long."""
    bits = mix(least) & U64((1 << BITS) - 1)
    out = np.zeros((least.shape[1], HASHES // PER_LONG), U64)
    for k in range(HASHES):
        out[:, k // PER_LONG] |= bits[k] << U64(BITS * (k % PER_LONG))
    return out


def band_keys(least: np.ndarray) -> np.ndarray:
    out = np.empty((least.shape[1], BANDS), U64)
    for b in range(BANDS):
        key = np.full(least.shape[1], b, U64)
        for r in range(ROWS):
            key = mix(key + least[b * ROWS + r] * _BAND_FACTORS[r])
        out[:, b] = key
    return out


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    take_worker("neardup")
    for batch in batches:
        offsets, data = text_bytes(batch.column("text"))
        ids = batch.column("doc_id")
        for a, b in slices(offsets):
            h, of = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            n = np.bincount(of, minlength=b - a)
            some = np.flatnonzero(n)
            set_a, set_b = np.zeros(b - a, U64), np.zeros(b - a, U64)
            bands = np.zeros((b - a, BANDS), U64)
            if len(some):
                starts = (np.cumsum(n) - n)[some]
                set_a[some], set_b[some] = np.add.reduceat(mix(h + U64(1)), starts), np.add.reduceat(mix(h + U64(2)), starts)
                bands[some] = band_keys(minima(h, starts, 0, BANDS * ROWS))
            yield pa.RecordBatch.from_arrays(
                [ids.slice(a, b - a), pa.array(n.astype(np.int64)), pa.array(set_a.view(np.int64)), pa.array(set_b.view(np.int64)), _lists(bands)],
                names=["doc_id", "n_shingles", "set_a", "set_b", "bands"],
            )


def signatures(docs: DataFrame) -> DataFrame:
    """Size, fingerprint and band keys of each document's shingle set."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_sign, _SIGNED)


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    take_worker("neardup")
    for batch in batches:
        offsets, data = text_bytes(batch.column("text"))
        for a, b in slices(offsets):
            h, of = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            n = np.bincount(of, minlength=b - a)
            limits = np.concatenate([[0], np.cumsum(n)])
            signature, some = np.zeros((b - a, HASHES // PER_LONG), U64), np.flatnonzero(n)
            if len(some):
                signature[some] = pack_bits(minima(h, limits[some]))
            shingles = pa.ListArray.from_arrays(pa.array(limits.astype(np.int32)), pa.array(h.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(n.astype(np.int64)), _lists(signature), _lists(bitmaps(h, of, b - a)), shingles], names=["doc_id", "n_shingles", "signature", "bitmap", "shingles"])


def bitmaps(h: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """For each of n sets of hashes h (of: each one's set) the bits that its hashes set, as longs."""
    set_bits = np.zeros((n, BITMAP_BITS), bool)
    set_bits[of, (mix(h + U64(3)) & U64(BITMAP_BITS - 1)).astype(np.int64)] = True
    return np.packbits(set_bits, axis=1, bitorder="little").view(U64)


def most_common(a: Column, n_a: Column, b: Column, n_b: Column) -> Column:
    """The most that two sets can share, from their bitmaps and sizes: each bit that only one of them sets stands for at
    least one member that the other lacks. Never less than what they do share."""
    alone = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: F.bit_count(u.bitwiseAND(F.bitwise_not(v)))), F.lit(0), lambda n, k: n + k)
    return F.least(n_a - alone(a, b), n_b - alone(b, a))


def estimate(a: Column, b: Column) -> Column:
    """Similarity from packed signatures: equal places by bit counts, less the share that is equal by chance."""
    ones = int("0001" * PER_LONG, 2)
    ones = ones - (1 << 64) if ones >= 1 << 63 else ones

    def unequal(k: int) -> Column:
        x = F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))
        for shift in (1, 2):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        return F.bit_count(x.bitwiseAND(F.lit(ones)))

    share = F.lit(1.0) - sum((unequal(k) for k in range(1, HASHES // PER_LONG)), unequal(0)) / F.lit(float(HASHES))
    chance = 2.0**-BITS
    return (share - chance) / (1 - chance)


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) of each end of the edges (a, b): the smallest id reachable. Alternating large and small stars; each
    round is one aggregation and one join, so a hub with many edges is pre-aggregated and its join may be split. As soon as no
    id has two smaller neighbours, the edges are parents, and are followed by doubling instead."""
    now = saved(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    while now.count() > now.select("u").distinct().count():
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(now.join(least, "u").select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        large = saved(large, "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        now = saved(small.select("u", F.col("m").alias("v")).unionByName(small.select(F.col("v").alias("u"), F.col("m").alias("v"))).filter("u <> v").distinct(), "edges")
    found = roots(now.toDF("id", "component"))
    return saved(found.unionByName(found.select(F.col("component").alias("id"), "component").distinct()), "components")


def roots(parents: DataFrame) -> DataFrame:
    """(id, component) of each id of (id, component), followed to the end by doubling; each id has one smaller parent."""
    now = parents
    while True:
        up = now.select(F.col("id").alias("component"), F.col("component").alias("above"))
        now = saved(now.join(up, "component", "left").select("id", F.coalesce("above", "component").alias("component"), F.col("above").isNotNull().alias("moved")), "parents")
        if now.filter("moved").isEmpty():
            return now.drop("moved")
        now = now.drop("moved")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each document.

    Sets are the distinct 5-word shingles of the whole text in lower case; a shorter text is one shingle, one without
    words has none and is linked with nothing. Linked are documents with 100 * intersection >= percent * union, confirmed
    on full sets; a component has the smallest doc_id that its links reach. Documents of equal sets form a class that its
    smallest doc_id stands for. In each band a bucket's members first meet one member (the smallest, then others), so a
    large group becomes one component without its pairs; only pairs of different components in a bucket meet at last, and
    what estimates and bitmaps refute of them isn't written.
    Null texts count as empty; rows without doc_id take part as texts, but their component_id and kept are null; repeated
    doc_ids stay, but of different texts under one doc_id any one may stand for all; an empty table gives an empty one; other
    columns are left out.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = saved(signatures(docs), "signatures")
    full = signed.filter("n_shingles > 0")
    # Written before it is joined: a set that many documents share then meets plain exchanges, which Spark can split.
    classes = saved(full.groupBy("n_shingles", "set_a", "set_b").agg(F.min("doc_id").alias("rep")), "classes")
    members = saved(signed.select("doc_id", "n_shingles", "set_a", "set_b").join(classes, ["n_shingles", "set_a", "set_b"], "left").select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep")), "members")
    reps = full.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").select(F.col("doc_id").alias("rep"), "bands").dropDuplicates(["rep"])
    in_bands = reps.select("rep", F.explode("bands").alias("bucket"))
    shared = in_bands.groupBy("bucket").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).filter("low <> high").select("bucket")
    buckets = saved(in_bands.join(shared, "bucket"), "buckets")
    some = buckets.select("rep").distinct()
    sets = saved(docs.join(some.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"]).mapInArrow(_set_rows, _SETS), "sets")
    least = percent / 100 - MARGIN

    def sized(side: str, *more: str) -> DataFrame:
        return sets.select(F.col("doc_id").alias(side), F.col("n_shingles").alias(f"n_{side}"), F.col("signature").alias(f"s_{side}"), *(F.col(c).alias(f"{c}_{side}") for c in more))

    def likely() -> Column:
        sizes = F.lit(100) * F.least("n_a", "n_b") >= F.lit(percent) * F.greatest("n_a", "n_b")
        return sizes & (estimate(F.col("s_a"), F.col("s_b")) >= least)

    def possible() -> Column:
        most = most_common(F.col("bitmap_a"), F.col("n_a"), F.col("bitmap_b"), F.col("n_b"))
        return F.lit(100) * most >= F.lit(percent) * (F.col("n_a") + F.col("n_b") - most)

    def confirmed(pairs: DataFrame, *keep: str) -> DataFrame:
        """Of pairs (a, b) with their sizes, those linked by their full sets."""
        for side in ("a", "b"):
            pairs = pairs.join(sets.select(F.col("doc_id").alias(side), F.col("shingles").alias(f"set_{side}")), side)
        common = F.size(F.array_intersect("set_a", "set_b"))
        return pairs.filter(F.lit(100) * common >= F.lit(percent) * (F.col("n_a") + F.col("n_b") - common)).select(*keep)

    # Each class meets the smallest member of its buckets; what is linked points to a smaller class.
    low = buckets.groupBy("bucket").agg(F.min("rep").alias("hub"))
    pairs = buckets.join(low, "bucket").filter("rep <> hub").groupBy(F.col("rep").alias("a")).agg(F.min("hub").alias("b"))
    first = saved(confirmed(pairs.join(sized("a"), "a").join(sized("b"), "b").filter(likely()).drop("s_a", "s_b"), "a", "b"), "links")
    components = roots(first.toDF("id", "component"))
    for turn in range(1, HUB_ROUNDS + 1):
        # Buckets that still hold more than one component, with each member's component.
        now = buckets.join(components.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        mixed = now.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min(F.struct("rep", "component")).alias("hub")).filter("low <> high")
        left = now.join(mixed.select("bucket", "hub"), "bucket")
        if turn < HUB_ROUNDS:
            pairs = left.filter("component <> hub.component").select(F.col("rep").alias("a"), F.col("hub.rep").alias("b"), F.col("component").alias("c_a"), F.col("hub.component").alias("c_b")).groupBy("a", "c_a", "c_b").agg(F.min("b").alias("b"))
            pairs = pairs.join(sized("a"), "a").join(sized("b"), "b").filter(likely())
        else:
            # Members of a bucket's largest component don't meet each other; all others meet the whole bucket.
            left = saved(left.drop("hub"), "buckets")
            largest = left.groupBy("bucket", "component").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.max(F.struct("n", "component")).alias("most"))
            left = saved(left.join(largest, "bucket").select("bucket", "rep", "component", (F.col("component") != F.col("most.component")).alias("minor")), "buckets")
            sides = [left.select("bucket", "minor", F.col("rep").alias(s), F.col("component").alias(f"c_{s}")).join(sized(s, "bitmap"), s) for s in ("a", "b")]
            # Refuted here, by estimates and then by bitmaps, a group's pairs never leave the join.
            met = sides[0].filter("minor").drop("minor").join(sides[1], "bucket").filter(F.expr("c_a <> c_b AND (NOT minor OR a < b)"))
            pairs = met.filter(likely() & possible()).select("a", "b", "c_a", "c_b", "n_a", "n_b").distinct()
        # Links between components join components; their graph is far smaller than that of the documents.
        links = saved(confirmed(pairs.drop("s_a", "s_b"), "c_a", "c_b").distinct(), "links")
        if not links.isEmpty():
            joined = connected_components(links.toDF("a", "b"))
            moved = components.join(joined.select(F.col("id").alias("component"), F.col("component").alias("above")), "component", "left").select("id", F.coalesce("above", "component").alias("component"))
            components = saved(moved.unionByName(joined.join(components.select("id"), "id", "left_anti")), "components")
    out = members
    out = out.join(components.withColumnRenamed("id", "rep"), "rep", "left")
    component = F.coalesce("component", "rep")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))
