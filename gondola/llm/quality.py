"""Quality of texts by averaged subword embeddings: hashed words, word pairs and character n-grams, softmax, numpy SGD."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gondola.llm.common import INVERSE, SLICE_BYTES, U64, WHITE, odd_numbers, powers, prefix_hash, slices, small_batches, take_worker, text_bytes, word_spans

#: Rows of the embedding table, its width, and the lengths of character n-grams (in bytes, with the blank on either side).
TABLE_BITS, WIDTH = 18, 16
CHAR_GRAMS = (3, 4, 5)
#: At most so many labelled documents train the model: those with the smallest hashes of their doc_id.
MAX_LABELLED = 4000
EPOCHS, RATE, SEED = 6, 0.5, 7
THRESHOLD = 0.3

_KIND = odd_numbers(16, 909)


def feature_ids(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of all features of the texts in data, and each one's text number."""
    shift = U64(64 - TABLE_BITS)
    start, end, of = word_spans(data, offsets)
    prefix = prefix_hash(np.where(WHITE[data], np.uint8(32), data))
    inverse = powers(INVERSE, len(prefix))
    words = (prefix[end] - prefix[start]) * inverse[start]
    pair = np.flatnonzero(of[1:] == of[:-1])
    rows = [(words * _KIND[0]) >> shift, (words[pair] * _KIND[1] + words[pair + 1] * _KIND[2]) * _KIND[3] >> shift]
    texts = [of, of[pair]]
    text = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    blank = np.concatenate([[0], np.cumsum(WHITE[data], dtype=np.int32)])
    for n in CHAR_GRAMS:
        m = len(data) - n + 1
        if m <= 0:
            continue
        at = np.flatnonzero((text[:m] == text[n - 1 :]) & (blank[n - 1 : n - 1 + m] == blank[1 : 1 + m]))
        rows.append((prefix[at + n] - prefix[at]) * inverse[at] * _KIND[3 + n] >> shift)
        texts.append(text[at])
    return np.concatenate(rows).astype(np.int32), np.concatenate(texts)


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    take_worker("quality")
    for b in batches:
        offsets, data = text_bytes(b.column("text"))
        for k in range(len(b)):
            row, n = np.unique(feature_ids(data[offsets[k] : offsets[k + 1]], np.array([0, offsets[k + 1] - offsets[k]]))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(k, 1), b.column("quality").slice(k, 1), pa.array([row], pa.list_(pa.int32())), pa.array([n], pa.list_(pa.int32()))], names=["doc_id", "quality", "rows", "counts"])


def held_out(doc_id: str = "doc_id"):
    """One document in five is never learnt from: crc32 of its id as text, modulo 5, is 0."""
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


class QualityModel:
    """Two classes; `table` has each feature's share of the log odds of class 1, `bias` what is added to their mean."""

    def __init__(self, table: np.ndarray, bias: float):
        self.table, self.bias = table, bias

    @staticmethod
    def fit(bags: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> QualityModel:
        """Stochastic gradient descent over bags of (rows, counts, class); one class alone gives its share as the score."""
        rng = np.random.default_rng(seed)
        vectors = rng.uniform(-1 / WIDTH, 1 / WIDTH, (1 << TABLE_BITS, WIDTH)).astype(np.float32)
        out, bias = np.zeros((2, WIDTH), np.float32), np.zeros(2, np.float32)
        steps, total = 0, max(1, epochs * len(bags))
        for _ in range(epochs):
            for k in rng.permutation(len(bags)):
                rows, counts, label = bags[k]
                now = rate * (1 - steps / total)
                steps += 1
                weight = (counts / max(1, counts.sum())).astype(np.float32)
                mine = vectors[rows]
                mean = weight @ mine
                z = out @ mean + bias
                p = np.exp(z - z.max())
                p /= p.sum()
                p[label] -= 1
                back = p @ out
                out -= now * np.outer(p, mean)
                bias -= now * 0.1 * p
                # The mean spreads a text's step over all its features; scaled up so that rare features learn too.
                vectors[rows] = mine - now * np.sqrt(weight)[:, None] * back
        return QualityModel(vectors @ (out[1] - out[0]), float(bias[1] - bias[0]))


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> QualityModel:
    """Fit on at most `most` labelled documents outside the held-out fifth, as labels.quality marks them (the lowest of
    several marks). Their number is bounded, so their bags of features go to the driver, where the steps run in order."""
    small_batches(docs.sparkSession)
    marks = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").filter(~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    chosen = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "quality")
    rows = rows.select("doc_id", "text", F.col("quality").cast("int").alias("quality"))
    table = rows.mapInArrow(_bags, "doc_id long, quality int, rows array<int>, counts array<int>").toArrow()
    # Bags are views into the fetched batches, in the order of doc_id.
    bags = []
    for b in table.to_batches():
        limits, feature, count = (np.asarray(x) for x in (b.column("rows").offsets, b.column("rows").values, b.column("counts").values))
        bags += [(d, int(q), feature[x:y], count[x:y]) for d, q, x, y in zip(b.column("doc_id").to_pylist(), b.column("quality").to_pylist(), limits[:-1], limits[1:], strict=True)]
    bags.sort(key=lambda bag: bag[0])
    model = QualityModel.fit([(feature, count, label) for _, label, feature, count in bags])
    del table, bags
    pa.default_memory_pool().release_unused()
    return model


def _score(model, extra: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker("quality")
        table, bias = model.value
        for b in batches:
            offsets, data = text_bytes(b.column("text"))
            score = np.empty(len(b))
            for a, e in slices(offsets, SLICE_BYTES // 4):
                rows, of = feature_ids(data[offsets[a] : offsets[e]], offsets[a : e + 1] - offsets[a])
                n = np.bincount(of, minlength=e - a)
                z = np.bincount(of, weights=table[rows], minlength=e - a) / np.maximum(n, 1) + bias
                score[a:e] = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in extra), pa.array(score)], names=[*extra, "score"])

    return run


def score_quality(docs: DataFrame, model: QualityModel, keep: list[str] | None = None) -> DataFrame:
    """The columns named in `keep` (all if None) and `score`, from 0 to 1, higher where quality 1 is likelier.

    Only the whole text is read. Null and empty texts have no features and get the score of the bias alone; equal texts get
    equal scores, whatever their doc_id, which may be null or repeated; an empty table gives an empty one; an own column named score is replaced.
    """
    small_batches(docs.sparkSession)
    names = [c for c in (docs.columns if keep is None else keep) if c != "score"]
    rows = docs.select(*dict.fromkeys([*names, "text"]))
    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names), "score double"])
    return rows.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast((model.table, model.bias)), names), schema)
