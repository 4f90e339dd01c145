"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are presences: each word, the four and the six letters it starts with (languages that
compound carry their marker there), pairs of neighbours and pairs with one word
between, hashed to ``2 ** BITS`` coordinates. Every coordinate has its own
learning rate and an L1 threshold, so few weights are not zero; those are
broadcast (at most ``MAX_WEIGHTS`` of them) and whole texts are scored in place,
with no shuffle.

Training reads at most ``MAX_TRAIN`` labelled documents, those with the lowest
hash of doc_id among rows whose crc32(doc_id) mod 3 is not 1. It runs in one
task whose memory that parameter bounds; features are extracted in many.

Defined results: a null or empty text scores as the bias alone; repeated labels
of a document count as toxic if one is; of texts that share a labelled doc_id the
least is learned, once; with no positive or no negative label
all scores are the smoothed share of toxic labels; repeated rows are scored each; other columns
are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


BITS = 20
MAX_TRAIN = 12_000
MAX_WEIGHTS = 1 << BITS
THRESHOLD = 0.7
#: Words remembered by a task before its table starts anew.
VOCABULARY = 200_000

ALPHA, BETA, L1, L2, EPOCHS, POSITIVE_WEIGHT = 1.5, 1.0, 30.0, 0.1, 12, 10.0
#: Lengths of the starts of words.
STARTS = (4, 6)
#: Training documents that a coordinate must occur in.
MIN_DOCS = 3

_WORDS = re.compile(r"\w+")
_PAIR, _SKIP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_MIX, _SHIFT = np.uint64(0xFF51AFD7ED558CCD), np.uint64(64 - BITS)


class _Vocabulary(dict):
    """Word -> row of ``hashes`` (whole word, its starts), filled on first use."""

    def __init__(self) -> None:
        super().__init__()
        self.pending: list[tuple[int, ...]] = []
        self.hashes = np.empty((1 + len(STARTS), 1024), np.uint64)

    def __missing__(self, word: str) -> int:
        self.pending.append((xxhash.xxh3_64_intdigest(word), *(xxhash.xxh3_64_intdigest(word[:n], seed=n) for n in STARTS)))
        self[word] = n = len(self)
        return n

    def rows(self, words: list[str]) -> np.ndarray:
        if len(self) > VOCABULARY:
            self.__init__()
            self.clear()
        out = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.pending:
            a, b = len(self) - len(self.pending), len(self)
            if b > self.hashes.shape[1]:  # by doubling, so that new words do not copy the table each time
                grown = np.empty((len(self.hashes), 2 * b), np.uint64)
                grown[:, :a] = self.hashes[:, :a]
                self.hashes = grown
            self.hashes[:, a:b] = np.array(self.pending, np.uint64).T
            self.pending = []
        return self.hashes[:, out]


def coordinates(text: str | None, vocabulary: _Vocabulary) -> np.ndarray:
    """Hashed coordinates of a text's features, with repeats."""
    words = _WORDS.findall((text or "").lower())
    if not words:
        return np.empty(0, np.int64)
    h, *starts = vocabulary.rows(words)
    out = [h, *starts]
    for gap, by in ((1, _PAIR), (2, _SKIP)):
        if len(h) > gap:
            x = h[:-gap] * by + h[gap:]
            out.append(x ^ (x >> np.uint64(31)))
    return ((np.concatenate(out) * _MIX) >> _SHIFT).astype(np.int64)


def ftrl(examples: list[tuple[np.ndarray, int]], epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, float]:
    """Indices and values of the weights that are not zero, and the bias."""
    size = 1 << BITS
    z, n = np.zeros(size), np.zeros(size)
    zb = nb = 0.0
    positives = sum(y for _, y in examples)
    if not positives or positives == len(examples):
        share = (positives + 1) / (len(examples) + 2)
        return np.empty(0, np.int64), np.empty(0), math.log(share / (1 - share))

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))

    frequent = np.bincount(np.concatenate([x for x, _ in examples]), minlength=size) >= MIN_DOCS
    examples = [(x[frequent[x]], y) for x, y in examples]
    for _ in range(epochs):
        for x, y in examples:
            zi, ni = z[x], n[x]
            w = weights(zi, ni)
            wb = -zb / ((BETA + math.sqrt(nb)) / ALPHA + L2)
            p = 1 / (1 + math.exp(-max(-35.0, min(35.0, float(w.sum()) + wb))))
            g = (p - y) * (POSITIVE_WEIGHT if y else 1.0)
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA
            z[x] = zi + g - sigma * w
            n[x] = ni + g * g
            zb += g - (math.sqrt(nb + g * g) - math.sqrt(nb)) / ALPHA * wb
            nb += g * g
    kept = np.nonzero(np.abs(z) > L1)[0]
    return kept, weights(z[kept], n[kept]), -zb / ((BETA + math.sqrt(nb)) / ALPHA + L2)


def is_held_out(doc_id: str | None) -> bool:
    return zlib.crc32((doc_id or "").encode()) % 3 == 1


def held_out() -> F.Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> tuple[np.ndarray, np.ndarray, float]:
    y = labels.filter("toxic is not null and doc_id is not null").filter(~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("long").alias("toxic"))
    chosen = y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    # at most max_train rows are broadcast, and one text of each stays
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))

    def extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _Vocabulary()
        for b in batches:
            xs = [np.unique(coordinates(t, vocabulary)).astype(np.int32).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(xs, pa.binary())], names=["doc_id", "toxic", "x"])

    def fit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))]
        # each epoch in the same mixed order, whatever the partitions were
        rows.sort(key=lambda r: (xxhash.xxh3_64_intdigest(str(r[0])), r[0], r[2]))
        if rows:
            index, value, bias = ftrl([(np.frombuffer(x, np.int32), int(y)) for _, y, x in rows])
            yield pa.RecordBatch.from_arrays([pa.array(np.append(index, -1)), pa.array(np.append(value, bias))], names=["i", "w"])

    features = rows.select("doc_id", "text", "toxic").mapInArrow(extract, f"doc_id {dict(docs.dtypes)['doc_id']}, toxic long, x binary")
    model = features.repartition(1).mapInArrow(fit, "i long, w double")
    found = model.collect()  # at most MAX_WEIGHTS + 1 rows
    w = sorted((r.i, r.w) for r in found)
    if not w:
        return np.empty(0, np.int64), np.empty(0), 0.0
    return np.array([i for i, _ in w[1:]], np.int64), np.array([v for _, v in w[1:]]), w[0][1]


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """doc_id, held_out, score and predicted for every row."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, value, bias = shared.value
        w = np.zeros(1 << BITS)
        w[index] = value
        vocabulary = _Vocabulary()

        def one(text: str | None) -> float:
            x = coordinates(text, vocabulary)
            x = np.unique(x[w[x] != 0])
            return 1 / (1 + math.exp(-max(-35.0, min(35.0, float(w[x].sum()) + bias))))

        for b in batches:
            s = np.array([one(t) for t in b.column(2).to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, score double, predicted int")
