"""Quality by nearest-neighbour voting in a latent-semantic space.

The terms of a text are its words, their shapes (letters, digits and marks as classes, runs cut to two),
neighbouring shapes, and how many words repeat the one before, hashed to ``TERMS`` columns. A truncated singular value
decomposition of the labelled texts' weighted terms gives ``TERMS x RANK`` loadings. Loadings and the labelled texts'
vectors, both of fixed size, are broadcast; every document is projected in place and compared with *all* labelled
vectors in blocks of exact cosine products, and its ``VOTERS`` nearest vote with a power of their similarity. Nothing is
shuffled but the training rows.

Training reads at most ``MAX_TRAIN`` labelled documents: of the rows whose crc32(doc_id) mod 5 is not 0, those with the lowest
hash of doc_id. Each is read once, however often it is repeated, so the fit, one task, is bounded by that parameter.

Defined results: a null or empty text has no neighbours and scores the share of good labels, smoothed; so do all texts
without labelled rows; a document labelled twice is good if all its labels are; of texts that share a labelled doc_id the least
is learned; repeated rows are scored each; texts are read whole, however long; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_TRAIN = 4096
TERMS = 1 << 13
RANK = 64
VOTERS = 25
POWER = 4
#: Weight of the share of good labels beside the voters.
PRIOR = 0.5
THRESHOLD = 0.3
#: Labelled documents that a term must occur in.
MIN_DOCS = 3
#: Documents compared at once; words remembered by a task before its table starts anew.
ROWS, WORDS = 256, 200_000

_LETTER, _DIGIT, _RUN = re.compile(r"[^\W\d_]"), re.compile(r"\d"), re.compile(r"(.)\1{2,}", re.DOTALL)
_FIRST, _SECOND, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD)
_SHIFT = np.uint64(64 - 13)
assert TERMS == 1 << 13
#: Terms of the share of repeated neighbours, in eighths, and of one repetition.
_SHARES = [np.uint64(xxhash.xxh3_64_intdigest(f"repeated {k}/8", seed=2)) for k in range(9)]
_REPEATED = np.uint64(xxhash.xxh3_64_intdigest("repeated", seed=2))


class Model(NamedTuple):
    weights: np.ndarray
    loadings: np.ndarray
    vectors: np.ndarray
    good: np.ndarray
    share: float


def shape(word: str) -> str:
    """Letters as X or x, digits as 9, runs of one sign as two of it."""
    return _RUN.sub(r"\1\1", _DIGIT.sub("9", _LETTER.sub(lambda m: "X" if m[0].isupper() else "x", word)))


class _Words(dict):
    """Word -> row of ``hashes`` (the word, its shape)."""

    def __init__(self) -> None:
        super().__init__()
        self.pending: list[tuple[int, int]] = []
        self.hashes = np.empty((2, 1024), np.uint64)

    def __missing__(self, word: str) -> int:
        self.pending.append((xxhash.xxh3_64_intdigest(word.lower(), seed=1), xxhash.xxh3_64_intdigest(shape(word))))
        self[word] = n = len(self)
        return n

    def rows(self, words: list[str]) -> np.ndarray:
        if len(self) > WORDS:
            self.clear()
            self.__init__()
        out = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.pending:
            a, b = len(self) - len(self.pending), len(self)
            if b > self.hashes.shape[1]:
                grown = np.empty((2, 2 * b), np.uint64)
                grown[:, :a] = self.hashes[:, :a]
                self.hashes = grown
            self.hashes[:, a:b] = np.array(self.pending, np.uint64).T
            self.pending = []
        return out


def counts(text: str | None, known: _Words) -> np.ndarray:
    """How often each term occurs in a text."""
    words = (text or "").split()
    if not words:
        return np.zeros(TERMS)
    at = known.rows(words)
    word, kind = known.hashes[:, at]
    again = int((at[1:] == at[:-1]).sum())
    terms = [word, kind, kind[:-1] * _FIRST + kind[1:] * _SECOND]
    out = np.bincount(((np.concatenate(terms) * _MIX) >> _SHIFT).astype(np.int64), minlength=TERMS).astype(float)
    whole = np.array([_SHARES[8 * again // len(words)], _REPEATED])
    np.add.at(out, ((whole * _MIX) >> _SHIFT).astype(np.int64), (len(words), again))
    return out


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1, or 0 where there is no direction."""
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, length, out=np.zeros_like(rows), where=length > 1e-6)


def fit(rows: np.ndarray, good: np.ndarray) -> Model:
    """The model of labelled counts: term weights, loadings by a randomised decomposition, vectors of the rows."""
    share = float((good.sum() + 1) / (len(good) + 2))
    docs = (rows > 0).sum(axis=0)
    weights = np.where(docs >= MIN_DOCS, np.log((1 + len(rows)) / (1 + docs)) + 0.3, 0).astype(np.float32)
    a = unit(np.log1p(rows, dtype=np.float32) * weights)
    rank = min(RANK, *a.shape)
    basis = np.random.default_rng(0).standard_normal((TERMS, min(rank + 16, len(a)))).astype(np.float32)
    for _ in range(4):  # subspace iteration
        basis, _ = np.linalg.qr(a.T @ (a @ basis))
    _, _, turn = np.linalg.svd(a @ basis, full_matrices=False)
    loadings = basis @ turn[:rank].T
    return Model(weights, loadings, unit(a @ loadings), good.astype(np.float32), share)


def votes(rows: np.ndarray, model: Model) -> np.ndarray:
    """Scores of a block of counts: exact cosines with all labelled vectors, the nearest of which vote."""
    if not len(model.good):
        return np.full(len(rows), model.share)
    cosine = unit(unit(np.log1p(rows, dtype=np.float32) * model.weights) @ model.loadings) @ model.vectors.T
    n = min(VOTERS, cosine.shape[1])
    nearest = np.argpartition(-cosine, n - 1, axis=1)[:, :n]
    weight = np.clip(np.take_along_axis(cosine, nearest, 1), 0, 1).astype(float) ** POWER
    return ((weight * model.good[nearest]).sum(axis=1) + PRIOR * model.share) / (weight.sum(axis=1) + PRIOR)


def is_held_out(doc_id: str | None) -> bool:
    return zlib.crc32((doc_id or "").encode()) % 5 == 0


def held_out() -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    """A model of at most ``max_train`` labelled documents."""
    y = labels.filter("quality is not null and doc_id is not null").filter(~held_out()).groupBy("doc_id").agg(F.min("quality").cast("long").alias("quality"))
    chosen = y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    # at most max_train rows are broadcast, and one text of each stays
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("quality").alias("quality"))

    def extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for b in batches:
            found = [counts(t, known) for t in b.column(1).to_pylist()]
            at = [np.nonzero(x)[0] for x in found]
            packed = [np.concatenate([i, x[i]]).tobytes() for x, i in zip(found, at)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), b.column(2), pa.array(packed, pa.binary())], names=["doc_id", "quality", "x"])

    def learn(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))), key=lambda r: r[0])
        if rows:
            x = np.zeros((len(rows), TERMS), np.float32)
            for k, (_, _, packed) in enumerate(rows):
                i, n = np.split(np.frombuffer(packed), 2)
                x[k, i.astype(np.int64)] = n
            model = fit(x, np.array([r[1] > 0 for r in rows]))
            yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(v, np.float32).tobytes()], pa.binary()) for v in model], names=list(Model._fields))

    features = rows.mapInArrow(extract, "doc_id string, quality long, x binary")
    found = features.repartition(1).mapInArrow(learn, ", ".join(f"{f} binary" for f in Model._fields)).collect()  # one row, bounded by max_train
    if not found:
        return Model(np.zeros(TERMS, np.float32), np.zeros((TERMS, 0), np.float32), np.zeros((0, 0), np.float32), np.zeros(0, np.float32), 0.5)
    weights, loadings, vectors, good, share = (np.frombuffer(v, np.float32) for v in found[0])
    return Model(weights, loadings.reshape(TERMS, -1), vectors.reshape(len(good), -1), good, float(share[0]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for b in batches:
            found = np.empty(b.num_rows)
            for at in range(0, b.num_rows, ROWS):
                texts = b.column(2).slice(at, ROWS).to_pylist()
                found[at : at + len(texts)] = votes(np.stack([counts(t, known) for t in texts]), shared.value)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found), pa.array((found >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, score double, predicted int")
