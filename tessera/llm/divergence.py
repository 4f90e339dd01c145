"""Source divergence audit: how far apart the sources of a language write, by two-dimensional tiles of group blocks.

Map tasks count words into packed rows, one for each language and word, so only these meet in a
shuffle. Words of at least ``MIN_DOCS`` documents stay and get a chunk of the vocabulary and a
place in it. A group is a (lang, source); its counts become one packed vector a chunk. Groups are
dealt into blocks of ``BLOCK``; every vector is replicated to the tasks (block, block, span of
chunks) that need it, and each task adds up its submatrix chunk after chunk, holding one chunk of
two blocks at a time. Spark sums the submatrices over the spans.

All arithmetic is on whole numbers: shares are parts of ``SCALE`` by long division in base
1000, exact while a group has fewer than 9e15 words.

Defined results: null text, lang and source are ''; each row is a document, repeated rows and ids
included; a group without words has the smoothed share of none for every word, a language
without kept words has value 0 in every pair; ties are ranked by the item's UTF-8 bytes; a
language of one source has no pairs; very long texts are counted whole; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.vocabulary import Vocabulary, list_array
from tessera.storage import discard, materialize

MIN_DOCS = 30
SMOOTHING = 5
SCALE = 1_000_000_000
TOP_TERMS = 50
#: Words of a chunk of the vocabulary (about), groups of a block, chunks that one task works through.
CHUNK, BLOCK, SPAN = 4096, 32, 16
#: A map task sends what it has counted of a language once it holds so many (document, word) entries.
HELD = 1 << 21

#: ASCII letters in lower case; every other ASCII byte ends a word, bytes of other characters stay.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


class _Counts:
    """What a map task has counted of one language."""

    def __init__(self) -> None:
        self.words, self.sources = Vocabulary(), Vocabulary()
        self.parts: list[tuple[np.ndarray, np.ndarray, int]] = []
        self.size = 0

    def add(self, text: bytes, source: str) -> None:
        ids, n = np.unique(self.words.ids(text.translate(_TERMS).split()), return_counts=True)
        self.parts.append((ids, n, self.sources[source]))
        self.size += len(ids)

    def batch(self, lang: str) -> pa.RecordBatch:
        """One row a word: its documents, and its count in each source."""
        ids = np.concatenate([p[0] for p in self.parts])
        source = np.repeat([p[2] for p in self.parts], [len(p[0]) for p in self.parts])
        key, where = np.unique(ids * len(self.sources) + source, return_inverse=True)
        n = np.bincount(where, np.concatenate([p[1] for p in self.parts])).astype(np.int64)
        word, source = key // len(self.sources), key % len(self.sources)
        starts = np.searchsorted(word, np.arange(len(self.words) + 1))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([lang] * len(self.words), pa.string()),
                self.words.strings(),
                pa.array(np.bincount(ids, minlength=len(self.words)), pa.int64()),
                list_array(starts, pa.array(list(self.sources), pa.string()).take(pa.array(source))),
                list_array(starts, pa.array(n)),
            ],
            names=["lang", "term", "docs", "sources", "counts"],
        )


def _counter(most: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, _Counts] = {}
        size = 0
        for b in batches:
            for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary())):
                counts = held.setdefault(lang, _Counts())
                before = counts.size
                counts.add(text.as_py(), source)
                size += counts.size - before
                if size > most:  # what is largest goes
                    lang = max(held, key=lambda x: held[x].size)
                    size -= held[lang].size
                    yield held.pop(lang).batch(lang)
        for lang, counts in held.items():
            if counts.size:
                yield counts.batch(lang)

    return count


def share(count: Column, total: Column, size: Column) -> Column:
    """1 + floor(SCALE * (count + SMOOTHING) / (total + SMOOTHING * size)) by long division in base 1000."""
    whole = total + SMOOTHING * size
    rest, out = count + SMOOTHING, F.lit(0).cast("long")
    step = SCALE
    while step > 1:
        step //= 1000
        digit = F.call_function("div", rest * 1000, whole)
        out, rest = out + digit * step, rest * 1000 - digit * whole
    return out + 1


class _Tile:
    """The submatrix of two blocks of groups, over chunks that arrive in order."""

    def __init__(self, lang: str, i: int, j: int, per_block: int) -> None:
        self.lang, self.i, self.j, self.per_block = lang, i, j, per_block
        self.held: list[tuple[int, str, int, np.ndarray, np.ndarray]] = []
        self.sums: dict[tuple[str, str], int] = {}

    def add_chunk(self, size: int) -> None:
        """Add the differences of the vectors held, and let go of them."""
        held = sorted(self.held, key=lambda x: x[0])
        dense = np.empty((len(held), size), np.int64)
        for k, (_, _, zero, pos, p) in enumerate(held):
            dense[k] = zero
            dense[k, pos] = p
        block = np.array([x[0] // self.per_block for x in held])
        for k in np.nonzero(block == self.i)[0]:
            # each pair once: in one block the later groups, else all of the other block
            others = np.nonzero(block[k + 1 :] == self.j)[0] + k + 1
            values = np.abs(dense[others] - dense[k]).sum(axis=1)
            for other, v in zip(others, values.tolist()):
                pair = held[k][1], held[other][1]
                self.sums[pair] = self.sums.get(pair, 0) + v
        self.held.clear()

    def batch(self) -> Iterator[pa.RecordBatch]:
        if self.sums:
            a, b = zip(*self.sums)
            yield pa.RecordBatch.from_arrays([pa.array([self.lang] * len(a), pa.string()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(list(self.sums.values()), pa.int64())], names=["lang", "a", "b", "value"])


def _tiler(per_block: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def tiles(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = chunk = tile = None
        for b in batches:
            vectors = b.column("vector")
            rows = zip(*(b.column(n).to_pylist() for n in ("lang", "i", "j", "span", "chunk", "size", "index", "source", "zero")))
            for r, (lang, i, j, span, number, size, index, source, zero) in enumerate(rows):
                if tile and (key, chunk) != ((lang, i, j, span), (number, size)):
                    tile.add_chunk(chunk[1])
                if key != (lang, i, j, span):
                    yield from tile.batch() if tile else ()
                    key, tile = (lang, i, j, span), _Tile(lang, i, j, per_block)
                chunk = number, size
                v = vectors[r].values
                pos, p = (v.field(0).to_numpy(), v.field(1).to_numpy()) if v is not None else (np.empty(0, np.int64), np.empty(0, np.int64))
                tile.held.append((index, source, zero, pos, p))
        if tile:
            tile.add_chunk(chunk[1])
            yield from tile.batch()

    return tiles


def counts(docs: DataFrame, min_docs: int = MIN_DOCS, held: int = HELD) -> DataFrame:
    """lang, term, source, n and total (in the language) of every word kept, for each source that has it."""
    text = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    packed = text.mapInArrow(_counter(held), "lang string, term string, docs long, sources array<string>, counts array<long>")
    word = Window.partitionBy("lang", "term")
    kept = packed.withColumn("docs", F.sum("docs").over(word)).filter(F.col("docs") >= min_docs)
    each = kept.select("lang", "term", F.explode(F.arrays_zip("sources", "counts")).alias("x")).select("lang", "term", F.col("x.sources").alias("source"), F.col("x.counts").alias("n"))
    return each.groupBy("lang", "term", "source").agg(F.sum("n").alias("n")).withColumn("total", F.sum("n").over(word))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, chunk_words: int = CHUNK, per_block: int = BLOCK, per_span: int = SPAN, held: int = HELD) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value and rank."""
    spark = docs.sparkSession
    scratch: list[str] = []
    table = materialize(counts(docs, min_docs, held), "divergence-counts", scratch=scratch)
    langs = table.groupBy("lang", "term").agg(F.first("total").alias("total")).groupBy("lang").agg(F.count("*").alias("size"), F.sum("total").alias("lang_total"))
    sums = table.groupBy("lang", "source").agg(F.sum("n").alias("group_total"))
    groups = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    groups = groups.join(sums, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["group_total", "size", "lang_total"])
    groups = groups.withColumn("index", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    groups = materialize(groups.withColumn("groups", F.count("*").over(Window.partitionBy("lang"))), "divergence-groups", scratch=scratch)

    # as many chunks as the largest vocabulary needs; chunk 0 is empty and there for languages without words
    largest = groups.agg(F.max("size")).first()[0] or 0
    chunk = F.pmod(F.xxhash64("term"), F.lit(-(-largest // chunk_words) or 1)).cast("int") + 1
    placed = table.withColumn("chunk", chunk).withColumn("pos", F.dense_rank().over(Window.partitionBy("lang", "chunk").orderBy("term")) - 1)
    numbers = groups.select("lang", "source", "group_total", "size", "lang_total")
    shares = placed.join(numbers, ["lang", "source"]).select(
        "lang", "source", "term", "chunk", "pos",
        share(F.col("n"), F.col("group_total"), F.col("size")).alias("p"), share(F.col("total"), F.col("lang_total"), F.col("size")).alias("q"),
    )
    shares = materialize(shares, "divergence-shares", scratch=scratch)

    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = shares.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= TOP_TERMS)

    vectors = shares.groupBy("lang", "source", "chunk").agg(F.collect_list(F.struct("pos", "p")).alias("vector"))
    chunks = shares.groupBy("lang", "chunk").agg((F.max("pos") + 1).alias("size"))
    chunks = chunks.unionByName(groups.select("lang", F.lit(1).alias("x")).distinct().select("lang", F.lit(0).alias("chunk"), F.lit(0).alias("size")))
    zero = F.when(F.col("size") > 0, share(F.lit(0).cast("long"), F.col("group_total"), F.col("size"))).otherwise(0)
    members = groups.filter("groups > 1").select("lang", "source", "index", "groups", zero.alias("zero"))
    tiles = members.join(chunks, "lang").join(vectors, ["lang", "source", "chunk"], "left")
    block = F.floor(F.col("index") / per_block).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.floor((F.col("groups") - 1) / per_block).cast("int"))).alias("other")
    tiles = tiles.select("*", block.alias("block"), other).select(
        "lang", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.floor(F.col("chunk") / per_span).cast("int").alias("span"),
        "chunk", "size", "index", "source", "zero", "vector",
    )
    key = ["lang", "i", "j", "span"]
    parts = tiles.repartition(*key).sortWithinPartitions(*key, "chunk", "index").mapInArrow(_tiler(per_block), "lang string, a string, b string, value long")
    pairs = parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    ends = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x")
    pairs = pairs.select("lang", ends, "value").select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value").withColumn("rank", F.row_number().over(by))

    out = materialize(pairs.unionByName(terms), "divergence")
    discard(spark, scratch)
    return out
