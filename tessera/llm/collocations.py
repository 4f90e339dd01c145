"""Phrase collocation mining by hierarchical pair naming.

Map tasks turn texts into *blocks*: the words of up to ``BLOCK`` places of one language as numbers
of the block's own vocabulary. A word's name is the first (block, number) that holds it, found by
one window over the blocks' vocabularies, with its frequency; only names of frequent words go
back to the blocks. There, neighbours that both have a name are a pair, counted by
block and named in the same way; neighbouring frequent pairs are the triples. So a shuffle only ever
moves what a block holds once, however often a word repeats, and no vocabulary is
broadcast or gathered. The names in a pair or a triple are its parents: pair -> two words, triple ->
its first and its second pair. Cuts and subsumption are joins along them.

Defined results: a null text is '', a null lang ``und``; each row is a document, repeated rows and ids
included; n-grams never cross pieces or documents; very long texts make one large block; ties of cuts go to
the shorter first part, ties in rank to the larger frequency, then to the phrase's UTF-8 bytes; languages
without candidates give no rows, an empty table none; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.vocabulary import Vocabulary, list_array
from tessera.storage import discard, materialize

MIN_COUNT = 10
TOP = 2000
#: A longer candidate with at least this many hundredths of a phrase's occurrences stands for it.
SUBSUMED = 50
#: Places of a block, with separators.
BLOCK = 1 << 18
#: Blocks a map task can number.
PER_TASK = 1 << 12

#: ASCII letters in lower case, separators of pieces as a byte that UTF-8 never has, tabs as blanks.
_BREAK = 0xFF
_BYTES = bytes(c + 32 if 65 <= c <= 90 else _BREAK if chr(c) in ".,;:!?\n\v\f\r" else 32 if c == 9 else c for c in range(256))
_BREAKS, _SPACED = bytes([_BREAK]), b" %c " % _BREAK


class _Block:
    """Texts of one language as numbers of words; 0 stands between pieces."""

    def __init__(self) -> None:
        self.words = Vocabulary()
        self.words[_BREAKS] = 0
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, text: bytes) -> None:
        self.parts.append(self.words.ids([*text.translate(_BYTES).replace(_BREAKS, _SPACED).split(), _BREAKS]).astype(np.int32))
        self.size += len(self.parts[-1])

    def batch(self, number: int, lang: str) -> pa.RecordBatch:
        places = np.concatenate(self.parts)
        counts = np.bincount(places, minlength=len(self.words))[1:]
        one = np.array([0, len(counts)])
        return pa.RecordBatch.from_arrays(
            [
                pa.array([number], pa.int64()), pa.array([lang], pa.string()), pa.array([int(counts.sum())], pa.int64()),
                list_array(one, self.words.strings(1)), list_array(one, pa.array(counts, pa.int64())), pa.array([places.tobytes()], pa.binary()),
            ],
            names=["block", "lang", "n", "words", "counts", "places"],
        )


def _blocker(most: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, _Block] = {}
        number, size = TaskContext.get().partitionId() * PER_TASK, 0
        last = number + PER_TASK

        def close(lang: str) -> pa.RecordBatch:
            nonlocal number, size
            if number == last:
                raise ValueError(f"a partition has over {PER_TASK} blocks; read the input in smaller partitions")
            number += 1
            block = held.pop(lang)
            size -= block.size
            return block.batch(number - 1, lang)

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary())):
                block = held.setdefault(lang, _Block())
                before = block.size
                block.add(text.as_py())
                size += block.size - before
                if block.size >= most:
                    yield close(lang)
                elif size >= 4 * most:  # many languages
                    yield close(max(held, key=lambda x: held[x].size))
        for lang in list(held):
            yield close(lang)

    return blocks


def _names(column: pa.ListArray, row: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The name of each number of a block, and -1 for those that have none."""
    out = np.full(size, -1, np.int64)
    given = column[row].values
    if given is not None:
        out[given.field("at").to_numpy()] = given.field("name").to_numpy()
    return out


def _neighbours(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of neighbours of ``x`` that are not negative: first, second, how often; and the pair at each place or -1."""
    both = np.nonzero((x[:-1] >= 0) & (x[1:] >= 0))[0] if len(x) else np.empty(0, np.int64)
    known, local = np.unique(x[x >= 0], return_inverse=True)
    number = np.full(len(x), -1, np.int64)
    number[x >= 0] = local
    key, where, count = np.unique(number[both] * len(known) + number[both + 1], return_inverse=True, return_counts=True)
    places = np.full(max(len(x) - 1, 0), -1, np.int32)
    places[both] = where
    return known[key // max(len(known), 1)], known[key % max(len(known), 1)], count, places


def _pair(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of the next level: pairs of neighbours that have names, and the pair at each place."""
    for b in batches:
        for r, (block, size) in enumerate(zip(b.column("block").to_pylist(), b.column("size").to_pylist())):
            names = _names(b.column("names"), r, size)
            places = np.frombuffer(b.column("places")[r].as_buffer(), np.int32)
            first, second, count, pairs = _neighbours(np.where(places >= 0, names[places], -1))
            one = np.array([0, len(first)])
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int64()), *(list_array(one, pa.array(v, pa.int64())) for v in (first, second, count)), pa.array([pairs.tobytes()], pa.binary())],
                names=["block", "first", "second", "counts", "places"],
            )


def _named(each: DataFrame, key: list[str], least: int) -> DataFrame:
    """block, at, name and freq of each frequent entry of a block; ``key`` where it is the one that gives the name."""
    same = Window.partitionBy(*key)
    place = F.shiftleft("block", 31).bitwiseOR(F.col("at").cast("long"))
    named = each.withColumns({"freq": F.sum("n").over(same), "place": place}).filter(F.col("freq") >= least)
    named = named.withColumn("name", F.min("place").over(same))
    return named.select("block", "at", "name", "freq", *(F.when(F.col("place") == F.col("name"), F.col(k)).alias(k) for k in key))


def _with_names(blocks: DataFrame, named: DataFrame, size: Column) -> DataFrame:
    """Each block with the names of its frequent entries."""
    own = named.groupBy("block").agg(F.collect_list(F.struct("at", "name")).alias("names"))
    return blocks.select("block", size.alias("size"), "places").join(own, "block")


def ratio(both: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * both * both / (left * right)), exact below 10 ** 14 occurrences."""
    wide = [c.cast("decimal(14,0)") for c in (both, left, right)]
    return F.call_function("div", wide[0] * wide[0] * F.lit(1_000_000).cast("decimal(7,0)"), wide[1] * wide[2])


def mine(docs: DataFrame, least: int = MIN_COUNT, top: int = TOP, block_places: int = BLOCK) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the best phrases of each language."""
    spark = docs.sparkSession
    scratch: list[str] = []
    text = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    schema = "block long, lang string, n long, words array<string>, counts array<long>, places binary"
    now: list[str] = []
    blocks = materialize(text.mapInArrow(_blocker(block_places), schema), "phrases-words", scratch=now)
    totals = materialize(blocks.groupBy("lang").agg(F.sum("n").alias("n")), "phrases-totals", scratch=scratch)

    each = blocks.select("block", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "x"))
    each = each.select("block", (F.col("at") + 1).alias("at"), "lang", F.col("x.words").alias("word"), F.col("x.counts").alias("n"))
    words = materialize(_named(each, ["lang", "word"], least), "phrases-named-words", scratch=scratch)

    schema = "block long, first array<long>, second array<long>, counts array<long>, places binary"
    paired = _with_names(blocks, words, F.size("words") + 1).mapInArrow(_pair, schema)
    last, now = now, []
    paired = materialize(paired, "phrases-pairs", scratch=now)
    discard(spark, last)
    each = paired.select("block", F.posexplode(F.arrays_zip("first", "second", "counts")).alias("at", "x"))
    each = each.select("block", "at", F.col("x.first").alias("first"), F.col("x.second").alias("second"), F.col("x.counts").alias("n"))
    pairs = materialize(_named(each, ["first", "second"], least), "phrases-named-pairs", scratch=scratch)

    tripled = _with_names(paired, pairs, F.size("first")).mapInArrow(_pair, schema)
    each = tripled.select(F.explode(F.arrays_zip("first", "second", "counts")).alias("x")).select("x.*")
    triples = each.groupBy("first", "second").agg(F.sum("counts").alias("freq")).filter(F.col("freq") >= least)
    triples = materialize(triples, "phrases-triples", scratch=scratch)
    discard(spark, now)

    out = materialize(rank(words, pairs, triples, totals, top), "phrases")
    discard(spark, scratch)
    return out


def rank(words: DataFrame, pairs: DataFrame, triples: DataFrame, totals: DataFrame, top: int) -> DataFrame:
    """Scores along the parents, without what a longer phrase stands for; the best ``top`` of each language."""
    word = words.filter("word is not null").select("name", "lang", "word", "freq")
    first = word.select(F.col("name").alias("first"), "lang", F.col("word").alias("first_word"), F.col("freq").alias("l"))
    second = word.select(F.col("name").alias("second"), F.col("word").alias("second_word"), F.col("freq").alias("r"))
    pair = pairs.filter("first is not null").select("name", "first", "second", "freq").join(first, "first").join(second, "second")

    p = pair.select(F.col("name").alias("first"), "lang", F.concat_ws(" ", "first_word", "second_word").alias("start"), F.col("freq").alias("start_freq"), F.col("l").alias("start_l"))
    q = pair.select(F.col("name").alias("second"), F.col("second_word").alias("end"), F.col("freq").alias("end_freq"), F.col("r").alias("end_r"))
    three = triples.join(p, "first").join(q, "second")
    cuts = [ratio(F.col("freq"), F.col("start_l"), F.col("end_freq")), ratio(F.col("freq"), F.col("start_freq"), F.col("end_r"))]
    three = three.select("lang", F.concat_ws(" ", "start", "end").alias("phrase"), F.col("freq").alias("a"), "start_l", "end_freq", "start_freq", "end_r", cuts[0].alias("one"), cuts[1].alias("two"))
    late = F.col("two") < F.col("one")
    three = three.select(
        "lang", "phrase", "a", F.when(late, F.col("start_freq")).otherwise(F.col("start_l")).alias("l"), F.when(late, F.col("end_r")).otherwise(F.col("end_freq")).alias("r"), F.least("one", "two").alias("score"),
    )

    longer = triples.select(F.explode(F.array("first", "second")).alias("name"), F.col("freq").alias("longer")).groupBy("name").agg(F.max("longer").alias("longer"))
    stands = F.coalesce(100 * F.col("longer") >= SUBSUMED * F.col("freq"), F.lit(False))
    two = pair.join(longer, "name", "left").filter(~stands)
    two = two.select("lang", F.concat_ws(" ", "first_word", "second_word").alias("phrase"), F.col("freq").alias("a"), "l", "r", ratio(F.col("freq"), F.col("l"), F.col("r")).alias("score"))

    by = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = two.unionByName(three).withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
