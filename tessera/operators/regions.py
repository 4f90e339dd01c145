"""Connected regions of rasters in two levels: inside each tile, then across the borders of tiles only.

A region's number is its smallest place, y * WIDE + x. Tiles label their own places; labels that meet at a border are edges, and
these few are contracted to stars in rounds of joins, each written to the shared folder. No task holds more than a tile.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import tiles
from tessera.operators.cuts import regions
from tessera.operators.tiles import SIDE, SIZE, TILE, _ints, _lists, _longs, _plane, _schema, _taken, _types
from tessera.storage import discard, materialize

#: More than any column number, so that a place is one number.
WIDE = 1 << 31
MAX_ROUNDS = 60
_EDGES = ["left", "right", "top", "bottom"]


def _label(packed: DataFrame, keys: list[str], value: str, side: int) -> DataFrame:
    """Column label of each place, and what the four borders show: (values, labels) along each."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tiles.bounded(batches):
            sizes = _ints(b, [*TILE, *SIZE])
            labels, borders = [], [[[], []] for _ in _EDGES]
            for r, (tx, ty, w, h, _, _) in enumerate(sizes):
                x0, y0 = tx * side, ty * side
                v = _plane(b.column(value), r).reshape(min(side, h - y0), min(side, w - x0))
                number = regions(v[:, 1:] == v[:, :-1], v[1:] == v[:-1])
                first = np.full(int(number.max()) + 1, -1, np.int64)
                place = (np.arange(v.shape[0])[:, None] + y0) * WIDE + np.arange(v.shape[1]) + x0
                # the first place of a region in row order is its smallest
                names, where = np.unique(number.ravel(), return_index=True)
                first[names] = place.ravel()[where]
                label = first[number]
                labels.append(label)
                for k, cut in enumerate((np.s_[:, 0], np.s_[:, -1], np.s_[0], np.s_[-1])):
                    borders[k][0].append(v[cut])
                    borders[k][1].append(label[cut])
            out = [_lists(labels, pa.int64()), *(_lists(part, pa.int64()) for edge in borders for part in edge)]
            yield pa.RecordBatch.from_arrays([*_taken(b, keys, list(range(b.num_rows))), *_longs(sizes, 6), *out], names=[*keys, *TILE, *SIZE, "label", *names_of])

    names_of = [f"{e}_{part}" for e in _EDGES for part in ("value", "label")]
    return packed.mapInArrow(run, f"{_types(packed, keys)}, {_schema(['label', *names_of])}")


def _meetings(labelled: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, a, b): labels of places with one value on both sides of a border."""
    out = None
    for edge, other, dx, dy in (("right", "left", 1, 0), ("bottom", "top", 0, 1)):
        one = labelled.select(*keys, (F.col("tx") + dx).alias("tx"), (F.col("ty") + dy).alias("ty"), F.col(f"{edge}_value").alias("v"), F.col(f"{edge}_label").alias("l"))
        two = labelled.select(*keys, *TILE, F.col(f"{other}_value").alias("v2"), F.col(f"{other}_label").alias("l2"))
        met = one.join(two, [*keys, *TILE]).select(*keys, F.explode(F.arrays_zip("v", "l", "v2", "l2")).alias("m"))
        met = met.filter("m.v = m.v2").select(*keys, F.greatest("m.l", "m.l2").alias("a"), F.least("m.l", "m.l2").alias("b")).distinct()
        out = met if out is None else out.unionByName(met)
    return out


def contract(edges: DataFrame, keys: list[str], scratch: list[str]) -> DataFrame:
    """(keys, a, b) as stars: b the smallest node that a is connected with. The path of the table is added to ``scratch``."""
    spark, last, kept = edges.sparkSession, [], []
    now = materialize(edges, "meetings", scratch=kept)
    mark = None
    for _ in range(MAX_ROUNDS):
        both = now.unionByName(now.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(*keys, "a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, [*keys, "a"]).select(*keys, F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy(*keys, "a").agg(F.min("b").alias("m"))
        rest = large.join(least, [*keys, "a"]).filter("b <> m").select(*keys, F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
        last, kept = kept, []
        now = materialize(rest.unionByName(least.withColumnRenamed("m", "b")).distinct(), "meetings", scratch=kept)
        discard(spark, last)
        s = now.agg(F.count("*").alias("n"), F.expr(f"bit_xor(xxhash64({', '.join(keys)}, a, b))").alias("x"), F.sum(F.xxhash64("b", "a", *keys).cast("decimal(20,0)")).alias("s")).first()
        if (s.n, s.x, s.s) == mark:
            break
        mark = (s.n, s.x, s.s)
    else:
        raise RuntimeError("the regions did not settle")
    scratch += kept
    return now


def connected(df: DataFrame, keys: list[str], value: str, side: int = SIDE) -> DataFrame:
    """(keys, x, y, region): 4-connected regions of places with one value, numbered by their smallest place y * WIDE + x.

    ``value`` is a whole number; images are whole rectangles.
    """
    spark, scratch = df.sparkSession, []
    labelled = materialize(_label(tiles.pack(df, keys, [value], side=side), keys, value, side), "labels", scratch=scratch)
    stars = contract(_meetings(labelled, keys), keys, scratch)
    # a label's own place tells its tile; a tile has no more labels on its borders than places there
    tile = lambda c: F.floor(c / side).cast("long")
    known = stars.select(*keys, tile(F.col("a") % WIDE).alias("tx"), tile(F.floor(F.col("a") / WIDE)).alias("ty"), "a", "b")
    known = known.groupBy(*keys, *TILE).agg(F.map_from_entries(F.collect_list(F.struct("a", "b"))).alias("known"))
    named = labelled.join(known, [*keys, *TILE], "left")
    region = F.transform("label", lambda l: F.coalesce(F.col("known")[l], l))
    out = materialize(tiles.unpack(named.select(*keys, *TILE, "w", region.alias("region")), keys, ["region"], side), "regions")
    discard(spark, scratch)
    return out
