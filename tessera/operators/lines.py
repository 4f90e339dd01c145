"""Straight lines as relations: their pixels as column expressions, costs under them by a join, drawings of seams.

The pixels are those of :func:`tessera.operators.seams.raster`: step t of a line whose longer side is n moves by
t / n of both sides, truncated, and its end is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.pixelwise import XY
from tessera.operators.seams import BLOCKED, SHORT_LINE

#: What a drawing shows at a place; the largest wins.
LINE, FROZEN, MOVABLE = 1, 2, 3


def length(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """The longer side of a line."""
    return F.greatest(F.abs(bx - ax), F.abs(by - ay))


def steps(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """The line's pixels as an array of (x, y), empty for a line of one place."""
    n = length(ax, ay, bx, by)
    at = lambda a, b, t: a + F.signum((b - a).cast("double")).cast("long") * F.call_function("div", t * F.abs(b - a), n)
    empty = F.array().cast("array<struct<x:bigint,y:bigint>>")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda t: F.struct(at(ax, bx, t).alias("x"), at(ay, by, t).alias("y")))).otherwise(empty)


def pixels(df: DataFrame, keys: list[str], ends: tuple[str, str, str, str] = ("ax", "ay", "bx", "by")) -> DataFrame:
    """(keys, ord, x, y): the pixels of each row's line in order."""
    return df.select(*keys, F.posexplode(steps(*map(F.col, ends))).alias("ord", "p")).select(*keys, F.col("ord").cast("long").alias("ord"), "p.x", "p.y")


def costs(df: DataFrame, raster: DataFrame, line: list[str], image: list[str], value: str = "v") -> DataFrame:
    """(line, cost) of lines (line, ax, ay, bx, by); ``image``, among ``line``, are the raster's keys.

    The values under a line, BLOCKED where the raster has none, and BLOCKED for each pixel that a line shorter than SHORT_LINE lacks.
    """
    under = pixels(df, line).join(raster.select(*image, *XY, F.col(value).alias("__v")), [*image, *XY], "left")
    sums = under.groupBy(*line).agg(F.sum(F.coalesce("__v", F.lit(BLOCKED))).alias("__sum"))
    lacks = F.greatest(SHORT_LINE - length(*map(F.col, ("ax", "ay", "bx", "by"))), F.lit(0).cast("long"))
    return df.join(sums, line, "left").select(*line, (F.coalesce("__sum", F.lit(0)) + BLOCKED * lacks).cast("long").alias("cost"))


def draw(vertices: DataFrame, keys: list[str], width: int, height: int) -> DataFrame:
    """(keys, x, y, mark) of closed contours (keys, contour, ord, movable, x, y): lines, and over them their frozen and movable vertices."""
    ring = W.partitionBy(*keys, "contour").orderBy("ord")
    whole = ring.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    nxt = lambda c: F.coalesce(F.lead(c).over(ring), F.first(c).over(whole))
    sides = vertices.select(*keys, "contour", "ord", F.col("x").alias("ax"), F.col("y").alias("ay"), nxt("x").alias("bx"), nxt("y").alias("by"))
    lined = pixels(sides.withColumnRenamed("ord", "side"), [*keys, "contour", "side"]).select(*keys, *XY, F.lit(LINE).alias("mark"))
    marked = vertices.select(*keys, *XY, F.when(F.col("movable"), MOVABLE).otherwise(FROZEN).alias("mark"))
    inside = (F.col("x") >= 0) & (F.col("x") < width) & (F.col("y") >= 0) & (F.col("y") < height)
    return lined.unionByName(marked).filter(inside).groupBy(*keys, *XY).agg(F.max("mark").cast("long").alias("mark"))
