"""Multiresolution pyramids with truncating integer arithmetic.

Reduce and expand send each pixel to the few places of the other level that it
contributes to and sum there, so a level costs one shuffle of partially summed
rows. ``size`` columns w and h travel with the pixels of a level; nothing is
collected. Levels are a loop on the driver, at most MAX_LEVELS.
"""

from __future__ import annotations

from functools import reduce as fold

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.pixelwise import XY

MAX_LEVELS = 29
#: Weights of the five taps around a destination's centre.
TAPS = (1, 4, 6, 4, 1)


def with_size(df: DataFrame, keys: list[str]) -> DataFrame:
    """Columns w and h: the image's size from its last column and row."""
    size = df.groupBy(*keys).agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    return df.join(size, keys)


def _tap(offset: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, TAPS)), (offset + 3).cast("int"))


def _half(n: str) -> Column:
    return F.expr(f"({n} + 1) div 2")


def _targets(at: str, size: str, wrap: bool) -> Column:
    """Structs (i, k): the reduced place i and weight k that a source place at ``at`` contributes to."""
    x, n = F.col(at), F.col(size)
    half = F.floor((n + 1) / 2).cast("long")
    if wrap:  # candidates around the seam too; their distance counts modulo the size
        low, high = F.floor((x - 2) / 2) - 1, F.floor((x + 2) / 2) + 1
        tap = lambda i: F.when(F.abs(x - 2 * i) <= 2, _tap(F.least(F.greatest(x - 2 * i, F.lit(-2)), F.lit(2)))).otherwise(0)
        round_about = lambda i: tap(i) + F.when(n > 2, tap2(i, n) + tap2(i, -n)).otherwise(tap2(i, n) + tap2(i, -n))
        tap2 = lambda i, s: F.when(F.abs(x + s - 2 * i) <= 2, _tap(F.least(F.greatest(x + s - 2 * i, F.lit(-2)), F.lit(2)))).otherwise(0)
        every = F.sequence(F.lit(0).cast("long"), half - 1)
        near = F.filter(every, lambda i: (i >= low) & (i <= high) | (i <= 1) | (i >= half - 2))
        return F.filter(F.transform(near, lambda i: F.struct(i.alias("i"), round_about(i).cast("long").alias("k"))), lambda t: t["k"] > 0)
    low, high = F.greatest(F.ceil((x - 2) / 2), F.lit(0)).cast("long"), F.least(F.floor((x + 2) / 2), half - 1).cast("long")
    return F.transform(F.sequence(low, high), lambda i: F.struct(i.alias("i"), _tap(x - 2 * i).cast("long").alias("k")))


def reduce_masked(df: DataFrame, keys: list[str], values: list[str], alpha: str = "alpha", wrap: bool = False) -> DataFrame:
    """Half size: the weighted mean of the valid pixels under the 5 x 5 kernel, truncated; a place with none is invalid with value 0. Needs w and h."""
    rows = df.withColumn("__tx", F.explode(_targets("x", "w", wrap))).withColumn("__ty", F.explode(_targets("y", "h", False)))
    k = F.when(F.col(alpha), F.col("__tx.k") * F.col("__ty.k")).otherwise(F.lit(0).cast("long"))
    sums = rows.groupBy(*keys, "w", "h", F.col("__tx.i").alias("x"), F.col("__ty.i").alias("y")).agg(F.sum(k).alias("__k"), *(F.sum(k * F.col(v)).alias(v) for v in values))
    out = [F.when(F.col("__k") > 0, F.expr(f"{v} div __k")).otherwise(F.lit(0).cast("long")).alias(v) for v in values]
    return sums.select(*keys, *XY, *out, (F.col("__k") > 0).alias(alpha), _half("w").alias("w"), _half("h").alias("h"))


def reduce_plain(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Half size without validity: edge pixels repeat outwards; over 256, truncated. Needs w and h."""

    def taps(at: str, size: str) -> Column:
        # a border pixel stands for its replicas too
        x, n = F.col(at), F.col(size)
        half = F.floor((n + 1) / 2).cast("long")
        low, high = F.greatest(F.ceil((x - 2) / 2), F.lit(0)).cast("long"), F.least(F.floor((x + 2) / 2), half - 1).cast("long")

        def weight(i: Column) -> Column:
            out = _tap(x - 2 * i)
            for d in (1, 2):
                out = out + F.when((x == 0) & (2 * i - d <= 2) & (2 * i + 0 <= 2 - d), _tap(F.greatest(-d - 2 * i, F.lit(-2)))).otherwise(0)
                out = out + F.when((x == n - 1) & (n - 1 + d - 2 * i <= 2), _tap(F.least(n - 1 + d - 2 * i, F.lit(2)))).otherwise(0)
            return out

        return F.transform(F.sequence(low, high), lambda i: F.struct(i.alias("i"), weight(i).cast("long").alias("k")))

    rows = df.withColumn("__tx", F.explode(taps("x", "w"))).withColumn("__ty", F.explode(taps("y", "h")))
    k = F.col("__tx.k") * F.col("__ty.k")
    sums = rows.groupBy(*keys, "w", "h", F.col("__tx.i").alias("x"), F.col("__ty.i").alias("y")).agg(*(F.sum(k * F.col(v)).alias(v) for v in values))
    return sums.select(*keys, *XY, *(F.expr(f"{v} div 256").alias(v) for v in values), _half("w").alias("w"), _half("h").alias("h"))


def _spread(at: str, size: str, wrap: bool) -> Column:
    """Structs (i, k): the places of the finer level of ``size`` that a coarse place contributes to."""
    x, n = F.col(at), F.col(size)
    places = F.array(*(F.struct((2 * x + d).cast("long").alias("i"), F.lit(k).cast("long").alias("k")) for d, k in ((-2, 1), (-1, 4), (0, 6), (1, 4), (2, 1))))
    if not wrap:
        return F.filter(places, lambda t: (t["i"] >= 0) & (t["i"] < n))
    # around the seam the last column's right neighbour is the first, and the first one's left the last; an odd ring's ends weigh 4
    coarse, odd = F.floor((n + 1) / 2).cast("long"), n % 2 == 1
    to = lambda i, k: F.struct(i.cast("long").alias("i"), k.cast("long").alias("k"))
    seam = F.array(
        F.when(x == 0, to(n - 1, F.lit(4))),
        F.when((x == 0) & ~odd, to(n - 2, F.lit(1))),
        F.when(x == coarse - 1, to(F.lit(0), F.when(odd, F.lit(4)).otherwise(F.lit(1)))),
    )
    seam = F.filter(seam, lambda t: t.isNotNull())
    inner = F.filter(places, lambda t: (t["i"] >= 0) & (t["i"] < n))
    return F.concat(inner, seam)


def expand(coarse: DataFrame, sizes: DataFrame, keys: list[str], values: list[str], wrap: bool = False) -> DataFrame:
    """Double size, to the (w, h) that ``sizes`` has per image: (1, 6, 1) at even, (4, 4) at odd places; over the weights in range, truncated."""
    rows = coarse.drop("w", "h").join(sizes.select(*keys, "w", "h"), keys)
    rows = rows.withColumn("__tx", F.explode(_spread("x", "w", wrap))).withColumn("__ty", F.explode(_spread("y", "h", False)))
    k = F.col("__tx.k") * F.col("__ty.k")
    sums = rows.groupBy(*keys, "w", "h", F.col("__tx.i").alias("x"), F.col("__ty.i").alias("y")).agg(F.sum(k).alias("__k"), *(F.sum(k * F.col(v)).alias(v) for v in values))
    return sums.select(*keys, *XY, *(F.expr(f"{v} div __k").alias(v) for v in values), "w", "h")


def gaussian(df: DataFrame, keys: list[str], values: list[str], levels: int, alpha: str | None = None, wrap: bool = False) -> list[DataFrame]:
    """Levels 0 .. levels - 1, each half the one before."""
    if not 1 <= levels <= MAX_LEVELS:
        raise ValueError(f"levels must be from 1 to {MAX_LEVELS}")
    out = [with_size(df, keys)]
    for _ in range(levels - 1):
        out.append(reduce_masked(out[-1], keys, values, alpha, wrap) if alpha else reduce_plain(out[-1], keys, values))
    return out


def _sizes(level: DataFrame, keys: list[str]) -> DataFrame:
    return level.groupBy(*keys).agg(F.first("w").alias("w"), F.first("h").alias("h"))


def _add(fine: DataFrame, other: DataFrame, keys: list[str], values: list[str], sign: int) -> DataFrame:
    up = other.select(*keys, *XY, *(F.col(v).alias(f"__{v}") for v in values))
    rows = fine.join(up, [*keys, *XY])
    return rows.select(*[c for c in fine.columns if c not in values], *((F.col(v) + sign * F.col(f"__{v}")).alias(v) for v in values))


def less_expanded(fine: DataFrame, coarse: DataFrame, keys: list[str], values: list[str], wrap: bool = False) -> DataFrame:
    """A Gaussian level less the expansion of the next, in ``values``; its other columns stay."""
    return _add(fine, expand(coarse, _sizes(fine, keys), keys, values, wrap), keys, values, -1)


def laplacian(df: DataFrame, keys: list[str], values: list[str], levels: int, alpha: str | None = None, wrap: bool = False) -> list[DataFrame]:
    """Each Gaussian level less the expansion of the next; the top level stays."""
    g = gaussian(df, keys, values, levels, alpha, wrap)
    return [less_expanded(g[i], g[i + 1], keys, values, wrap) for i in range(levels - 1)] + [g[-1]]


def collapse(levels: list[DataFrame], keys: list[str], values: list[str], wrap: bool = False) -> DataFrame:
    """The image of a Laplacian pyramid: coarse to fine, expand and add."""
    return fold(lambda up, fine: _add(fine, expand(up, _sizes(fine, keys), keys, values, wrap), keys, values, 1), levels[-2::-1], levels[-1])


def stack_levels(levels: list[DataFrame]) -> DataFrame:
    """All levels in one relation, by column level."""
    return fold(DataFrame.unionByName, (d.withColumn("level", F.lit(i).cast("long")) for i, d in enumerate(levels)))


def blend_levels(mask: list[DataFrame], white: list[DataFrame], black: list[DataFrame], keys: list[str], values: list[str], top: float = 255.0) -> list[DataFrame]:
    """Level by level: white where the mask is full, black where empty, else linear, rounded half away from zero."""
    from tessera.functions.scalar import half_away, lerp_masked

    out = []
    for m, w, b in zip(mask, white, black, strict=True):
        rows = w.join(b.select(*keys, *XY, *(F.col(v).alias(f"__b{v}") for v in values)), [*keys, *XY]).join(m.select(*keys, *XY, (F.col("m") / top).alias("__m")), [*keys, *XY])
        out.append(rows.select(*keys, *XY, *(half_away(lerp_masked(F.col("__m"), F.col(v) * 1.0, F.col(f"__b{v}") * 1.0)).alias(v) for v in values), "w", "h"))
    return out


def filter_half_width(levels: int) -> int:
    """How far a pixel's influence reaches through ``levels`` levels."""
    return 0 if levels == 1 else 2 ** (levels + 1) - 4


def natural_levels(short_side: int, wanted: int = 0) -> int:
    """Halvings until the short side is at most 8; a positive wish caps them, a negative one subtracts."""
    levels = 1
    while short_side > 8 and levels < MAX_LEVELS:
        short_side = (short_side + 1) >> 1
        levels += 1
    if wanted > 0:
        return min(wanted, levels)
    return max(1, levels + wanted)


def half_width_of(levels: Column) -> Column:
    """:func:`filter_half_width` of a column."""
    return F.when(levels == 1, 0).otherwise(F.pow(F.lit(2.0), levels + 1) - 4).cast("long")


def natural_levels_of(short_side: Column, wanted: int = 0) -> Column:
    """:func:`natural_levels` of a column of whole numbers."""
    # (s + 1) >> 1 again and again is the ceiling of s over powers of two
    over = (F.when(F.ceil(short_side / (1 << n)) > 8, 1).otherwise(0) for n in range(MAX_LEVELS - 1))
    levels = fold(lambda a, b: a + b, over, F.lit(1))
    return (F.least(levels, F.lit(wanted)) if wanted > 0 else F.greatest(levels + wanted, F.lit(1))).cast("long")
