"""Mosaic blending: images join the mosaic one by one across seams.

The fold over a mosaic's images is ordered, as seams depend on what is there already;
every step handles all mosaics at once and is written to the shared folder, so plans
stay short and a lost executor costs one step.
"""

from __future__ import annotations

from functools import reduce as fold

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import colour, planes
from tessera.functions.scalar import half_away
from tessera.operators import cuts, masks, pyramid, seams, tiles, windows
from tessera.operators.pixelwise import XY
from tessera.plans.config import NEAREST, BlendConfig
from tessera.storage import materialize


def overlaps(df: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """(keys, a, b) with a < b: images of a mosaic that share a place. Sets of images that share one are combined before any pair is made."""
    met = df.groupBy(*keys, *XY).agg(F.sort_array(F.collect_set(order)).alias("met")).filter("size(met) > 1").select(*keys, "met").distinct()
    pairs = met.select(*keys, F.posexplode("met").alias("i", "a"), "met").select(*keys, "a", F.explode(F.expr("slice(met, i + 2, size(met))")).alias("b"))
    return pairs.distinct()


def assemble(df: DataFrame, keys: list[str], n: int, order: str = "ord") -> DataFrame:
    """(keys, order, batch): greedy batches of images that don't overlap; in order, an image joins the first batch that has none it overlaps.

    ``n`` bounds the images of a mosaic; the fold runs over one row per mosaic.
    """
    pairs = overlaps(df, keys, order).groupBy(*keys, F.col("b").alias(order)).agg(F.collect_set("a").alias("hit"))
    images = df.select(*keys, order).distinct().join(pairs, [*keys, order], "left")
    rows = images.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce("hit", F.expr("cast(array() as array<bigint>)")).alias("hit")))).alias("images"))

    def step(acc, image):
        busy = F.transform(F.filter(acc, lambda x: F.array_contains(image["hit"], x["o"])), lambda x: x["batch"])
        free = F.array_min(F.filter(F.sequence(F.lit(0), F.lit(n)), lambda i: ~F.array_contains(busy, i)))
        return F.concat(acc, F.array(F.struct(image["o"].alias("o"), free.alias("batch"))))

    kind = dict(df.dtypes)[order]
    placed = rows.select(*keys, F.explode(F.aggregate("images", F.expr(f"cast(array() as array<struct<o:{kind},batch:int>>)"), step)).alias("p"))
    return placed.select(*keys, F.col("p.o").alias(order), F.col("p.batch").cast("long").alias("batch"))


def _mismatch(config: BlendConfig, channels: tuple[str, ...]) -> Column:
    """How much the two images differ at a place, from 0 to 255; blocked where not both are there."""
    one = lambda side: tuple(F.col(f"{c}{side}") for c in channels)
    if len(channels) == 1:
        d = F.abs(one("w")[0] - one("b")[0])
    elif config.difference == "delta-e":
        d = half_away(255 * colour.delta_e(one("w"), one("b"), 255, config.luminance_weight, config.chrominance_weight))
    else:
        d = half_away(colour.hue_luminance_difference(one("w"), one("b"), 255, config.chrominance_weight, config.luminance_weight))
    return F.when(F.col("white") & F.col("black"), F.least(d.cast("long"), F.lit(seams.BLOCKED))).otherwise(seams.BLOCKED).cast("long")


def _light(channels: tuple[str, ...]) -> Column:
    """The sum of both images' luminances, whose slopes weigh the steps of a graph cut."""
    one = lambda side: tuple(F.col(f"{c}{side}") for c in channels)
    of = lambda c: c[0] if len(c) == 1 else half_away(colour.PROJECTORS["luminance"](c, 255))
    return (of(one("w")) + of(one("b"))).cast("long")


def seam_mask(both: DataFrame, keys: list[str], config: BlendConfig, channels: tuple[str, ...], size: tuple[int, int]) -> DataFrame:
    """(keys, x, y, m): 255 where the white image is to be seen.

    The graph cut and the optimizers take one overlap's bounding box as an array, not the canvas; outside
    the overlap the nearest-feature mask stays.
    """
    guide = masks.nearest_feature(both, keys, wrap=config.wrap, size=size)
    if config.seam == "nearest" and not config.optimizers:
        return guide
    place = [*keys, *XY]
    guide = materialize(guide, "guide")
    cost = _mismatch(config, channels)
    rows = both.withColumn("shared", F.col("white") & F.col("black")).select(*place, "shared", cost.alias("cost"), _light(channels).alias("light")).join(guide, place)
    box = masks.bounding_box(rows, keys, "shared")
    inner = rows.join(box, keys).filter("x between x0 and x1 and y between y0 and y1")
    # one number a place: cost, guide, whether both images are there, light
    packed = inner.select(
        *keys, (F.col("x") - F.col("x0")).alias("x"), (F.col("y") - F.col("y0")).alias("y"),
        (F.col("cost") + F.when(F.col("m") > 0, 256).otherwise(0) + F.when(F.col("shared"), 512).otherwise(0) + 1024 * F.col("light")).alias("v"),
    )
    settings = dict(
        distance=config.vectorize_distance, chain=config.optimizers, graph_cut=config.seam == "graphcut", radius=config.dijkstra_radius, distance_weight=config.distance_weight,
        mismatch_weight=config.mismatch_weight, tau=config.tau, delta_max=config.delta_max, delta_min=config.delta_min, k_max=config.k_max,
    )
    factor = config.coarse_factor

    def kernel(images: list[np.ndarray]) -> list[list[tuple]]:
        shared = [(image & 512) > 0 for image in images]
        parts = [(image & 255, s, (image >> 8 & 1) * 255, image >> 10) for image, s in zip(images, shared)]
        out = []
        for s, mask in zip(shared, cuts.coarse_seams(parts, factor, **settings)):
            y, x = np.nonzero(s)
            out.append(list(zip(x.tolist(), y.tolist(), mask[y, x].tolist())))
        return out

    moved = seams.per_images(packed, keys, kernel, "x long, y long, moved long").join(box, keys)
    moved = moved.select(*keys, (F.col("x") + F.col("x0")).alias("x"), (F.col("y") + F.col("y0")).alias("y"), "moved")
    return guide.join(moved, place, "left").select(*place, F.coalesce("moved", "m").alias("m"))


def _region(masked: DataFrame, keys: list[str], levels: int) -> DataFrame:
    """(keys, x0, y0, x1, y1): where a seam has any effect, from a corner that all levels share with the canvas; no row without a seam."""
    margin, step = 2 * pyramid.filter_half_width(levels), 2 ** (levels - 1)
    low = lambda c: F.greatest(F.floor((F.col(c) - margin) / step) * step, F.lit(0)).cast("long").alias(c)
    return windows.transition_bounds(masked.select(*keys, *XY, "m"), keys).select(*keys, low("x0"), low("y0"), (F.col("x1") + margin).alias("x1"), (F.col("y1") + margin).alias("y1"))


def _both(black: DataFrame, white: DataFrame, keys: list[str], channels: tuple[str, ...]) -> DataFrame:
    """Both images at every place: channels with b or w behind their names, and whether each is valid."""
    side = lambda df, end, alpha: df.select(*keys, *XY, *(F.col(c).alias(f"{c}{end}") for c in channels), F.col("alpha").alias(alpha))
    both = side(black, "b", "black").join(side(white, "w", "white"), [*keys, *XY], "full")
    values = [F.coalesce(f"{c}{end}", F.lit(0)).alias(f"{c}{end}") for end in "bw" for c in channels]
    return both.select(*keys, *XY, *values, *(F.coalesce(c, F.lit(False)).alias(c) for c in ("black", "white")))


def join_image(black: DataFrame, white: DataFrame, keys: list[str], levels: int, channels: tuple[str, ...] = ("v",), config: BlendConfig = NEAREST, size: tuple[int, int] = (0, 0), hard: bool = False) -> DataFrame:
    """One step: (keys, x, y, channels, alpha, m) of the mosaic so far and of the next image, on one canvas.

    No overlap: white lies on top. Complete overlap: white is skipped. Otherwise the two
    are blended in pyramid space across the seam, within the region that the seam affects (all of a canvas
    that wraps around). m is the white image's mask; ``hard`` cuts along it and does not blend.
    """
    place = [*keys, *XY]
    both = materialize(_both(black, white, keys, channels), "step")
    kind = masks.overlap_class(both, keys)
    seam = both.join(kind.filter("overlap = 'partial'"), keys, "left_semi")
    mask = materialize(seam_mask(seam, keys, config, channels, size), "mask")
    # tables of places are small as files, so without the hints they might go through the driver
    rows = both.join(kind.hint("merge"), keys).join(mask.hint("merge"), place, "left")
    m = F.when(F.col("overlap") == "complete", 0).when(F.col("overlap") == "none", F.when(F.col("white"), 255).otherwise(0)).otherwise(F.col("m")).cast("long")
    rows = rows.withColumn("m", m)
    blended: list[str] = []
    if not hard:
        wrap = config.wrap in ("horizontal", "both")
        part = seam.join(mask, place)
        if config.wrap == "none":
            region = materialize(_region(part, keys, levels), "region")
            part = part.join(region, keys).filter("x between x0 and x1 and y between y0 and y1")
            part = part.withColumns({"x": F.col("x") - F.col("x0"), "y": F.col("y") - F.col("y0")}).drop("x0", "y0", "x1", "y1")
        part = materialize(part, "part")
        names = list(channels)

        def half(end: str, a: str) -> list[DataFrame]:
            seen = tuple(F.col(f"{c}{end}") for c in channels)
            seen = planes.into(seen, config.space) if config.space != "identity" else seen
            return tiles.laplacian(tiles.pack(part.select(*place, *(v.alias(c) for c, v in zip(channels, seen)), F.col(a).alias("alpha")), keys, names, ["alpha"]), keys, names, levels, "alpha", wrap)

        weights = tiles.gaussian(tiles.pack(part, keys, ["m"]), keys, ["m"], levels)
        done = tiles.unpack(tiles.collapse(tiles.blend_levels(weights, half("w", "white"), half("b", "black"), keys, names), keys, names, wrap), keys, names)
        if config.space != "identity":
            done = done.select(*place, *(v.alias(c) for c, v in zip(channels, planes.out(tuple(map(F.col, channels)), config.space))))
        if config.wrap == "none":
            done = done.join(region.hint("merge"), keys).withColumns({"x": F.col("x") + F.col("x0"), "y": F.col("y") + F.col("y0")})
        blended = [f"{c}s" for c in channels]
        rows = rows.join(done.select(*place, *(F.least(F.greatest(c, F.lit(0)), F.lit(255)).alias(f"{c}s") for c in channels)).hint("merge"), place, "left")
    alpha = F.col("black") | F.col("white")

    def value(c: str) -> Column:
        cut = F.when(F.col("white") & ((F.col("m") > 0) | ~F.col("black")), F.col(f"{c}w")).otherwise(F.col(f"{c}b"))
        out = F.when(F.col("overlap") == "partial", F.coalesce(f"{c}s", cut)).otherwise(cut) if blended else cut
        return F.when(alpha, out).otherwise(0).cast("long").alias(c)

    return rows.select(*place, *map(value, channels), alpha.alias("alpha"), F.col("m"))


def canvas(df: DataFrame, keys: list[str], width: int, height: int, channels: tuple[str, ...] = ("v",)) -> DataFrame:
    """Every place of the canvas for every mosaic; places without a pixel are invalid."""
    places = df.select(*keys).distinct().withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(width - 1).cast("long")))).withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(height - 1).cast("long"))))
    filled = {c: F.coalesce(c, F.lit(0).cast("long")) for c in channels}
    return places.join(df, [*keys, *XY], "left").withColumns(filled | {"alpha": F.coalesce("alpha", F.lit(False))})


def blend(
    df: DataFrame, keys: list[str], width: int, height: int, images: int, levels: int = 0, order: str = "ord", channels: tuple[str, ...] = ("v",), config: BlendConfig = NEAREST, masks_only: bool = False
) -> DataFrame:
    """Mosaics of up to ``images`` positioned images (keys, order, x, y, channels, alpha) on a canvas.

    ``masks_only`` gives (keys, step, x, y, m) of every step instead and blends nothing. With
    ``config.pre_assemble`` images that do not overlap join the mosaic together.
    """
    n = pyramid.natural_levels(min(width, height), levels or config.levels)
    if config.seam != "nearest" or config.optimizers:
        box = masks.bounding_box(df, [*keys, order])
        shortest = box.agg(F.min(F.least(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) + 1)).first()[0]
        config = config.for_images(shortest or 0)
    if config.pre_assemble:
        valid = df.filter("alpha")
        batches = assemble(valid, keys, images, order)
        df = valid.join(batches, [*keys, order]).drop(order).withColumnRenamed("batch", order)
    at = lambda i: canvas(df.filter(F.col(order) == i).drop(order), keys, width, height, channels)
    base = materialize(at(0), "mosaic")
    steps = []
    for i in range(1, images):
        joined = materialize(join_image(base, at(i), keys, n, channels, config, (width, height), masks_only), "mosaic")
        steps.append(joined.select(*keys, F.lit(i).cast("long").alias("step"), *XY, "m"))
        base = joined.drop("m")
    return fold(DataFrame.unionByName, steps) if masks_only else base
