"""Stack fusion: score every pixel, normalise over the stack, blend in pyramid space.

Images of a stack are told apart by the order column, and a pyramid is one relation
over all of them, so every step treats all scenes and images in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import colour, exposure
from tessera.functions.scalar import clamp, fill_in, half_up
from tessera.operators import pyramid, stack, tiles, windows
from tessera.operators.pixelwise import XY
from tessera.plans.config import FuseConfig

GRAY, RGB = ("v",), ("r", "g", "b")


def _projected(name: str, channels: tuple[str, ...], top: float) -> Column:
    columns = [F.col(c) for c in channels]
    if len(columns) == 1:
        return columns[0] * 1.0
    if name not in colour.PROJECTORS:
        raise ValueError(f"unknown projector {name!r}; known: {', '.join(colour.PROJECTORS)}")
    return colour.PROJECTORS[name](tuple(columns), top)


def score(df: DataFrame, keys: list[str], config: FuseConfig, top: float = 255.0, channels: tuple[str, ...] = GRAY, alpha: str | None = None) -> DataFrame:
    """Column w: the sum of the enabled criteria on a gray or colour stack, 0 where ``alpha`` is false. Gray has no saturation."""
    place = [*keys, *XY]
    rows = df.withColumn("__gray", half_up(_projected(config.projector, channels, top))).withColumn("__on", F.col(alpha) if alpha else F.lit(True))
    base, terms = rows, []
    if config.exposure_weight:
        w = exposure.weight(config.exposure_function, _projected(config.projector, channels, top) / top, config.exposure_optimum, config.exposure_width)
        if config.exposure_lower > 0 or config.exposure_upper < 1:
            low, high = _projected(config.lower_projector, channels, top), _projected(config.upper_projector, channels, top)
            w = stack.exposure_with_cutoff(w, low, high, config.exposure_lower * top, config.exposure_upper * top)
        terms.append(config.exposure_weight * w)
    if config.saturation_weight:
        s = colour.saturation(tuple(F.col(c) for c in channels), top) if len(channels) == 3 else F.lit(0.0)
        terms.append(config.saturation_weight * s)
    if config.contrast_weight:
        contrast = F.lit(0.0)
        if not config.edge_scale or config.min_curvature:
            rows = rows.join(windows.local_stddev(base, keys, config.contrast_window, "__on", "__gray"), place, "left")
            contrast = F.coalesce("stddev", F.lit(0.0))
        if config.edge_scale:
            sharp = base
            if config.lce_scale:
                sharp = windows.convolve(base, keys, windows.gaussian_sharpening(config.lce_scale, config.lce_factor), "__gray").withColumnRenamed("out", "__gray")
            edges = windows.convolve(sharp, keys, windows.laplacian_of_gaussian(config.edge_scale), "__gray")
            rows = rows.join(edges.withColumnRenamed("out", "__edge"), place, "left")
            edge = F.abs(F.coalesce("__edge", F.lit(0.0)))
            contrast = fill_in(edge, contrast, config.min_curvature * top, 1.0, 1.0) if config.min_curvature else edge
        terms.append(config.contrast_weight * contrast / top)
    if config.entropy_weight:
        if config.entropy_lower > 0 or config.entropy_upper < 1:
            base = base.withColumns({c: clamp(F.col(c), config.entropy_lower * top, 0, config.entropy_upper * top, int(top)).cast("long") for c in channels})
        # all channels go through one exchange
        rows = rows.join(windows.local_entropies(base, keys, {c: f"__e{c}" for c in channels}, config.entropy_window, "__on"), place, "left")
        parts = [F.coalesce(f"__e{c}", F.lit(0.0)) for c in channels]
        terms.append(config.entropy_weight * (F.least(*parts) if len(parts) > 1 else parts[0]) / top)
    return rows.select(*df.columns, stack.total_score(F.col(alpha) if alpha else None, *terms).alias("w"))


def blend_stack(df: DataFrame, scene: list[str], levels: int, values: tuple[str, ...] = GRAY, mask: str = "m", order: str = "ord", top: int = 255) -> DataFrame:
    """Sum over the stack of Laplacian times the masks' Gaussian, per level; then collapse. Masks are integers from 0 to top.

    Images and masks go through one pyramid of tiles, so a level is one shuffle and their product needs no join.
    """
    keys, names = [*scene, order], list(values)
    both = tiles.gaussian(tiles.pack(df, keys, [*names, mask]), keys, [*names, mask], levels)
    out = []
    for i, level in enumerate(both):
        rows = tiles.plus_expanded(level, both[i + 1], keys, names, -1) if i + 1 < levels else level
        out.append(tiles.weighted_sum(rows, scene, names, mask, top))
    done = tiles.unpack(tiles.collapse(out, scene, names), scene, names)
    return done.select(*scene, *XY, *(F.least(F.greatest(v, F.lit(0)), F.lit(top)).alias(v) for v in names))


def fuse(df: DataFrame, scene: list[str], config: FuseConfig | None = None, side: int = 8, order: str = "ord", channels: tuple[str, ...] = GRAY, alpha: str | None = None) -> DataFrame:
    """A stack (scene, order, x, y, channels) as one image per scene; with ``alpha``, places valid in no image are 0 and a column alpha tells."""
    config = config or FuseConfig()
    place = [*scene, *XY]
    scored = score(df, [*scene, order], config, channels=channels, alpha=alpha)
    if config.hard_mask:
        masked = stack.hard_mask(scored, place, order=order)
    else:
        masked = stack.normalise(scored, place)
    masked = masked.withColumn("m", F.floor(F.col("m") + 0.5).cast("long"))
    out = blend_stack(masked, scene, pyramid.natural_levels(side, config.levels), channels, order=order)
    if not alpha:
        return out
    out = out.join(stack.alpha_union(df, place, alpha), place)
    return out.select(*place, *(F.when(F.col("alpha"), F.col(c)).otherwise(0).cast("long").alias(c) for c in channels), "alpha")
