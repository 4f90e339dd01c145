"""Local neighbourhoods.

Sums over a k x k window are separable, so they are two window functions with a
value range, first along rows and then along columns: work and rows are linear in the
pixels whatever k. Entropy works on tiles with a halo: small windows are compared place by place, others slide histograms. General kernels
send each pixel to the places it contributes to and aggregate there, with partial sums
before the shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators import tiles
from tessera.operators.pixelwise import XY


def _span(keys: list[str], fixed: str, along: str, half: int) -> W:
    return W.partitionBy(*keys, fixed).orderBy(along).rangeBetween(-half, half)


def box_sums(df: DataFrame, keys: list[str], half: int, **terms: Column) -> DataFrame:
    """Sums of the terms over the window around every place, as columns of those names."""
    rows = df.withColumns({f"__{k}": v for k, v in terms.items()})
    across = _span(keys, "y", "x", half)
    rows = rows.withColumns({f"__{k}": F.sum(f"__{k}").over(across) for k in terms})
    down = _span(keys, "x", "y", half)
    return rows.withColumns({k: F.sum(f"__{k}").over(down) for k in terms}).drop(*(f"__{k}" for k in terms))


def extent(df: DataFrame, keys: list[str]) -> DataFrame:
    """Last column and row per image; one small row each."""
    return df.groupBy(*keys).agg(F.max("x").alias("x_max"), F.max("y").alias("y_max"))


def interior(df: DataFrame, keys: list[str], half: int) -> DataFrame:
    """Places whose whole window lies in the image."""
    rows = df.join(extent(df, keys), keys)
    return rows.filter((F.col("x") >= half) & (F.col("y") >= half) & (F.col("x") <= F.col("x_max") - half) & (F.col("y") <= F.col("y_max") - half)).drop("x_max", "y_max")


def local_stddev(df: DataFrame, keys: list[str], size: int = 5, alpha: str = "alpha", value: str = "v") -> DataFrame:
    """Sample deviation of the valid values in the window, at valid interior places; up to one value gives 0. Exact integer sums decide."""
    if size < 3 or size % 2 == 0:
        raise ValueError("the window size must be odd and at least 3")
    half, on, v = size // 2, F.col(alpha), F.col(value)
    one = lambda x: F.when(on, x).otherwise(F.lit(0).cast("long"))
    sums = box_sums(df, keys, half, n=one(F.lit(1).cast("long")), s=one(v), q=one(v * v))
    inner = interior(sums, keys, half).filter(on)
    n, s, q = F.col("n"), F.col("s"), F.col("q")
    var = (n * q - s * s) / (n * (n - 1))
    return inner.select(*keys, *XY, F.when(n <= 1, F.lit(0.0)).otherwise(F.sqrt(var)).alias("stddev"))


#: Up to this size a window's values are compared with each other, all tiles of one shape at once.
SMALL_WINDOW = 3


def sliding_entropy(values: np.ndarray, valid: np.ndarray, half: int) -> np.ndarray:
    """Entropy over the log of the number of distinct values, of the valid values around each place whose window lies in the array; else 0.

    Columns keep histograms of as many rows as the window has; the next row is inserted and the last one erased, and running
    sums over the columns give every window's counts. So the work does not grow with the window.
    """
    h, w = values.shape
    out = np.zeros((h, w))
    size = 2 * half + 1
    if h < size or w < size:
        return out
    known, rank = np.unique(values, return_inverse=True)
    rank = rank.reshape(h, w)
    x = np.arange(w)
    columns = np.zeros((w, len(known)), np.int32)
    c = np.arange(size * size + 1)
    by_count = np.where(c > 0, c * np.log(np.maximum(c, 1)), 0.0)

    def count(y: int, sign: int) -> None:
        on = valid[y]
        columns[x[on], rank[y, on]] += sign

    for y in range(h):
        count(y, 1)
        if y >= size:
            count(y - size, -1)
        if y >= size - 1:
            running = np.zeros((w + 1, len(known)), np.int32)
            np.cumsum(columns, axis=0, out=running[1:])
            windows = running[size:] - running[:-size]
            n, bins, t = windows.sum(axis=1), (windows > 0).sum(axis=1), by_count[windows].sum(axis=1)
            some = bins > 1
            entropy = (np.log(np.maximum(n, 1)) - t / np.maximum(n, 1)) / np.log(np.maximum(bins, 2))
            out[y - half, half : w - half] = np.where(some, entropy, 0.0)
    return out


def small_entropy(values: np.ndarray, valid: np.ndarray, half: int) -> np.ndarray:
    """:func:`sliding_entropy` of many arrays, [row, y, x]: each value of a window is counted in it, so the work grows with the fourth power of its size."""
    h, w = values.shape[1:]
    out = np.zeros(values.shape)
    size = 2 * half + 1
    if h < size or w < size:
        return out
    at = [np.s_[:, dy : h - size + 1 + dy, dx : w - size + 1 + dx] for dy in range(size) for dx in range(size)]
    n, bins, t = (np.zeros(values[at[0]].shape, kind) for kind in (np.int64, np.int64, float))
    logs = np.log(np.arange(1, size * size + 1))
    for i, a in enumerate(at):
        count, first = np.zeros(n.shape, np.int64), valid[a].copy()
        for j, b in enumerate(at):
            same = valid[a] & valid[b] & (values[a] == values[b])
            count += same
            if j < i:
                first &= ~same
        n += valid[a]
        bins += first
        t += logs[np.maximum(count, 1) - 1]
    entropy = (np.log(np.maximum(n, 1)) - t / np.maximum(n, 1)) / np.log(np.maximum(bins, 2))
    out[:, half : h - half, half : w - half] = np.where(bins > 1, entropy, 0.0)
    return out


def local_entropies(df: DataFrame, keys: list[str], values: dict[str, str], size: int = 3, alpha: str = "alpha", top: float = 255.0, side: int = tiles.SIDE) -> DataFrame:
    """Entropy of the valid values in the window over the log of their number of distinct values, times ``top``, at valid interior places,
    for each column of ``values`` under the name it has there. Values are whole numbers.

    Tiles with a halo of half a window go through one exchange for all columns, then through :func:`small_entropy` or :func:`sliding_entropy`; both give the same.
    """
    half = size // 2
    names = [f"__v{i}" for i in range(len(values))]
    packed = tiles.pack(df.select(*keys, *XY, *(F.col(c).alias(n) for c, n in zip(values, names)), F.coalesce(F.col(alpha), F.lit(False)).alias("__on")), keys, names, ["__on"], side)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tiles.bounded(batches):
            at, found = [], []
            planes = [(b.column(n).offsets.to_numpy(), tiles._numbers(b.column(n).values)) for n in (*names, "__on")]
            for (tx, ty, w, h, x0, y0, pw, ph), rows in tiles._alike(tiles._geometry(b, [*tiles.TILE, "w", "h", "x0", "y0", "pw", "ph"])):
                left, top_, right, low = max(tx * side, half), max(ty * side, half), min(tx * side + side, w - half), min(ty * side + side, h - half)
                if left >= right or top_ >= low:
                    continue
                *given, on = (tiles._stack(starts[rows], v, (ph, pw)) for starts, v in planes)
                on = on > 0
                inner = np.s_[:, top_ - y0 : low - y0, left - x0 : right - x0]
                of, y, x = np.nonzero(on[inner])
                entropies = [small_entropy(v, on, half) if size <= SMALL_WINDOW else np.stack([sliding_entropy(*pair, half) for pair in zip(v, on)]) for v in given]
                at.append(rows[of])
                found.append((x + left, y + top_, *(e[inner][of, y, x] * top for e in entropies)))
            columns = [np.concatenate(c) for c in zip(*found)] if found else [np.empty(0, kind) for kind in (np.int64, np.int64, *([float] * len(names)))]
            yield pa.RecordBatch.from_arrays([*tiles._taken(b, keys, np.concatenate(at) if at else []), *map(pa.array, columns)], names=[*keys, *XY, *values.values()])

    schema = ", ".join([tiles._types(df, keys), "x long, y long", *(f"`{n}` double" for n in values.values())])
    return tiles.haloed(packed, keys, [*names, "__on"], half, side).mapInArrow(run, schema)


def local_entropy(df: DataFrame, keys: list[str], size: int = 3, alpha: str = "alpha", value: str = "v", top: float = 255.0, side: int = tiles.SIDE) -> DataFrame:
    """:func:`local_entropies` of one column, as column entropy."""
    return local_entropies(df, keys, {value: "entropy"}, size, alpha, top, side)


def convolve(df: DataFrame, keys: list[str], kernel: dict[tuple[int, int], float], value: str = "v", normalise: bool = False) -> DataFrame:
    """Sum of kernel[dx, dy] * v(x + dx, y + dy) over the places that exist; ``normalise`` divides by the weight met, times the kernel's."""
    taps = F.array(*(F.struct(F.lit(-dx).cast("long").alias("dx"), F.lit(-dy).cast("long").alias("dy"), F.lit(float(w)).alias("w")) for (dx, dy), w in kernel.items()))
    moved = df.withColumn("__t", F.explode(taps)).select(*keys, (F.col("x") + F.col("__t.dx")).alias("x"), (F.col("y") + F.col("__t.dy")).alias("y"), (F.col("__t.w") * F.col(value)).alias("p"), F.col("__t.w").alias("w"))
    total = sum(kernel.values())
    sums = moved.groupBy(*keys, *XY).agg(F.sum("p").alias("p"), F.sum("w").alias("w"))
    out = F.col("p") / F.col("w") * total if normalise else F.col("p")
    return sums.select(*keys, *XY, out.alias("out")).join(df.select(*keys, *XY), [*keys, *XY], "left_semi")


PLUS = {(0, 0): 1.0, (1, 0): 1.0, (-1, 0): 1.0, (0, 1): 1.0, (0, -1): 1.0}


def laplacian_of_gaussian(scale: float, rounded: int = 12) -> dict[tuple[int, int], float]:
    """LoG kernel with radius three scales, shifted to sum to zero."""
    radius = max(1, math.ceil(3 * scale))
    raw = {(x, y): (x * x + y * y - 2 * scale * scale) / (2 * math.pi * scale**6) * math.exp(-(x * x + y * y) / (2 * scale * scale)) for x in range(-radius, radius + 1) for y in range(-radius, radius + 1)}
    mean = sum(raw.values()) / len(raw)
    return {k: round(v - mean, rounded) for k, v in raw.items()}


def gaussian_sharpening(scale: float, factor: float, rounded: int = 12) -> dict[tuple[int, int], float]:
    """(1 + factor) * identity - factor * Gaussian."""
    radius = max(1, math.ceil(3 * scale))
    raw = {(x, y): math.exp(-(x * x + y * y) / (2 * scale * scale)) for x in range(-radius, radius + 1) for y in range(-radius, radius + 1)}
    total = sum(raw.values())
    return {k: round((1 + factor) * (k == (0, 0)) - factor * v / total, rounded) for k, v in raw.items()}


def gradients(df: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """Symmetric differences gx, gy halved; borders, which lack a neighbour, get 0."""
    row, column = W.partitionBy(*keys, "y").orderBy("x"), W.partitionBy(*keys, "x").orderBy("y")
    d = lambda w: F.coalesce((F.lead(value).over(w) - F.lag(value).over(w)) / 2, F.lit(0.0))
    return df.select(*keys, *XY, d(row).alias("gx"), d(column).alias("gy"))


def isolated_points(df: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """Zero places with no zero among their eight neighbours."""
    zero = box_sums(df, keys, 1, z=F.when(F.col(value) == 0, 1).otherwise(0).cast("long"))
    return zero.filter((F.col(value) == 0) & (F.col("z") == 1)).select(*keys, *XY)


def transition_bounds(df: DataFrame, keys: list[str], value: str = "m") -> DataFrame:
    """Bounding box of the places that differ from their left or upper neighbour, the neighbour included; images without one fall out."""
    left, up = F.lag(value).over(W.partitionBy(*keys, "y").orderBy("x")), F.lag(value).over(W.partitionBy(*keys, "x").orderBy("y"))
    rows = df.select(*keys, *XY, (left != F.col(value)).alias("h"), (up != F.col(value)).alias("k")).filter("h or k")
    x0, y0 = F.when(F.col("h"), F.col("x") - 1).otherwise(F.col("x")), F.when(F.col("k"), F.col("y") - 1).otherwise(F.col("y"))
    return rows.groupBy(*keys).agg(F.min(x0).alias("x0"), F.min(y0).alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
