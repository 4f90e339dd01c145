"""Distances, nearest features, overlap and polygon operators on binary masks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.pixelwise import XY
from tessera.operators.tiles import bounded


#: Rows of pixels in one array of the Euclidean transform.
BAND = 64


def envelope(f: np.ndarray) -> np.ndarray:
    """min over q of (p - q)^2 + f(q) for every p, by the lower envelope of parabolas."""
    n = len(f)
    out = np.full(n, np.inf)
    at = np.flatnonzero(np.isfinite(f))
    if not len(at):
        return out
    hull, cuts = [int(at[0])], [-np.inf]
    for q in at[1:].tolist():
        while True:
            v = hull[-1]
            s = ((f[q] + q * q) - (f[v] + v * v)) / (2 * (q - v))
            if s > cuts[-1]:
                break
            hull.pop()
            cuts.pop()
        hull.append(q)
        cuts.append(s)
    p = np.arange(n)
    nearest = np.array(hull)[np.searchsorted(np.array(cuts), p, "right") - 1]
    return (p - nearest) ** 2 + f[nearest]


def column_distances(df: DataFrame, keys: list[str], features: dict[str, Column]) -> DataFrame:
    """A column for each feature: distance to the nearest one in the same column of the image (null: none there), by running windows over one exchange."""
    column = W.partitionBy(*keys, "x").orderBy("y")
    before, after = column.rowsBetween(W.unboundedPreceding, 0), column.rowsBetween(0, W.unboundedFollowing)

    def nearest(feature: Column) -> Column:
        seen = F.when(feature, F.col("y"))
        return F.least(F.col("y") - F.last(seen, ignorenulls=True).over(before), F.first(seen, ignorenulls=True).over(after) - F.col("y"))

    return df.select(*keys, *XY, *(nearest(f).alias(name) for name, f in features.items()))


def squared_rows(f: np.ndarray) -> np.ndarray:
    """Squared distances along the last axis to the nearest place, which starts from its own: min over q of (p - q)^2 + f(q)."""
    width = f.shape[-1]
    if width > 128:
        return np.apply_along_axis(envelope, -1, f)
    d, at = np.full_like(f, np.inf), np.arange(width)
    for q in range(width):  # all rows at once, one candidate column after the other
        np.minimum(d, (at - q) ** 2 + f[..., q : q + 1], out=d)
    return d


def _euclidean(rows: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Squared Euclidean distances of column distances ``names``: bands of whole rows, all bands of one size at once."""
    cells = F.collect_list(F.struct(*XY, *names)).alias("cells")
    bands = rows.groupBy(*keys, F.floor(F.col("y") / BAND).alias("__band")).agg(cells)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches):
            if not b.num_rows:
                continue
            ends = b.column("cells").offsets.to_numpy()
            x, y, *given = (c.slice(ends[0], ends[-1] - ends[0]) for c in b.column("cells").values.flatten())
            x, y, ends = x.to_numpy(), y.to_numpy(), ends - ends[0]
            of = np.repeat(np.arange(b.num_rows), np.diff(ends))
            least = lambda v: np.minimum.reduceat(v, ends[:-1])
            x, y = x - least(x)[of], y - least(y)[of]
            wide, high = (np.maximum.reduceat(v, ends[:-1]) + 1 for v in (x, y))
            start = np.concatenate([[0], np.cumsum(wide * high)])
            place = start[of] + y * wide[of] + x
            found = []
            for g in given:
                f = np.full(start[-1], np.inf)
                g = g.to_numpy(zero_copy_only=False).astype(float)
                f[place] = np.where(np.isnan(g), np.inf, g * g)
                for w, h in set(zip(wide.tolist(), high.tolist())):
                    same = np.nonzero((wide == w) & (high == h))[0]
                    at = start[same][:, None] + np.arange(w * h)
                    f[at] = squared_rows(f[at].reshape(-1, h, w)).reshape(len(same), -1)
                d = f[place]
                found.append(pa.array(np.where(np.isfinite(d), d, 0).astype(np.int64), mask=~np.isfinite(d)))
            columns = [b.column(k).take(pa.array(of)) for k in keys]
            yield pa.RecordBatch.from_arrays([*columns, *(c.slice(int(b.column("cells").offsets[0].as_py()), len(of)) for c in b.column("cells").values.flatten()[:2]), *found], names=[*keys, *XY, *names])

    kinds = dict(rows.dtypes)
    return bands.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in (*keys, *XY)), *(f"`{n}` long" for n in names)]))


def distances(df: DataFrame, keys: list[str], features: dict[str, Column], metric: str = "euclidean") -> DataFrame:
    """(keys, x, y) and a column for each feature: squared Euclidean or Manhattan distance to the nearest one; null where an image has none.

    One exchange for all columns by running windows in the JVM, one for all rows: running windows
    (Manhattan) or arrays of bands of rows (Euclidean).
    """
    if metric not in ("euclidean", "manhattan"):
        raise ValueError("the metric must be euclidean or manhattan")
    rows = column_distances(df, keys, features)
    if metric == "euclidean":
        return _euclidean(rows, keys, list(features))
    line = W.partitionBy(*keys, "y").orderBy("x")
    before, after = line.rowsBetween(W.unboundedPreceding, 0), line.rowsBetween(0, W.unboundedFollowing)
    x = F.col("x")
    return rows.select(*keys, *XY, *(F.least(F.min(F.col(n) - x).over(before) + x, F.min(F.col(n) + x).over(after) - x).alias(n) for n in features))


def distance_transform(df: DataFrame, keys: list[str], feature: Column, metric: str = "euclidean") -> DataFrame:
    """Squared Euclidean or Manhattan distance of every place to the nearest feature, column d; null where an image has none."""
    return distances(df, keys, {"d": feature}, metric)


def periodic_distances(df: DataFrame, keys: list[str], features: dict[str, Column], width: int, height: int, horizontal: bool = True, vertical: bool = False, metric: str = "euclidean") -> DataFrame:
    """:func:`distances` on a strip or torus: copies on the periodic sides, then the crop."""
    rows = df.select(*keys, *XY, *(f.alias(f"__{n}") for n, f in features.items()))
    shifts = [(i, j) for i in ((-1, 0, 1) if horizontal else (0,)) for j in ((-1, 0, 1) if vertical else (0,))]
    copies = rows.withColumn("__s", F.explode(F.array(*(F.struct(F.lit(i * width).cast("long").alias("dx"), F.lit(j * height).cast("long").alias("dy")) for i, j in shifts))))
    copies = copies.withColumns({"x": F.col("x") + F.col("__s.dx"), "y": F.col("y") + F.col("__s.dy")})
    found = distances(copies, keys, {n: F.col(f"__{n}") for n in features}, metric)
    return found.filter((F.col("x") >= 0) & (F.col("x") < width) & (F.col("y") >= 0) & (F.col("y") < height))


def periodic(df: DataFrame, keys: list[str], feature: Column, width: int, height: int, horizontal: bool = True, vertical: bool = False, metric: str = "euclidean") -> DataFrame:
    """:func:`distance_transform` on a strip or torus."""
    return periodic_distances(df, keys, {"d": feature}, width, height, horizontal, vertical, metric)


def nearest_feature(df: DataFrame, keys: list[str], white: str = "white", black: str = "black", metric: str = "euclidean", wrap: str = "none", size: tuple[int, int] = (0, 0)) -> DataFrame:
    """Column m: 255 where the nearest place that only white covers is closer than the nearest that only black covers.

    Both distances go through the same two exchanges. ``wrap`` (horizontal, vertical or both) makes a canvas of ``size`` a strip or torus.
    """
    features = {"dw": F.col(white) & ~F.col(black), "db": F.col(black) & ~F.col(white)}
    if wrap == "none":
        rows = distances(df, keys, features, metric)
    else:
        rows = periodic_distances(df, keys, features, *size, wrap in ("horizontal", "both"), wrap in ("vertical", "both"), metric)
    closer = F.col("dw").isNotNull() & (F.col("db").isNull() | (F.col("dw") < F.col("db")))
    return rows.select(*keys, *XY, F.when(closer, 255).otherwise(0).cast("long").alias("m"))


def overlap_class(df: DataFrame, keys: list[str], white: str = "white", black: str = "black") -> DataFrame:
    """none, partial or complete: whether white has places in common with black, and places of its own."""
    a = df.groupBy(*keys).agg(F.bool_or(F.col(white) & F.col(black)).alias("common"), F.bool_or(F.col(white) & ~F.col(black)).alias("own"))
    return a.select(*keys, F.when(~F.col("common"), "none").when(F.col("own"), "partial").otherwise("complete").alias("overlap"))


def bounding_box(df: DataFrame, keys: list[str], valid: str = "alpha") -> DataFrame:
    return df.filter(valid).groupBy(*keys).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))


def tally(df: DataFrame, keys: list[str], value: str, bound: int) -> DataFrame:
    """Non-zero values, counted up to ``bound``."""
    return df.groupBy(*keys).agg(F.least(F.count_if(F.col(value) != 0), F.lit(bound).cast("long")).alias("n"))


def fill_polygons(vertices: DataFrame, keys: list[str], width: int, height: int) -> DataFrame:
    """Even-odd fill of closed contours (keys, contour, ord, x, y) sampled at pixel centres; contours cancel where they overlap.

    Each edge meets the scan lines between its ends; sorted crossings of a line pair up to spans.
    """
    ring = W.partitionBy(*keys, "contour").orderBy("ord")
    whole = W.partitionBy(*keys, "contour").orderBy("ord").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    nxt = lambda c: F.coalesce(F.lead(c).over(ring), F.first(c).over(whole))
    edges = vertices.withColumns({"x2": nxt("x"), "y2": nxt("y")}).filter("y <> y2")
    low, high = F.least("y", "y2"), F.greatest("y", "y2")
    # half-open in y, so a shared vertex counts once
    first, last = F.greatest(F.ceil(low), F.lit(0)).cast("long"), F.least(F.ceil(high) - 1, F.lit(height - 1)).cast("long")
    lines = edges.filter(first <= last).withColumn("line", F.explode(F.sequence(first, last)))
    at = F.col("x") + (F.col("line") - F.col("y")) * (F.col("x2") - F.col("x")) / (F.col("y2") - F.col("y"))
    order = W.partitionBy(*keys, "contour", "line").orderBy("at")
    crossings = lines.select(*keys, "contour", "line", at.alias("at")).withColumns({"n": F.row_number().over(order), "to": F.lead("at").over(order)})
    spans = crossings.filter("n % 2 = 1").select(*keys, "line", F.greatest(F.ceil("at"), F.lit(0)).cast("long").alias("a"), F.least(F.ceil("to") - 1, F.lit(width - 1)).cast("long").alias("b")).filter("a <= b")
    inside = spans.withColumn("x", F.explode(F.sequence("a", "b")))
    return inside.groupBy(*keys, "x", F.col("line").alias("y")).agg((F.count("*") % 2).alias("m")).filter("m = 1").select(*keys, *XY)
