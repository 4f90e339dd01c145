"""The pixel algebra: maps, aligned combinations, masked forms, crops and strides.

Images are relations keyed by ``keys`` (image id and coordinates). Aligned
combination is an inner equi-join on the keys, so one hash partitioning serves a
chain of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

XY = ["x", "y"]


def transform(df: DataFrame, **values: Column) -> DataFrame:
    return df.withColumns(values)


def transform_if(df: DataFrame, mask: Column, **values: Column) -> DataFrame:
    """New values where the mask holds; the others stay (a null mask does not hold)."""
    return df.withColumns({k: F.when(mask, v).otherwise(F.col(k)) for k, v in values.items()})


def combine(a: DataFrame, b: DataFrame, keys: list[str], suffixes: tuple[str, str] = ("_a", "_b")) -> DataFrame:
    """Both images' values at each common place, columns suffixed."""
    left = a.select(*keys, *(F.col(c).alias(c + suffixes[0]) for c in a.columns if c not in keys))
    right = b.select(*keys, *(F.col(c).alias(c + suffixes[1]) for c in b.columns if c not in keys))
    return left.join(right, keys)


def combine_three(a: DataFrame, b: DataFrame, c: DataFrame, keys: list[str]) -> DataFrame:
    third = c.select(*keys, *(F.col(x).alias(x + "_c") for x in c.columns if x not in keys))
    return combine(a, b, keys).join(third, keys)


def overwrite_if(under: DataFrame, over: DataFrame, keys: list[str], mask: str, values: list[str]) -> DataFrame:
    """``over``'s values where it has the place and its ``mask`` holds, else ``under``'s."""
    top = over.select(*keys, F.col(mask).alias("__m"), *(F.col(v).alias(f"__{v}") for v in values))
    rows = under.join(top, keys, "left")
    return rows.select(*[c for c in under.columns if c not in values], *(F.when(F.col("__m"), F.col(f"__{v}")).otherwise(F.col(v)).alias(v) for v in values))


def overlay(under: DataFrame, over: DataFrame, keys: list[str]) -> DataFrame:
    """All places of either image, ``over``'s where both have one."""
    rest = under.join(over.select(*keys), keys, "left_anti")
    return rest.unionByName(over.select(*rest.columns))


def crop(df: DataFrame, x0: int, y0: int, x1: int, y1: int) -> DataFrame:
    """Places in [x0, x1) x [y0, y1); the range reaches the scan where x and y are stored."""
    return df.filter((F.col("x") >= x0) & (F.col("x") < x1) & (F.col("y") >= y0) & (F.col("y") < y1))


def stride(df: DataFrame, sx: int, sy: int) -> DataFrame:
    """Every sx-th column and sy-th row."""
    return df.filter((F.col("x") % sx == 0) & (F.col("y") % sy == 0)).withColumns({"x": F.expr(f"x div {sx}"), "y": F.expr(f"y div {sy}")})


def merge_channels(df: DataFrame, name: str = "rgb") -> DataFrame:
    return df.withColumn(name, F.struct("r", "g", "b")).drop("r", "g", "b")


def split_channels(df: DataFrame, name: str = "rgb") -> DataFrame:
    return df.select(*[c for c in df.columns if c != name], f"{name}.r", f"{name}.g", f"{name}.b")
