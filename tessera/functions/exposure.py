"""Exposure weight functions, and the registry for user-defined ones.

All are functions of z = (y - optimum) / width; widths are rescaled so that every
function has the full width at half maximum of the Gaussian of that width.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

GAUSS_FWHM = 2 * math.sqrt(2 * math.log(2))
SAMPLES = 65_536

#: name -> (its own full width at half maximum for width 1, weight of z)
BUILT_IN: dict[str, tuple[float, Callable[[Column], Column]]] = {
    "gaussian": (GAUSS_FWHM, lambda z: F.exp(-z * z / 2)),
    "lorentzian": (2 * math.sqrt(2), lambda z: 1 / (1 + z * z / 2)),
    "halfsine": (2 * math.pi / 3, lambda z: F.when(F.abs(z) <= math.pi / 2, F.cos(z)).otherwise(F.lit(0.0))),
    "fullsine": (math.pi, lambda z: F.when(F.abs(z) <= math.pi, 0.5 + F.cos(z) / 2).otherwise(F.lit(0.0))),
    "bisquare": (2 * 0.5**0.25, lambda z: F.when(F.abs(z) <= 1, 1 - z * z * z * z).otherwise(F.lit(0.0))),
}
ALIASES = {"gauss": "gaussian", "lorentz": "lorentzian", "half-sine": "halfsine", "full-sine": "fullsine", "bi-square": "bisquare"}
_user: dict[str, Callable[[pd.Series], pd.Series]] = {}


def register_weight(name: str, weight: Callable[[pd.Series], pd.Series]) -> None:
    """A vectorised user function of z, run as a scalar pandas UDF."""
    if name in BUILT_IN or name in ALIASES:
        raise ValueError(f"{name!r} is built in")
    _user[name] = weight


def names() -> list[str]:
    return [*BUILT_IN, *ALIASES, *_user]


def weight(name: str, y: Column, optimum: float = 0.5, width: float = 0.2) -> Column:
    """The weight of normalised luminance ``y`` in [0, 1]."""
    if width <= 0:
        raise ValueError("the width must be positive")
    key = ALIASES.get(name, name)
    if key in BUILT_IN:
        own, f = BUILT_IN[key]
        return f((y - optimum) / (width * GAUSS_FWHM / own))
    if key in _user:
        return F.pandas_udf(_user[key], DoubleType())((y - optimum) / width)
    raise ValueError(f"unknown weight function {name!r}; known: {', '.join(names())}")


def dump(spark: SparkSession, name: str, n: int = 21, optimum: float = 0.5, width: float = 0.2) -> DataFrame:
    """n equidistant samples (i, y, w) over [0, 1]."""
    return spark.range(n).select(F.col("id").alias("i"), (F.col("id") / (n - 1)).alias("y")).withColumn("w", weight(name, F.col("y"), optimum, width))


def validate(spark: SparkSession, name: str, optimum: float = 0.5, width: float = 0.2, n: int = SAMPLES) -> DataFrame:
    """One row (n_negative, n_over, n_zero, n, valid): a weight may not be negative, over one, or zero throughout."""
    return faults(dump(spark, name, n, optimum, width), [], F.col("w"))


def faults(df: DataFrame, keys: list[str], w: Column) -> DataFrame:
    """(keys, n_negative, n_over, n_zero, n, valid) of the weights ``w`` that occur: none may be negative or over one, nor all zero."""
    out = df.groupBy(*keys).agg(F.count_if(w < 0).alias("n_negative"), F.count_if(w > 1).alias("n_over"), F.count_if(w == 0).alias("n_zero"), F.count("*").alias("n"))
    return out.withColumn("valid", (F.col("n_negative") == 0) & (F.col("n_over") == 0) & (F.col("n_zero") < F.col("n")))


def tabulated(spark: SparkSession, name: str, n: int = 256, optimum: float = 0.5, width: float = 0.2) -> DataFrame:
    """A lookup table (i, w) for nearest-sample weights; n rows, so it may be broadcast."""
    return dump(spark, name, n, optimum, width).select("i", "w")


def lookup(df: DataFrame, y: Column, table: DataFrame, n: int = 256) -> DataFrame:
    """``df`` with the table's nearest weight as column w."""
    i = F.floor(F.least(F.greatest(y, F.lit(0.0)), F.lit(1.0)) * (n - 1) + 0.5).cast("long")
    return df.withColumn("i", i).join(F.broadcast(table), "i", "left").drop("i")
