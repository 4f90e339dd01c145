"""Scoring and selection across a stack of images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def exposure_with_cutoff(score: Column, low: Column, high: Column, lower: float, upper: float) -> Column:
    """The score where the low projector reaches ``lower`` and the high one does not pass ``upper``, else 0."""
    return F.when((low >= lower) & (high <= upper), score).otherwise(F.lit(0.0))


def total_score(alpha: Column | None, *scores: Column) -> Column:
    out = sum(scores[1:], scores[0])
    return out if alpha is None else F.when(alpha, out).otherwise(F.lit(0.0))


def normalise(df: DataFrame, place: list[str], weight: str = "w", top: int = 255, name: str = "m") -> DataFrame:
    """Soft masks: top * w / sum of w at the place; where all weights are 0, the integer share top div n."""
    at = W.partitionBy(*place)
    total, n = F.sum(weight).over(at), F.count("*").over(at)
    return df.withColumn(name, F.when(total > 0, top * F.col(weight) / total).otherwise(F.floor(F.lit(top) / n).cast("double")))


def hard_mask(df: DataFrame, place: list[str], weight: str = "w", order: str = "ord", top: float = 255.0, name: str = "m") -> DataFrame:
    """One-hot masks: the heaviest image, the first on ties; where all weights are 0, top / n each.

    The winner is an aggregate (partial sums before the shuffle), joined back on the place.
    """
    best = df.groupBy(*place).agg(F.max(F.struct(F.col(weight).alias("w"), (-F.col(order)).alias("o"))).alias("__best"), F.count("*").alias("__n"))
    rows = df.join(best, place)
    out = F.when(F.col("__best.w") <= 0, top / F.col("__n")).when(F.col(order) == -F.col("__best.o"), F.lit(top)).otherwise(F.lit(0.0))
    return rows.withColumn(name, out).drop("__best", "__n")


def weighted_average(df: DataFrame, place: list[str], value: str = "v", mask: str = "m", name: str = "v") -> DataFrame:
    """Single-level fusion: the mean of the stack under the masks, rounded half up."""
    return df.groupBy(*place).agg(F.floor(F.sum(F.col(value) * F.col(mask)) / F.sum(mask) + 0.5).cast("long").alias(name))


def alpha_union(df: DataFrame, place: list[str], alpha: str = "alpha") -> DataFrame:
    return df.groupBy(*place).agg(F.bool_or(alpha).alias("alpha"))
