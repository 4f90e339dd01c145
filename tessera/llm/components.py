"""Connected components of an edge table, by alternating large and small stars.

Every step is joins and combined aggregates over the edge table; no component is
gathered in one task. The edges of a node with very many of them meet one least
neighbour, in a join that adaptive execution splits where it is skewed. Edges reach
fixed stars in a number of rounds that grows with the logarithm of the longest path;
each round is written to the shared folder and the one before it deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.storage import discard, materialize

MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    rest = down.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return rest.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, scratch: list[str] | None = None) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): the smallest node it reaches. Its table's path is added to ``scratch``."""
    spark, last, kept = edges.sparkSession, [], []
    now = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges", scratch=kept)
    mark = None
    for _ in range(MAX_ROUNDS):
        last, kept = kept, []
        now = materialize(_small_star(_large_star(now)), "edges", scratch=kept)
        discard(spark, last)
        # order-free sum of the edges; equal twice in a row means stars
        s = now.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x"), F.sum(F.xxhash64("b", "a").cast("decimal(20,0)")).alias("s")).first()
        if (s.n, s.x, s.s) == mark:
            break
        mark = (s.n, s.x, s.s)
    else:
        raise RuntimeError("the components did not settle")
    if scratch is not None:
        scratch += kept
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
