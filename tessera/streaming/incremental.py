"""Mosaicking as a stream: each micro-batch of images joins the mosaic kept in a folder.

Versions are written beside each other and named by batch, so a batch that is run
again after a failure replaces its own version and nothing else.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fold_images(stream: DataFrame, keys: list[str], path: str, step: Callable[[DataFrame | None, DataFrame], DataFrame]):
    """Start a query that folds batches into the mosaic under ``path``; ``step(so_far, batch)`` gives the new one."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = spark.read.parquet(f"{path}/v={number - 1}") if number else None
        step(before, batch).write.mode("overwrite").parquet(f"{path}/v={number}")

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", f"{path}/_checkpoint").trigger(availableNow=True).start()


def latest(spark: SparkSession, path: str, number: int) -> DataFrame:
    return spark.read.parquet(f"{path}/v={number}")


def overlay_step(keys: list[str]) -> Callable[[DataFrame | None, DataFrame], DataFrame]:
    """The newest valid pixel of each place, by the batch's order column within a batch."""

    def step(before: DataFrame | None, batch: DataFrame) -> DataFrame:
        new = batch.filter("alpha").groupBy(*keys, "x", "y").agg(F.max_by("v", "ord").alias("v"))
        if before is None:
            return new
        return before.join(new.select(*keys, "x", "y"), [*keys, "x", "y"], "left_anti").unionByName(new)

    return step
