"""Intermediate tables in the folder that the driver and all executors share.

A table written here cuts lineage and outlives a lost executor, which a
local checkpoint does not.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Used only in local mode, and only where the session names no shared folder, as in tests.
LOCAL_DIR = "/tmp/checkpoints"

_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a cluster without one is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return LOCAL_DIR


#: Spark's own option to delete an execution's shuffle files once it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Tables that Spark may broadcast unasked: none by the size of files, which says little of how many rows Parquet packs into
#: them, and by the size measured once a shuffle has run only up to a fixed one. What a hint asks for is still broadcast.
BROADCASTS = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "1m"}


@contextmanager
def _set(spark: SparkSession, options: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in options}
    try:
        for k, v in options.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


@contextmanager
def without_leftovers(spark: SparkSession) -> Iterator[None]:
    """Executions in here leave no shuffle files behind: what they write has no need of them, and they would pile up until the driver collects garbage."""
    with _set(spark, {CLEANUP: "true"}):
        yield


@contextmanager
def bounded_broadcasts(spark: SparkSession) -> Iterator[None]:
    """Executions in here send no table through the driver that grows with the input."""
    with _set(spark, BROADCASTS):
        yield


def materialize(df: DataFrame, name: str, partition_by: str | None = None, scratch: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return it as read from there; its path is added to ``scratch``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    with without_leftovers(spark), bounded_broadcasts(spark):
        writer.parquet(path)
    _written.append(path)
    if scratch is not None:
        scratch.append(path)
    return spark.read.schema(df.schema).parquet(path)


def written() -> list[str]:
    """The tables that this process wrote and that are still there."""
    return list(_written)


def discard(spark: SparkSession, paths: list[str]) -> int:
    """Delete tables that no frame still to be run reads, and empty the list."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    n = 0
    while paths:
        name = paths.pop()
        path = jvm.org.apache.hadoop.fs.Path(name)
        n += bool(path.getFileSystem(conf).delete(path, True))
        if name in _written:
            _written.remove(name)
    return n


def release(spark: SparkSession) -> int:
    """Delete all tables that this process wrote; frames that read them can't be used afterwards."""
    return discard(spark, list(_written))
