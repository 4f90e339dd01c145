"""Columns of numbers exchanged between tasks as packed rows.

A map task packs the records for each reduce partition into one binary value, so
millions of small records cost a few rows. Records that share a key inside one
map task are combined there: one *witness* goes to the key's partition, the others
take any partition and say so, hence no key, however hot, fills a partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of an Arrow batch that holds whole texts.
TEXT_ROWS = 1000


def bounded_batches(spark: SparkSession) -> None:
    """Let the session send whole texts to Python in smaller batches than its default, which both sides hold in memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= TEXT_ROWS:
        spark.conf.set(key, str(TEXT_ROWS))


def partition_count(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def partition_ids(spark: SparkSession, n: int) -> list[int]:
    """For each of ``n`` hash partitions a number that Spark sends there."""
    found: dict[int, int] = {}
    top = 16 * n + 64
    while len(found) < n:
        rows = spark.range(top).select(F.col("id").cast("int").alias("i")).groupBy(F.pmod(F.hash("i"), F.lit(n)).alias("p")).agg(F.min("i").alias("i"))
        found = {r.p: r.i for r in rows.collect()}  # n rows
        top *= 4
    return [found[p] for p in range(n)]


def pack(columns: list[np.ndarray]) -> bytes:
    return len(columns[0]).to_bytes(8, "little") + b"".join(np.ascontiguousarray(c).tobytes() for c in columns)


def unpack(blob: bytes, kinds: list[str]) -> list[np.ndarray]:
    n, at, out = int.from_bytes(blob[:8], "little"), 8, []
    for kind in kinds:
        out.append(np.frombuffer(blob, kind, n, at))
        at += out[-1].nbytes
    return out


def scatter(to: np.ndarray, columns: list[np.ndarray], ids: list[int], tag: int) -> Iterator[pa.RecordBatch]:
    """One row (pid, tag, blob) for each partition number that occurs in ``to``."""
    order = np.argsort(to, kind="stable")
    cuts = np.searchsorted(to[order], np.arange(len(ids) + 1))
    columns = [c[order] for c in columns]
    pids, blobs = [], []
    for p, pid in enumerate(ids):
        a, b = cuts[p], cuts[p + 1]
        if b > a:
            pids.append(pid)
            blobs.append(pack([c[a:b] for c in columns]))
    if pids:
        yield pa.RecordBatch.from_arrays([pa.array(pids, pa.int32()), pa.array([tag] * len(pids), pa.int32()), pa.array(blobs, pa.large_binary() if sum(map(len, blobs)) > 1 << 30 else pa.binary())], names=["pid", "tag", "blob"])


SCATTERED = "pid int, tag int, blob binary"


def exchange(rows: DataFrame, n: int) -> DataFrame:
    return rows.repartition(n, "pid")


def witnesses(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by key; whether each record (in that order) is the first of its key; the size of its group."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    first = np.ones(len(k), bool)
    first[1:] = k[1:] != k[:-1]
    group = np.cumsum(first) - 1
    return order, first, np.bincount(group)[group] if len(k) else group
