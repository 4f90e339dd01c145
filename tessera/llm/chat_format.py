"""Chat formatting: collapse cumulative snapshots, then render what is left.

Logs often hold a conversation again and again as it grows. Each turn gets a
rolling hash of all turns up to it (running sums of position-tagged turn hashes,
four lanes of 32 bits); a conversation whose last hash is another's hash at the
same length, with more turns after it, is a snapshot and goes by an anti-join.
Of conversations with the same turns the one with the smallest conv_id stays. Up to here only hashes move;
then the turns of the conversations that stay are rendered.

Defined results: turns are ordered by (turn, role, text), nulls first; repeated
rows of a conversation count once; null role or text render as empty; rows with
a null conv_id form one conversation; further columns are not read; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LANES = ["k1", "k2", "k3", "k4"]
START, END = "<|im_start|>", "<|im_end|>"


def _turn_hashes(turns: DataFrame) -> DataFrame:
    """(key, conv_id, role, text, pos, lanes) for each distinct turn, in order; ``key`` is conv_id as text, never null."""
    order = W.partitionBy("key").orderBy(F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text"))
    # h covers role and text with their presence and lengths, so fields can't run into each other
    content = [F.coalesce(F.length("role"), F.lit(-1)), F.coalesce(F.length("text"), F.lit(-1)), F.col("role"), F.col("text")]
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("null"))
    rows = turns.select(key.alias("key"), "conv_id", "turn", "role", "text")
    same = lambda c: F.lag(F.struct("turn", "role", "text")).over(order).getField(c).eqNullSafe(F.col(c))
    rows = rows.withColumn("again", (F.row_number().over(order) > 1) & same("turn") & same("role") & same("text")).filter("not again")
    rows = rows.withColumn("pos", F.row_number().over(order))
    a, b = F.xxhash64(F.lit(17), F.col("pos"), *content), F.xxhash64(F.lit(91), *content, F.col("pos"))
    mask = F.lit(0xFFFFFFFF)
    rows = rows.withColumns({"a": a, "b": b}).withColumns({"l1": F.col("a").bitwiseAND(mask), "l2": F.shiftrightunsigned("a", 32), "l3": F.col("b").bitwiseAND(mask), "l4": F.shiftrightunsigned("b", 32)})
    running = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.select("key", "conv_id", "role", "text", "pos", *(F.sum(f"l{i}").over(running).alias(f"k{i}") for i in range(1, 5)))


def collapse(turns: DataFrame) -> DataFrame:
    """Maximal conversations: conv_id, n_turns, n_copies, text rendered."""
    hashed = _turn_hashes(turns)
    convs = hashed.groupBy("key").agg(F.first("conv_id").alias("conv_id"), F.max("pos").alias("n_turns"), *(F.max_by(k, "pos").alias(k) for k in LANES))
    # Copies first, so that a hot conversation is one row; the aggregate combines before its shuffle.
    distinct = convs.groupBy("n_turns", *LANES).agg(F.min_by("key", F.struct(F.col("conv_id").isNull(), F.col("conv_id"))).alias("key"), F.count("*").alias("n_copies"))
    proper = hashed.select("key", "pos", *LANES).withColumn("n", F.max("pos").over(W.partitionBy("key"))).filter("pos < n")
    prefixes = proper.select(F.col("pos").alias("n_turns"), *LANES).distinct()
    kept = distinct.join(prefixes, ["n_turns", *LANES], "left_anti").select("key", "n_turns", "n_copies")
    body = F.concat(F.lit(START), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(END + "\n"))
    rows = hashed.select("key", "conv_id", "pos", body.alias("body")).join(kept, "key")
    bodies = F.transform(F.array_sort(F.collect_list(F.struct("pos", "body"))), lambda x: x.getField("body"))
    out = rows.groupBy("key").agg(F.first("conv_id").alias("conv_id"), F.first("n_turns").alias("n_turns"), F.first("n_copies").alias("n_copies"), F.array_join(bodies, "").alias("text"))
    return out.select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), F.col("n_copies").cast("long").alias("n_copies"), "text")
