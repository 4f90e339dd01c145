"""What the index sends: keys and ids, whatever the number of partitions that a document's keys fall into."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import ngram_join as N


@pytest.fixture
def partitions(spark):
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    yield lambda n: spark.conf.set(key, str(n))
    spark.conf.set(key, before)


def test_more_partitions_send_no_more_bytes(spark, monkeypatch, partitions):
    rnd = np.random.default_rng(5)
    docs = spark.createDataFrame([(i, " ".join(f"w{x}" for x in rnd.integers(0, 10**6, 3000))) for i in range(400)], "doc_id long, text string").coalesce(1)
    sent = []
    exchange = N.exchange

    def spy(rows, n):
        sent.append(rows.agg(F.sum(F.length("blob"))).first()[0])
        return exchange(rows, n)

    monkeypatch.setattr(N, "exchange", spy)
    common = spark.sparkContext.broadcast(np.empty(0, np.uint64))
    for n in (2, 40):
        partitions(n)
        N._index(docs, N.Join(5, 80, 100), {}, common, [])
    few, many = sent[0], sent[2]
    assert few < many < 1.2 * few


def test_small_buckets_of_the_same_members_are_one(spark, partitions):
    partitions(3)
    words = [f"w{i}" for i in range(400)]
    texts = {7: words, 3: [*words, "more"], 9: [*words, "other"], 1: [f"v{i}" for i in range(400)]}
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string").repartition(4)
    rows = N._index(docs, N.Join(5, 80, 100), {}, spark.sparkContext.broadcast(np.empty(0, np.uint64)), []).filter("kind = 2").collect()
    buckets = {}
    for r in rows:
        buckets.setdefault(r.id, []).append(r.other)
    members = [tuple(sorted(x)) for x in buckets.values()]
    assert (3, 7, 9) in members and len(members) == len(set(members)) and not any(1 in x for x in members)


def test_packed_numbers_come_back():
    rnd = np.random.default_rng(1)
    key = rnd.integers(0, 1 << 48, 500).astype(np.uint64)
    doc = np.array([5, -3, 1 << 62, -(1 << 62), 0, 12])
    row = rnd.integers(0, len(doc), len(key))
    got = N._unpack_keys(N._pack_keys(key, row, doc))
    assert sorted(zip(key.tolist(), doc[row].tolist())) == sorted(zip(*(x.tolist() for x in got)))
    buckets = [np.sort(rnd.integers(-(1 << 62), 1 << 62, (20, n)), axis=1) for n in (2, 3, 64)]
    assert all((a == b).all() for a, b in zip(buckets, N._unpack_buckets(N._pack_buckets(buckets)), strict=True))


def test_buckets_cut_by_batches_stay_whole(spark, monkeypatch):
    monkeypatch.setattr(N, "MEMBERS_AT_ONCE", 4)
    join, shingles = N.Join(5, 80, 100), N.Shingler(5)
    sets = [shingles(" ".join(f"w{i}-{g}" for i in range(100)) + f" x{k}") for g in range(12) for k in range(3)]
    info = spark.createDataFrame([(i, len(s), bytearray(N.sketch(N._mix(s + N._C)).tobytes())) for i, s in enumerate(sets)], "id long, n long, sketch binary")
    members = info.selectExpr("id div 3 as bucket", "id")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        got = {(r.a, r.b, r.closed) for r in N._small_buckets(members, info, join).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == {(3 * g, 3 * g + k, False) for g in range(12) for k in (1, 2)}
