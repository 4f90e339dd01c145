"""Intermediate tables and what they leave behind."""

import pytest

from tessera import storage


def test_tables_are_written_listed_and_discarded(spark):
    mine: list[str] = []
    df = spark.range(100).repartition(7)
    out = storage.materialize(df, "numbers", scratch=mine)
    assert out.dtypes == df.dtypes and sorted(r.id for r in out.collect()) == list(range(100))
    assert len(mine) == 1 and mine[0] in storage.written()
    path = mine[0]
    assert storage.discard(spark, mine) == 1 and mine == [] and path not in storage.written()
    with pytest.raises(Exception, match="PATH_NOT_FOUND|Path does not exist"):
        spark.read.parquet(path).count()


@pytest.mark.parametrize("before", ["false", "true"])
def test_the_session_keeps_its_own_cleanup_setting(spark, before):
    spark.conf.set(storage.CLEANUP, before)
    try:
        with storage.without_leftovers(spark):
            assert spark.conf.get(storage.CLEANUP) == "true"
        assert spark.conf.get(storage.CLEANUP) == before
        with pytest.raises(ZeroDivisionError), storage.without_leftovers(spark):
            raise ZeroDivisionError
        assert spark.conf.get(storage.CLEANUP) == before
    finally:
        spark.conf.unset(storage.CLEANUP)


def test_a_table_is_whole_though_its_shuffles_are_gone(spark):
    """The same frame written twice, and read after both: nothing that is still needed goes."""
    df = spark.range(1000).selectExpr("id % 10 as k", "id").groupBy("k").sum("id")
    one, two = storage.materialize(df, "sums"), storage.materialize(df, "sums")
    assert sorted(one.collect()) == sorted(two.collect()) == sorted(df.collect())


def test_no_table_of_places_goes_through_the_driver(spark):
    """Runs of equal numbers are a few bytes as a file and many rows in memory; what a hint asks for is still broadcast."""
    from pyspark.sql import functions as F

    rows = spark.range(200_000).selectExpr("id", "id div 1000 as v")
    a, b = storage.materialize(rows, "a"), storage.materialize(rows, "b")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan(a.join(b, "id"))
    with storage.bounded_broadcasts(spark):
        joined = a.join(b, "id")
        assert joined.count() == 200_000 and "Broadcast" not in plan(joined)
        assert "BroadcastHashJoin" in plan(a.join(F.broadcast(b), "id"))
    assert "BroadcastHashJoin" in plan(a.join(b, "id"))


def test_a_blend_step_broadcasts_nothing(spark):
    from tessera.plans import blend

    rows = spark.range(160).selectExpr("id div 80 as image_id", "id % 10 as x", "id % 80 div 10 as y", "id % 200 as v")
    side = lambda ok: rows.withColumn("alpha", ok)
    out = blend.join_image(side(rows.x < 7), side(rows.x > 3), ["image_id"], 2)
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString() and out.count() == 160
