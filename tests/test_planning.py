"""Plans, look-ahead and the planner contract."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from rangeloom.functions.scalars import effective_size, look_ahead
from rangeloom.operators import planner
from rangeloom.operators.ledger import stats
from rangeloom.operators.planner import RangeSource, allocate, may_allocate, plan_ranges


def plan(spark, last, following, size, pid=0):
    return rows(plan_ranges(spark.createDataFrame([(last, following, pid)], "last_id long, next_id long, max_partition_id long"), size))


def test_two_ranges(spark):
    assert plan(spark, 0, 1000, 500) == [(1, 1, 500), (2, 501, 1000)]
    assert plan(spark, 0, 1000, 0) == [(1, 1, 1000)]


@pytest.mark.parametrize("last, following, n", [(0, 2000, 2), (0, 2500, 3), (100, 1101, 2), (0, 500, 1), (0, 1000, 1), (999, 2000, 2)])
def test_plans_are_contiguous(spark, last, following, n):
    got = plan(spark, last, following, 1000, 7)
    assert len(got) == n and got[0][1] == last + 1 and got[-1][2] == following and got[0][0] == 8
    assert all(b[1] == a[2] + 1 for a, b in zip(got, got[1:], strict=False))


def test_plans_in_steps(spark, monkeypatch):
    monkeypatch.setattr(planner, "STEP", 7)
    got = plan(spark, 0, 1000, 10)
    assert got == [(i + 1, i * 10 + 1, i * 10 + 10) for i in range(100)]
    assert plan(spark, 0, 75, 10)[-1] == (8, 71, 75)


def test_look_ahead(spark):
    cases = [(1000, 2, 3), (1000, 0, 3), (1000, 4, 3), (1000, 10, 5), (2**62, 3, 4), (-1, 10, 5)]
    df = spark.createDataFrame(cases, "s long, w long, m long").select(look_ahead(F.col("s"), F.col("w"), F.col("m")).alias("x"))
    assert [r.x for r in df.collect()] == [9000, 9000, 12000, 50000, 1_000_000, 1_000_000]
    df = spark.createDataFrame([(2000,), (0,), (-5,)], "s long").select(effective_size(F.col("s")).alias("x"))
    assert [r.x for r in df.collect()] == [2000, 3000, 3000]


def test_next_max_id(spark):
    ids = [*range(1, 501), *range(800, 1201)]
    source = RangeSource(spark.createDataFrame([(i,) for i in ids], "id long"), "id")
    for start, n, want in ((0, 100, 100), (450, 100, 849), (1150, 500, 1200), (1200, 10, 1200), (5000, 10, 5000)):
        assert source.next_max_id(start, n).first()[0] == want


@pytest.mark.parametrize("threshold, pending, claimed, want", [(1000, 500, 0, True), (1000, 1000, 0, False), (1000, 1500, 0, False), (10, 15, 0, False), (100, 80, 30, False)])
def test_back_pressure(spark, threshold, pending, claimed, want):
    df = spark.createDataFrame([(pending, claimed)], "pending long, claimed long")
    assert may_allocate(df, threshold).first()["allocate"] is want


def test_allocate(spark):
    schema = "partition_id long, min_id long, max_id long, status string"
    source = RangeSource(spark.range(1, 2001).toDF("id"), "id", 500)
    empty = spark.createDataFrame([], schema)
    assert rows(allocate(spark, empty, source, 1000)) == [(1, 1, 500), (2, 501, 1000)]
    full = spark.createDataFrame([(1, 1, 500, "completed"), (2, 1001, 2000, "completed")], schema)
    assert rows(allocate(spark, full, source, 1000)) == [(3, 501, 1000)]
    busy = spark.createDataFrame([(1, 1, 500, "pending")], schema)
    assert rows(allocate(spark, busy, source, 1000, threshold=1)) == []
    assert stats(empty).first()["total"] == 0
