"""Settling between rounds, and intermediate tables that come and go."""

from gridloom.llm import scratch


def test_settle_waits_its_time(spark, monkeypatch):
    monkeypatch.setattr(scratch, "_settled", 0.0)
    times = iter([100.0, 101.0, 102.0, 107.0, 108.0])
    monkeypatch.setattr(scratch.time, "monotonic", lambda: next(times))
    collected = []
    monkeypatch.setattr(scratch, "trim", lambda: collected.append(1))
    scratch.settle(spark)
    assert scratch._settled == 101.0 and len(collected) == 1
    scratch.settle(spark)
    assert scratch._settled == 101.0 and len(collected) == 1
    scratch.settle(spark)
    assert scratch._settled == 108.0 and len(collected) == 2


def test_settle_spares_what_is_in_use(spark, monkeypatch):
    rows = scratch.kept(spark.range(1000).selectExpr("id % 7 AS k", "id").repartition(4, "k"))
    sums = rows.groupBy("k").sum("id")
    want = sorted(sums.collect())
    table = scratch.written(rows, "test")
    monkeypatch.setattr(scratch, "_settled", float("-inf"))
    scratch.settle(spark)
    assert sorted(sums.collect()) == want == sorted(table.groupBy("k").sum("id").collect())
    scratch.release(spark)
    assert sorted(sums.collect()) == want
