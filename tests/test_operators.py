from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gridloom.functions import physics
from gridloom.model import MergePolicy, TileSpec
from gridloom.operators import catalogs, merge, regrid, stencil, temporal

T0 = datetime(2026, 1, 1)


def grid(spark, rows):
    return spark.createDataFrame([(y, x, None if v is None else float(v)) for y, r in enumerate(rows) for x, v in enumerate(r)], "y int, x int, value double")


def table(df, *keys):
    return {tuple(r[k] for k in keys or ("y", "x")): r.value for r in df.collect()}


BLOCKS = [[1, 1, 2, 2], [1, 1, 2, 2], [3, 3, 4, 4], [3, 3, 4, 4]]


def test_block_reductions(spark):
    assert table(regrid.block_reduce(grid(spark, BLOCKS), 2, 4, 4)) == {(0, 0): 1, (0, 1): 2, (1, 0): 3, (1, 1): 4}
    ramp = grid(spark, [[y * 5 + x for x in range(5)] for y in range(5)])
    assert table(regrid.block_reduce(ramp, 2, 5, 5, "max")) == {(0, 0): 6, (0, 1): 8, (1, 0): 16, (1, 1): 18}
    holed = grid(spark, [[1, None], [1, 1]])
    assert table(regrid.block_reduce(holed, 2, 2, 2, "min")) == {(0, 0): None}
    assert table(regrid.consumed(grid(spark, [[0.25, 0.75], [0.5, 0.5]]), 2, 2, 2)) == {(0, 0): 0.5}
    with pytest.raises(ValueError):
        regrid.block_reduce(ramp, 0, 5, 5)


def test_zooms(spark):
    labels = grid(spark, [[1, 2], [3, 4]])
    assert table(regrid.replicate(labels, 2)) == {(y, x): 1 + x // 2 + 2 * (y // 2) for y in range(4) for x in range(4)}
    near = table(regrid.zoom(labels, 2, 2, 2, order=0))
    assert set(near.values()) == {1, 2, 3, 4} and len(near) == 16
    smooth = table(regrid.zoom(labels, 1.5, 2, 2))
    assert smooth == {(0, 0): 1, (0, 1): 1.5, (0, 2): 2, (1, 0): 2, (1, 1): 2.5, (1, 2): 3, (2, 0): 3, (2, 1): 3.5, (2, 2): 4}
    assert table(regrid.zoom(grid(spark, [[1, None], [3, 4]]), 1.5, 2, 2))[0, 1] is None
    assert table(regrid.resample(labels, 10, 10, 2, 2)) == table(labels)
    assert table(regrid.resample(grid(spark, BLOCKS), 10, 20, 4, 4, "mean"))[1, 1] == 4
    assert len(table(regrid.resample(grid(spark, BLOCKS), 10, 15, 4, 4, "mean"))) == 9
    for bad in ((0, 1, "mean"), (1, 1.5, "cubic")):
        with pytest.raises(ValueError):
            regrid.resample(labels, bad[0], bad[1], 2, 2, bad[2])


def test_slope_and_aspect(spark):
    east = grid(spark, [[x for x in range(4)] for _ in range(4)])
    got = {(r.y, r.x): (r.slope_deg, r.aspect_deg) for r in stencil.slope_aspect(east, 1.0).collect()}
    assert got[1, 1] == pytest.approx((45, 180)) and got[1, 0][0] == pytest.approx(26.565, abs=1e-3)
    assert {r.aspect_deg for r in stencil.slope_aspect(grid(spark, [[5] * 3] * 3), 1.0).collect()} == {-1.0}
    north = stencil.slope_aspect(grid(spark, [[-y] * 3 for y in range(3)]), 1.0).where("y = 1 and x = 1").first()
    assert north.aspect_deg == pytest.approx(270)


def test_halos(spark):
    ramp = grid(spark, [[y * 6 + x for x in range(6)] for y in range(6)])
    out = stencil.haloed_tiles(ramp, 3, 1, 6, 6)
    assert out.groupBy("ty", "tx").count().collect()[0]["count"] == 16 and out.where("is_inner").count() == 36
    assert stencil.halo_block(ramp, TileSpec((0, 2), (4, 6)), 1, 6, 6).count() == 9
    with pytest.raises(ValueError):
        stencil.haloed_tiles(ramp, 3, -1, 6, 6)


def ramp_in_time(spark, order=(0, 1, 2, 3), gap=None):
    rows = [(T0 + timedelta(hours=h), 0, 0, None if h == gap else float(h)) for h in order]
    return spark.createDataFrame(rows, "t timestamp_ntz, y int, x int, value double")


@pytest.mark.parametrize("order", [(0, 1, 2, 3), (2, 0, 3, 1)])
def test_interpolation(spark, order):
    times = [T0 + timedelta(minutes=m) for m in (-60, 0, 30, 90, 180, 999)]
    linear = table(temporal.interpolate(ramp_in_time(spark, order), times), "t")
    assert [linear[(t,)] for t in times] == [0, 0, 0.5, 1.5, 3, 3]
    near = table(temporal.interpolate(ramp_in_time(spark, order), times, "nearest"), "t")
    assert [near[(t,)] for t in times] == [0, 0, 0, 1, 3, 3]
    assert table(temporal.interpolate(ramp_in_time(spark, order, gap=1), times), "t")[(times[3],)] is None
    assert temporal.interpolate(ramp_in_time(spark), []).count() == 0
    with pytest.raises(ValueError):
        temporal.interpolate(ramp_in_time(spark), times, "cubic")


def test_time_scans(spark):
    steps = ramp_in_time(spark)
    assert temporal.time_window(steps, T0, T0 + timedelta(hours=1)).count() == 2 and temporal.time_window(steps).count() == 4
    assert temporal.nearest_step(steps, T0 + timedelta(minutes=30)).first().value == 0
    assert temporal.hours(T0 + timedelta(minutes=20), T0 + timedelta(minutes=50)) == (T0, T0 + timedelta(hours=1))
    assert temporal.hours(T0, T0 + timedelta(hours=2, minutes=9))[1] == T0 + timedelta(hours=2)
    other = steps.withColumn("t", F.timestamp_add("HOUR", F.lit(1), "t"))
    temporal.require_same_times(steps, steps)
    with pytest.raises(ValueError):
        temporal.require_same_times(steps, other)


@pytest.mark.parametrize(
    ("policy", "want"),
    [(MergePolicy.MONOTONE_MIN, [1, 2, 3, 7]), (MergePolicy.MONOTONE_MAX, [5, 2, 3, 7]), (MergePolicy.ACCUMULATE, [6, None, 3, 7]), (MergePolicy.LAST_WRITER, [5, None, 3, 7]), (MergePolicy.UNION, [5, None, 3, 7])],
)
def test_merges(spark, policy, want):
    old = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (0, 2, None)], "y int, x int, value double")
    new = spark.createDataFrame([(0, 0, 5.0), (0, 1, None), (0, 2, 3.0), (0, 3, 7.0)], "y int, x int, value double")
    got = table(merge.merge_cells(old, new, policy))
    assert [got[0, x] for x in range(4)] == want
    assert table(merge.merge_cells(None, new, policy)) == table(new)


def test_nan_is_missing_in_merges(spark):
    old, new = grid(spark, [[float("nan"), 1]]), grid(spark, [[3, float("nan")]])
    assert table(merge.merge_cells(old, new, MergePolicy.MONOTONE_MAX)) == {(0, 0): 3, (0, 1): 1}


def test_fluence_between_and_beyond_rings(spark):
    rings = [(1000.0, 1.2), (2000.0, 0.6), (3000.0, 0.3)]
    at = spark.createDataFrame([(float(r),) for r in (0, 1000, 1500, 2500, 4000)], "r double")
    got = [r.j for r in at.select(physics.fluence(F.col("r"), rings).alias("j")).collect()]
    assert got == pytest.approx([1.2, 1.2, 0.6 * 2**0.5, 0.3 * 2**0.5, 0.15])
    with pytest.raises(ValueError):
        physics.fluence(F.col("r"), rings[:1])


def test_scalars(spark):
    row = spark.range(1).select(
        physics.cfl_step(F.lit(750.0)).alias("a"), physics.cfl_step(F.lit(9000)).alias("b"), physics.cfl_step(F.lit(10)).alias("c"),
        physics.text_key(F.lit("  A \n b ")).alias("d"), physics.safe_label(F.lit("a b/ç.1")).alias("e"),
        physics.wind_direction(F.lit(0.0), F.lit(-1.0)).alias("f"), physics.arrival(F.lit(1e9)).alias("g"), physics.fuel_category(F.lit(98)).alias("h"),
    ).first()
    assert tuple(row) == (4, 54, 1, "a b", "a_b__.1", 0.0, None, 14)


def test_evictions_keep_the_newest(spark):
    entries = spark.createDataFrame([(i, 10) for i in range(9000)], "atime long, size long")
    gone = catalogs.evictions(entries, 25)
    assert gone.count() == 8998 and gone.agg(F.max("atime")).first()[0] == 8997
    assert catalogs.evictions(entries, 90_000).count() == 0


def test_upserts_take_null_keys_as_equal(spark):
    old = spark.createDataFrame([("a", None, 1), ("a", 1, 2)], "k string, t int, v int")
    new = spark.createDataFrame([("a", None, 9)], "k string, t int, v int")
    assert sorted(r.v for r in catalogs.upserted(old, new, ["k", "t"]).collect()) == [2, 9]
