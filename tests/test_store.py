from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gridloom.model import Grid, MergePolicy, Request, TileSpec, VarSpec
from gridloom.sources import files
from gridloom.sources.store import Cube, restore_snapshot, save_snapshot

T0 = datetime(2026, 6, 1)


@pytest.fixture()
def cube(spark, tmp_path):
    return Cube(spark, str(tmp_path / "cube"), Grid(32614, 500.0, 11, 9, 0.0, 4500.0), tile=4)


def ramp(cube):
    return cube.grid.cells(cube.spark).select("y", "x", (F.col("y") * cube.grid.width + F.col("x")).cast("double").alias("value"))


def hourly(cube, n=6, value=None):
    steps = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = ramp(cube).withColumn("h", steps)
    t = F.timestamp_add("HOUR", F.col("h"), F.lit(T0).cast("timestamp_ntz")).cast("timestamp_ntz")
    return rows.select(t.alias("t"), "y", "x", (F.col("h") * 1000.0 + F.col("value") if value is None else F.lit(value)).alias("value"))


def test_static_round_trip_and_versions(cube):
    assert cube.write_static("a", ramp(cube), units="m", producer="p") == 1
    got = cube.read_static("a").collect()
    assert len(got) == 99 and all(r.value == r.y * 11 + r.x for r in got)
    assert cube.write_static("a", ramp(cube).withColumn("value", F.lit(float("nan")))) == 2
    assert cube.read_static("a").where("value is not null").count() == 0
    again = Cube(cube.spark, cube.root)
    assert again.grid == cube.grid and again.catalog.list_variables() == ["a"] and again.catalog.latest_version("a") == 2


def test_cells_outside_the_grid_are_refused(cube):
    with pytest.raises(ValueError):
        cube.write_static("a", ramp(cube).withColumn("x", F.col("x") + 1))
    with pytest.raises(ValueError):
        Cube(cube.spark, cube.root, Grid(32614, 500.0, 5, 5, 0.0, 0.0))
    with pytest.raises(KeyError):
        cube.read_static("nothing")


def test_time_scans(cube):
    cube.write_time("w", hourly(cube), native_res_m=27_750)
    assert cube.times("w") == [T0 + timedelta(hours=h) for h in range(6)]
    window = cube.read_window("w", T0 + timedelta(hours=1), T0 + timedelta(hours=3))
    assert window.select("t").distinct().count() == 3 and cube.read_window("w", T0 + timedelta(days=9)).count() == 0
    assert {r.value // 1000 for r in cube.read_step("w", T0 + timedelta(minutes=90)).collect()} == {1}
    assert cube.catalog.native_resolution("w") == 27_750
    assert cube.time_coverage("w", T0, T0 + timedelta(hours=9)) == {"times": cube.times("w"), "window_covered": False, "first": T0, "last": T0 + timedelta(hours=5)}
    plan = window._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(t_day" in plan.replace("\n", "")


def test_blocks_and_halos(cube):
    cube.write_static("a", ramp(cube))
    cube.write_time("w", hourly(cube))
    rows = cube.read_block("a", TileSpec((4, 8), (0, 4)), halo=2).collect()
    assert {(r.y, r.x) for r in rows} == {(y, x) for y in range(2, 9) for x in range(0, 6)}
    assert sum(r.is_inner for r in rows) == 16
    assert cube.read_block("w", TileSpec((0, 2), (0, 2), (1, 3))).count() == 8
    with pytest.raises(ValueError):
        cube.read_block("a", TileSpec((0, 2), (0, 2)), halo=-1)


def test_append_is_idempotent(cube):
    assert cube.append_step("w", T0, ramp(cube)) and not cube.append_step("w", T0, ramp(cube))
    assert cube.append_step("w", T0 + timedelta(days=1), ramp(cube))
    assert cube.read_time("w").count() == 198 and len(cube.times("w")) == 2
    assert cube.has("w", T0) and not cube.has("w") and not cube.has("w", T0 + timedelta(hours=1))


def test_tile_writes_leave_other_tiles(cube):
    cube.init_static("a", 7.0)
    cube.init_static("a", 9.0)
    part = ramp(cube).where("y < 2 and x < 2").withColumn("is_inner", F.col("x") == 0)
    cube.write_tiles("a", part)
    got = {(r.y, r.x): r.value for r in cube.read_static("a").collect()}
    assert len(got) == 99 and got[0, 0] == 0 and got[1, 0] == 11 and got[0, 1] == 7 and got[8, 10] == 7
    cube.write_tiles("a", ramp(cube).withColumn("value", F.lit(3.0)), MergePolicy.MONOTONE_MIN)
    got = {(r.y, r.x): r.value for r in cube.read_static("a").collect()}
    assert got[0, 0] == 0 and got[1, 0] == 3 and got[8, 10] == 3
    cube.init_static("b")
    assert cube.read_filled("b", -1.0).where("value = -1").count() == 99


def test_layers_of_merged_tiles(cube, monkeypatch):
    from gridloom.sources import store

    monkeypatch.setattr(store, "LAYERS", 3)
    cube.write_time("w", hourly(cube, 2, 1.0))
    want = {(T0 + timedelta(hours=h), y, x): 1.0 for h in range(2) for y in range(9) for x in range(11)}
    for k in range(4):
        y, t = (k * 3) % 9, T0 + timedelta(hours=k % 2)
        cells = ramp(cube).where(F.col("y") == y).select(F.lit(t).cast("timestamp_ntz").alias("t"), "y", "x", F.lit(float(k)).alias("value"))
        assert cube.write_tiles("w", cells) == k + 2
        want |= {(t, y, x): float(k) for x in range(11)}
        assert {(r.t, r.y, r.x): r.value for r in cube.read_time("w").collect()} == want
        assert cube.catalog.variable("w").path.count(store.LAYER) < 3
    later = T0 + timedelta(hours=5)
    assert cube.append_step("w", later, ramp(cube)) and not cube.append_step("w", later, ramp(cube))
    assert cube.times("w") == [T0, T0 + timedelta(hours=1), later] and cube.read_time("w").count() == 3 * 99


class Killed(Exception):
    pass


@pytest.mark.parametrize("step", ["_store", "_check_stored", "swap", "write_text"])
def test_writes_that_break_off_change_nothing(cube, monkeypatch, step):
    cube.init_static("a", 7.0)

    def boom(*args, **kwargs):
        raise Killed

    where = {"swap": cube.catalog, "write_text": files}.get(step, cube)
    for work in (lambda c: c.write_tiles("a", ramp(c)), lambda c: c.write_static("a", ramp(c)), lambda c: c.write_static("b", ramp(c))):
        with monkeypatch.context() as m:
            m.setattr(where, step, boom)
            with pytest.raises(Killed):
                work(cube)
        again = Cube(cube.spark, cube.root)
        assert {r.value for r in again.read_static("a").collect()} == {7.0} and again.catalog.list_variables() == ["a"]
        assert again.catalog.state == cube.catalog.state
    assert cube.write_static("a", ramp(cube)) == 2


def test_pointers_are_replaced_whole(spark, tmp_path):
    at = str(tmp_path / "pointer.json")
    files.write_text(spark, at, "one")
    files.write_text(spark, f"file:{at}", "two")
    assert files.read_text(spark, at) == "two" and files.listed(spark, str(tmp_path)) == ["pointer.json"]


def test_appends_do_not_write_the_catalog_again(cube, monkeypatch):
    from gridloom.sources import catalog

    monkeypatch.setattr(catalog, "PARTS", 3)
    for k in range(6):
        cube.append_step("w", T0 + timedelta(hours=k), ramp(cube).limit(3))
    assert len(cube.times("w")) == 6 and Cube(cube.spark, cube.root).times("w") == cube.times("w")


def test_write_together_runs_its_plan_once(cube):
    from pyspark.sql import types as T

    rows = cube.spark.sparkContext.accumulator(0)

    def seen(batches):
        for pdf in batches:
            rows.add(len(pdf))
            yield pdf.assign(b=pdf.value * 2)

    made = ramp(cube).mapInPandas(seen, T.StructType([*ramp(cube).schema.fields, T.StructField("b", T.DoubleType())]))
    assert cube.write_together(made.withColumnRenamed("value", "a"), {"a": {"units": "m"}, "b": {}}) == {"a": 1, "b": 1}
    assert rows.value == 99 and cube.catalog.variable("a").units == "m"
    assert cube.read_static("b").agg(F.max("value")).first()[0] == 196
    assert not files.listed(cube.spark, f"{cube.root}/stage")


def test_merge_by_policy_for_both_kinds(cube):
    low = VarSpec("arrival", merge_policy=MergePolicy.MONOTONE_MIN)
    cube.merge(low, ramp(cube), source="s", producer="p")
    cube.merge(low, ramp(cube).withColumn("value", F.lit(5.0)), source="s", producer="p")
    assert cube.read_static("arrival").agg(F.max("value")).first()[0] == 5
    summed = VarSpec("rain", kind="time", merge_policy=MergePolicy.ACCUMULATE)
    for _ in range(2):
        cube.merge(summed, hourly(cube, 2, 1.0), source="s", producer="p")
    assert {r.value for r in cube.read_time("rain").collect()} == {2.0}


@pytest.mark.parametrize(
    ("start", "end", "want"),
    [(None, None, True), (T0, None, True), (T0 + timedelta(minutes=30), None, False), (T0, T0 + timedelta(days=1), True), (T0 - timedelta(hours=1), T0 + timedelta(hours=1), False), (T0, T0 + timedelta(days=2), False)],
)
def test_satisfies_time(cube, start, end, want):
    cube.write_time("w", hourly(cube, 24, 1.0), native_res_m=100)
    request = Request(start, end)
    assert cube.satisfies(VarSpec("w", "time"), request) is want
    assert cube.satisfies(VarSpec("w", "time", max_native_res_m=50), request) is False
    assert cube.satisfies(VarSpec("w", "static"), request) is False


def test_staleness(cube):
    cube.write_static("i", ramp(cube))
    assert not cube.is_output_stale("o", ["i"])
    cube.write_static("o", ramp(cube))
    assert not cube.is_output_stale("o", ["i"]) and not cube.is_output_stale("o", []) and not cube.is_output_stale("o", ["absent"])
    cube.write_static("i", ramp(cube))
    assert cube.is_output_stale("o", ["i"])


def test_drop_export_and_snapshots(cube, spark, tmp_path):
    cube.write_static("a", ramp(cube))
    cube.write_static("b", ramp(cube))
    cube.export_catalog()
    assert '"name": "a"' in files.read_text(spark, f"{cube.root}/catalog.json")
    save_snapshot(cube, str(tmp_path / "snap"))
    cube.drop(["a"])
    assert cube.catalog.list_variables() == ["b"]
    back = restore_snapshot(spark, str(tmp_path / "snap"), cube.root, overwrite=True)
    assert back.read_static("a").count() == 99
    with pytest.raises(FileExistsError):
        restore_snapshot(spark, str(tmp_path / "snap"), cube.root)
    with pytest.raises(FileNotFoundError):
        restore_snapshot(spark, str(tmp_path / "none"), str(tmp_path / "x" / "y"))
    with pytest.raises(ValueError):
        save_snapshot(cube, "/x")
