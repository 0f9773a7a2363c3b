import sys
import textwrap
import time
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from gridloom.model import Capabilities, Grid, MergePolicy, Request, TileSpec, VarSpec, tiles_of
from gridloom.plans import contract_kit, lineage
from gridloom.plans.adapter import DataAdapter, DataNeed, NoDataAvailable
from gridloom.plans.contracts import DriverProducer, FunctionProducer, Producer, ProducerRegistry, TiledProducer, as_registry
from gridloom.plans.model_adapter import CommandModel, FireModel, namelist, patched_namelist, surface_field
from gridloom.plans.pipeline import Pipeline, parallel
from gridloom.plans.retry import RetryPolicy, attempt
from gridloom.plans.runner import PipelineRunner
from gridloom.sources.store import Cube


@pytest.fixture()
def cube(spark, tmp_path):
    return Cube(spark, str(tmp_path / "cube"), Grid(32614, 500.0, 6, 5, 0.0, 2500.0), tile=4)


def constant(name, value, requires=(), **spec):
    def run(inputs, request):
        return run.cube.grid.cells(run.cube.spark).select("y", "x", F.lit(float(value)).alias("value"))

    p = FunctionProducer(run, [VarSpec(name, **spec)], requires, name=f"make_{name}")
    p.func.cube = None
    return p


def bound(cube, *producers):
    for p in producers:
        p.func.cube = cube
    return ProducerRegistry(producers)


def values(cube, name):
    return {r.value for r in cube.read_static(name).collect()}


def test_pipelines():
    p = Pipeline.chain(["a", parallel("b", "c"), "d"])
    assert p.topological_layers() == [["a"], ["b", "c"], ["d"]]
    assert p.edges == [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")]
    assert "d after b, c" in p.explain() and '"a" -> "b"' in p.to_dot()
    assert p.remove("b").topological_layers() == [["a"], ["c"], ["d"]]
    assert p.add("c", after=["e"]).nodes["c"].after == {"a", "e"}
    with pytest.raises(ValueError, match="unknown"):
        p.topological_layers()
    with pytest.raises(ValueError, match="cycle"):
        Pipeline().add("a", after=["b"]).add("b", after=["a"]).topological_layers()


def test_targets_are_walked_backwards():
    class P:
        def __init__(self, name, produces, requires=()):
            self.name, self.produces, self.requires = name, produces, requires

    registry = ProducerRegistry([P("src", ["raw"]), P("m1", ["a"], ["raw", "outside"]), P("m2", ["b"], ["raw", "a"])])
    p = Pipeline.from_targets(["b"], registry)
    assert p.topological_layers() == [["src"], ["m1"], ["m2"]] and p.nodes["m2"].after == {"src", "m1"}
    registry.register(P("src", ["raw"], ["b"]), replace=True)
    with pytest.raises(RuntimeError, match="m2 -> src -> m2|src"):
        Pipeline.from_targets(["b"], registry)
    with pytest.raises(KeyError):
        Pipeline.from_targets(["nothing"], registry)


def test_registry_has_one_owner_a_variable():
    class P:
        requires = ()

        def __init__(self, name, *produces):
            self.name, self.produces = name, produces

    r = ProducerRegistry([P("a", "x", "y")])
    with pytest.raises(ValueError):
        r.register(P("b", "x"))
    r.register(P("b", "x"), replace=True)
    assert r.producer_for("x").name == "b" and r.producer_for("y").name == "a" and len(r) == 2 and "a" in r
    r.unregister("b")
    assert not r.has_variable("x") and r.variables() == ["y"]
    with pytest.raises(TypeError):
        as_registry([object()])


def test_runner_skips_reruns_and_reports(cube, tmp_path):
    reg = bound(cube, constant("raw", 1), constant("out", 2, ["raw"]))
    runner = PipelineRunner(reg, verbose=False, result_dir=tmp_path / "runs")
    p = Pipeline.from_targets(["out"], reg)
    assert [(s.name, s.status) for s in runner.run(cube, p).steps] == [("make_raw", "ok"), ("make_out", "ok")]
    assert runner.run(cube, p).counts == {"ok": 0, "skipped": 2, "error": 0}
    cube.write_static("raw", cube.read_static("raw"))  # fresher than out
    assert [s.status for s in runner.run(cube, p, result_path=False).steps] == ["skipped", "ok"]
    assert runner.run(cube, p, force=True, result_path=tmp_path / "r.json").step("make_out").versions == {"out": 3}
    assert '"ok": true' in (tmp_path / "r.json").read_text() and list((tmp_path / "runs").glob("runresult_*.json"))


def test_failures_block_what_depends_on_them(cube):
    def boom(inputs, request):
        raise OSError("gone")

    bad = FunctionProducer(boom, ["bad"], name="bad")
    reg = bound(cube, constant("out", 2, ["bad"]), constant("other", 3))
    reg.register(bad)
    p = Pipeline.from_targets(["out", "other"], reg)
    result = PipelineRunner(reg, verbose=False, retry=RetryPolicy(2)).run(cube, p)
    assert {s.name: s.status for s in result.steps} == {"bad": "error", "make_other": "ok", "make_out": "error"}
    assert result.step("bad").attempts == 2 and result.step("bad").dead_letter and not result.ok
    assert result.step("make_out").error == "upstream dependency failed"


def test_triggers(cube):
    reg = bound(cube, constant("a", 1), constant("b", 2), constant("c", 3))
    p = Pipeline().add("make_a")
    p.on_complete("make_a", "make_b", lambda c: c.has("a")).on_complete("make_a", "make_c", lambda c: 1 / 0)
    runner = PipelineRunner(reg, verbose=False)
    first = runner.run(cube, p)
    assert first.triggered == ["make_b"] and values(cube, "b") == {2.0} and not cube.has("c")
    assert runner.run(cube, p).triggered == []  # a skipped source fires nothing


def test_consumers_resolution_reaches_the_producer(cube):
    cube.write_static("raw", cube.grid.cells(cube.spark).select("y", "x", F.lit(9.0).alias("value")), native_res_m=2000)
    reg = bound(cube, constant("raw", 1), constant("out", 2, [VarSpec("raw", max_native_res_m=600)]))
    result = PipelineRunner(reg, verbose=False).run(cube, Pipeline.from_targets(["out"], reg))
    assert result.step("make_raw").status == "ok" and values(cube, "raw") == {1.0}


def test_retry():
    calls = []

    def flaky(n):
        calls.append(time.perf_counter())
        if len(calls) < n:
            raise ValueError(len(calls))
        return "done"

    assert attempt(flaky, 3, policy=RetryPolicy(3, 0.01)) == ("done", None, 3)
    assert calls[2] - calls[1] > calls[1] - calls[0] > 0.009
    result, error, n = attempt(lambda: 1 / 0, policy=RetryPolicy(5, 0, (OSError,)))
    assert result is None and isinstance(error, ZeroDivisionError) and n == 1
    with pytest.raises(ValueError):
        RetryPolicy(0)


class Smooth(TiledProducer):
    name, tile = "smooth", 2
    produces, requires = (VarSpec("mean"),), (VarSpec("raw"),)
    capabilities = Capabilities(halo_cells=1, tile_parallel=True)

    def process(self, rows, tile):
        if tile == self.bad:
            raise ValueError("no")
        mean = lambda r: rows[(abs(rows.y - r.y) <= 1) & (abs(rows.x - r.x) <= 1)].raw.mean()
        return rows.assign(value=rows.apply(mean, axis=1))

    bad = None


def test_tiled_producers_see_their_halo(cube):
    cube.write_static("raw", cube.grid.cells(cube.spark).select("y", "x", (F.col("y") * 6 + F.col("x")).cast("double").alias("value")))
    p = Smooth()
    reg = ProducerRegistry([p])
    result = PipelineRunner(reg, verbose=False).run(cube, Pipeline().add("smooth"))
    assert result.ok and result.step("smooth").tile_summary()["n"] == 9
    got = {(r.y, r.x): r.value for r in cube.read_static("mean").collect()}
    assert len(got) == 30 and got[2, 3] == 15.0 and got[0, 0] == 3.5
    p.bad = (1, 1)
    failed = PipelineRunner(reg, verbose=False).run(cube, Pipeline().add("smooth"), force=True)
    assert failed.step("smooth").error.endswith("tile 1,1: ValueError: no") and cube.catalog.latest_version("mean") == 1
    p.bad, p.wanted = None, lambda cube, request, tile: tile.y[0] == 0
    _, metrics, unstage = p.compute_tiles(cube, Request())
    assert metrics.count() == 3
    unstage()


class Counted(Smooth):
    """Writes a file for each call, so that calls in workers can be counted."""

    name, folder, fails, attempts = "smooth", "", (), 1

    def init(self, cube, request):
        self.log = ["init"]

    def finalize(self, cube, request, versions):
        self.log.append("finalize")
        return versions

    def process(self, rows, tile):
        n = len(list(Path(self.folder).glob(f"{tile[0]}-{tile[1]}-*")))
        (Path(self.folder) / f"{tile[0]}-{tile[1]}-{n}").touch()
        if (*tile, n) in self.fails:
            raise ValueError("not now")
        return rows.assign(value=1.0)


def test_each_tile_is_worked_once(cube, tmp_path):
    cube.write_static("raw", cube.grid.cells(cube.spark).select("y", "x", F.lit(1.0).alias("value")))
    p = Counted()
    calls = tmp_path / "calls"
    calls.mkdir()
    p.folder = str(calls)
    run = lambda: PipelineRunner(ProducerRegistry([p]), verbose=False).run(cube, Pipeline().add("smooth"), force=True).step("smooth")
    assert run().status == "ok" and len(list(calls.iterdir())) == 9 and p.log == ["init", "finalize"]
    # a tile that would fail if it were worked again can't spoil what was written
    assert cube.read_static("mean").count() == 30
    p.fails = {(0, 1, 1)}
    step = run()
    assert step.status == "error" and len(list(calls.iterdir())) == 18 and p.log == ["init"]
    assert step.tile_summary()["errors"] == 1 and cube.catalog.latest_version("mean") == 1
    p.fails, p.attempts = {(0, 1, 2)}, 2
    step = run()
    assert step.status == "ok" and max(t.attempts for t in step.tiles) == 2 and len(list(calls.iterdir())) == 18 + 10


def test_needs_are_found_by_name():
    need = DataNeed("wind", "time", units="m/s", dtype="double", description="of the day")
    adapter = DataAdapter([need, VarSpec("dem", units="m")])
    assert adapter.need("wind") is need and adapter.varspecs()[0].units == "m/s" and adapter.varspecs()[1].units == "m"
    with pytest.raises(KeyError):
        adapter.need("nothing")


def test_fields_of_models(spark):
    rows = [(t, z, y, x, 100.0 * t + 10 * z + y + x) for t in (0, 1) for z in (0, 1) for y in range(3) for x in range(4)]
    levels = spark.createDataFrame(rows, "t int, level int, y int, x int, value double")
    got = {(r.y, r.x): r.value for r in surface_field(levels, spark, 2, 4).collect()}
    assert got == {(y, x): 100.0 + y + x for y in range(2) for x in range(4)}
    flat = surface_field(levels.where("level = 1").drop("level"), spark, 3, 4)
    assert {r.value - r.y - r.x for r in flat.collect()} == {110.0}
    none = surface_field(None, spark, 2, 3).collect()
    assert len(none) == 6 and {r.value for r in none} == {None}


def test_adapter_resolves_and_fetches(cube):
    reg = bound(cube, constant("raw", 4), constant("bad", 1))
    reg.get("make_bad").func = lambda inputs, request: 1 / 0
    adapter = DataAdapter(["raw", DataNeed("ghost", required=False), DataNeed("bad", required=False)])
    assert adapter.missing(cube) == ["raw"] and not adapter.search(cube)["raw"]["present"]
    report = adapter.resolve(cube, reg)
    assert report["raw"]["via"] == "producer:make_raw" and report["ghost"]["error"] == "no_producer" and report["bad"]["error"].startswith("producer_failed")
    assert adapter.resolve(cube, reg)["raw"]["via"] == "cube"
    got = adapter.fetch(cube, target_pixel_m=1000)
    assert got["ghost"] is None and got["raw"].count() == 2 * 3
    with pytest.raises(NoDataAvailable):
        DataAdapter(["ghost"]).resolve(cube, reg)
    with pytest.raises(NoDataAvailable):
        DataAdapter(["bad"]).resolve(cube, reg)
    with pytest.raises(ValueError):
        DataAdapter(["a", DataNeed("a")])


def test_drivers_and_windows(cube):
    seen = {}

    class Driver:
        name, produces, is_static = "d", ["w"], False

        def fetch(self, cube, t_start, t_end):
            seen["end"] = t_end
            for k in range(3):
                cube.append_step("w", t_start + timedelta(days=k), cube.grid.cells(cube.spark).select("y", "x", F.lit(float(k)).alias("value")))
            return ["w"]

    t = datetime(2026, 1, 1)
    p = DriverProducer(Driver(), end="inclusive_day")
    assert p.run(cube, Request(t, t + timedelta(days=3))) == {"w": 1} and seen["end"] == t + timedelta(days=2)
    assert p.is_satisfied(cube, "w", Request(t, t + timedelta(days=3))) and not p.is_satisfied(cube, "w", Request(t, t + timedelta(days=9)))
    got = DataAdapter(["w"]).fetch(cube, Request(t, t + timedelta(days=2)), target_times=[t + timedelta(hours=36)])["w"]
    assert {r.value for r in got.collect()} == {1.5}


KERNEL = """
    import pandas as pd
    t = pd.read_parquet("TIGN_IN.parquet")
    t.to_parquet("TIGN_G.parquet")
    t.assign(value=(t.value < 1e8).astype(float)).to_parquet("FIRE_AREA.parquet")
"""


def test_external_models_round_trip(cube, tmp_path):
    cells = cube.grid.cells(cube.spark)
    cube.write_static("ignition_t0", cells.select("y", "x", F.when(F.col("x") < 3, F.col("x").cast("double")).alias("value")))
    cube.write_static("nfuel_cat", cells.select("y", "x", F.when(F.col("y") == 0, 14).otherwise(3).alias("value")), dtype="smallint")
    (tmp_path / "kernel.py").write_text(textwrap.dedent(KERNEL))
    model = FireModel([sys.executable, str(tmp_path / "kernel.py")], extra={"ros_max": "max"})
    assert model.run(cube, Request()) == {"arrival_s": 1, "fire_area": 1, "ros_max": 1}
    got = {(r.y, r.x): r.value for r in cube.read_static("arrival_s").collect()}
    assert got[0, 1] is None and got[1, 1] == 1.0 and got[1, 2] == pytest.approx(2.0) and got[1, 4] is None
    assert {r.value for r in cube.read_static("fire_area").where("y > 0 and x < 3").collect()} == {1.0}
    broken = CommandModel("broken", [sys.executable, "-c", "raise SystemExit(3)"], [VarSpec("z")], [])
    with pytest.raises(RuntimeError, match="ended with 3"):
        broken.run(cube, Request())


def test_namelists():
    text = " &time\n run_hours = 1, ! hours\n RUN_HOURS = 2,\n /\n"
    assert patched_namelist(text, {"run_hours": 9}) == " &time\n run_hours = 9, ! hours\n RUN_HOURS = 9,\n /\n"
    assert patched_namelist(text, {"run_hours": 9}, ignore_case=False).count("9") == 1
    assert namelist({"fire": {"ifire": [0, 1], "on": True, "name": "x"}}) == " &fire\n ifire = 0, 1,\n on = .true.,\n name = 'x',\n /\n"


def test_lineage(cube, tmp_path):
    (tmp_path / "in.txt").write_text("x")
    with pytest.raises(ZeroDivisionError), lineage.RunManifest(cube.catalog, "a run", {"b": 1}) as m:
        m.record_input("cfg", tmp_path / "in.txt")
        m.record_input("dir", tmp_path)
        m.record_input("gone", tmp_path / "none")
        m.record_output("v", 1, "p")
        1 / 0
    s = m.summary()
    assert s["status"] == "error" and (s["run_inputs"], s["run_outputs"], s["run_libs"]) == (2, 1, 4)
    assert lineage.config_hash({"a": 1, "b": 2}) == lineage.config_hash({"b": 2, "a": 1})
    store = lineage.CheckpointStore(cube.catalog)
    for k in (1, 2, 10):
        store.save("p", k, {"k": k})
    store.save("p", 2, "again")
    assert store.latest("p") == (10, {"k": 10}) and store.load("p", 2) == "again" and store.steps("p") == [1, 2, 10]
    assert store.delete("p", 10) == 1 and store.delete("p") == 2 and store.latest("p") is None


def test_migrations(cube):
    done = []
    assert lineage.migrate(cube.catalog, {1: done.append, 2: done.append}, 2) == [1, 2] and lineage.schema_version(cube.catalog) == 2
    assert lineage.migrate(cube.catalog, {}, 2) == []
    with pytest.raises(lineage.SchemaTooNew):
        lineage.migrate(cube.catalog, {}, 1)
    with pytest.raises(KeyError):
        lineage.migrate(cube.catalog, {3: done.append, 5: done.append}, 5)
    assert lineage.schema_version(cube.catalog) == 2


def test_contract_kit(cube):
    good = constant("a", 1)
    bound(cube, good)
    assert [f.ok for f in contract_kit.check_producer(good, cube)] == [True] * 3

    class Leaky(Producer):
        name, produces = "leaky", (VarSpec("z"),)

        def compute(self, inputs, request):
            cube.write_static("z", cube.grid.cells(cube.spark).select("y", "x", F.lit(1.0).alias("value")))
            return {}

    assert [f.ok for f in contract_kit.check_producer(Leaky(), cube)] == [True, False]


def test_model_values():
    assert [t.shape for t in tiles_of(3, 5, 2)] == [(2, 2), (2, 2), (2, 1), (1, 2), (1, 2), (1, 1)]
    assert TileSpec((2, 4), (0, 2)).with_halo(1, 5, 9) == TileSpec((1, 5), (0, 3)) and TileSpec((0, 1), (0, 1)).with_halo(0, 1, 1) == TileSpec((0, 1), (0, 1))
    assert Request(datetime(2026, 1, 1, 12), datetime(2026, 1, 3)).n_days == 2
    with pytest.raises(ValueError):
        Request().n_days  # noqa: B018
    g = Grid.around(-96.797, 32.776, 2500, 500)
    assert g.crs_epsg == 32614 and g.shape == (11, 11) and g.bounds[0] % 500 == 0
    assert MergePolicy("monotone_min") is MergePolicy.MONOTONE_MIN
    for bad in (lambda: Capabilities(halo_cells=-1), lambda: Capabilities(boundary_coupled=True), lambda: VarSpec("a", "odd"), lambda: TileSpec((0, 1), (0, 1)).with_halo(-1, 1, 1)):
        with pytest.raises(ValueError):
            bad()
