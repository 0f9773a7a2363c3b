import json
import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gridloom.functions import geo, nests
from gridloom.model import Grid, MergePolicy
from gridloom.plans import cascade
from gridloom.sources import drivers, kml
from gridloom.sources.cache import ContentCache
from gridloom.sources.config import load_config, merged
from gridloom.sources.discovery import DataAsset, DataQuery, DataSource, DataSourceRegistry, RasterSource
from gridloom.sources.store import Cube
from gridloom.streaming import ingest

LON, LAT = -96.797, 32.776
RADII = {"Serious Burn (2nd-deg)": 8000, "Severe Burn (3rd-deg)": 6000, "Critical Burn (clothing)": 4000, "Unsurvivable Burn (structures)": 2500}


def write_kml(path, *folders, skip=()):
    cx, cy = geo.to_utm(LON, LAT, 32614)

    def ring(name, r):
        points = [geo.from_utm(cx + r * math.cos(k * math.pi / 36), cy + r * math.sin(k * math.pi / 36), 32614) for k in range(73)]
        line = " ".join(f"{x:.9f},{y:.9f},0" for x, y in points)
        return f"<Placemark><name>{name}</name><Polygon><outerBoundaryIs><LinearRing><coordinates>{line}</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark>"

    body = "".join(f"<Folder><name>{f}</name>{''.join(ring(n, r) for n, r in RADII.items() if n not in skip)}</Folder>" for f in folders)
    path.write_text(f'<?xml version="1.0"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document>{body}</Document></kml>')
    return str(path)


@pytest.fixture()
def cube(spark, tmp_path):
    return Cube(spark, str(tmp_path / "cube"), Grid.around(LON, LAT, 10_000, 1000))


def test_utm_matches_published_points():
    assert geo.to_utm(9, 45, 32632) == pytest.approx((500000, 4982950.4002), abs=1e-3)
    for lon, lat, epsg in ((-69, -33, 32719), (5.9, 79.5, 32631), (-179.9, 0.1, 32601)):
        assert geo.utm_epsg(lon, lat) == epsg
        assert geo.from_utm(*geo.to_utm(lon, lat, epsg), epsg) == pytest.approx((lon, lat), abs=1e-11)
    with pytest.raises(ValueError):
        geo.to_utm(0, 0, 4326)


def test_utm_columns_are_the_numbers(spark):
    rows = spark.createDataFrame([(LON, LAT), (-96.0, 33.5)], "lon double, lat double")
    x, y = geo.utm_columns(F.col("lon"), F.col("lat"), 32614)
    for r in rows.select("lon", "lat", x.alias("x"), y.alias("y")).collect():
        assert (r.x, r.y) == pytest.approx(geo.to_utm(r.lon, r.lat, 32614), abs=1e-6)


def test_ring_sets_are_chosen_by_name_then_city_then_alone(spark, tmp_path):
    both = write_kml(tmp_path / "a.kml", "Dallas  TX USA MEAN Thermal Damage", "Dallas TX USA High Thermal Damage")
    assert kml.load_damage(spark, both, "Dallas TX USA", "mean").band == "mean"
    with pytest.raises(ValueError):
        kml.load_damage(spark, both, "Dallas TX USA", "Low")
    one = write_kml(tmp_path / "b.kml", "Dallas TX USA Median Thermal Damage")
    assert kml.load_damage(spark, one, "Dallas TX USA").band == "Median"
    assert [r.fluence for r in kml.load_damage(spark, one, "Paris").rings] == [0.25, 0.42, 0.84, 1.2]
    with pytest.raises(ValueError):
        kml.load_damage(spark, write_kml(tmp_path / "c.kml", "x", skip=("Severe Burn (3rd-deg)",)), "x")


def test_thermal_driver(cube, tmp_path):
    path = write_kml(tmp_path / "a.kml", "Dallas TX USA Mean Thermal Damage")
    radii = {r.ring: r.radius for r in kml.ring_radii(kml.rings_table(cube.spark, kml.load_damage(cube.spark, path, "Dallas TX USA")), 32614).collect()}
    assert radii == pytest.approx(RADII, rel=1e-4)
    assert drivers.ThermalDriver(path, "Dallas TX USA").fetch(cube) == ["thermal_fluence", "thermal_power", "ignition_t0", "burnable"]
    cx, cy = geo.to_utm(LON, LAT, 32614)
    t0 = {(r.y, r.x): r.value for r in cube.read_static("ignition_t0").collect()}
    for r in cube.grid.cells(cube.spark).collect():
        d = math.hypot(r.cx - cx, r.cy - cy)
        if min(abs(d - 2500), abs(d - 4000)) > 50:
            assert (t0[r.y, r.x] == 0.0) == (2500 < d < 4000)
    assert cube.read_static("thermal_fluence").agg(F.max("value")).first()[0] == pytest.approx(1.2, abs=1e-6)
    assert cube.catalog.variable("burnable").dtype == "tinyint"


@pytest.mark.parametrize(("u", "v", "speed", "direction"), [(3.0, 4.0, 5.0, 216.8699), (0.0, -5.0, 5.0, 0.0), (-5.0, 0.0, 5.0, 90.0)])
def test_wind_driver(cube, tmp_path, u, v, speed, direction):
    t = datetime(2026, 6, 1)
    rows = [(t + timedelta(hours=h), 34 - i * 0.25, 262 + j * 0.25, u, v) for h in range(5) for i in range(9) for j in range(13)]
    cube.spark.createDataFrame(rows, "time timestamp_ntz, latitude double, longitude double, u float, v float").write.parquet(str(tmp_path / "wind"))
    driver = drivers.WindDriver(str(tmp_path / "wind"))
    driver.fetch(cube, t + timedelta(minutes=30), t + timedelta(hours=3))
    assert cube.times("wind_speed_ms") == [t + timedelta(hours=h) for h in range(4)]
    assert cube.read_time("wind_speed_ms").count() == 4 * cube.grid.width * cube.grid.height
    assert cube.read_time("wind_speed_ms").agg(F.min("value")).first()[0] == pytest.approx(speed)
    assert cube.read_time("wind_dir_deg").agg(F.max("value")).first()[0] == pytest.approx(direction, abs=1e-3)
    assert cube.catalog.native_resolution("wind_dir_deg") == 27_750
    with pytest.raises(ValueError):
        driver.fetch(cube)


def test_fuel_and_dem_drivers(cube):
    h, w = cube.grid.shape
    calls = []

    def ask(piece):
        calls.append(piece)
        if max(piece.height, piece.width) > 8:
            raise OSError("too large")
        return [[(98.0 if piece.row + i == 0 else 3.0) for j in range(piece.width)] for i in range(piece.height)]

    service = drivers.TileService(ask, max_px=20, min_px=4, retries=2, wait_s=0)
    drivers.FuelDriver(lambda cube: service.raster(cube.spark, h, w)).fetch(cube)
    assert {(r.y == 0, r.value) for r in cube.read_static("nfuel_cat").collect()} == {(True, 14), (False, 3)}
    with pytest.raises(RuntimeError):
        drivers.TileService(lambda p: 1 / 0, retries=1).read(drivers.Piece(0, 0, 5, 5))
    plane = cube.grid.cells(cube.spark).select(F.col("y").alias("row"), F.col("x").alias("col"), F.when((F.col("y") == 3) & (F.col("x") == 3), -1e9).otherwise(F.col("x") * 1000.0).alias("value"))
    drivers.DemDriver(lambda cube: plane).fetch(cube)
    slope = {(r.y, r.x): r.value for r in cube.read_static("slope_deg").collect()}
    aspect = {(r.y, r.x): r.value for r in cube.read_static("aspect_deg").collect()}
    assert slope[10, 10] == pytest.approx(45, abs=1e-4) and aspect[10, 10] == 180.0 and cube.catalog.native_resolution("dem") == 10
    mean = cube.read_static("dem").where("y = 3 and x = 3").first().value
    assert mean == pytest.approx(sum(x * 1000 for x in range(w)) / w, rel=1e-2)


def test_wind_is_retried_cached_and_sampled(cube, tmp_path):
    t = datetime(2026, 1, 1)
    rows = [(t + timedelta(hours=h), 30.0 + 0.25 * i, 260.0 + 0.25 * j, 3.0 + h, 4.0) for h in range(4) for i in range(24) for j in range(24)]
    cube.spark.createDataFrame(rows, "time timestamp_ntz, latitude double, longitude double, u float, v float").write.parquet(str(tmp_path / "wind"))

    class Flaky(drivers.WindDriver):
        calls = 0

        def read_source(self, spark):
            self.calls += 1
            if self.calls < 3:
                raise OSError("busy")
            return super().read_source(spark)

    driver = Flaky(str(tmp_path / "wind"), retries=3, cache=str(tmp_path / "cache"), wait_s=0.0)
    assert driver.fetch(cube, t, t + timedelta(hours=3)) == ["wind_speed_ms", "wind_dir_deg"] and driver.calls == 3
    before = cube.read_time("wind_speed_ms").agg(F.sum("value")).first()[0]
    driver.fetch(cube, t, t + timedelta(hours=3))
    assert driver.calls == 3 and cube.read_time("wind_speed_ms").agg(F.sum("value")).first()[0] == before
    driver.fetch(cube, t, t + timedelta(hours=2))  # another window
    assert driver.calls == 4
    broken = Flaky(str(tmp_path / "wind"), retries=2, wait_s=0.0)
    with pytest.raises(RuntimeError, match="busy"):
        broken.fetch(cube, t, t + timedelta(hours=1))
    speed, direction = cube.read_time("wind_speed_ms"), cube.read_time("wind_dir_deg")
    u, v = drivers.centre_wind(speed, direction, t + timedelta(minutes=80), *cube.grid.shape)
    assert (u, v) == (pytest.approx(4.0, abs=1e-4), pytest.approx(4.0, abs=1e-4))
    assert drivers.centre_wind(speed.limit(0), direction.limit(0), t, *cube.grid.shape) is None
    with pytest.raises(ValueError):
        drivers.centre_wind(speed, direction.where(F.col("t") > F.lit(t)), t, *cube.grid.shape)


def test_uniform_fuel(cube):
    cells = cube.grid.cells(cube.spark)
    drivers.UniformFuelDriver(5, mask=cells.select("y", "x", (F.col("x") == 0).alias("value"))).fetch(cube)
    assert {(r.x == 0, r.value) for r in cube.read_static("nfuel_cat").collect()} == {(True, 14), (False, 5)}
    with pytest.raises(ValueError):
        drivers.UniformFuelDriver(-1)
    with pytest.raises(ValueError):
        drivers.UniformFuelDriver(mask=cells.limit(3).select("y", "x", F.lit(True).alias("value"))).fetch(cube)
    with pytest.raises(ValueError):  # as many rows, but other cells
        drivers.UniformFuelDriver(mask=cells.select((F.col("y") + 1).alias("y"), "x", F.lit(True).alias("value"))).fetch(cube)
    d = drivers.register(drivers.UniformFuelDriver())
    assert drivers.driver_for("nfuel_cat") is d and drivers.all_drivers() == [d]
    drivers.reset_registry()
    with pytest.raises(KeyError):
        drivers.driver_for("nfuel_cat")


def test_met_patches_and_soundings(spark):
    met = spark.createDataFrame([(0.0, 280.0, 1.0), (300.0, 281.0, 2.0)], "SKINTEMP double, ST double, A double")
    got = drivers.met_patches(met, {"B": "A", "C": "none"}, {"SKINTEMP": "ST"}).collect()
    assert [(r.SKINTEMP, r.B) for r in got] == [(280.0, 1.0), (300.0, 2.0)]
    lines = spark.createDataFrame([("1 2 3 4 5 6",), ("1 2 3",)], "value string")
    assert [r.value for r in drivers.sounding_lines(lines, 1.0, -2.0).collect()] == ["1 2 3 1.0000 -2.0000 6", "1 2 3"]


def test_discovery(spark, tmp_path):
    grid = Grid(32614, 10.0, 4, 4, 0.0, 40.0)
    spark.range(16).selectExpr("int(id div 4) row", "int(id % 4) col", "double(id) value").write.csv(str(tmp_path / "r"), header=True)
    spark.range(4).selectExpr("int(id div 2) row", "int(id % 2) col", "int(id) value").write.parquet(str(tmp_path / "c"))

    class Failing(DataSource):
        name, variables = "failing", ("dem",)

        def search(self, query):
            raise OSError

        def fetch(self, spark, asset, grid):
            raise OSError

    local = RasterSource("local", {"dem": (str(tmp_path / "r"), "csv", 0.0, 40.0, 10.0), "code": (str(tmp_path / "c"), "parquet", 0.0, 40.0, 20.0)})
    other = RasterSource("other", {"dem": ("x", "csv", 0.0, 0.0, 1.0)})
    r = DataSourceRegistry().register(other).register(local, priority=5).register(Failing(), priority=9)
    assert [s.name for s in r.sources_for("dem")] == ["failing", "local", "other"]
    assert [a.source for a in r.search(DataQuery("dem"))] == ["local", "other"] and r.first_hit(DataQuery("none")) is None
    got = {(c.y, c.x): c.value for c in r.fetch(spark, r.first_hit(DataQuery("dem")), grid).collect()}
    assert len(got) == 16 and got[1, 2] == 6.0
    codes = {(c.y, c.x): c.value for c in r.fetch(spark, r.first_hit(DataQuery("code")), grid).collect()}
    assert codes[0, 1] == 0 and codes[3, 3] == 3 and codes[1, 2] == 1
    with pytest.raises(KeyError):
        r.fetch(spark, DataAsset("nobody", "dem", ""), grid)
    with pytest.raises(ValueError):
        DataSourceRegistry().register(local, variables=[])


def test_cache(spark, tmp_path):
    c = ContentCache(tmp_path)
    a, b = c.key("s", x=1, y=2), c.key("s", y=2, x=1)
    assert a == b != c.key("t", x=1, y=2) and c.get("s", a) is None
    c.put_bytes("s", a, b"one", {"n": 1})
    c.put_bytes("s", a, b"two")
    assert c.get("s", a).read_bytes() == b"one" and c.metadata("s", a) == {"n": 1} and c.has("s", a)
    (tmp_path / "f").write_bytes(b"12345")
    c.put_file("t", "k", tmp_path / "f", move=True)
    assert not (tmp_path / "f").exists() and c.size_bytes() == 8 and c.table(spark).count() == 2
    c.get("s", a)
    assert [e.key for e in c.evict(3)] == ["k"] and c.size_bytes() == 3
    c.clear()
    assert c.entries() == []


def test_config(tmp_path):
    (tmp_path / "a.yaml").write_text("a: 1\nb: {c: 2}\n")
    (tmp_path / "a.json").write_text('{"a": 1}')
    assert load_config(tmp_path / "a.yaml") == {"a": 1, "b": {"c": 2}} and load_config(tmp_path / "a.json") == {"a": 1}
    with pytest.raises(ValueError):
        load_config(tmp_path / "a.toml")
    assert merged({"a": {"b": 1, "c": [1]}, "d": 2}, {"a": {"b": None, "c": [9]}, "d": 3}) == {"a": {"b": 1, "c": [9]}, "d": 3}


def test_nests():
    out = nests.solve_nests(1000, [9000, 3000, 1000])
    assert [(n.dx_m, n.e_we, n.ratio, n.i_start) for n in out] == [(9000, 112, 1, 1), (3000, 169, 3, 28), (1000, 253, 3, 43)]
    with pytest.raises(ValueError):
        nests.solve_nests(1000, [4000, 1500])
    assert nests.time_step(9000) == 54 and nests.time_step(10) == 1
    assert nests.bounding_box(0, 0, 111, 0.5) == (1.5, -1.5, -1.5, 1.5)
    assert len(nests.days_between(datetime(2024, 2, 28).date(), datetime(2024, 3, 1).date())) == 3


def test_streams_append_once_and_merge(cube, tmp_path):
    spark = cube.spark
    t = datetime(2026, 1, 1)
    rows = [(t + timedelta(hours=k), y, x, float(k)) for k in range(2) for y in range(2) for x in range(2)]
    spark.createDataFrame(rows, "t timestamp_ntz, y int, x int, value double").write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema("t timestamp_ntz, y int, x int, value double").parquet(str(tmp_path / "in"))
    for name in ("c1", "c2"):  # another checkpoint sends everything again
        ingest.append_steps(read(), cube, "w", str(tmp_path / name), units="m").awaitTermination()
    assert cube.read_time("w").count() == 8 and len(cube.times("w")) == 2
    cube.init_static("low", 5.0)
    ingest.merge_stream(read(), cube, "low", MergePolicy.MONOTONE_MIN, str(tmp_path / "c3")).awaitTermination()
    assert cube.read_static("low").where("value = 0").count() == 4
    with pytest.raises(ValueError):
        ingest.merge_stream(read(), cube, "low", MergePolicy.ACCUMULATE, str(tmp_path / "c4"))
    q = ingest.running_merge(read(), MergePolicy.ACCUMULATE).writeStream.format("memory").queryName("running").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.value for r in spark.table("running").collect()} == {1.0}


def test_command_line(spark, tmp_path, capsys):
    path = write_kml(tmp_path / "a.kml", "Dallas TX USA Mean Thermal Damage")
    config = {"cube": str(tmp_path / "cube2"), "grid": {"lon": LON, "lat": LAT, "radius_m": 5000, "pixel_m": 1000}, "start": "2026-01-01", "days": 1, "thermal": {"kml_path": path, "city": "Dallas TX USA"}, "uniform_fuel": {}}
    (tmp_path / "c.json").write_text(json.dumps(config))
    run = lambda *a: cascade.main([str(tmp_path / "c.json"), *a], spark)
    assert run("ignition_t0", "nfuel_cat", "--dry-run") == 0 and "thermal" in capsys.readouterr().out
    assert run("ignition_t0", "nfuel_cat") == 0 and "uniform_fuel: ok" in capsys.readouterr().out
    assert run("ignition_t0") == 0 and "thermal: skipped" in capsys.readouterr().out
    config["thermal"]["kml_path"] = str(tmp_path / "none.kml")
    (tmp_path / "c.json").write_text(json.dumps(config))
    assert run("ignition_t0") == 2
