"""Data drivers: they fetch variables and write them to a cube.

The network services that feed such drivers are behind plain functions here
(``TileService``) or Parquet tables, so that any store can stand in for them.
"""

from __future__ import annotations

import hashlib
import math
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from datetime import datetime

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import geo, physics
from gridloom.operators import regrid, stencil, temporal
from gridloom.sources import kml
from gridloom.sources.store import Cube

#: What rasters hold where they have nothing, and metres of a degree.
NODATA, DEGREE_M = -9999, 111_000.0
PAD_DEG = 0.5


class Driver:
    name = "driver"
    produces: tuple[str, ...] = ()
    is_static = True

    def fetch(self, cube: Cube, t_start: datetime | None = None, t_end: datetime | None = None) -> list[str]:
        raise NotImplementedError


_registry: dict[str, Driver] = {}


def register(driver: Driver) -> Driver:
    for v in driver.produces:
        _registry[v] = driver
    return driver


def driver_for(variable: str) -> Driver:
    if variable not in _registry:
        raise KeyError(f"no driver for {variable}")
    return _registry[variable]


def all_drivers() -> list[Driver]:
    return list(dict.fromkeys(_registry.values()))


def reset_registry() -> None:
    _registry.clear()


class ThermalDriver(Driver):
    """Four static variables from a KML's damage rings."""

    name = "thermal"
    produces = ("thermal_fluence", "thermal_power", "ignition_t0", "burnable")

    def __init__(self, kml_path: str, city: str, band: str = "Mean", pulse_s: float = 10.0):
        self.kml_path, self.city, self.band, self.pulse_s = kml_path, city, band, pulse_s

    def field(self, cube: Cube) -> DataFrame:
        damage = kml.load_damage(cube.spark, self.kml_path, self.city, self.band)
        rings = kml.ring_radii(kml.rings_table(cube.spark, damage), cube.grid.crs_epsg).collect()  # four rows
        away = F.hypot(F.col("cx") - rings[0].cx, F.col("cy") - rings[0].cy)
        j = physics.fluence(away, [(r.radius, r.fluence) for r in rings]).cast("float")
        cells = cube.grid.cells(cube.spark).withColumn("thermal_fluence", j)
        j = F.col("thermal_fluence")
        # thresholds in the cells' own precision
        low, high = (float(np.float32(v)) for v in (kml.FLUENCE["Critical Burn (clothing)"], kml.FLUENCE["Unsurvivable Burn (structures)"]))
        return cells.select("y", "x", j, physics.thermal_power(j, self.pulse_s).alias("thermal_power"), physics.burning_annulus(j, low, high).alias("ignition_t0"), physics.burnable(j, high).alias("burnable"))

    def fetch(self, cube, t_start=None, t_end=None):
        kinds = (("thermal_fluence", "MJ/m2", "float"), ("thermal_power", "kW/m2", "float"), ("ignition_t0", "s", "float"), ("burnable", "", "tinyint"))
        cube.write_together(self.field(cube), {n: dict(source=f"kml:{self.kml_path}", units=units, producer=self.name, dtype=dtype) for n, units, dtype in kinds})
        return list(self.produces)


class UniformFuelDriver(Driver):
    """One fuel category everywhere, another where a mask (y, x, value) is true."""

    name = "uniform_fuel"
    produces = ("nfuel_cat",)

    def __init__(self, category: int = 3, no_fuel: int = physics.NO_FUEL, mask: DataFrame | None = None):
        if category < 0 or no_fuel < 0:
            raise ValueError("categories must not be negative")
        self.category, self.no_fuel, self.mask = category, no_fuel, mask

    def fetch(self, cube, t_start=None, t_end=None):
        cells = cube.grid.cells(cube.spark).select("y", "x")
        value = F.lit(self.category)
        if self.mask is not None:
            inside = F.col("y").between(0, cube.grid.height - 1) & F.col("x").between(0, cube.grid.width - 1)
            n = self.mask.where(inside).select("y", "x").distinct().count()
            if n != cube.grid.width * cube.grid.height or n != self.mask.count():
                raise ValueError(f"the mask must hold each of the grid's {cube.grid.width * cube.grid.height} cells once; it has {n} of them")
            cells = cells.join(self.mask.select("y", "x", F.col("value").alias("masked")), ["y", "x"], "left")
            value = F.when(F.col("masked").cast("boolean"), self.no_fuel).otherwise(self.category)
        cube.write_static("nfuel_cat", cells.select("y", "x", value.alias("value")), source=f"uniform_fuel({self.category})", units="category", producer=self.name, dtype="smallint")
        return ["nfuel_cat"]


@dataclass(frozen=True)
class Piece:
    """A part of a raster: pixel offsets and size."""

    row: int
    col: int
    height: int
    width: int

    def quarters(self) -> list[Piece]:
        h, w = self.height // 2, self.width // 2
        return [Piece(self.row + a, self.col + b, c, d) for a, c in ((0, h), (h, self.height - h)) for b, d in ((0, w), (w, self.width - w)) if c and d]


class TileService:
    """A raster service asked in pieces: retried with growing waits, quartered where a piece keeps failing.

    ``ask(piece)`` gives rows of values (height x width). Small pieces that fail
    raise. Only the plan is the driver's: pieces are fetched by executors.
    """

    def __init__(self, ask: Callable[[Piece], Iterable[Iterable[float]]], max_px: int = 1000, min_px: int = 250, retries: int = 4, wait_s: float = 1.0):
        self.ask, self.max_px, self.min_px, self.retries, self.wait_s = ask, max_px, min_px, retries, wait_s

    def plan(self, height: int, width: int) -> list[Piece]:
        cut = lambda n: [(a, min(self.max_px, n - a)) for a in range(0, n, self.max_px)]
        return [Piece(r, c, h, w) for r, h in cut(height) for c, w in cut(width)]

    def read(self, piece: Piece) -> list[tuple[Piece, Iterable[Iterable[float]]]]:
        error: Exception | None = None
        for k in range(self.retries):
            try:
                return [(piece, self.ask(piece))]
            except Exception as e:
                error = e
                time.sleep(self.wait_s * 2**k if k + 1 < self.retries else 0)
        if max(piece.height, piece.width) <= self.min_px:
            raise RuntimeError(f"no data for {piece}") from error
        return [part for q in piece.quarters() for part in self.read(q)]

    def raster(self, spark, height: int, width: int) -> DataFrame:
        """(row, col, value) of the whole raster; rows and columns that a reply lacks are NODATA."""
        service = self

        def fetch(batches):
            import pandas as pd

            for pdf in batches:
                for r in pdf.itertuples(index=False):
                    for piece, values in service.read(Piece(int(r.row), int(r.col), int(r.height), int(r.width))):
                        have = [list(v) for v in values]
                        get = lambda i, j: have[i][j] if i < len(have) and j < len(have[i]) else NODATA  # noqa: E731, B023
                        yield pd.DataFrame([(piece.row + i, piece.col + j, float(get(i, j))) for i in range(piece.height) for j in range(piece.width)], columns=["row", "col", "value"])

        pieces = spark.createDataFrame([(p.row, p.col, p.height, p.width) for p in self.plan(height, width)], "row int, col int, height int, width int")
        return pieces.repartition(max(1, len(self.plan(height, width)))).mapInPandas(fetch, "row int, col int, value double")


class DemDriver(Driver):
    """Elevation on the grid (rows and columns are the grid's), with slope and aspect."""

    name = "dem"
    produces = ("dem", "slope_deg", "aspect_deg")
    native_res_m = 10.0

    def __init__(self, raster: Callable[[Cube], DataFrame]):
        self.raster = raster

    def fetch(self, cube, t_start=None, t_end=None):
        cells = self.raster(cube).select(F.col("row").alias("y"), F.col("col").alias("x"), "value")
        dem = physics.filled(cube.grid.cells(cube.spark).select("y", "x").join(cells, ["y", "x"], "left"))
        note = dict(source="dem", native_res_m=self.native_res_m, producer=self.name)
        cube.write_static("dem", dem, units="m", **note)
        graded = stencil.slope_aspect(cube.read_static("dem"), cube.grid.pixel_m)
        cube.write_together(graded.select("y", "x", "slope_deg", "aspect_deg"), dict.fromkeys(("slope_deg", "aspect_deg"), dict(units="deg", **note)))
        return list(self.produces)


class FuelDriver(Driver):
    """Fuel codes on the grid, and categories with everything unburnable as no fuel."""

    name = "fuel"
    produces = ("fbfm13", "nfuel_cat")
    native_res_m = 30.0

    def __init__(self, raster: Callable[[Cube], DataFrame], no_fuel: int = physics.NO_FUEL):
        self.raster, self.no_fuel = raster, no_fuel

    def fetch(self, cube, t_start=None, t_end=None):
        cells = self.raster(cube).select(F.col("row").alias("y"), F.col("col").alias("x"), F.col("value").cast("smallint").alias("value"))
        codes = cube.grid.cells(cube.spark).select("y", "x").join(cells, ["y", "x"], "left").withColumn("value", F.coalesce("value", F.lit(NODATA).cast("smallint")))
        note = dict(source="fuel", native_res_m=self.native_res_m, producer=self.name, units="category", dtype="smallint")
        cube.write_static("fbfm13", codes, **note)
        fuel = physics.fuel_category(F.col("value"))
        cube.write_static("nfuel_cat", cube.read_static("fbfm13").withColumn("value", F.when(fuel == physics.NO_FUEL, self.no_fuel).otherwise(fuel)), **note)
        return list(self.produces)


class WindDriver(Driver):
    """Hourly wind speed and direction from a table (time, latitude, longitude, u, v) on a regular grid.

    Latitudes may fall; longitudes run 0 to 360. The area, with a margin, and
    the hours are filtered in the scan.
    """

    name = "wind"
    produces = ("wind_speed_ms", "wind_dir_deg")
    is_static = False

    def __init__(self, path: str, step_deg: float = 0.25, retries: int = 4, cache: str | None = None, wait_s: float = 1.0):
        """``retries``: times the source is tried, with waits that double; ``cache``: a folder that
        keeps the winds of a grid and window, which all executors reach."""
        self.path, self.step, self.retries, self.cache, self.wait_s = path, step_deg, max(1, retries), cache, wait_s

    def cache_path(self, cube: Cube, t_start: datetime, t_end: datetime) -> str:
        g = cube.grid
        key = f"{self.path}|{g.crs_epsg}|{g.width}|{g.height}|{g.pixel_m}|{g.x0:.3f}|{g.y1:.3f}|{t_start.isoformat()}|{t_end.isoformat()}"
        return f"{self.cache}/wind_{hashlib.sha256(key.encode()).hexdigest()[:20]}"

    def read_source(self, spark) -> DataFrame:
        return spark.read.parquet(self.path)

    def opened(self, spark) -> DataFrame:
        for k in range(self.retries):
            try:
                return self.read_source(spark)
            except Exception as e:
                error = e
                time.sleep(self.wait_s * 2**k if k + 1 < self.retries else 0)
        raise RuntimeError(f"no winds at {self.path}: {error}") from error

    def interpolated(self, cube: Cube, t_start: datetime, t_end: datetime) -> DataFrame:
        """(t, y, x, u, v)."""
        first, last = temporal.hours(t_start, t_end)
        lon, lat = geo.lonlat_columns(F.col("cx"), F.col("cy"), cube.grid.crs_epsg)
        cells = cube.grid.cells(cube.spark).select("y", "x", geo.lon_0_360(lon).alias("lon"), lat.alias("lat"))
        area = cells.agg(F.min("lon").alias("w"), F.max("lon").alias("e"), F.min("lat").alias("s"), F.max("lat").alias("n")).first()
        rows = self.opened(cube.spark)
        near = rows.where(F.col("latitude").between(area.s - PAD_DEG, area.n + PAD_DEG) & F.col("longitude").between(area.w - PAD_DEG, area.e + PAD_DEG))
        near = near.where((F.col("time") >= temporal.at(first)) & (F.col("time") <= temporal.at(last)))
        base = near.agg(F.min("latitude").alias("lat0"), F.min("longitude").alias("lon0")).first()
        if base.lat0 is None:
            raise ValueError("the source has no wind for this area and window")
        index = lambda c, zero: F.round((F.col(c) - zero) / self.step).cast("int")
        nodes = near.select(F.col("time").alias("t"), index("latitude", base.lat0).alias("i"), index("longitude", base.lon0).alias("j"), F.col("u").cast("double").alias("u"), F.col("v").cast("double").alias("v"))
        return regrid.bilinear_nodes(cells, nodes, F.col("lon"), F.col("lat"), base.lon0, base.lat0, self.step, ("u", "v"), ("t",))

    def fetch(self, cube, t_start=None, t_end=None):
        if t_start is None or t_end is None:
            raise ValueError("wind needs both ends of a window")
        u, v = F.col("u"), F.col("v")
        columns = lambda wind: wind.select("t", "y", "x", physics.wind_speed(u, v).alias("wind_speed_ms"), physics.wind_direction(u, v).alias("wind_dir_deg"))
        if self.cache is None:
            made = columns(self.interpolated(cube, t_start, t_end))
        else:
            at = self.cache_path(cube, t_start, t_end)
            try:
                made = cube.spark.read.parquet(at)
                made = made.select("t", "y", "x", *self.produces)
            except Exception:  # not there, or not whole
                columns(self.interpolated(cube, t_start, t_end)).write.mode("overwrite").parquet(at)
                made = cube.spark.read.parquet(at)
        note = dict(source=f"parquet:{self.path}", native_res_m=self.step * DEGREE_M, producer=self.name)
        cube.write_together(made, {"wind_speed_ms": dict(units="m/s", **note), "wind_dir_deg": dict(units="deg", **note)})
        return list(self.produces)


def centre_wind(speed: DataFrame, direction: DataFrame, at: datetime, height: int, width: int) -> tuple[float, float] | None:
    """(u, v) at the grid's middle cell and the step nearest to the hour of ``at``; None without steps.

    Both variables (t, y, x, value) must have the same steps; of two equally
    near the earlier counts. Directions are those the wind comes from.
    """
    middle = (F.col("y") == height // 2) & (F.col("x") == width // 2)
    named = lambda df, n: df.where(middle).select("t", F.col("value").alias(n), F.lit(True).alias(f"has_{n}"))
    both = named(speed, "speed").join(named(direction, "direction"), "t", "full")
    hour = F.lit(at.replace(minute=0, second=0, microsecond=0)).cast("timestamp_ntz")
    away = F.abs(F.unix_micros(F.col("t").cast("timestamp")) - F.unix_micros(hour.cast("timestamp")))
    found = both.agg(
        F.min_by(F.struct("speed", "direction"), F.struct(away.alias("away"), "t")).alias("best"),
        F.max(F.col("has_speed").isNull() | F.col("has_direction").isNull()).alias("apart"),
    ).first()
    if found.best is None:
        return None
    if found.apart:
        raise ValueError("speed and direction have different steps")
    turn = math.radians(found.best.direction)
    return -found.best.speed * math.sin(turn), -found.best.speed * math.cos(turn)


def met_patches(met: DataFrame, copies: dict[str, str], where_zero: dict[str, str]) -> DataFrame:
    """Meteorology with columns copied, and columns that are 0 taken from another."""
    out = met.withColumns({to: F.col(of) for to, of in copies.items() if of in met.columns})
    return out.withColumns({c: F.when(F.col(c) == 0, F.col(of)).otherwise(F.col(c)) for c, of in where_zero.items() if {c, of} <= set(met.columns)})


def sounding_lines(lines: DataFrame, u: float, v: float) -> DataFrame:
    """Text rows with columns 4 and 5 (of five or more) set to a wind."""
    parts = F.split(F.trim("value"), r"\s+")
    patched = F.concat_ws(" ", F.slice(parts, 1, 3), F.lit(f"{u:.4f}"), F.lit(f"{v:.4f}"), F.slice(parts, 6, F.greatest(F.size(parts) - 5, F.lit(0))))
    return lines.withColumn("value", F.when(F.size(parts) >= 5, patched).otherwise(F.col("value")))
