"""A cube: variables on one grid, as versioned Parquet behind a catalog.

<root>/vars/<name>/<version>/ty=/tx=/ holds a static variable, with t_day= above
a time variable's tiles. Bulk writes and merges of tiles make a new version and
then point the catalog at it; appended steps go into the current one. Reads return
lazy DataFrames, whose filters prune partitions and reach the scan.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import asdict
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.model import Grid, MergePolicy, Request, TileSpec, VarSpec
from gridloom.operators import catalogs, merge, stencil, temporal
from gridloom.sources import files
from gridloom.sources.catalog import Catalog

TILE = 256
#: Between the folders of a variable's path, and folders after which a merge writes the variable whole.
LAYER, LAYERS = ";", 8


def _now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


class Cube:
    def __init__(self, spark: SparkSession, root: str, grid: Grid | None = None, tile: int = TILE):
        """Open the cube at ``root``, or create it on ``grid``."""
        self.spark, self.root = spark, str(root).rstrip("/")
        at = f"{self.root}/grid.json"
        if files.exists(spark, at):
            saved = json.loads(files.read_text(spark, at))
            self.tile = saved.pop("tile")
            self.grid = Grid(**saved)
            if grid is not None and grid != self.grid:
                raise ValueError("the cube has another grid")
        elif grid is None:
            raise FileNotFoundError(f"no cube at {self.root}")
        else:
            self.grid, self.tile = grid, tile
            files.write_text(spark, at, json.dumps(asdict(grid) | {"tile": tile}))
        self.catalog = Catalog(spark, f"{self.root}/catalog")

    def stage(self, tag: str) -> str:
        """An unused folder beside the variables, for rows that are read more than once."""
        return f"{self.root}/stage/{tag}-{uuid.uuid4().hex[:12]}"

    def unstage(self, path: str) -> None:
        files.delete(self.spark, path)

    # Scans

    def _read(self, variable: str, kind: str | None = None) -> DataFrame:
        row = self.catalog.variable(variable)
        if row is None:
            raise KeyError(f"no such variable: {variable}")
        if kind and row.kind != kind:
            raise ValueError(f"{variable} is a {row.kind} variable")
        layers = row.path.split(LAYER)
        parts = self._parts(row.kind)
        out = self._layer(row, layers[-1])
        merged = out.select(*parts).distinct()
        for path in reversed(layers[:-1]):  # a tile is read from the last layer that has it
            rows = self._layer(row, path)
            out = out.unionByName(rows.join(merged, parts, "left_anti").select(*out.columns))
            if path != layers[0]:
                merged = merged.union(rows.select(*parts)).distinct()
        return out

    def _layer(self, row, path: str) -> DataFrame:
        keys = "t timestamp_ntz, " if row.kind == "time" else ""
        parts = "t_day date, " if row.kind == "time" else ""
        return self.spark.read.schema(f"{keys}y int, x int, value {row.dtype}, {parts}ty int, tx int").parquet(f"{self.root}/{path}")

    def read_static(self, variable: str) -> DataFrame:
        return self._read(variable, "static").select("y", "x", "value")

    def read_time(self, variable: str) -> DataFrame:
        return self._read(variable, "time").select("t", "y", "x", "value")

    def read(self, variable: str) -> DataFrame:
        row = self.catalog.variable(variable)
        return self.read_time(variable) if row is not None and row.kind == "time" else self.read_static(variable)

    def times(self, variable: str) -> list[datetime]:
        return self.catalog.list_times(variable)

    def read_window(self, variable: str, t_start: datetime | None = None, t_end: datetime | None = None) -> DataFrame:
        """Steps of a closed window; days outside it aren't opened."""
        rows = self._read(variable, "time")
        if t_start is not None:
            rows = rows.where(F.col("t_day") >= F.lit(t_start.date()))
        if t_end is not None:
            rows = rows.where(F.col("t_day") <= F.lit(t_end.date()))
        return temporal.time_window(rows, t_start, t_end).select("t", "y", "x", "value")

    def read_step(self, variable: str, t: datetime) -> DataFrame:
        """The step nearest to ``t``, which the catalog names."""
        times = self.times(variable)
        if not times:
            raise KeyError(f"{variable} has no steps")
        best = min(times, key=lambda s: (abs(s - t), s))
        return self.read_window(variable, best, best)

    def read_block(self, variable: str, tile: TileSpec, halo: int = 0) -> DataFrame:
        """A tile's cells, with ``halo`` cells around it and is_inner; a time range counts steps."""
        rows = self._read(variable)
        outer = tile.with_halo(halo, self.grid.height, self.grid.width)
        for axis, (a, b) in (("ty", outer.y), ("tx", outer.x)):
            rows = rows.where(F.col(axis).between(a // self.tile, (b - 1) // self.tile))
        if tile.t is not None and "t" in rows.columns:
            rows = temporal.step_index(rows, *tile.t)
        keys = ["t"] if "t" in rows.columns else []
        return stencil.halo_block(rows, tile, halo, self.grid.height, self.grid.width).select(*keys, "y", "x", "value", "is_inner")

    def read_filled(self, variable: str, fill: float | None = None) -> DataFrame:
        """A static variable on every cell of the grid; absent ones hold ``fill``."""
        cells = self.grid.cells(self.spark).select("y", "x")
        return cells.join(self.read_static(variable), ["y", "x"], "left").withColumn("value", F.coalesce("value", F.lit(fill)))

    # Sinks

    def _laid_out(self, cells: DataFrame, kind: str, dtype: str) -> DataFrame:
        value = F.col("value").cast("double") if dtype in ("float", "double") else F.col("value")
        value = F.when(~F.isnan(value), value) if dtype in ("float", "double") else value
        keys = ["t"] if kind == "time" else []
        out = cells.select(*keys, F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), value.cast(dtype).alias("value"))
        if kind == "time":
            out = out.withColumn("t", F.col("t").cast("timestamp_ntz")).withColumn("t_day", F.to_date("t"))
        return out.withColumn("ty", F.expr(f"y div {self.tile}").cast("int")).withColumn("tx", F.expr(f"x div {self.tile}").cast("int"))

    def _parts(self, kind: str) -> list[str]:
        return (["t_day"] if kind == "time" else []) + ["ty", "tx"]

    def _store(self, cells: DataFrame, path: str, kind: str, dtype: str, mode: str = "overwrite") -> None:
        parts = self._parts(kind)
        rows = self._laid_out(cells, kind, dtype).repartition(*parts)
        rows.write.mode(mode).option("partitionOverwriteMode", "static").partitionBy(*parts).parquet(f"{self.root}/{path}")

    def _check_stored(self, path: str) -> None:
        """Refuse what lies outside the grid, by the tiles that were written: the plan isn't run again."""
        rows = self.spark.read.schema("y int, x int").parquet(f"{self.root}/{path}")
        at = rows.agg(F.min("y"), F.max("y"), F.min("x"), F.max("x")).first()  # from the files' statistics, mostly
        if at[0] is not None and (at[0] < 0 or at[1] >= self.grid.height or at[2] < 0 or at[3] >= self.grid.width):
            files.delete(self.spark, f"{self.root}/{path}")
            raise ValueError("cells lie outside the grid")

    def _unused(self, variable: str) -> tuple[str, int]:
        """The next version's folder; another one than what a write that broke off has left."""
        version = self.catalog.latest_version(variable) + 1
        return f"vars/{variable}/{version:06d}-{uuid.uuid4().hex[:6]}", version

    def _write(self, variable: str, cells: DataFrame, kind: str, *, source: str, native_res_m: float, units: str, producer: str, description: str, dtype: str) -> int:
        path, version = self._unused(variable)
        self._store(cells, path, kind, dtype)
        self._check_stored(path)
        with self.catalog.lock:
            self._point_at(variable, kind, units, dtype, description, producer, path, source, float(native_res_m), version, self._steps_at(path, kind))
        return version

    def _steps_at(self, path: str, kind: str) -> list[datetime | None]:
        if kind != "time":
            return [None]
        written = self.spark.read.schema("t timestamp_ntz").parquet(f"{self.root}/{path}")
        return [r.t for r in written.select("t").distinct().orderBy("t").collect()]

    def write_together(self, cells: DataFrame, columns: dict[str, dict]) -> dict[str, int]:
        """Several variables from the columns of one frame, whose plan runs once; notes by column as of ``write_static``.

        A frame with t makes time variables. Returns the versions.
        """
        stage = self.stage("frame")
        kind = "time" if "t" in cells.columns else "static"
        keys = (["t"] if kind == "time" else []) + ["y", "x"]
        try:
            cells.select(*keys, *columns).write.parquet(stage)
            staged = self.spark.read.schema(cells.select(*keys, *columns).schema).parquet(stage)
            write = self.write_time if kind == "time" else self.write_static
            return {n: write(n, staged.select(*keys, F.col(n).alias("value")), **note) for n, note in columns.items()}
        finally:
            self.unstage(stage)

    def _point_at(self, variable, kind, units, dtype, description, producer, path, source, native_res_m, version, steps) -> None:
        seq = self.catalog.next_sequence()
        known = self.catalog.rows("variables", [(variable, kind, units, dtype, description, producer, path)])
        tiles = self.catalog.rows("tiles", [(variable, t, source, native_res_m, version, _now(), seq) for t in steps])
        self.catalog.swap(
            variables=catalogs.upserted(self.catalog.table("variables"), known, ["name"]),
            # all steps of before go, so that none outlives its data
            tiles=self.catalog.table("tiles").where(F.col("variable") != variable).unionByName(tiles),
        )

    def write_static(self, variable: str, cells: DataFrame, *, source: str = "", native_res_m: float | None = None, units: str = "", producer: str = "", description: str = "", dtype: str = "float") -> int:
        """Replace a static variable; returns its version."""
        res = self.grid.pixel_m if native_res_m is None else native_res_m
        return self._write(variable, cells, "static", source=source, native_res_m=res, units=units, producer=producer, description=description, dtype=dtype)

    def write_time(self, variable: str, cells: DataFrame, *, source: str = "", native_res_m: float | None = None, units: str = "", producer: str = "", description: str = "", dtype: str = "float") -> int:
        """Replace a time variable; returns its version."""
        res = self.grid.pixel_m if native_res_m is None else native_res_m
        return self._write(variable, cells, "time", source=source, native_res_m=res, units=units, producer=producer, description=description, dtype=dtype)

    def append_step(self, variable: str, t: datetime, cells: DataFrame, *, source: str = "", native_res_m: float | None = None, units: str = "", producer: str = "", description: str = "", dtype: str = "float") -> bool:
        """Add one step, unless the catalog has it; tells whether it was added."""
        if self.catalog.has(variable, t):
            return False
        stamped = cells.withColumn("t", temporal.at(t))
        row = self.catalog.variable(variable)
        if row is None:
            self.write_time(variable, stamped, source=source, native_res_m=native_res_m, units=units, producer=producer, description=description, dtype=dtype)
            return True
        if row.kind != "time":
            raise ValueError(f"{variable} is a {row.kind} variable")
        if LAYER in row.path:  # its tiles of that day may be in a later layer
            self.write_tiles(variable, stamped)
            return True
        # a step is checked in a stage before it joins the others
        stage = f"stage/step-{uuid.uuid4().hex[:12]}"
        self._store(stamped, stage, "time", row.dtype)
        self._check_stored(stage)
        self._store(self._layer(row, stage).select("t", "y", "x", "value"), row.path, "time", row.dtype, mode="append")
        self.unstage(f"{self.root}/{stage}")
        res = float(self.grid.pixel_m if native_res_m is None else native_res_m)
        with self.catalog.lock:
            self.catalog.add("tiles", [(variable, t, source, res, self.catalog.latest_version(variable), _now(), self.catalog.next_sequence())])
        return True

    def write_tiles(self, variable: str, cells: DataFrame, policy: MergePolicy = MergePolicy.LAST_WRITER) -> int:
        """Merge cells into the tiles that they lie in; returns the variable's new version.

        Rows of a halo (is_inner false) are left out. The merged tiles are a new
        layer over the variable's folders, to which the catalog is pointed last:
        readers see all of them or none, a merge that breaks off changes nothing,
        and other tiles aren't rewritten. The ``LAYERS``-th layer writes the
        variable whole instead.
        """
        row = self.catalog.variable(variable)
        if row is None:
            raise KeyError(f"no such variable: {variable}")
        if "is_inner" in cells.columns:
            cells = cells.where("is_inner").drop("is_inner")
        keys = ("t", "y", "x") if row.kind == "time" else ("y", "x")
        parts = self._parts(row.kind)
        stage = f"stage/tiles-{uuid.uuid4().hex[:12]}"
        self._store(cells, stage, row.kind, row.dtype)
        try:
            self._check_stored(stage)
            new = self._layer(row, stage)
            path, version = self._unused(variable)
            old = self._read(variable)
            if row.path.count(LAYER) + 1 < LAYERS:
                old = old.join(new.select(*parts).distinct(), parts, "left_semi")
                layers = f"{row.path}{LAYER}{path}"
            else:
                layers = path
            self._store(merge.merge_cells(old.select(*keys, "value"), new.select(*keys, "value"), policy, keys), path, row.kind, row.dtype)
            steps = sorted({*self.times(variable), *self._steps_at(stage, row.kind)}) if row.kind == "time" else [None]
        finally:
            self.unstage(f"{self.root}/{stage}")
        with self.catalog.lock:
            latest = self.catalog.table("tiles").where(F.col("variable") == variable).orderBy(F.col("seq").desc()).first()
            self._point_at(variable, row.kind, row.units, row.dtype, row.description, row.producer, layers, latest.source, latest.native_res_m, version, steps)
        return version

    def init_static(self, variable: str, fill: float | None = None, *, overwrite: bool = False, units: str = "", producer: str = "", description: str = "", dtype: str = "float", source: str = "") -> None:
        """Make the variable, holding ``fill`` everywhere (nothing where None); keep one that is there."""
        if self.catalog.variable(variable) is not None and not overwrite:
            return
        cells = self.grid.cells(self.spark).select("y", "x", F.lit(fill).cast("double").alias("value"))
        self.write_static(variable, cells if fill is not None else cells.limit(0), units=units, producer=producer, description=description, dtype=dtype, source=source)

    def init_time(self, variable: str, times: Sequence[datetime], fill: float, *, overwrite: bool = False, units: str = "", producer: str = "", description: str = "", dtype: str = "float", source: str = "") -> None:
        if self.catalog.variable(variable) is not None and not overwrite:
            return
        steps = F.explode(F.array(*[temporal.at(t) for t in times]))
        cells = self.grid.cells(self.spark).select(steps.alias("t"), "y", "x", F.lit(fill).cast("double").alias("value"))
        self.write_time(variable, cells, units=units, producer=producer, description=description, dtype=dtype, source=source)

    def merge(self, spec: VarSpec, cells: DataFrame, *, source: str, producer: str) -> int:
        """Write a declared variable by its merge policy, cell by cell and step by step."""
        keys = ("t", "y", "x") if spec.kind == "time" else ("y", "x")
        if spec.merge_policy is not MergePolicy.LAST_WRITER and self.catalog.variable(spec.name) is not None:
            cells = merge.merge_cells(self.read(spec.name), cells, spec.merge_policy, keys)
        write = self.write_time if spec.kind == "time" else self.write_static
        return write(spec.name, cells, source=source, units=spec.units, producer=producer, description=spec.description, dtype=spec.dtype)

    def drop(self, variables: Sequence[str]) -> None:
        names = list(variables)
        self.catalog.swap(
            variables=self.catalog.table("variables").where(~F.col("name").isin(names)), tiles=self.catalog.table("tiles").where(~F.col("variable").isin(names))
        )
        for name in names:
            files.delete(self.spark, f"{self.root}/vars/{name}")

    # Questions

    def has(self, variable: str, t: datetime | None = None) -> bool:
        return self.catalog.has(variable, t)

    def satisfies(self, spec: VarSpec | str, request: Request | None = None) -> bool:
        """A declared variable by ``catalogs.satisfied``; a name alone by its presence."""
        if isinstance(spec, str):
            return self.catalog.variable(spec) is not None
        request = request or Request()
        specs = self.spark.createDataFrame([(spec.name, spec.kind or None, None if spec.max_native_res_m is None else float(spec.max_native_res_m))], "name string, kind string, max_native_res_m double")
        return catalogs.satisfied(specs, self.catalog.table("variables"), self.catalog.table("tiles"), request.t_start, request.t_end).first().satisfied

    def time_coverage(self, variable: str, t_start: datetime | None = None, t_end: datetime | None = None) -> dict:
        times = self.times(variable)
        inside = [t for t in times if (t_start is None or t >= t_start) and (t_end is None or t <= t_end)]
        covered = bool(times) and (t_start is None or times[0] <= t_start) and (t_end is None or times[-1] >= t_end)
        return {"times": inside, "window_covered": covered, "first": times[0] if times else None, "last": times[-1] if times else None}

    def is_output_stale(self, output: str, inputs: Sequence[str]) -> bool:
        return self.catalog.is_output_stale(output, list(inputs))

    def export_catalog(self) -> None:
        self.catalog.export_json(f"{self.root}/catalog.json")


def save_snapshot(cube: Cube, target: str) -> None:
    """Copy the whole cube to ``target``, which must be empty or absent."""
    if files.listed(cube.spark, target):
        raise FileExistsError(target)
    _refuse(target)
    files.copy_tree(cube.spark, cube.root, target)
    files.write_text(cube.spark, f"{target}/snapshot.json", json.dumps({"saved_at": _now().isoformat(), "source": cube.root}))


def restore_snapshot(spark: SparkSession, snapshot: str, root: str, overwrite: bool = False) -> Cube:
    if not files.exists(spark, f"{snapshot}/grid.json"):
        raise FileNotFoundError(f"no snapshot at {snapshot}")
    if files.exists(spark, root):
        if not overwrite:
            raise FileExistsError(root)
        _refuse(root)
        files.delete(spark, root)
    files.copy_tree(spark, snapshot, root)
    return Cube(spark, root)


def _refuse(path: str) -> None:
    """No root of a file system, nor a folder right below one, is ever overwritten."""
    bare = path.split("://", 1)[-1].split(":", 1)[-1]
    if len([p for p in bare.split("/") if p not in ("", ".")]) < 2 or ".." in bare.split("/"):
        raise ValueError(f"refusing to overwrite {path}")
