"""The catalog of a cube: small Parquet tables behind one pointer file.

A change writes a whole new table and then moves the pointer, so readers see the
tables of before or after, never half of one. One driver writes at a time.
"""

from __future__ import annotations

import json
import threading
from datetime import datetime

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import catalogs
from gridloom.sources import files

SCHEMAS = {
    "variables": "name string, kind string, units string, dtype string, description string, producer string, path string",
    "tiles": "variable string, t timestamp_ntz, source string, native_res_m double, version int, fetched_at timestamp_ntz, seq long",
    "scenarios": "name string, grid_epsg int, grid_pixel_m double, grid_width int, grid_height int, grid_x0 double, grid_y1 double, scenario_date timestamp_ntz, created_at timestamp_ntz",
    "runs": "run_id string, started_at timestamp_ntz, ended_at timestamp_ntz, status string, git_sha string, config_hash string, python string, platform_str string, parent_run_id string, notes string",
    "run_inputs": "run_id string, role string, path string, sha256 string, bytes long",
    "run_outputs": "run_id string, variable string, version int, producer string",
    "run_libs": "run_id string, name string, version string",
    "checkpoints": "producer string, step_id long, saved_at timestamp_ntz, state binary",
    "cube_meta": "key string, value string",
}
KEYS = {
    "variables": ["name"], "tiles": ["variable", "t", "version"], "scenarios": ["name"], "runs": ["run_id"], "run_inputs": ["run_id", "role", "path"],
    "run_outputs": ["run_id", "variable", "version"], "run_libs": ["run_id", "name"], "checkpoints": ["producer", "step_id"], "cube_meta": ["key"],
}

#: Replaced tables that stay; between a table's folders, and how many it has before it is written whole.
KEPT, PART, PARTS = 32, ",", 64


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._pointer = f"{self.root}/current.json"
        self.lock = threading.RLock()
        self.state = {"sequence": 0, "tables": {}}
        if files.exists(spark, self._pointer):
            self.state = json.loads(files.read_text(spark, self._pointer))

    def table(self, name: str) -> DataFrame:
        at = self.state["tables"].get(name)
        schema = SCHEMAS[name]
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{p}" for p in at.split(PART)]) if at else self.spark.createDataFrame([], schema)

    def next_sequence(self) -> int:
        return self.state["sequence"] + 1

    def swap(self, **tables: DataFrame) -> None:
        """Replace whole tables at once."""
        n = self.next_sequence()
        fresh = {name: f"{name}-{n:08d}" for name in tables}
        for name, df in tables.items():
            df.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/{fresh[name]}")
        old = self.state.get("old", []) + [self.state["tables"][name] for name in tables if name in self.state["tables"]]
        # plans that are still running may read the tables of before
        gone, old = old[:-KEPT], old[-KEPT:]
        self._move({"sequence": n, "tables": self.state["tables"] | fresh, "old": old})
        for at in gone:
            for part in at.split(PART):
                files.delete(self.spark, f"{self.root}/{part}")

    def _move(self, state: dict) -> None:
        files.write_text(self.spark, self._pointer, json.dumps(state))
        self.state = state

    def add(self, name: str, rows: list[tuple]) -> None:
        """Insert rows of new keys without writing the others again, but for every ``PARTS``-th time."""
        at = self.state["tables"].get(name)
        if not at or at.count(PART) + 1 >= PARTS:
            self.put(name, rows)
            return
        n = self.next_sequence()
        fresh = f"{name}-{n:08d}"
        self.rows(name, rows).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/{fresh}")
        self._move(self.state | {"sequence": n, "tables": self.state["tables"] | {name: f"{at}{PART}{fresh}"}})

    def rows(self, name: str, rows: list[tuple]) -> DataFrame:
        return self.spark.createDataFrame(rows, SCHEMAS[name])

    def put(self, name: str, rows: list[tuple]) -> None:
        """Insert rows, in place of those of the same keys."""
        self.swap(**{name: catalogs.upserted(self.table(name), self.rows(name, rows), KEYS[name])})

    def remove(self, name: str, column: str, values: list) -> None:
        self.swap(**{name: self.table(name).where(~F.col(column).isin(values))})

    # Questions; the tables are small, and so are the answers

    def variable(self, name: str) -> Row | None:
        return self.table("variables").where(F.col("name") == name).first()

    def list_variables(self) -> list[str]:
        return [r.name for r in self.table("variables").select("name").orderBy("name").collect()]

    def has(self, variable: str, t: datetime | None = None) -> bool:
        return not catalogs.holds(self.table("tiles"), variable, t).isEmpty()

    def list_times(self, variable: str) -> list[datetime]:
        return [r.t for r in catalogs.list_times(self.table("tiles"), variable).collect()]

    def list_tiles(self, variable: str | None = None) -> DataFrame:
        return catalogs.list_tiles(self.table("tiles"), variable)

    def native_resolution(self, variable: str) -> float | None:
        row = catalogs.native_resolution(self.table("tiles").where(F.col("variable") == variable)).first()
        return row.native_res_m if row else None

    def latest_version(self, variable: str) -> int:
        row = catalogs.latest_version(self.table("tiles").where(F.col("variable") == variable)).first()
        return row.version if row else 0

    def is_output_stale(self, output: str, inputs: list[str]) -> bool:
        """Compares the order of writes, which no clock's resolution blurs."""
        tiles = self.table("tiles").select("variable", F.col("seq").alias("fetched_at"))
        return catalogs.is_stale(tiles, output, inputs).first().stale

    def export_json(self, path: str) -> None:
        """A readable mirror of variables, tiles and scenarios."""
        mirror = {n: [json.loads(x) for x in self.table(n).toJSON().collect()] for n in ("variables", "tiles", "scenarios")}
        files.write_text(self.spark, path, json.dumps(mirror, indent=2))
