"""The shipped drivers and models as one registry, and a command line that runs them.

    python -m gridloom.plans.cascade CONFIG TARGET... [--dry-run] [--force]
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable, Mapping
from datetime import datetime, timedelta
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession

from gridloom.log import configure
from gridloom.model import Grid
from gridloom.plans.contracts import DriverProducer, ProducerRegistry
from gridloom.plans.model_adapter import FireModel
from gridloom.plans.pipeline import Pipeline
from gridloom.plans.runner import PipelineRunner
from gridloom.sources import drivers
from gridloom.sources.config import load_config
from gridloom.sources.store import Cube

Factory = Callable[[Mapping[str, Any]], Any]


class Cascade:
    """Factories by name; those whose part of the configuration is absent aren't built."""

    def __init__(self):
        self.factories: dict[str, Factory] = {}

    def add(self, name: str, factory: Factory) -> Cascade:
        self.factories[name] = factory
        return self

    def registry(self, config: Mapping[str, Any], only: list[str] | None = None) -> ProducerRegistry:
        out = ProducerRegistry()
        for name, factory in self.factories.items():
            if name in config and (only is None or name in only):
                out.register(factory(config[name] or {}))
        return out


def default_cascade() -> Cascade:
    out = Cascade()
    out.add("thermal", lambda c: DriverProducer(drivers.ThermalDriver(**c)))
    out.add("uniform_fuel", lambda c: DriverProducer(drivers.UniformFuelDriver(**c)))
    out.add("wind", lambda c: DriverProducer(drivers.WindDriver(**c), end="inclusive_day", check="as_requested"))
    table = lambda path: lambda cube: cube.spark.read.parquet(path)
    out.add("dem", lambda c: DriverProducer(drivers.DemDriver(table(c["path"]))))
    out.add("fuel", lambda c: DriverProducer(drivers.FuelDriver(table(c["path"]))))
    out.add("fire_model", lambda c: FireModel(**c))
    return out


def _arguments(argv: list[str] | None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="gridloom", description=__doc__.splitlines()[0])
    p.add_argument("config")
    p.add_argument("targets", nargs="+")
    p.add_argument("--cube", help="the cube's root; else that of the configuration")
    p.add_argument("--start", type=datetime.fromisoformat)
    p.add_argument("--days", type=float)
    p.add_argument("--force", action="store_true")
    p.add_argument("--dry-run", action="store_true", help="print the plan and stop")
    p.add_argument("--result", help="where the report goes")
    return p.parse_args(argv)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0: all steps are done; 1: one failed; 2: an input file is missing."""
    args = _arguments(argv)
    config = load_config(args.config)
    configure()
    for part in ("thermal", "wind", "dem", "fuel"):
        path = (config.get(part) or {}).get("kml_path" if part == "thermal" else "path")
        if path and "://" not in path and not Path(path).exists():
            print(f"missing input: {path}", file=sys.stderr)
            return 2
    registry = default_cascade().registry(config)
    pipeline = Pipeline.from_targets(args.targets, registry)
    if args.dry_run:
        print(pipeline.explain())
        return 0
    spark = spark or SparkSession.builder.appName("gridloom").getOrCreate()
    at = config["grid"]
    grid = Grid.around(at["lon"], at["lat"], at["radius_m"], at["pixel_m"])
    cube = Cube(spark, args.cube or config["cube"], grid)
    start = args.start or (datetime.fromisoformat(str(config["start"])) if "start" in config else None)
    days = args.days or config.get("days")
    end = start + timedelta(days=days) if start and days else None
    result = PipelineRunner(registry).run(cube, pipeline, t_start=start, t_end=end, force=args.force, result_path=args.result or False)
    for step in result.steps:
        print(f"{step.name}: {step.status} {step.error or ''}".rstrip())
    return 0 if result.ok else 1


if __name__ == "__main__":
    sys.exit(main())
