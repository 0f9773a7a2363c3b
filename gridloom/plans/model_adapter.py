"""External models: inputs staged as files, a command run on them, outputs read back."""

from __future__ import annotations

import re
import shutil
import subprocess
import tempfile
from collections.abc import Mapping, Sequence
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import physics
from gridloom.model import Grid, MergePolicy, Request, VarSpec
from gridloom.plans.contracts import Producer


class ModelAdapter(Producer):
    """stage_inputs, run_model and parse_outputs in a fresh folder, removed unless ``keep_stage``.

    The folder is the driver's: a model is a program on one machine, and reads
    and writes what fits there.
    """

    keep_stage = False

    def stage_inputs(self, inputs: Mapping[str, DataFrame], request: Request, stage: Path) -> None:
        raise NotImplementedError

    def run_model(self, stage: Path, request: Request) -> Path:
        raise NotImplementedError

    def parse_outputs(self, out: Path, spark) -> dict[str, DataFrame]:
        raise NotImplementedError

    def run(self, cube, request: Request) -> dict[str, int]:
        stage = Path(tempfile.mkdtemp(prefix=f"{self.name}-"))
        try:
            inputs = self.extract(cube, request)
            self.stage_inputs(inputs, request, stage)
            return self.update(cube, self.parse_outputs(self.run_model(stage, request), cube.spark), request)
        finally:
            if not self.keep_stage:
                shutil.rmtree(stage, ignore_errors=True)


class CommandModel(ModelAdapter):
    """A program that reads <name>.parquet of its inputs and writes <name>.parquet of its outputs."""

    def __init__(self, name: str, command: Sequence[str], produces: Sequence[VarSpec], requires: Sequence[VarSpec], templates: Mapping[str, str] | None = None, timeout_s: float | None = None):
        self.name, self.command, self.produces, self.requires = name, list(command), tuple(produces), tuple(requires)
        self.templates, self.timeout_s = dict(templates or {}), timeout_s

    def stage_inputs(self, inputs, request, stage):
        for n, df in inputs.items():
            df.toPandas().to_parquet(stage / f"{n}.parquet", index=False)
        for n, text in self.templates.items():
            (stage / n).write_text(text)

    def run_model(self, stage, request):
        done = subprocess.run(self.command, cwd=stage, capture_output=True, text=True, timeout=self.timeout_s)
        if done.returncode:
            raise RuntimeError(f"{self.name} ended with {done.returncode}: {done.stderr[-500:]}")
        return stage

    def parse_outputs(self, out, spark):
        import pandas as pd

        made = {}
        for spec in self.produces:
            at = out / f"{spec.name}.parquet"
            if at.exists():
                made[spec.name] = spark.createDataFrame(pd.read_parquet(at), "y int, x int, value double" if spec.kind == "static" else "t timestamp_ntz, y int, x int, value double")
            elif not spec.required:
                made[spec.name] = spark.createDataFrame([], "y int, x int, value double")
        return made


class FireModel(CommandModel):
    """A fire-spread program: gated ignition times in, arrival and burnt area out.

    It reads TIGN_IN (ignition before T where fuel burns, else a time that never
    comes) and NFUEL_CAT, and writes TIGN_G and FIRE_AREA on cells refined by
    ``refine``; arrivals are block minima, areas block maxima. ``extra`` outputs
    (name: block reduction) are optional.
    """

    def __init__(self, command: Sequence[str], name: str = "fire_model", refine: int = 1, extra: Mapping[str, str] | None = None, **options):
        self.refine, self.extra = refine, dict(extra or {})
        produces = (VarSpec("arrival_s", units="s", merge_policy=MergePolicy.MONOTONE_MIN), VarSpec("fire_area", merge_policy=MergePolicy.MONOTONE_MAX))
        produces += tuple(VarSpec(n, merge_policy=MergePolicy.MONOTONE_MAX, required=False) for n in self.extra)
        super().__init__(name, command, produces, (VarSpec("ignition_t0"), VarSpec("nfuel_cat", dtype="smallint")), **options)

    def extract(self, cube, request):
        self.shape = cube.grid.shape
        return super().extract(cube, request)

    def stage_inputs(self, inputs, request, stage):
        t0, fuel = inputs["ignition_t0"].withColumnRenamed("value", "t0"), inputs["nfuel_cat"].withColumnRenamed("value", "fuel")
        until = F.broadcast(t0.agg(physics.last_ignition(F.col("t0")).alias("until")))  # one row
        gate = physics.gated_ignition(F.col("t0").cast("double"), F.col("fuel"), F.col("until"))
        tign = fuel.join(t0, ["y", "x"], "left").join(until).select("y", "x", gate.alias("value"))
        super().stage_inputs({"TIGN_IN": tign, "NFUEL_CAT": inputs["nfuel_cat"]}, request, stage)

    def parse_outputs(self, out, spark):
        from gridloom.operators.regrid import block_reduce

        import pandas as pd

        def field(n: str, op: str) -> DataFrame:
            at = out / f"{n}.parquet"
            if not at.exists():
                return missing_field(spark, *self.shape)
            cells = spark.createDataFrame(pd.read_parquet(at), "y int, x int, value double")
            h, w = self.shape
            return block_reduce(cells, self.refine, h * self.refine, w * self.refine, op)

        made = {"arrival_s": field("TIGN_G", "min").withColumn("value", physics.arrival(F.col("value"))), "fire_area": field("FIRE_AREA", "max")}
        for n, op in self.extra.items():
            made[n] = field(n, op)
        return made


def patched_namelist(text: str, values: Mapping[str, object], ignore_case: bool = True) -> str:
    """Every ``key = value`` of the text with the new value; indents and comments stay."""
    for key, value in values.items():
        pattern = re.compile(rf"^(\s*{re.escape(key)}\s*=\s*)([^!\n]*?)(\s*(?:!.*)?)$", re.M | (re.I if ignore_case else 0))
        text = pattern.sub(lambda m, v=value: f"{m[1]}{v},{m[3]}", text)
    return text


def namelist(sections: Mapping[str, Mapping[str, object]]) -> str:
    """Fortran namelists; a list is a row with a value for each domain."""
    lines = []
    for name, values in sections.items():
        lines.append(f" &{name}")
        for key, value in values.items():
            row = value if isinstance(value, (list, tuple)) else [value]
            lines.append(f" {key} = " + ", ".join(_fortran(v) for v in row) + ",")
        lines += [" /", ""]
    return "\n".join(lines)


def _fortran(v: object) -> str:
    if isinstance(v, bool):
        return ".true." if v else ".false."
    return f"'{v}'" if isinstance(v, str) else str(v)


def newest(paths: Sequence[str]) -> str:
    """The last output by name, which carries its time."""
    if not paths:
        raise FileNotFoundError("the model wrote nothing")
    return max(paths)


def missing_field(spark, height: int, width: int) -> DataFrame:
    """A field of a variable that a model didn't write: every cell is there, and missing."""
    return Grid(0, 1.0, width, height, 0.0, 0.0).cells(spark).select("y", "x", F.lit(None).cast("double").alias("value"))


def surface_field(levels: DataFrame | None, spark, height: int, width: int) -> DataFrame:
    """Of a model's (t, level, y, x, value), or (t, y, x, value), the lowest level of the last step on the grid.

    Cells beyond the grid are cut off; without the variable every cell is missing.
    """
    if levels is None:
        return missing_field(spark, height, width)
    inside = levels.where(F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1))
    rank = F.struct("t", (-F.col("level")).alias("up")) if "level" in levels.columns else F.col("t")
    # the field's last step, of which each cell's lowest level counts; combined before the shuffle
    last = F.broadcast(levels.agg(F.max("t").alias("last")))  # one row
    return inside.join(last, F.col("t") == F.col("last")).groupBy("y", "x").agg(F.max_by("value", rank).cast("double").alias("value"))


def last_frame(cells: DataFrame, keys: tuple[str, ...] = ("y", "x")) -> DataFrame:
    """Each cell's value at its last time; an aggregate, combined before the shuffle."""
    return cells.groupBy(*keys).agg(F.max_by("value", "t").alias("value"))
