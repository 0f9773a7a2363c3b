"""Values that describe grids, variables, requests and operator nodes.

Cells are rows: a static variable is (y, x, value), a time variable is
(t, y, x, value) with ``t`` a TIMESTAMP_NTZ. A missing value is NULL. Row 0 is
the top of the grid, so northing falls as ``y`` rises.
"""

from __future__ import annotations

import enum
import json
from dataclasses import asdict, dataclass, field, replace
from datetime import datetime
from math import ceil, floor
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.geo import to_utm, utm_epsg

KINDS = ("static", "time")


@dataclass(frozen=True)
class Grid:
    """A projected frame that every variable lies on."""

    crs_epsg: int
    pixel_m: float
    width: int
    height: int
    x0: float
    y1: float

    def __post_init__(self):
        if self.pixel_m <= 0 or self.width <= 0 or self.height <= 0:
            raise ValueError("a grid needs a positive pixel, width and height")

    @classmethod
    def around(cls, lon: float, lat: float, radius_m: float, pixel_m: float) -> Grid:
        """The UTM grid that covers a radius, snapped outwards to whole pixels."""
        epsg = utm_epsg(lon, lat)
        cx, cy = to_utm(lon, lat, epsg)
        snap = lambda edge, v: edge(v / pixel_m) * pixel_m
        x0, x1 = snap(floor, cx - radius_m), snap(ceil, cx + radius_m)
        y0, y1 = snap(floor, cy - radius_m), snap(ceil, cy + radius_m)
        return cls(epsg, pixel_m, int((x1 - x0) / pixel_m), int((y1 - y0) / pixel_m), x0, y1)

    @property
    def shape(self) -> tuple[int, int]:
        return self.height, self.width

    @property
    def bounds(self) -> tuple[float, float, float, float]:
        """left, bottom, right, top."""
        return self.x0, self.y1 - self.height * self.pixel_m, self.x0 + self.width * self.pixel_m, self.y1

    @property
    def affine(self) -> tuple[float, float, float, float, float, float]:
        """(a, b, c, d, e, f) of x = a col + b row + c, y = d col + e row + f."""
        return self.pixel_m, 0.0, self.x0, 0.0, -self.pixel_m, self.y1

    def cells(self, spark: SparkSession) -> DataFrame:
        """(y, x, cx, cy) of every cell; rows are generated on the executors."""
        n = spark.range(self.width * self.height)
        at = n.select((F.col("id") / self.width).cast("int").alias("y"), (F.col("id") % self.width).cast("int").alias("x"))
        p = self.pixel_m
        return at.withColumns({"cx": self.x0 + (F.col("x") + 0.5) * p, "cy": self.y1 - (F.col("y") + 0.5) * p})

    def save(self, path: str | Path) -> None:
        Path(path).write_text(json.dumps(asdict(self), indent=2))

    @classmethod
    def load(cls, path: str | Path) -> Grid:
        return cls(**json.loads(Path(path).read_text()))


class MergePolicy(str, enum.Enum):
    """What a cell holds after a write meets one that is there."""

    LAST_WRITER = "last_writer"
    MONOTONE_MIN = "monotone_min"
    MONOTONE_MAX = "monotone_max"
    ACCUMULATE = "accumulate"
    UNION = "union"


@dataclass(frozen=True)
class VarSpec:
    """A variable that a node declares to need or make."""

    name: str
    kind: str = "static"
    dtype: str = "float"
    units: str = ""
    merge_policy: MergePolicy = MergePolicy.LAST_WRITER
    description: str = ""
    max_native_res_m: float | None = None
    required: bool = True

    def __post_init__(self):
        if self.kind and self.kind not in KINDS:
            raise ValueError(f"kind must be one of {KINDS}")


@dataclass(frozen=True)
class CostHint:
    cpu: float = 1.0
    memory_mb: float = 0.0
    io_mb: float = 0.0


@dataclass(frozen=True)
class Capabilities:
    """What a producer tells the planner; hints only, but for their checks."""

    halo_cells: int = 0
    tile_parallel: bool = False
    boundary_coupled: bool = False
    iterative: bool = False
    requires_barrier: bool = False
    cost_hint: CostHint = field(default_factory=CostHint)
    memory_budget_mb: float | None = None

    def __post_init__(self):
        if self.halo_cells < 0:
            raise ValueError("halo_cells must not be negative")
        if self.boundary_coupled and not self.halo_cells:
            raise ValueError("a boundary-coupled producer needs halo cells")
        if self.memory_budget_mb is not None and self.memory_budget_mb < 0:
            raise ValueError("memory_budget_mb must not be negative")


@dataclass(frozen=True)
class TileSpec:
    """Half-open ranges of rows, columns and, for time variables, steps."""

    y: tuple[int, int]
    x: tuple[int, int]
    t: tuple[int, int] | None = None
    halo: int = 0

    @property
    def shape(self) -> tuple[int, int]:
        return self.y[1] - self.y[0], self.x[1] - self.x[0]

    def with_halo(self, halo: int, height: int, width: int) -> TileSpec:
        """The tile grown by ``halo`` cells and clipped to the grid."""
        if halo < 0:
            raise ValueError("halo must not be negative")
        if not halo:
            return self
        y = max(0, self.y[0] - halo), min(height, self.y[1] + halo)
        x = max(0, self.x[0] - halo), min(width, self.x[1] + halo)
        return replace(self, y=y, x=x, halo=0)


def tiles_of(height: int, width: int, size: int) -> list[TileSpec]:
    """Tiles in row-major order; the last of a row or column may be smaller."""
    if size <= 0:
        raise ValueError("a tile's size must be positive")
    spans = lambda n: [(a, min(a + size, n)) for a in range(0, n, size)]
    return [TileSpec(y, x) for y in spans(height) for x in spans(width)]


@dataclass(frozen=True)
class Request:
    """The window and options of one run or fetch."""

    t_start: datetime | None = None
    t_end: datetime | None = None
    force: bool = False
    tile: TileSpec | None = None
    context: dict[str, Any] = field(default_factory=dict)

    @property
    def n_days(self) -> int:
        """Days between the dates of both ends, 1 at least; a request without a window has none."""
        if self.t_start is None or self.t_end is None:
            raise ValueError("a request without both ends has no number of days")
        return max(1, (self.t_end.date() - self.t_start.date()).days)
