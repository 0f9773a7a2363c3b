"""Declared inputs of a model or analysis: found, made if need be, and read."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame

from gridloom.model import Request, VarSpec
from gridloom.operators import regrid, temporal
from gridloom.plans.contracts import ProducerRegistry, as_registry


@dataclass(frozen=True)
class DataNeed:
    name: str
    kind: str = ""
    max_native_res_m: float | None = None
    required: bool = True
    dtype: str = "float"
    units: str = ""
    description: str = ""

    def spec(self) -> VarSpec:
        return VarSpec(self.name, self.kind, self.dtype, self.units, description=self.description, max_native_res_m=self.max_native_res_m, required=self.required)


class NoDataAvailable(RuntimeError):
    def __init__(self, name: str, request: Request | None, reason: str):
        window = f" for {request.t_start} to {request.t_end}" if request and request.t_start else ""
        super().__init__(f"no data for {name}{window}: {reason}")
        self.name, self.reason = name, reason


class DataAdapter:
    def __init__(self, needs: Sequence[DataNeed | VarSpec | str]):
        as_need = lambda n: n if isinstance(n, DataNeed) else DataNeed(n) if isinstance(n, str) else DataNeed(n.name, n.kind, n.max_native_res_m, n.required, n.dtype, n.units, n.description)
        self.needs = tuple(map(as_need, needs))
        if len({n.name for n in self.needs}) < len(self.needs):
            raise ValueError("a name is needed twice")

    def names(self) -> tuple[str, ...]:
        return tuple(n.name for n in self.needs)

    def varspecs(self) -> tuple[VarSpec, ...]:
        return tuple(n.spec() for n in self.needs)

    def need(self, name: str) -> DataNeed:
        for n in self.needs:
            if n.name == name:
                return n
        raise KeyError(f"{name} isn't needed here")

    def search(self, cube) -> dict[str, dict[str, Any]]:
        """By name: present, resolution_ok and native_res_m."""
        out = {}
        for n in self.needs:
            present = cube.catalog.variable(n.name) is not None
            res = cube.catalog.native_resolution(n.name) if present else None
            fine = present and (n.max_native_res_m is None or (res is not None and res <= n.max_native_res_m))
            out[n.name] = {"present": present, "resolution_ok": fine, "native_res_m": res}
        return out

    def missing(self, cube, request: Request | None = None) -> list[str]:
        """Required names that the cube doesn't satisfy."""
        return [n.name for n in self.needs if n.required and not cube.satisfies(n.spec(), request)]

    def resolve(self, cube, registry: ProducerRegistry | Sequence, request: Request | None = None) -> dict[str, dict[str, Any]]:
        """See that each need is in the cube, running its producer where it isn't.

        By name: satisfied, via ("cube", "producer:<name>" or None), error and
        native_res_m. What is required and can't be had raises NoDataAvailable.
        """
        registry, request, report = as_registry(registry), request or Request(), {}
        for n in self.needs:
            entry: dict[str, Any] = {"satisfied": False, "via": None, "error": None, "native_res_m": None}
            report[n.name] = entry
            cause, via = None, "cube"
            if not cube.satisfies(n.spec(), request):
                if not registry.has_variable(n.name):
                    entry["error"] = "no_producer"
                else:
                    producer = registry.producer_for(n.name)
                    via = f"producer:{producer.name}"
                    try:
                        producer.run(cube, request)
                    except Exception as error:
                        entry["error"], cause = f"producer_failed: {error}", error
                    else:
                        if not cube.satisfies(n.spec(), request):
                            entry["error"] = "producer_ran_but_not_satisfied"
            if entry["error"] is None:
                entry |= {"satisfied": True, "via": via, "native_res_m": cube.catalog.native_resolution(n.name)}
            elif n.required:
                raise NoDataAvailable(n.name, request, entry["error"]) from cause
        return report

    def fetch(self, cube, request: Request | None = None, *, target_pixel_m: float | None = None, target_times: Sequence[datetime] | None = None, spatial_method: str = "bilinear", temporal_method: str = "linear") -> dict[str, DataFrame | None]:
        """Lazy frames by name; None where an optional need is absent.

        Time variables are read within the request's window, taken to
        ``target_times``, and then to ``target_pixel_m`` from the grid's pixel.
        """
        request, out = request or Request(), {}
        for n in self.needs:
            row = cube.catalog.variable(n.name)
            if row is None:
                if n.required:
                    raise NoDataAvailable(n.name, request, "not in the cube")
                out[n.name] = None
                continue
            timed = row.kind == "time"
            windowed = timed and (request.t_start is not None or request.t_end is not None)
            cells = cube.read_window(n.name, request.t_start, request.t_end) if windowed else cube.read(n.name)
            if timed and target_times is not None:
                cells = temporal.interpolate(cells, list(target_times), temporal_method)
            if target_pixel_m is not None:
                cells = regrid.resample(cells, cube.grid.pixel_m, target_pixel_m, *cube.grid.shape, spatial_method, ("t",) if timed else ())
            out[n.name] = cells
        return out
