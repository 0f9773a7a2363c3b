"""Scenario settings of a nested atmosphere and fire model, and its namelists."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta
from pathlib import Path

from gridloom.functions.nests import Nest, solve_nests, time_step
from gridloom.plans.model_adapter import namelist
from gridloom.sources.config import load_config

# The model's codes for smoke tracers, and its time format.
SMOKE = {"chem_opt": 17, "emiss_opt": 5, "tracer_opt": 0}
STAMP = "%Y-%m-%d_%H:%M:%S"


@dataclass(frozen=True)
class Scenario:
    center_lon: float
    center_lat: float
    start: datetime
    nests: tuple[Nest, ...]
    duration_days: float = 30.0
    fire_mesh_ratio: int = 10
    fire_level: int | None = None  # the nest with the fire mesh; else the last
    smoke: bool = False
    interval_s: int = 21_600

    def __post_init__(self):
        if not self.nests:
            raise ValueError("a scenario needs a domain")

    @property
    def end(self) -> datetime:
        return self.start + timedelta(days=self.duration_days)

    @property
    def max_dom(self) -> int:
        return len(self.nests)

    @property
    def fire_domain(self) -> int:
        return self.fire_level if self.fire_level is not None else self.max_dom

    @classmethod
    def load(cls, path: str | Path) -> Scenario:
        """From a file with start, center (lon, lat), extent_km, resolutions_m and what else differs."""
        c = load_config(path)
        solved = solve_nests(c.pop("extent_km", 1000.0), c.pop("resolutions_m", [9000, 3000, 1000]), c.pop("nest_fraction", 0.5))
        center, start = c.pop("center"), c.pop("start")
        start = start if isinstance(start, datetime) else datetime.fromisoformat(str(start))
        return cls(center["lon"], center["lat"], start, tuple(solved), **c)

    def namelist_input(self) -> str:
        """Time, domains, fire on its own domain only, and chemistry only with smoke."""
        times = {f"{end}_{k}": [getattr(t, k)] * self.max_dom for end, t in (("start", self.start), ("end", self.end)) for k in ("year", "month", "day", "hour")}
        fire = [self.fire_mesh_ratio if n.level == self.fire_domain else 0 for n in self.nests]
        of = lambda name: [getattr(n, name) for n in self.nests]
        sections = {
            "time_control": times | {"interval_seconds": self.interval_s},
            "domains": {
                "time_step": time_step(self.nests[0].dx_m), "max_dom": self.max_dom, "e_we": of("e_we"), "e_sn": of("e_we"), "dx": of("dx_m"), "grid_id": of("level"),
                "parent_id": of("parent_id"), "i_parent_start": of("i_start"), "j_parent_start": of("i_start"), "parent_grid_ratio": of("ratio"), "sr_x": fire, "sr_y": fire,
            },
            "fire": {"ifire": [int(r > 0) for r in fire]},
        }
        if self.smoke:
            sections["chem"] = {k: [v] * self.max_dom for k, v in SMOKE.items()}
        return namelist(sections)

    def namelist_preprocessor(self) -> str:
        of = lambda name: [getattr(n, name) for n in self.nests]
        return namelist({
            "share": {"wrf_core": "ARW", "max_dom": self.max_dom, "start_date": [self.start.strftime(STAMP)] * self.max_dom, "end_date": [self.end.strftime(STAMP)] * self.max_dom, "interval_seconds": self.interval_s},
            "geogrid": {
                "parent_id": of("parent_id"), "parent_grid_ratio": of("ratio"), "i_parent_start": of("i_start"), "j_parent_start": of("i_start"), "e_we": of("e_we"), "e_sn": of("e_we"),
                "dx": self.nests[0].dx_m, "dy": self.nests[0].dx_m, "ref_lat": self.center_lat, "ref_lon": self.center_lon,
            },
        })
