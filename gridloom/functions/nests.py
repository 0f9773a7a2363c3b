"""Nested model domains and calendar fields, as configuration-sized arithmetic.

Halves round to even, as the published namelists do.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, datetime, timedelta
from math import cos, radians


@dataclass(frozen=True)
class Nest:
    level: int
    dx_m: float
    e_we: int
    parent_id: int
    ratio: int
    i_start: int

    @property
    def cells(self) -> int:
        return self.e_we - 1


def solve_nests(extent_km: float, resolutions_m: Sequence[float], fraction: float = 0.5) -> list[Nest]:
    """Domains from coarse to fine; each covers ``fraction`` of its parent, centred.

    Whole ratios of 2 or more are required between neighbours.
    """
    if not resolutions_m:
        raise ValueError("at least one resolution is needed")
    n = max(20, round(extent_km * 1000 / resolutions_m[0]))
    out = [Nest(1, resolutions_m[0], n + 1, 1, 1, 1)]
    for coarse, fine in zip(resolutions_m, resolutions_m[1:]):
        ratio = round(coarse / fine)
        if ratio < 2 or abs(coarse / fine - ratio) > 1e-6:
            raise ValueError(f"{coarse} m is no whole multiple of {fine} m by 2 or more")
        parent = out[-1]
        held = max(4, round(fraction * parent.cells))
        out.append(Nest(parent.level + 1, fine, held * ratio + 1, parent.level, ratio, max(1, (parent.cells - held) // 2 + 1)))
    return out


def time_step(dx_m: float) -> int:
    return max(1, round(6 * dx_m / 1000))


def bounding_box(lon: float, lat: float, half_km: float, pad_deg: float = 0.0) -> tuple[float, float, float, float]:
    """North, west, south, east, rounded to hundredths of a degree."""
    dlat = half_km / 111.0 + pad_deg
    dlon = half_km / (111.0 * cos(radians(lat))) + pad_deg
    return tuple(round(v, 2) for v in (lat + dlat, lon - dlon, lat - dlat, lon + dlon))


def days_between(first: date, last: date) -> list[date]:
    return [first + timedelta(days=k) for k in range((last - first).days + 1)]


def calendar_fields(prefix: str, t: datetime) -> dict[str, int]:
    return {f"{prefix}_{k}": getattr(t, k) for k in ("year", "month", "day", "hour", "minute", "second")}
