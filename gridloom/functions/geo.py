"""UTM by the Krueger series, for columns and for numbers.

The series in the third flattening to the sixth order is exact to well below a
millimetre within a zone (Karney, Transverse Mercator with an accuracy of a few
nanometers, 2011). The same formulas serve both kinds of argument; ``Numbers``
and ``Columns`` supply the functions they need.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS 84 and UTM.
A, FLATTENING, SCALE, EASTING, NORTHING = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0, 10000000.0
_N = FLATTENING / (2 - FLATTENING)
_E = math.sqrt(FLATTENING * (2 - FLATTENING))
_RADIUS = A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64 + _N**6 / 256)


def _series(*rows: tuple[float, ...]) -> list[float]:
    """Row k holds the coefficients of n^(k+1), n^(k+2), ..."""
    return [sum(c * _N ** (k + 1 + i) for i, c in enumerate(row)) for k, row in enumerate(rows)]


# Krueger's coefficients, forward (alpha) and inverse (beta).
_ALPHA = _series(
    (1 / 2, -2 / 3, 5 / 16, 41 / 180, -127 / 288, 7891 / 37800),
    (13 / 48, -3 / 5, 557 / 1440, 281 / 630, -1983433 / 1935360),
    (61 / 240, -103 / 140, 15061 / 26880, 167603 / 181440),
    (49561 / 161280, -179 / 168, 6601661 / 7257600),
    (34729 / 80640, -3418889 / 1995840),
    (212378941 / 319334400,),
)
_BETA = _series(
    (1 / 2, -2 / 3, 37 / 96, -1 / 360, -81 / 512, 96199 / 604800),
    (1 / 48, 1 / 15, -437 / 1440, 46 / 105, -1118711 / 3870720),
    (17 / 480, -37 / 840, -209 / 4480, 5569 / 90720),
    (4397 / 161280, -11 / 504, -830251 / 7257600),
    (4583 / 161280, -108847 / 3991680),
    (20648693 / 638668800,),
)

# The series from conformal to geographic latitude.
_DELTA = _series(
    (2, -2 / 3, -2, 116 / 45, 26 / 45, -2854 / 675),
    (7 / 3, -8 / 5, -227 / 45, 2704 / 315, 2323 / 945),
    (56 / 15, -136 / 35, -1262 / 105, 73814 / 2835),
    (4279 / 630, -332 / 35, -399572 / 14175),
    (4174 / 315, -144838 / 6237),
    (601676 / 22275,),
)


def utm_zone(lon: float) -> int:
    return int((lon + 180) / 6) + 1


def utm_epsg(lon: float, lat: float) -> int:
    """32601-32660 north of the equator and on it, 32701-32760 south of it."""
    return (32600 if lat >= 0 else 32700) + utm_zone(lon)


def _frame(epsg: int) -> tuple[float, float]:
    """Central meridian in degrees and false northing."""
    south, zone = divmod(epsg - 32600, 100)
    if south not in (0, 1) or not 1 <= zone <= 60:
        raise ValueError(f"EPSG {epsg} is no UTM zone on WGS 84")
    return zone * 6 - 183.0, NORTHING * south


def _forward(lon, lat, epsg: int, m):
    meridian, north = _frame(epsg)
    phi, lam = lat * (math.pi / 180), (lon - meridian) * (math.pi / 180)
    sine = m.sin(phi)
    tau = m.sinh(m.atanh(sine) - m.atanh(sine * _E) * _E)
    xi, eta = m.atan2(tau, m.cos(lam)), m.asinh(m.sin(lam) / m.sqrt(tau * tau + m.cos(lam) * m.cos(lam)))
    x, y = eta, xi
    for k, a in enumerate(_ALPHA, 1):
        x = x + m.cos(xi * (2 * k)) * m.sinh(eta * (2 * k)) * a
        y = y + m.sin(xi * (2 * k)) * m.cosh(eta * (2 * k)) * a
    return x * (SCALE * _RADIUS) + EASTING, y * (SCALE * _RADIUS) + north


def _inverse(x, y, epsg: int, m):
    meridian, north = _frame(epsg)
    xi0, eta0 = (y - north) * (1 / (SCALE * _RADIUS)), (x - EASTING) * (1 / (SCALE * _RADIUS))
    xi, eta = xi0, eta0
    for k, b in enumerate(_BETA, 1):
        xi = xi - m.sin(xi0 * (2 * k)) * m.cosh(eta0 * (2 * k)) * b
        eta = eta - m.cos(xi0 * (2 * k)) * m.sinh(eta0 * (2 * k)) * b
    lam = m.atan2(m.sinh(eta), m.cos(xi))
    chi = m.asin(m.sin(xi) / m.cosh(eta))
    phi = chi
    for k, d in enumerate(_DELTA, 1):
        phi = phi + m.sin(chi * (2 * k)) * d
    return lam * (180 / math.pi) + meridian, phi * (180 / math.pi)


class _Columns:
    sin, cos, sinh, cosh, asinh, atanh, asin, atan2, sqrt = map(
        staticmethod, (F.sin, F.cos, F.sinh, F.cosh, F.asinh, F.atanh, F.asin, F.atan2, F.sqrt)
    )


def to_utm(lon: float, lat: float, epsg: int) -> tuple[float, float]:
    return _forward(lon, lat, epsg, math)


def from_utm(x: float, y: float, epsg: int) -> tuple[float, float]:
    return _inverse(x, y, epsg, math)


def utm_columns(lon: Column, lat: Column, epsg: int) -> tuple[Column, Column]:
    """Easting and northing of longitudes and latitudes in degrees."""
    return _forward(lon.cast("double"), lat.cast("double"), epsg, _Columns)


def lonlat_columns(x: Column, y: Column, epsg: int) -> tuple[Column, Column]:
    """Longitude and latitude in degrees of eastings and northings."""
    return _inverse(x.cast("double"), y.cast("double"), epsg, _Columns)


def lon_0_360(lon: Column) -> Column:
    return F.when(lon < 0, lon + 360).otherwise(lon)
