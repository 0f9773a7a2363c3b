"""Scalar formulas over cell values, all inside generated code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The cell value of a point that is never reached, and what counts as one.
NEVER, REACHED = 1e9, 0.99e9
#: Burnable fuel categories and the one that doesn't burn.
FUELS, NO_FUEL = (1, 13), 14


def wind_speed(u: Column, v: Column) -> Column:
    return F.hypot(u, v)


def wind_direction(u: Column, v: Column) -> Column:
    """Degrees that the wind comes from, clockwise from north, 0 to 360."""
    return F.pmod(F.lit(270.0) - F.degrees(F.atan2(v, u)), F.lit(360.0))


def wind_vector(speed: Column, direction: Column) -> tuple[Column, Column]:
    return -speed * F.sin(F.radians(direction)), -speed * F.cos(F.radians(direction))


def fuel_category(code: Column) -> Column:
    """Codes of burnable fuels as they are, all others as no fuel."""
    return F.when(code.between(*FUELS), code).otherwise(F.lit(NO_FUEL))


def last_ignition(t0: Column) -> Column:
    """An aggregate: a second after the last ignition, 1 where there is none."""
    return F.coalesce(F.max(F.when(~F.isnan(t0) & (t0 >= 0), t0)), F.lit(0.0)) + 1.0


def gated_ignition(t0: Column, fuel: Column, until: Column) -> Column:
    """Ignition before ``until`` where there is fuel, else NEVER."""
    burns = t0.isNotNull() & ~F.isnan(t0) & (t0 >= 0) & fuel.between(*FUELS)
    return F.when(burns, F.least(t0, until - 0.1)).otherwise(F.lit(NEVER))


def arrival(value: Column) -> Column:
    """A model's arrival time, NULL where it never came."""
    return F.when(value > REACHED, F.lit(None).cast("double")).otherwise(value)


def fluence(radius: Column, rings: Sequence[tuple[float, float]]) -> Column:
    """Fluence at a distance, log-linear between rings of (radius, fluence).

    Within the innermost ring it is that ring's; beyond the outermost the last
    slope goes on. At least two rings with different radii are needed.
    """
    rings = sorted(rings)
    if len(rings) < 2:
        raise ValueError("fluence needs two rings at least")

    def between(a: tuple[float, float], b: tuple[float, float]) -> Column:
        low, high = F.log(F.lit(float(a[1]))), F.log(F.lit(float(b[1])))
        return F.exp(low + (high - low) * (radius - a[0]) / (b[0] - a[0]))

    out = F.when(radius <= rings[0][0], F.lit(float(rings[0][1])))
    for a, b in zip(rings, rings[1:-1]):
        out = out.when(radius <= b[0], between(a, b))
    return out.otherwise(between(rings[-2], rings[-1]))


def thermal_power(fluence_mj: Column, pulse_s: float) -> Column:
    """kW/m2 of a pulse of MJ/m2."""
    return fluence_mj * 1000.0 / pulse_s


def burning_annulus(fluence_mj: Column, low: float = 0.84, high: float = 1.20) -> Column:
    """0.0 from the critical fluence up to the unsurvivable one, else NULL."""
    return F.when((fluence_mj >= low) & (fluence_mj < high), F.lit(0.0))


def burnable(fluence_mj: Column, high: float = 1.20) -> Column:
    return (fluence_mj < high).cast("byte")


def filled(cells: DataFrame) -> DataFrame:
    """Elevations with bad ones (null, not finite, beyond 1e6) as the mean of good ones, 0 where none is good.

    The mean is one aggregate row, sent to all; no window holds the whole grid.
    """
    value = F.col("value").cast("double")
    good = F.when(value.isNotNull() & ~F.isnan(value) & (F.abs(value) <= 1e6), value)
    mean = F.broadcast(cells.agg(F.avg(good).alias("mean_of_good")))
    return cells.join(mean).withColumn("value", F.coalesce(good, "mean_of_good", F.lit(0.0))).drop("mean_of_good")


def cfl_step(dx_m: Column) -> Column:
    """Seconds of a model's time step: 6 for each km, 1 at least; halves round to even."""
    return F.greatest(F.lit(1), F.bround(6.0 * dx_m / 1000.0, 0).cast("int"))


def text_key(text: Column) -> Column:
    """A name without case and runs of white space."""
    return F.lower(F.regexp_replace(F.trim(F.regexp_replace(text, r"\s+", " ")), r"\s+", " "))


def safe_label(text: Column) -> Column:
    return F.regexp_replace(text, r"[^A-Za-z0-9\-_.]", "_")
