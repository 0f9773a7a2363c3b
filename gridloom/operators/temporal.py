"""Time axes: windows, nearest steps, interpolation, coverage."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def at(t: datetime) -> Column:
    return F.lit(t).cast("timestamp_ntz")


def micros(a: Column, b: Column) -> Column:
    """Microseconds from ``a`` to ``b``."""
    return F.timestamp_diff("MICROSECOND", a, b)


def time_window(cells: DataFrame, t_start: datetime | None = None, t_end: datetime | None = None) -> DataFrame:
    """Steps from ``t_start`` to ``t_end``, both included; None leaves a side open."""
    if t_start is not None:
        cells = cells.where(F.col("t") >= at(t_start))
    return cells if t_end is None else cells.where(F.col("t") <= at(t_end))


def nearest_step(cells: DataFrame, t: datetime) -> DataFrame:
    """The cells of the step nearest to ``t``, the earlier one of two as near.

    The step is found from the time column alone and joined back (one row).
    """
    gap = F.abs(micros(F.col("t"), at(t)))
    best = cells.agg(F.min(F.struct(gap.alias("gap"), F.col("t").alias("t")))["t"].alias("t"))
    return cells.join(F.broadcast(best), "t")


def step_index(cells: DataFrame, first: int, last: int) -> DataFrame:
    """Steps by their place on the time axis, half open."""
    steps = cells.select("t").distinct().withColumn("step", F.row_number().over(Window.orderBy("t")) - 1)
    return cells.join(F.broadcast(steps.where((F.col("step") >= first) & (F.col("step") < last)).select("t")), "t")


def _bracketed(cells: DataFrame, times: Sequence[datetime]) -> DataFrame:
    """(y, x, t) of every target with ``before`` and ``after``: structs of the steps around it."""
    steps = cells.select("y", "x", "t", F.struct("t", F.col("value").cast("double").alias("value")).alias("step"), F.lit(False).alias("target"))
    wanted = F.explode(F.array(*[at(t) for t in times]))
    targets = cells.select("y", "x").distinct().select("y", "x", wanted.alias("t"), F.lit(None).alias("step"), F.lit(True).alias("target"))
    # one shuffle by cell; within a cell, steps precede targets of the same time
    order = Window.partitionBy("y", "x").orderBy("t", "target")
    back = order.rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("y", "x").orderBy(F.col("t").desc(), F.col("target")).rowsBetween(Window.unboundedPreceding, 0)
    both = steps.unionByName(targets.withColumn("step", F.col("step").cast(steps.schema["step"].dataType)))
    both = both.withColumn("before", F.last("step", ignorenulls=True).over(back)).withColumn("after", F.last("step", ignorenulls=True).over(ahead))
    return both.where("target").select("t", "y", "x", "before", "after")


def interpolate(cells: DataFrame, times: Sequence[datetime], method: str = "linear") -> DataFrame:
    """Cells at ``times``: linear between the steps around, or the nearest step.

    Before the first and after the last step its value holds. Of two steps as
    near the earlier counts. Steps may come in any order. Linear values between
    a missing and a known step are missing.
    """
    if method not in ("linear", "nearest"):
        raise ValueError(f"no such method: {method}")
    if not times:
        return cells.where(F.lit(False))
    rows = _bracketed(cells, times)
    before, after = F.coalesce("before", "after"), F.coalesce("after", "before")
    gap, part = micros(before["t"], after["t"]), micros(before["t"], F.col("t"))
    if method == "nearest":
        value = F.when(F.abs(micros(F.col("t"), before["t"])) <= F.abs(micros(F.col("t"), after["t"])), before["value"]).otherwise(after["value"])
    else:
        value = F.when(gap == 0, before["value"]).otherwise(before["value"] + (after["value"] - before["value"]) * (part / gap))
    return rows.select("t", "y", "x", value.alias("value"))


def coverage(tiles: DataFrame, t_start: datetime | None = None, t_end: datetime | None = None) -> DataFrame:
    """One row a variable: first, last, in_window (steps in the closed window) and window_covered."""
    t, a, b = F.col("t"), t_start, t_end
    inside = F.lit(True)
    if a is not None:
        inside = inside & (t >= at(a))
    if b is not None:
        inside = inside & (t <= at(b))
    steps = tiles.where("t is not null").groupBy("variable").agg(
        F.min("t").alias("first"), F.max("t").alias("last"), F.count_if(inside).alias("in_window")
    )
    covered = F.lit(True)
    if a is not None:
        covered = covered & (F.col("first") <= at(a))
    if b is not None:
        covered = covered & (F.col("last") >= at(b))
    return steps.withColumn("window_covered", covered)


def hours(t_start: datetime, t_end: datetime) -> tuple[datetime, datetime]:
    """Both ends as whole hours; a second one that isn't after ``t_start`` is moved on by an hour."""
    whole = lambda t: t.replace(minute=0, second=0, microsecond=0)
    first, last = whole(t_start), whole(t_end)
    return first, last if last > t_start else last + timedelta(hours=1)


def require_same_times(a: DataFrame, b: DataFrame) -> None:
    """Refuse two time variables whose steps differ."""
    one, other = a.select("t").distinct(), b.select(F.col("t").alias("u")).distinct()
    if not one.join(other, F.col("t") == F.col("u"), "full_outer").where("t is null or u is null").isEmpty():
        raise ValueError("the variables have different time axes")
