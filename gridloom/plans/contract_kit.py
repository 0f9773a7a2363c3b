"""Checks that a producer keeps its contract, for producers' own tests."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import functions as F

from gridloom.model import Request
from gridloom.plans.contracts import names_of, specs_of


@dataclass(frozen=True)
class Finding:
    check: str
    ok: bool
    detail: str = ""


def check_capabilities(producer) -> Finding:
    problems = []
    if not getattr(producer, "name", ""):
        problems.append("no name")
    if not names_of(getattr(producer, "produces", ())):
        problems.append("produces nothing")
    if set(names_of(producer.produces)) & set(names_of(producer.requires)):
        problems.append("needs what it makes")
    if not hasattr(producer, "capabilities"):
        problems.append("no capabilities")
    return Finding("capabilities", not problems, "; ".join(problems))


def check_io_isolation(producer, cube, request: Request) -> Finding:
    """``compute`` writes nothing."""
    before = cube.catalog.state["sequence"]
    producer.compute(producer.extract(cube, request), request)
    return Finding("io_isolation", cube.catalog.state["sequence"] == before, "compute wrote to the cube" * (cube.catalog.state["sequence"] != before))


def differing(a, b, tolerance: float = 0.0) -> int:
    """Cells that differ by more than ``tolerance``; two missing values are equal."""
    keys = [c for c in ("t", "y", "x") if c in a.columns]
    both = a.select(*keys, F.col("value").alias("a"), F.lit(1).alias("in_a")).join(b.select(*keys, F.col("value").alias("b"), F.lit(1).alias("in_b")), keys, "full_outer")
    same = F.col("in_a").eqNullSafe(F.col("in_b")) & (F.col("a").eqNullSafe(F.col("b")) | F.coalesce(F.abs(F.col("a") - F.col("b")) <= tolerance, F.lit(False)))
    return both.where(~same).count()


def check_idempotency(producer, cube, request: Request, tolerance: float = 0.0) -> Finding:
    """Two computations over the same inputs agree."""
    first, second = (producer.compute(producer.extract(cube, request), request) for _ in range(2))
    bad = {n: d for n in first if (d := differing(first[n], second[n], tolerance))}
    return Finding("idempotency", first.keys() == second.keys() and not bad, f"cells differ: {bad}" if bad else "")


def check_producer(producer, cube, request: Request | None = None) -> list[Finding]:
    """All checks, up to the first that fails."""
    request, out = request or Request(), []
    for check in (check_capabilities, lambda p: check_io_isolation(p, cube, request), lambda p: check_idempotency(p, cube, request)):
        out.append(check(producer))
        if not out[-1].ok:
            break
    return out
