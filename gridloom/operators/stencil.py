"""Neighbourhoods: halos of tiles, and slope and aspect from 3 x 3 cells."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.model import TileSpec


def block(cells: DataFrame, y: tuple[int, int], x: tuple[int, int]) -> DataFrame:
    """Cells of half-open ranges; the filter reaches the scan."""
    return cells.where((F.col("y") >= y[0]) & (F.col("y") < y[1]) & (F.col("x") >= x[0]) & (F.col("x") < x[1]))


def halo_block(cells: DataFrame, tile: TileSpec, halo: int, height: int, width: int) -> DataFrame:
    """A tile's cells and their surroundings, with is_inner telling them apart."""
    outer = tile.with_halo(halo, height, width)
    inner = (F.col("y") >= tile.y[0]) & (F.col("y") < tile.y[1]) & (F.col("x") >= tile.x[0]) & (F.col("x") < tile.x[1])
    return block(cells, outer.y, outer.x).withColumn("is_inner", inner)


def haloed_tiles(cells: DataFrame, size: int, halo: int, height: int, width: int) -> DataFrame:
    """Every tile (ty, tx) with its halo: only cells near an edge are replicated."""
    if halo < 0:
        raise ValueError("halo must not be negative")
    near = lambda c, n: F.sequence(F.greatest(F.lit(0), F.floor((F.col(c) - halo) / size).cast("int")), F.least(F.lit((n - 1) // size), F.floor((F.col(c) + halo) / size).cast("int")))
    out = cells.withColumn("ty", F.explode(near("y", height))).withColumn("tx", F.explode(near("x", width)))
    return out.withColumn("is_inner", (F.expr(f"y div {size}") == F.col("ty")) & (F.expr(f"x div {size}") == F.col("tx")))


def slope_aspect(cells: DataFrame, pixel_m: float) -> DataFrame:
    """Horn's slope and aspect in degrees of a dense (y, x, value) grid.

    Edges are repeated outwards. Two shuffles: neighbours in a row, then rows
    above and below. Aspect is the angle of the fall, anticlockwise from east
    (0) over up (90), and -1 where it is flat. A missing neighbour makes both
    missing.
    """
    row, column = Window.partitionBy("y").orderBy("x"), Window.partitionBy("x").orderBy("y")
    triple = lambda w, c: F.struct(F.lag(c).over(w).alias("before"), F.lead(c).over(w).alias("after"), F.lag(F.lit(1)).over(w).alias("has_before"), F.lead(F.lit(1)).over(w).alias("has_after"))
    edge = lambda t, side, own: F.when(t[f"has_{side}"].isNull(), own).otherwise(t[side])
    value = F.col("value").cast("double")
    across = cells.withColumn("r", triple(row, value))
    across = across.withColumn("line", F.struct(edge(F.col("r"), "before", value).alias("l"), value.alias("m"), edge(F.col("r"), "after", value).alias("r")))
    down = across.withColumn("c", triple(column, F.col("line")))
    up, here, low = edge(F.col("c"), "before", F.col("line")), F.col("line"), edge(F.col("c"), "after", F.col("line"))
    dzdx = ((up["r"] + 2 * here["r"] + low["r"]) - (up["l"] + 2 * here["l"] + low["l"])) / (8 * pixel_m)
    dzdy = ((low["l"] + 2 * low["m"] + low["r"]) - (up["l"] + 2 * up["m"] + up["r"])) / (8 * pixel_m)
    graded = down.select("y", "x", dzdx.alias("dzdx"), dzdy.alias("dzdy"))
    aspect = F.pmod(F.atan2(F.col("dzdy"), -F.col("dzdx")) * (180 / math.pi) + 360, F.lit(360.0))
    flat = (F.col("dzdx") == 0) & (F.col("dzdy") == 0)
    return graded.select(
        "y", "x", F.degrees(F.atan(F.hypot("dzdx", "dzdy"))).alias("slope_deg"), F.when(flat, F.lit(-1.0)).otherwise(aspect).alias("aspect_deg")
    )
