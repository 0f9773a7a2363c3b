"""Coarser and finer grids: block reductions, replication, interpolating zooms, joins to other frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REDUCTIONS = {"min": F.min, "max": F.max, "mean": F.avg}


def block_reduce(cells: DataFrame, k: int, height: int, width: int, op: str = "mean", keys: tuple[str, ...] = ()) -> DataFrame:
    """One cell of each k x k block; trailing partial blocks are dropped.

    A block with a missing cell is missing, as NaN is in arrays. Partial
    aggregation happens before the one shuffle. Operations other than min and
    max are means.
    """
    if k < 1:
        raise ValueError("the factor must be 1 or more")
    inside = (F.col("y") < height // k * k) & (F.col("x") < width // k * k)
    reduce = REDUCTIONS.get(op, F.avg)(F.col("value").cast("double"))
    blocks = cells.where(inside).groupBy(*keys, F.expr(f"y div {k}").cast("int").alias("y"), F.expr(f"x div {k}").cast("int").alias("x"))
    return blocks.agg(F.when(F.count("value") == k * k, reduce).alias("value"))


def consumed(fraction: DataFrame, k: int, height: int, width: int) -> DataFrame:
    """1 - block mean: what is gone of a remaining fraction."""
    return block_reduce(fraction, k, height, width).withColumn("value", 1 - F.col("value"))


def replicate(cells: DataFrame, k: int) -> DataFrame:
    """Each cell as k x k cells; rows multiply in place, without a shuffle."""
    steps = F.sequence(F.lit(0), F.lit(k - 1))
    down = cells.withColumn("i", F.explode(steps)).withColumn("j", F.explode(steps))
    return down.withColumns({"y": (F.col("y") * k + F.col("i")).cast("int"), "x": (F.col("x") * k + F.col("j")).cast("int")}).drop("i", "j")


def _axis(n_in: int, n_out: int, order: int) -> Column:
    """For each output index of an axis: (input index, weight)s, corners aligned."""
    # multiplied first, so that corners and other whole coordinates come out whole
    at = lambda i: i.cast("double") * (n_in - 1) / max(n_out - 1, 1)
    if order == 0:
        taps = lambda i: F.array(F.struct(F.floor(at(i) + 0.5).cast("int").alias("from"), F.lit(1.0).alias("w"), i.alias("to")))
    else:
        low = lambda i: F.least(F.floor(at(i)), F.lit(max(n_in - 2, 0))).cast("int")
        taps = lambda i: F.array(
            F.struct(low(i).alias("from"), (1 - (at(i) - low(i))).alias("w"), i.alias("to")),
            F.struct((low(i) + 1).alias("from"), (at(i) - low(i)).alias("w"), i.alias("to")),
        )
    return F.filter(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(n_out - 1)), taps)), lambda p: p["w"] > 0)


def zoom(cells: DataFrame, ratio: float, height: int, width: int, order: int = 1, keys: tuple[str, ...] = ()) -> DataFrame:
    """Interpolate to round(n * ratio) cells an axis; order 1 is bilinear, 0 nearest.

    Corners map to corners. Axes are independent, so rows are zoomed and then
    columns: each pass sends a cell to the few outputs that weigh it, and sums.
    An output that weighs a missing cell is missing.
    """
    if ratio <= 0:
        raise ValueError("the ratio must be positive")
    if abs(ratio - 1) < 1e-9:
        return cells
    sizes = {"y": (height, round(height * ratio)), "x": (width, round(width * ratio))}
    spark, out = cells.sparkSession, cells.withColumn("value", F.col("value").cast("double"))
    for axis, (n_in, n_out) in sizes.items():
        taps = spark.range(1).select(F.inline(_axis(n_in, n_out, order)))
        need = taps.groupBy("to").agg(F.count(F.lit(1)).alias("need"))
        taps = F.broadcast(taps.join(need, "to"))  # two rows for each output index of one axis
        other = "x" if axis == "y" else "y"
        met = out.join(taps, F.col(axis) == F.col("from"))
        summed = met.groupBy(*keys, other, F.col("to").alias(axis)).agg(
            F.sum(F.col("value") * F.col("w")).alias("value"), F.count("value").alias("have"), F.first("need").alias("need")
        )
        out = summed.withColumn("value", F.when(F.col("have") == F.col("need"), F.col("value"))).drop("have", "need")
    return out.select(*keys, "y", "x", "value")


def resample(cells: DataFrame, src_m: float, dst_m: float, height: int, width: int, method: str = "bilinear", keys: tuple[str, ...] = ()) -> DataFrame:
    """To a pixel of ``dst_m``: bilinear, nearest, or mean (blocks for whole factors, else bilinear)."""
    if src_m <= 0 or dst_m <= 0:
        raise ValueError("pixel sizes must be positive")
    if method not in ("bilinear", "nearest", "mean"):
        raise ValueError(f"no such method: {method}")
    ratio = src_m / dst_m
    if abs(ratio - 1) < 1e-9:
        return cells
    factor = round(dst_m / src_m)
    if method == "mean" and factor >= 2 and abs(dst_m / src_m - factor) < 1e-9:
        return block_reduce(cells, factor, height, width, "mean", keys)
    return zoom(cells, ratio, height, width, 0 if method == "nearest" else 1, keys)


def nearest_cells(targets: DataFrame, raster: DataFrame, px: Column, py: Column, x0: float, y1: float, pixel: float) -> DataFrame:
    """Targets with the raster cell that holds their point; points outside get NULL.

    ``raster``: row, col, value. An equi-join on the computed row and column.
    """
    at = targets.withColumns({"row": F.floor((F.lit(y1) - py) / pixel).cast("int"), "col": F.floor((px - x0) / pixel).cast("int")})
    return at.join(raster.select("row", "col", "value"), ["row", "col"], "left").drop("row", "col")


def bilinear_nodes(targets: DataFrame, nodes: DataFrame, lon: Column, lat: Column, lon0: float, lat0: float, step: float, values: tuple[str, ...], keys: tuple[str, ...] = ("time",)) -> DataFrame:
    """Values of a regular node grid at points, linear along both axes.

    ``nodes``: keys, i (index of latitude, ascending from ``lat0``), j (of
    longitude from ``lon0``), values. Each target meets its four nodes in an
    equi-join; a target that lacks one is missing. ``targets`` need y and x.
    """
    fi, fj = (lat - lat0) / step, (lon - lon0) / step
    i, j = F.floor(fi).cast("int"), F.floor(fj).cast("int")
    corners = F.array(*[
        F.struct((i + di).alias("i"), (j + dj).alias("j"), ((fi - i if di else 1 - (fi - i)) * (fj - j if dj else 1 - (fj - j))).alias("w"))
        for di in (0, 1) for dj in (0, 1)
    ])
    taps = targets.select("y", "x", F.inline(F.filter(corners, lambda c: c["w"] > 0)))
    need = F.sum("w")
    met = taps.join(nodes, ["i", "j"])
    sums = met.groupBy(*keys, "y", "x").agg(need.alias("w"), *[F.sum(F.col(v) * F.col("w")).alias(v) for v in values], *[F.count(v).alias(f"n_{v}") for v in values], F.count(F.lit(1)).alias("n"))
    whole = F.col("w") > 1 - 1e-9
    return sums.select(*keys, "y", "x", *[F.when(whole & (F.col(f"n_{v}") == F.col("n")), F.col(v)).alias(v) for v in values])
