"""Questions to the catalog's tables, as plans over ``variables`` and ``tiles``.

``tiles`` has a row for each variable and step: variable, t (NULL for static
variables), source, native_res_m, version, fetched_at.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.temporal import at


def list_tiles(tiles: DataFrame, variable: str | None = None) -> DataFrame:
    rows = tiles if variable is None else tiles.where(F.col("variable") == variable)
    return rows.orderBy("variable", F.col("t").asc_nulls_first())


def list_times(tiles: DataFrame, variable: str) -> DataFrame:
    return tiles.where((F.col("variable") == variable) & F.col("t").isNotNull()).select("t").orderBy("t")


def holds(tiles: DataFrame, variable: str, t: datetime | None = None) -> DataFrame:
    """At most one row where the step is there; without ``t``, where a static tile is."""
    step = F.col("t").isNull() if t is None else F.col("t") == at(t)
    return tiles.where((F.col("variable") == variable) & step).limit(1)


def native_resolution(tiles: DataFrame) -> DataFrame:
    """The coarsest resolution of each variable."""
    return tiles.groupBy("variable").agg(F.max("native_res_m").alias("native_res_m"))


def latest_version(tiles: DataFrame) -> DataFrame:
    return tiles.groupBy("variable").agg(F.coalesce(F.max("version"), F.lit(0)).alias("version"))


def is_stale(tiles: DataFrame, output: str, inputs: Sequence[str]) -> DataFrame:
    """One row ``stale``: was an input fetched after the output? False where either is absent."""
    newest = lambda rows: F.max(F.when(rows, F.col("fetched_at")))
    of_inputs = F.col("variable").isin(list(inputs)) if inputs else F.lit(False)
    both = tiles.agg(newest(of_inputs).alias("inputs"), newest(F.col("variable") == output).alias("output"))
    return both.select(F.coalesce(F.col("inputs") > F.col("output"), F.lit(False)).alias("stale"))


def satisfied(specs: DataFrame, variables: DataFrame, tiles: DataFrame, t_start: datetime | None = None, t_end: datetime | None = None) -> DataFrame:
    """``specs`` (name, kind, max_native_res_m) with ``satisfied``.

    The variable must be known, of the kind (if one is given), and nowhere
    coarser than the cap. A static one needs its tile. A time variable needs
    steps; with a start alone, that very step; with both ends, steps from the
    start on to the date that the end, exclusive, reaches. Gaps aren't looked at.
    """
    held = tiles.groupBy("variable").agg(
        F.count_if(F.col("t").isNull()).alias("n_static"), F.min("t").alias("first"), F.max("t").alias("last"), F.max("native_res_m").alias("coarsest"),
        (F.count_if(F.col("t") == at(t_start)) if t_start is not None else F.lit(0)).alias("n_start"),
    )
    known = variables.select(F.col("name").alias("variable"), F.col("kind").alias("own_kind"))
    rows = specs.join(F.broadcast(known), specs.name == known.variable, "left").join(F.broadcast(held), "variable", "left")
    kind_ok = F.col("kind").isNull() | (F.col("kind") == F.col("own_kind"))
    fine = F.col("max_native_res_m").isNull() | (F.col("coarsest") <= F.col("max_native_res_m"))
    timed: Column = F.col("first").isNotNull()
    if t_start is not None and t_end is None:
        timed = F.col("n_start") > 0
    elif t_start is not None:
        last_day = F.lit((t_end - timedelta(microseconds=1)).date())
        timed = timed & (F.col("first") <= at(t_start)) & (F.to_date("last") >= last_day)
    present = F.when(F.col("own_kind") == "static", F.col("n_static") > 0).when(F.col("own_kind") == "time", timed).otherwise(F.lit(False))
    return rows.select(*specs.columns, F.coalesce(F.col("variable").isNotNull() & kind_ok & fine & present, F.lit(False)).alias("satisfied"))


def missing_steps(incoming: DataFrame, tiles: DataFrame) -> DataFrame:
    """Rows of ``incoming`` (variable, t, ...) whose step the catalog lacks."""
    known = tiles.where("t is not null").select("variable", "t")
    return incoming.join(known, ["variable", "t"], "left_anti")


def upserted(table: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``table`` with ``rows`` instead of those of the same keys; NULL keys are equal."""
    match = None
    for k in keys:
        one = table[k].eqNullSafe(rows[k])
        match = one if match is None else match & one
    return table.join(rows, match, "left_anti").unionByName(rows.select(*table.columns))


def latest_checkpoints(checkpoints: DataFrame) -> DataFrame:
    newest = Window.partitionBy("producer").orderBy(F.col("step_id").desc())
    return checkpoints.withColumn("rn", F.row_number().over(newest)).where("rn = 1").drop("rn")


def first_hits(assets: DataFrame) -> DataFrame:
    """Of assets (variable, source, priority, seq) each variable's from its best source."""
    best = Window.partitionBy("variable").orderBy(F.col("priority").desc(), "seq")
    return assets.withColumn("rn", F.row_number().over(best)).where("rn = 1").drop("rn")


def latency_summary(metrics: DataFrame) -> DataFrame:
    """Of tile metrics (producer, elapsed, ok): tiles, min, exact median, max, total, errors."""
    return metrics.groupBy("producer").agg(
        F.count(F.lit(1)).alias("tiles"), F.min("elapsed").alias("min_s"), F.percentile("elapsed", 0.5).alias("median_s"),
        F.max("elapsed").alias("max_s"), F.sum("elapsed").alias("total_s"), F.count_if(~F.col("ok")).alias("errors"),
    )


def run_summary(steps: DataFrame) -> DataFrame:
    """Of steps (run_id, status, elapsed): counts by status, total time, ok."""
    count = lambda s: F.count_if(F.col("status") == s).alias(f"n_{s}")
    return steps.groupBy("run_id").agg(count("ok"), count("skipped"), count("error"), F.sum("elapsed").alias("total_s"), F.bool_and(F.col("status") != "error").alias("ok"))


def running_total(entries: DataFrame, order: str, value: str, span: int = 4096) -> DataFrame:
    """``running``: the sum up to each row, by a whole-number order, in two levels.

    Rows are summed within spans of the order, and spans before each other, so
    no task holds all rows.
    """
    cut = entries.withColumn("span", F.floor(F.col(order) / span))
    within = Window.partitionBy("span").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = cut.groupBy("span").agg(F.sum(value).alias("total"))
    heads = spans.withColumn("head", F.coalesce(F.sum("total").over(before), F.lit(0))).drop("total")
    own = cut.withColumn("own", F.sum(value).over(within))
    return own.join(heads, "span").withColumn("running", F.col("head") + F.col("own")).drop("span", "own", "head")


def evictions(entries: DataFrame, target_bytes: int, order: str = "atime", size: str = "size") -> DataFrame:
    """Entries that go, the least recently used first, until the rest fits ``target_bytes``."""
    total = entries.agg(F.sum(size).alias("all_bytes"))
    rows = running_total(entries, order, size).join(F.broadcast(total))
    return rows.where(F.col("all_bytes") - (F.col("running") - F.col(size)) > target_bytes).drop("all_bytes", "running")
