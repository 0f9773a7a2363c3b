"""Every operator of the gridded engine as a query over the star-schema tables, with SQL.

Lifts turn tables into variables: G (static) averages prices of line items into
a square grid; E (time) averages events by day into an 8 x 8 grid, with values
missing for some events where that matters; C takes orders as catalog tiles.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import geo, nests, physics
from gridloom.model import Grid, MergePolicy, TileSpec, tiles_of
from gridloom.operators import catalogs, merge, regrid, stencil, temporal

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
START = datetime(2024, 1, 1)


def query(sql: str | None = None):
    """Register a query under its name, with the SQL that says the same."""

    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _grid(spark: SparkSession, sf_dir: str, n: int = 32, where: str = "true") -> DataFrame:
    items = _table(spark, sf_dir, "lineitem").where(where)
    cell = [(F.col("l_partkey") % n).cast("int").alias("y"), (F.col("l_orderkey") % n).cast("int").alias("x")]
    return items.groupBy(*cell).agg(F.avg("l_extendedprice").alias("value"))


def _dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 32 x 32 grid with every cell; those without line items are missing."""
    cells = Grid(32614, 500.0, 32, 32, 0.0, 16000.0).cells(spark).select("y", "x")
    return cells.join(_grid(spark, sf_dir), ["y", "x"], "left")


def _steps(spark: SparkSession, sf_dir: str, gaps: bool = False) -> DataFrame:
    events = _table(spark, sf_dir, "events")
    value = F.when(F.col("event_id") % 7 != 0, F.col("value")) if gaps else F.col("value")
    t = F.date_trunc("day", "ts").cast("timestamp_ntz").alias("t")
    return events.groupBy(t, (F.col("user_id") % 8).cast("int").alias("y"), (F.col("event_id") % 8).cast("int").alias("x")).agg(F.avg(value).alias("value"))


def _tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("variable"), F.col("o_orderdate").alias("t"), F.col("o_orderstatus").alias("source"),
        F.col("o_totalprice").alias("native_res_m"), F.lit(0).alias("version"), F.col("o_orderdate").alias("fetched_at"),
    )


def _near(c: str | Column, digits: int = 4) -> Column:
    """Rounded, away from ties that the order of a sum decides."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c + 1e-7, digits)


def _stamp(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def G(n: int = 32, where: str = "true") -> str:
    return f"SELECT (l_partkey % {n})::INT AS y, (l_orderkey % {n})::INT AS x, avg(l_extendedprice) AS value FROM lineitem WHERE {where} GROUP BY 1, 2"


DENSE = f"SELECT (i // 32)::INT AS y, (i % 32)::INT AS x, g.value FROM range(1024) t(i) LEFT JOIN ({G()}) g ON g.y = i // 32 AND g.x = i % 32"


def E(gaps: bool = False) -> str:
    value = "CASE WHEN event_id % 7 <> 0 THEN value END" if gaps else "value"
    return f"SELECT date_trunc('day', ts)::TIMESTAMP AS t, (user_id % 8)::INT AS y, (event_id % 8)::INT AS x, avg({value}) AS value FROM events GROUP BY 1, 2, 3"


C = "SELECT o_orderpriority AS variable, o_orderdate AS t, o_orderstatus AS source, o_totalprice AS native_res_m, 0 AS version, o_orderdate AS fetched_at FROM orders"


# Grids ----------------------------------------------------------------------


def _blocks(k: int, op: str) -> str:
    return f"""
    WITH g AS ({G()})
    SELECT (y // {k})::INT AS y, (x // {k})::INT AS x, CASE WHEN count(value) = {k * k} THEN round({op}(value) + 1e-7, 4) END AS value
    FROM g WHERE y < 32 // {k} * {k} AND x < 32 // {k} * {k} GROUP BY 1, 2"""


@query(_blocks(2, "avg"))
def block_mean_2x(spark, sf_dir):
    return regrid.block_reduce(_grid(spark, sf_dir), 2, 32, 32).withColumn("value", _near("value"))


@query(_blocks(2, "min"))
def block_min_2x(spark, sf_dir):
    return regrid.block_reduce(_grid(spark, sf_dir), 2, 32, 32, "min").withColumn("value", _near("value"))


@query(_blocks(4, "max"))
def block_max_4x(spark, sf_dir):
    return regrid.block_reduce(_grid(spark, sf_dir), 4, 32, 32, "max").withColumn("value", _near("value"))


@query(_blocks(5, "avg"))
def block_mean_trailing_dropped(spark, sf_dir):
    return regrid.block_reduce(_grid(spark, sf_dir), 5, 32, 32).withColumn("value", _near("value"))


@query(f"""
    WITH g AS (SELECT y, x, value / 100000 AS value FROM ({G()}))
    SELECT (y // 4)::INT AS y, (x // 4)::INT AS x, CASE WHEN count(value) = 16 THEN round(1 - avg(value) + 1e-7, 6) END AS value FROM g GROUP BY 1, 2""")
def fuel_consumed(spark, sf_dir):
    fraction = _grid(spark, sf_dir).withColumn("value", F.col("value") / 100000)
    return regrid.consumed(fraction, 4, 32, 32).withColumn("value", _near("value", 6))


@query(f"WITH g AS ({G()}) SELECT (y * 2 + i)::INT AS y, (x * 2 + j)::INT AS x, round(value + 1e-7, 4) AS value FROM g, range(2) a(i), range(2) b(j)")
def block_replicate_2x(spark, sf_dir):
    return regrid.replicate(_grid(spark, sf_dir), 2).withColumn("value", _near("value"))


@query(f"""
    WITH g AS ({DENSE}),
    a AS (SELECT i, least(floor(i * 31 / 47), 30)::INT AS lo, i * 31 / 47 - least(floor(i * 31 / 47), 30) AS w FROM range(48) t(i)),
    p AS (SELECT i, lo AS at, 1 - w AS w FROM a WHERE 1 - w > 0 UNION ALL SELECT i, lo + 1, w FROM a WHERE w > 0)
    SELECT v.i::INT AS y, h.i::INT AS x, CASE WHEN count(value) = count(*) THEN round(sum(value * v.w * h.w) + 1e-7, 4) END AS value
    FROM p v, p h, g WHERE g.y = v.at AND g.x = h.at GROUP BY 1, 2""")
def zoom_bilinear(spark, sf_dir):
    out = regrid.zoom(_dense(spark, sf_dir), 1.5, 32, 32)
    return out.select(F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), _near("value").alias("value"))


@query(f"""
    WITH g AS ({G()}), a AS (SELECT i, floor(i * 31 / 47 + 0.5)::INT AS at FROM range(48) t(i))
    SELECT v.i::INT AS y, h.i::INT AS x, round(value + 1e-7, 4) AS value FROM a v, a h, g WHERE g.y = v.at AND g.x = h.at""")
def zoom_nearest(spark, sf_dir):
    out = regrid.zoom(_grid(spark, sf_dir), 1.5, 32, 32, order=0)
    return out.select(F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), _near("value").alias("value"))


@query(f"""
    WITH g AS ({DENSE}),
    n AS (SELECT c.y, c.x, max(CASE WHEN dy = -1 AND dx = -1 THEN s.value END) a, max(CASE WHEN dy = -1 AND dx = 0 THEN s.value END) b, max(CASE WHEN dy = -1 AND dx = 1 THEN s.value END) c,
                 max(CASE WHEN dy = 0 AND dx = -1 THEN s.value END) d, max(CASE WHEN dy = 0 AND dx = 1 THEN s.value END) f,
                 max(CASE WHEN dy = 1 AND dx = -1 THEN s.value END) g, max(CASE WHEN dy = 1 AND dx = 0 THEN s.value END) h, max(CASE WHEN dy = 1 AND dx = 1 THEN s.value END) i
          FROM g c, range(-1, 2) p(dy), range(-1, 2) q(dx), g s
          WHERE s.y = greatest(0, least(31, c.y + dy)) AND s.x = greatest(0, least(31, c.x + dx)) GROUP BY 1, 2),
    z AS (SELECT y, x, ((c + 2 * f + i) - (a + 2 * d + g)) / 4000 AS dzdx, ((g + 2 * h + i) - (a + 2 * b + c)) / 4000 AS dzdy FROM n)
    SELECT y, x, round(degrees(atan(sqrt(dzdx * dzdx + dzdy * dzdy))) + 1e-7, 4) AS slope_deg,
           CASE WHEN dzdx = 0 AND dzdy = 0 THEN -1 ELSE round(((degrees(atan2(dzdy, -dzdx)) + 360) % 360) + 1e-7, 4) END AS aspect_deg FROM z""")
def horn_slope_aspect(spark, sf_dir):
    out = stencil.slope_aspect(_dense(spark, sf_dir), 500.0)
    return out.select("y", "x", _near("slope_deg").alias("slope_deg"), F.when(F.col("aspect_deg") < 0, F.lit(-1.0)).otherwise(_near("aspect_deg")).alias("aspect_deg"))


@query(f"WITH g AS ({G()}) SELECT y, x, round(value + 1e-7, 4) AS value, y BETWEEN 24 AND 31 AND x BETWEEN 8 AND 15 AS is_inner FROM g WHERE y BETWEEN 22 AND 31 AND x BETWEEN 6 AND 17")
def halo_read(spark, sf_dir):
    out = stencil.halo_block(_grid(spark, sf_dir), TileSpec((24, 32), (8, 16)), 2, 32, 32)
    return out.withColumn("value", _near("value"))


@query(f"""
    WITH g AS ({G()})
    SELECT ty::INT AS ty, tx::INT AS tx, count(*) AS cells, count(*) FILTER (y // 8 = ty AND x // 8 = tx) AS inner_cells, round(sum(value) + 1e-5, 2) AS total
    FROM g, range(4) a(ty), range(4) b(tx) WHERE y BETWEEN ty * 8 - 2 AND ty * 8 + 9 AND x BETWEEN tx * 8 - 2 AND tx * 8 + 9 GROUP BY 1, 2""")
def halo_tiles(spark, sf_dir):
    tiles = stencil.haloed_tiles(_grid(spark, sf_dir), 8, 2, 32, 32).groupBy("ty", "tx")
    return tiles.agg(F.count(F.lit(1)).alias("cells"), F.count_if("is_inner").alias("inner_cells"), F.round(F.sum("value") + 1e-5, 2).alias("total"))


@query("SELECT (i // 11)::INT AS y, (i % 11)::INT AS x, 700000 + (i % 11 + 0.5) * 500 AS cx, 3630000 - (i // 11 + 0.5) * 500 AS cy FROM range(121) t(i)")
def grid_cells(spark, sf_dir):
    return Grid(32614, 500.0, 11, 11, 700000.0, 3630000.0).cells(spark)


_AROUND = Grid.around(-96.797, 32.776, 50_000, 1000)


@query(f"SELECT {_AROUND.x0} + (i % {_AROUND.width} + 0.5) * 1000 AS cx, {_AROUND.y1} - (i // {_AROUND.width} + 0.5) * 1000 AS cy, 0.0::DOUBLE AS moved_m FROM range({_AROUND.width * _AROUND.height}) t(i)")
def utm_roundtrip(spark, sf_dir):
    """How far cells move by the inverse and forward projection, in metres to the millimetre."""
    cells = _AROUND.cells(spark)
    lon, lat = geo.lonlat_columns(F.col("cx"), F.col("cy"), 32614)
    there = cells.select("cx", "cy", lon.alias("lon"), lat.alias("lat"))
    x, y = geo.utm_columns(F.col("lon"), F.col("lat"), 32614)
    return there.select("cx", "cy", F.round(F.hypot(x - F.col("cx"), y - F.col("cy")), 3).alias("moved_m"))


@query("SELECT row_number() OVER (ORDER BY y0, x0)::INT - 1 AS tile, y0::INT AS y0, least(y0 + 12, 32)::INT AS y1, x0::INT AS x0, least(x0 + 12, 32)::INT AS x1 FROM range(0, 32, 12) a(y0), range(0, 32, 12) b(x0)")
def tile_enumeration(spark, sf_dir):
    rows = [(k, *t.y, *t.x) for k, t in enumerate(tiles_of(32, 32, 12))]
    return spark.createDataFrame(rows, "tile int, y0 int, y1 int, x0 int, x1 int")


# Merges ---------------------------------------------------------------------

_OLD, _NEW = "l_linenumber = 1", "l_linenumber = 2"


def _merging(policy: MergePolicy) -> Query:
    def run(spark, sf_dir):
        out = merge.merge_cells(_grid(spark, sf_dir, 40, _OLD), _grid(spark, sf_dir, 40, _NEW), policy)
        return out.withColumn("value", _near("value"))

    return run


def _merge_sql(value: str) -> str:
    return f"""
    WITH a AS ({G(40, _OLD)}), b AS ({G(40, _NEW)})
    SELECT coalesce(a.y, b.y) AS y, coalesce(a.x, b.x) AS x, round(CASE WHEN b.y IS NULL THEN a.value ELSE {value} END + 1e-7, 4) AS value
    FROM a FULL JOIN b ON a.y = b.y AND a.x = b.x"""


for _name, _policy, _value in (
    ("merge_last_writer", MergePolicy.LAST_WRITER, "b.value"),
    ("merge_union", MergePolicy.UNION, "b.value"),
    ("merge_min", MergePolicy.MONOTONE_MIN, "least(a.value, b.value)"),
    ("merge_max", MergePolicy.MONOTONE_MAX, "greatest(a.value, b.value)"),
    ("merge_accumulate", MergePolicy.ACCUMULATE, "coalesce(a.value, 0) + b.value"),
):
    QUERIES[_name], ORACLE_SQL[_name] = _merging(_policy), _merge_sql(_value)


@query("SELECT (l_partkey % 40)::INT AS y, (l_orderkey % 40)::INT AS x, round(sum(l_extendedprice) + 1e-5, 2) AS value FROM lineitem GROUP BY 1, 2")
def accumulate_running(spark, sf_dir):
    writes = _table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 40).cast("int").alias("y"), (F.col("l_orderkey") % 40).cast("int").alias("x"), F.col("l_extendedprice").alias("value"))
    return merge.accumulated(writes, MergePolicy.ACCUMULATE).withColumn("value", F.round(F.col("value") + 1e-5, 2))


@query("""
    WITH w AS (SELECT (l_partkey % 40)::INT AS y, (l_orderkey % 40)::INT AS x, arg_max(l_extendedprice, (l_orderkey * 10 + l_linenumber) * 1e7 + l_extendedprice) AS value FROM lineitem GROUP BY 1, 2)
    SELECT y, x, round(value + 1e-7, 4) AS value FROM w""")
def last_write_of_many(spark, sf_dir):
    writes = _table(spark, sf_dir, "lineitem").select(
        (F.col("l_partkey") % 40).cast("int").alias("y"), (F.col("l_orderkey") % 40).cast("int").alias("x"), F.col("l_extendedprice").alias("value"), ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1e7 + F.col("l_extendedprice")).alias("seq")
    )
    return merge.accumulated(writes, MergePolicy.LAST_WRITER).withColumn("value", _near("value"))


# Time -----------------------------------------------------------------------


@query(f"WITH e AS ({E()}) SELECT strftime(t, '%Y-%m-%d %H:%M:%S') AS t, y, x, round(value + 1e-7, 4) AS value FROM e WHERE t BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-09'")
def time_window_inclusive(spark, sf_dir):
    out = temporal.time_window(_steps(spark, sf_dir), START + timedelta(days=4), START + timedelta(days=8))
    return out.select(_stamp("t").alias("t"), "y", "x", _near("value").alias("value"))


_HALF_DAYS = [START + timedelta(hours=12 * k) for k in range(-2, 62)]
_BRACKET = f"""
    WITH e AS ({E(True)}), w AS (SELECT TIMESTAMP '2024-01-01' + INTERVAL 12 HOUR * k AS t FROM range(-2, 62) r(k)), c AS (SELECT DISTINCT y, x FROM e),
    lo AS (SELECT w.t, c.y, c.x, max(e.t) AS a FROM w CROSS JOIN c LEFT JOIN e ON e.y = c.y AND e.x = c.x AND e.t <= w.t GROUP BY ALL),
    hi AS (SELECT w.t, c.y, c.x, min(e.t) AS b FROM w CROSS JOIN c LEFT JOIN e ON e.y = c.y AND e.x = c.x AND e.t >= w.t GROUP BY ALL),
    p AS (SELECT t, y, x, coalesce(a, b) AS a, coalesce(b, a) AS b FROM lo JOIN hi USING (t, y, x)),
    v AS (SELECT p.*, f.value AS va, g.value AS vb FROM p JOIN e f ON f.y = p.y AND f.x = p.x AND f.t = p.a JOIN e g ON g.y = p.y AND g.x = p.x AND g.t = p.b)
    SELECT strftime(t, '%Y-%m-%d %H:%M:%S') AS t, y, x, round({{}} + 1e-7, 4) AS value FROM v"""


@query(_BRACKET.format("CASE WHEN a = b THEN va ELSE va + (vb - va) * (date_diff('microsecond', a, t) / date_diff('microsecond', a, b)) END"))
def time_linear_interp(spark, sf_dir):
    out = temporal.interpolate(_steps(spark, sf_dir, gaps=True), _HALF_DAYS)
    return out.select(_stamp("t").alias("t"), "y", "x", _near("value").alias("value"))


@query(_BRACKET.format("CASE WHEN abs(date_diff('microsecond', t, a)) <= abs(date_diff('microsecond', t, b)) THEN va ELSE vb END"))
def time_nearest(spark, sf_dir):
    out = temporal.interpolate(_steps(spark, sf_dir, gaps=True), _HALF_DAYS, "nearest")
    return out.select(_stamp("t").alias("t"), "y", "x", _near("value").alias("value"))


@query(f"""
    WITH e AS ({E()}), s AS (SELECT DISTINCT t FROM e), b AS (SELECT t FROM s ORDER BY abs(date_diff('microsecond', TIMESTAMP '2024-01-10 12:00:00', t)), t LIMIT 1)
    SELECT strftime(t, '%Y-%m-%d %H:%M:%S') AS t, y, x, round(value + 1e-7, 4) AS value FROM e JOIN b USING (t)""")
def read_timestep_nearest(spark, sf_dir):
    out = temporal.nearest_step(_steps(spark, sf_dir), START + timedelta(days=9, hours=12))
    return out.select(_stamp("t").alias("t"), "y", "x", _near("value").alias("value"))


@query(f"""
    WITH e AS ({E()}), s AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS k FROM (SELECT DISTINCT t FROM e))
    SELECT strftime(t, '%Y-%m-%d %H:%M:%S') AS t, count(*) AS cells FROM e JOIN s USING (t) WHERE k >= 3 AND k < 6 GROUP BY 1""")
def read_steps_by_index(spark, sf_dir):
    return temporal.step_index(_steps(spark, sf_dir), 3, 6).groupBy("t").agg(F.count(F.lit(1)).alias("cells")).select(_stamp("t").alias("t"), "cells")


@query(f"""
    WITH c AS ({C})
    SELECT variable, strftime(min(t), '%Y-%m-%d %H:%M:%S') AS first, strftime(max(t), '%Y-%m-%d %H:%M:%S') AS last,
           count(*) FILTER (t BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-01-01') AS in_window,
           min(t) <= TIMESTAMP '1996-01-01' AND max(t) >= TIMESTAMP '1997-01-01' AS window_covered FROM c GROUP BY variable""")
def time_coverage(spark, sf_dir):
    out = temporal.coverage(_tiles(spark, sf_dir), datetime(1996, 1, 1), datetime(1997, 1, 1))
    return out.select("variable", _stamp("first").alias("first"), _stamp("last").alias("last"), "in_window", "window_covered")


# Catalog --------------------------------------------------------------------

_SPECS = [("1-URGENT", "time", None), ("2-HIGH", "time", 1.0), ("3-MEDIUM", None, None), ("4-NOT SPECIFIED", "static", None), ("5-LOW", "time", 1e9), ("dem", "static", None), ("dem", "time", None), ("nothing", None, None)]
_VARIABLES = [(f, "time") for f in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")] + [("dem", "static")]
_AS_SQL = lambda rows: ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


def _catalog(spark, sf_dir) -> DataFrame:
    dem = spark.createDataFrame([("dem", None, "s", 10.0, 0, START)], "variable string, t timestamp_ntz, source string, native_res_m double, version int, fetched_at timestamp_ntz")
    return _tiles(spark, sf_dir).unionByName(dem)


@query(f"""
    WITH c AS ({C} UNION ALL SELECT 'dem', NULL, 's', 10.0, 0, TIMESTAMP '2024-01-01'),
    s(name, kind, cap) AS (VALUES {_AS_SQL(_SPECS)}), v(name, kind) AS (VALUES {_AS_SQL(_VARIABLES)}),
    h AS (SELECT variable, count(*) FILTER (t IS NULL) AS n_static, min(t) AS a, max(t) AS b, max(native_res_m) AS coarsest FROM c GROUP BY variable)
    SELECT s.name, s.kind, s.cap AS max_native_res_m, coalesce(v.name IS NOT NULL AND (s.kind IS NULL OR s.kind = v.kind) AND (s.cap IS NULL OR coarsest <= s.cap)
           AND CASE v.kind WHEN 'static' THEN n_static > 0 ELSE a <= TIMESTAMP '1996-01-01' AND b::DATE >= DATE '1996-12-31' END, false) AS satisfied
    FROM s LEFT JOIN v ON v.name = s.name LEFT JOIN h ON h.variable = s.name""")
def satisfies_static_time(spark, sf_dir):
    specs = spark.createDataFrame(_SPECS, "name string, kind string, max_native_res_m double")
    known = spark.createDataFrame(_VARIABLES, "name string, kind string")
    return catalogs.satisfied(specs, known, _catalog(spark, sf_dir), datetime(1996, 1, 1), datetime(1997, 1, 1))


@query(f"""
    WITH c AS ({C})
    SELECT coalesce((SELECT max(fetched_at) FROM c WHERE variable IN ('1-URGENT', '2-HIGH')) > (SELECT max(fetched_at) FROM c WHERE variable = '5-LOW'), false) AS stale""")
def is_output_stale(spark, sf_dir):
    return catalogs.is_stale(_tiles(spark, sf_dir), "5-LOW", ["1-URGENT", "2-HIGH"])


@query(f"WITH c AS ({C}) SELECT variable, max(native_res_m) AS native_res_m FROM c GROUP BY variable")
def native_resolution(spark, sf_dir):
    return catalogs.native_resolution(_tiles(spark, sf_dir))


@query("SELECT o_orderpriority AS variable, coalesce(max(o_orderkey % 17), 0)::INT AS version FROM orders GROUP BY 1")
def latest_version(spark, sf_dir):
    tiles = _table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("variable"), (F.col("o_orderkey") % 17).cast("int").alias("version"))
    return catalogs.latest_version(tiles)


@query(f"WITH c AS ({C}) SELECT variable, strftime(t, '%Y-%m-%d %H:%M:%S') AS t, source, native_res_m FROM c WHERE variable = '2-HIGH' ORDER BY variable, c.t NULLS FIRST")
def list_tiles_sorted(spark, sf_dir):
    return catalogs.list_tiles(_tiles(spark, sf_dir), "2-HIGH").select("variable", _stamp("t").alias("t"), "source", "native_res_m")


@query("SELECT count(*) AS found FROM (SELECT 1 FROM orders WHERE o_orderpriority = '5-LOW' LIMIT 1)")
def has_variable(spark, sf_dir):
    t = _table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("variable"), F.lit(None).cast("timestamp_ntz").alias("t"))
    return catalogs.holds(t, "5-LOW").agg(F.count(F.lit(1)).alias("found"))


@query("""
    WITH k AS (SELECT 'p' || (o_custkey % 50) AS producer, o_orderkey AS step_id, o_totalprice AS state FROM orders)
    SELECT producer, max(step_id) AS step_id, arg_max(state, step_id) AS state FROM k GROUP BY producer""")
def latest_checkpoint(spark, sf_dir):
    rows = _table(spark, sf_dir, "orders").select(F.concat(F.lit("p"), F.col("o_custkey") % 50).alias("producer"), F.col("o_orderkey").alias("step_id"), F.col("o_totalprice").alias("state"))
    return catalogs.latest_checkpoints(rows)


@query(f"""
    WITH c AS ({C}), w AS (SELECT v AS variable, TIMESTAMP '1998-01-01' + INTERVAL 1 DAY * k AS t FROM (VALUES ('1-URGENT'), ('5-LOW'), ('new')) a(v), range(400) r(k))
    SELECT variable, strftime(t, '%Y-%m-%d %H:%M:%S') AS t FROM w WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.variable = w.variable AND c.t = w.t)""")
def append_missing_timesteps(spark, sf_dir):
    days = spark.range(400).select(F.explode(F.array(F.lit("1-URGENT"), F.lit("5-LOW"), F.lit("new"))).alias("variable"), F.timestamp_add("DAY", F.col("id").cast("int"), temporal.at(datetime(1998, 1, 1))).cast("timestamp_ntz").alias("t"))
    return catalogs.missing_steps(days, _tiles(spark, sf_dir)).select("variable", _stamp("t").alias("t"))


@query("""
    WITH n AS (SELECT l_suppkey % 20 AS p, l_quantity AS e, l_returnflag <> 'R' AS ok FROM lineitem)
    SELECT 'p' || p AS producer, count(*) AS tiles, min(e) AS min_s, quantile_cont(e, 0.5) AS median_s, max(e) AS max_s, sum(e) AS total_s, count(*) FILTER (NOT ok) AS errors FROM n GROUP BY p""")
def tile_latency_summary(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem").select(F.concat(F.lit("p"), F.col("l_suppkey") % 20).alias("producer"), F.col("l_quantity").alias("elapsed"), (F.col("l_returnflag") != "R").alias("ok"))
    return catalogs.latency_summary(rows)


@query("""
    WITH s AS (SELECT l_orderkey AS run_id, CASE l_returnflag WHEN 'A' THEN 'ok' WHEN 'N' THEN 'skipped' ELSE 'error' END AS status, l_quantity AS elapsed FROM lineitem)
    SELECT run_id, count(*) FILTER (status = 'ok') AS n_ok, count(*) FILTER (status = 'skipped') AS n_skipped, count(*) FILTER (status = 'error') AS n_error, sum(elapsed) AS total_s, bool_and(status <> 'error') AS ok FROM s GROUP BY run_id""")
def run_summary(spark, sf_dir):
    status = F.when(F.col("l_returnflag") == "A", "ok").when(F.col("l_returnflag") == "N", "skipped").otherwise("error")
    return catalogs.run_summary(_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), status.alias("status"), F.col("l_quantity").alias("elapsed")))


@query("""
    WITH k AS (SELECT doc_id, n_chars, sum(n_chars) OVER (ORDER BY doc_id) AS running, sum(n_chars) OVER () AS total FROM documents)
    SELECT doc_id AS atime, n_chars AS size FROM k WHERE total - (running - n_chars) > 500000""")
def lru_evict(spark, sf_dir):
    entries = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("atime"), F.col("n_chars").alias("size"))
    return catalogs.evictions(entries, 500_000)


@query("""
    WITH a AS (SELECT 'v' || (o_custkey % 100) AS variable, o_orderstatus AS source, CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'O' THEN 2 ELSE 3 END AS priority, o_orderkey AS seq FROM orders)
    SELECT variable, source, priority, seq FROM (SELECT *, row_number() OVER (PARTITION BY variable ORDER BY priority DESC, seq) AS rn FROM a) WHERE rn = 1""")
def source_priority_first_hit(spark, sf_dir):
    rank = F.when(F.col("o_orderstatus").isin("F", "O"), 2).otherwise(3)
    assets = _table(spark, sf_dir, "orders").select(F.concat(F.lit("v"), F.col("o_custkey") % 100).alias("variable"), F.col("o_orderstatus").alias("source"), rank.alias("priority"), F.col("o_orderkey").alias("seq"))
    return catalogs.first_hits(assets)


@query("""
    WITH a AS (SELECT o_orderkey AS k, o_totalprice AS v FROM orders WHERE o_orderstatus <> 'P'), b AS (SELECT o_orderkey AS k, -o_totalprice AS v FROM orders WHERE o_orderstatus <> 'F')
    SELECT k, v FROM b UNION ALL SELECT k, v FROM a WHERE k NOT IN (SELECT k FROM b)""")
def catalog_upsert(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"), "o_orderstatus")
    there, fresh = orders.where("o_orderstatus <> 'P'"), orders.where("o_orderstatus <> 'F'").withColumn("v", -F.col("v"))
    return catalogs.upserted(there.drop("o_orderstatus"), fresh.drop("o_orderstatus"), ["k"])


# Joins and cells ------------------------------------------------------------


@query(f"WITH e AS ({E()}), s AS ({G(8)}) SELECT strftime(t, '%Y-%m-%d %H:%M:%S') AS t, e.y, e.x, round(e.value * s.value + 1e-5, 2) AS value FROM e JOIN s ON s.y = e.y AND s.x = e.x")
def static_time_broadcast(spark, sf_dir):
    static = F.broadcast(_grid(spark, sf_dir, 8).withColumnRenamed("value", "static"))  # 64 cells
    return _steps(spark, sf_dir).join(static, ["y", "x"]).select(_stamp("t").alias("t"), "y", "x", F.round(F.col("value") * F.col("static") + 1e-5, 2).alias("value"))


@query(f"WITH a AS ({G(40, _OLD)}), b AS ({G(40, _NEW)}) SELECT a.y, a.x, round(a.value + 2 * b.value + 1e-7, 4) AS value FROM a JOIN b ON a.y = b.y AND a.x = b.x")
def cell_equi_join(spark, sf_dir):
    a, b = _grid(spark, sf_dir, 40, _OLD), _grid(spark, sf_dir, 40, _NEW).withColumnRenamed("value", "other")
    return a.join(b, ["y", "x"]).select("y", "x", _near(F.col("value") + 2 * F.col("other")).alias("value"))


@query(f"""
    WITH r AS ({G(16)}), c AS (SELECT i // 24 AS y, i % 24 AS x, 100 + (i % 24 + 0.5) * 10 AS cx, 900 - (i // 24 + 0.5) * 10 AS cy FROM range(576) t(i))
    SELECT c.y::INT AS y, c.x::INT AS x, round(r.value + 1e-7, 4) AS value FROM c LEFT JOIN r ON r.y = floor((880 - cy) / 13) AND r.x = floor((cx - 90) / 13)""")
def nearest_reproject(spark, sf_dir):
    cells = Grid(32614, 10.0, 24, 24, 100.0, 900.0).cells(spark)
    raster = _grid(spark, sf_dir, 16).select(F.col("y").alias("row"), F.col("x").alias("col"), "value")
    out = regrid.nearest_cells(cells, raster, F.col("cx"), F.col("cy"), 90.0, 880.0, 13.0)
    return out.select("y", "x", _near("value").alias("value"))


_NODES = f"SELECT t, y AS i, x AS j, value AS u, -2 * value AS v FROM ({E()})"


@query(f"""
    WITH n AS ({_NODES}), c AS (SELECT i // 10 AS y, i % 10 AS x, 0.07 + (i % 10) * 0.17 AS fx, 0.05 + (i // 10) * 0.18 AS fy FROM range(100) t(i)),
    p AS (SELECT y, x, (floor(fy / 0.25) + a)::INT AS i, (floor(fx / 0.25) + b)::INT AS j,
                 (CASE a WHEN 1 THEN fy / 0.25 - floor(fy / 0.25) ELSE 1 - (fy / 0.25 - floor(fy / 0.25)) END) * (CASE b WHEN 1 THEN fx / 0.25 - floor(fx / 0.25) ELSE 1 - (fx / 0.25 - floor(fx / 0.25)) END) AS w
          FROM c, range(2) s(a), range(2) r(b))
    SELECT strftime(t, '%Y-%m-%d %H:%M:%S') AS t, y::INT AS y, x::INT AS x, CASE WHEN sum(w) > 1 - 1e-9 THEN round(sum(u * w) + 1e-7, 4) END AS u, CASE WHEN sum(w) > 1 - 1e-9 THEN round(sum(v * w) + 1e-7, 4) END AS v
    FROM p JOIN n USING (i, j) WHERE w > 0 GROUP BY 1, 2, 3""")
def bilinear_node_join(spark, sf_dir):
    nodes = _steps(spark, sf_dir).select("t", F.col("y").alias("i"), F.col("x").alias("j"), F.col("value").alias("u"), (-2 * F.col("value")).alias("v"))
    at = spark.range(100).select((F.col("id") / 10).cast("int").alias("y"), (F.col("id") % 10).cast("int").alias("x"))
    at = at.withColumns({"lon": 260.07 + F.col("x") * 0.17, "lat": 30.05 + F.col("y") * 0.18})
    out = regrid.bilinear_nodes(at, nodes, F.col("lon"), F.col("lat"), 260.0, 30.0, 0.25, ("u", "v"), ("t",))
    return out.select(_stamp("t").alias("t"), "y", "x", _near("u").alias("u"), _near("v").alias("v"))


@query("SELECT p_partkey, p_size, (CASE WHEN p_size BETWEEN 1 AND 13 THEN p_size ELSE 14 END)::INT AS fuel FROM part")
def category_remap(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", "p_size", physics.fuel_category(F.col("p_size")).cast("int").alias("fuel"))


@query("""
    WITH c AS (SELECT p_partkey, p_size, CASE WHEN p_partkey % 5 > 0 THEN p_retailprice - 1000 END AS t0 FROM part),
    m AS (SELECT coalesce(max(CASE WHEN t0 >= 0 THEN t0 END), 0) + 1 AS T FROM c),
    g AS (SELECT p_partkey, CASE WHEN t0 >= 0 AND p_size BETWEEN 1 AND 13 THEN least(t0, T - 0.1) ELSE 1e9 END AS tign FROM c, m)
    SELECT p_partkey, round(tign, 4) AS tign, CASE WHEN tign > 0.99e9 THEN NULL ELSE round(tign, 4) END AS arrival FROM g""")
def burnability_gate(spark, sf_dir):
    cells = _table(spark, sf_dir, "part").select("p_partkey", "p_size", F.when(F.col("p_partkey") % 5 > 0, F.col("p_retailprice") - 1000).alias("t0"))
    until = F.broadcast(cells.agg(physics.last_ignition(F.col("t0")).alias("until")))  # one row
    gated = cells.join(until).select("p_partkey", physics.gated_ignition(F.col("t0"), F.col("p_size"), F.col("until")).alias("tign"))
    return gated.select("p_partkey", F.round("tign", 4).alias("tign"), F.round(physics.arrival(F.col("tign")), 4).alias("arrival"))


_WIND = "SELECT l_orderkey, l_linenumber, l_discount - 0.05 AS u, l_tax - 0.04 AS v FROM lineitem"


@query(f"WITH w AS ({_WIND}) SELECT l_orderkey, l_linenumber, round(sqrt(u * u + v * v) + 1e-7, 4) AS speed, round((270 - degrees(atan2(v, u))) - 360 * floor((270 - degrees(atan2(v, u))) / 360) + 1e-7, 4) AS direction FROM w")
def wind_speed_dir(spark, sf_dir):
    u, v = F.col("l_discount") - 0.05, F.col("l_tax") - 0.04
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", _near(physics.wind_speed(u, v)).alias("speed"), _near(physics.wind_direction(u, v)).alias("direction"))


@query("SELECT l_orderkey, l_linenumber, round(-l_quantity * sin(radians(l_tax * 4500)) + 1e-7, 4) AS u, round(-l_quantity * cos(radians(l_tax * 4500)) + 1e-7, 4) AS v FROM lineitem")
def wind_vector(spark, sf_dir):
    u, v = physics.wind_vector(F.col("l_quantity"), F.col("l_tax") * 4500)
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", _near(u).alias("u"), _near(v).alias("v"))


_RINGS = [(1000.0, 1.2), (1500.0, 0.84), (2500.0, 0.42), (4000.0, 0.25)]


@query("""
    WITH c AS (SELECT i // 41 AS y, i % 41 AS x, sqrt(((i % 41 - 20) * 250) ** 2 + ((i // 41 - 20) * 250) ** 2) AS r FROM range(1681) t(i)),
    f AS (SELECT y, x, CASE WHEN r <= 1000 THEN 1.2 WHEN r <= 1500 THEN exp(ln(1.2) + (ln(0.84) - ln(1.2)) * (r - 1000) / 500) WHEN r <= 2500 THEN exp(ln(0.84) + (ln(0.42) - ln(0.84)) * (r - 1500) / 1000)
                           ELSE exp(ln(0.42) + (ln(0.25) - ln(0.42)) * (r - 2500) / 1500) END AS j FROM c)
    SELECT y::INT AS y, x::INT AS x, round(j + 1e-9, 6) AS fluence, round(j * 1000 / 10 + 1e-7, 4) AS power, CASE WHEN j + 1e-9 >= 0.84 AND j + 1e-9 < 1.2 THEN 0.0 END AS ignition, (j + 1e-9 < 1.2)::INT AS burnable FROM f""")
def thermal_field(spark, sf_dir):
    cells = spark.range(1681).select((F.col("id") / 41).cast("int").alias("y"), (F.col("id") % 41).cast("int").alias("x"))
    r = F.hypot((F.col("x") - 20) * 250.0, (F.col("y") - 20) * 250.0)
    j, edge = F.col("j"), F.col("j") + 1e-9
    field = cells.withColumn("j", physics.fluence(r, _RINGS))
    return field.select("y", "x", F.round(j + 1e-9, 6).alias("fluence"), _near(physics.thermal_power(j, 10.0)).alias("power"), physics.burning_annulus(edge).alias("ignition"), physics.burnable(edge).cast("int").alias("burnable"))


@query(f"""
    WITH g AS (SELECT y, x, CASE WHEN (y * 32 + x) % 11 = 0 THEN NULL WHEN (y * 32 + x) % 13 = 0 THEN 5e6 ELSE value END AS value FROM ({G()}))
    SELECT y, x, round(coalesce(CASE WHEN abs(value) <= 1e6 THEN value END, avg(CASE WHEN abs(value) <= 1e6 THEN value END) OVER (), 0) + 1e-7, 3) AS value FROM g""")
def dem_cleanup(spark, sf_dir):
    at = F.col("y") * 32 + F.col("x")
    raw = _grid(spark, sf_dir).withColumn("value", F.when(at % 11 == 0, F.lit(None)).when(at % 13 == 0, 5e6).otherwise(F.col("value")))
    return physics.filled(raw).withColumn("value", F.round(F.col("value") + 1e-7, 3))


# Scalars and planning -------------------------------------------------------


@query("SELECT p_partkey, greatest(1, round_even(6 * p_size * 50 / 1000.0, 0))::INT AS step_s FROM part")
def cfl_step(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", physics.cfl_step(F.col("p_size") * 50).alias("step_s"))


@query("""
    WITH RECURSIVE r(level, dx, ratio) AS (VALUES (1, 9000.0, 1), (2, 3000.0, 3), (3, 1000.0, 3)),
    n(level, dx_m, e_we, parent_id, ratio, i_start) AS (
        SELECT 1, 9000.0::DOUBLE, greatest(20, round_even(1000000 / 9000.0, 0))::INT + 1, 1, 1, 1
        UNION ALL SELECT r.level, r.dx::DOUBLE, greatest(4, round_even(0.5 * (n.e_we - 1), 0))::INT * r.ratio + 1, n.level, r.ratio, greatest(1, (n.e_we - 1 - greatest(4, round_even(0.5 * (n.e_we - 1), 0))::INT) // 2 + 1)::INT
        FROM n JOIN r ON r.level = n.level + 1)
    SELECT level::INT AS level, dx_m, e_we::INT AS e_we, parent_id::INT AS parent_id, ratio::INT AS ratio, i_start::INT AS i_start FROM n""")
def nest_solver(spark, sf_dir):
    rows = [(n.level, n.dx_m, n.e_we, n.parent_id, n.ratio, n.i_start) for n in nests.solve_nests(1000, [9000.0, 3000.0, 1000.0])]
    return spark.createDataFrame(rows, "level int, dx_m double, e_we int, parent_id int, ratio int, i_start int")


@query("""SELECT page_id, sha256('{"params":{"page_id":' || page_id || ',"url":"' || url || '"},"source":"pages"}') AS key FROM pages""")
def cache_key(spark, sf_dir):
    params = F.struct("page_id", "url")
    whole = F.to_json(F.struct(params.alias("params"), F.lit("pages").alias("source")))
    return _table(spark, sf_dir, "pages").select("page_id", F.sha2(whole.cast("binary"), 256).alias("key"))


@query("SELECT c_custkey, lower(trim(regexp_replace(c_name || '   #  ' || c_mktsegment, '\\s+', ' ', 'g'))) AS key, regexp_replace(c_name || ' é/' || c_mktsegment, '[^A-Za-z0-9_.-]', '_', 'g') AS label FROM customer")
def text_normalise(spark, sf_dir):
    name = F.concat("c_name", F.lit("   #  "), "c_mktsegment")
    return _table(spark, sf_dir, "customer").select("c_custkey", physics.text_key(name).alias("key"), physics.safe_label(F.concat("c_name", F.lit(" é/"), "c_mktsegment")).alias("label"))


@query("SELECT o_orderkey, greatest(1, date_diff('day', o_orderdate, o_orderdate + INTERVAL 36 HOUR * (o_orderkey % 4)))::INT AS n_days FROM orders")
def n_days(spark, sf_dir):
    end = F.timestamp_add("HOUR", (F.col("o_orderkey") % 4 * 36).cast("int"), F.col("o_orderdate"))
    return _table(spark, sf_dir, "orders").select("o_orderkey", F.greatest(F.lit(1), F.datediff(end, "o_orderdate")).cast("int").alias("n_days"))


@query("""
    WITH d AS (SELECT o_custkey, list_sort(list_distinct(list(o_orderstatus))) AS declared, list_sort(list_distinct(list(CASE WHEN o_totalprice > 100000 THEN o_orderstatus ELSE 'X' END))) AS returned FROM orders GROUP BY o_custkey)
    SELECT o_custkey, array_to_string(list_sort(list_filter(declared, lambda v: NOT list_contains(returned, v))), ',') AS missing, array_to_string(list_sort(list_filter(returned, lambda v: NOT list_contains(declared, v))), ',') AS extra FROM d""")
def declared_vs_returned(spark, sf_dir):
    price = F.when(F.col("o_totalprice") > 100000, F.col("o_orderstatus")).otherwise("X")
    sets = _table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderstatus").alias("declared"), F.collect_set(price).alias("returned"))
    less = lambda a, b: F.array_join(F.array_sort(F.array_except(a, b)), ",")
    return sets.select("o_custkey", less("declared", "returned").alias("missing"), less("returned", "declared").alias("extra"))


_EDGES = [("thermal", "fire"), ("dem", "fire"), ("fuel", "fire"), ("wind", "fire"), ("meteo", "wind"), ("fire", "smoke"), ("fire", "report"), ("smoke", "report"), ("dem", "slope")]


@query(f"""
    WITH RECURSIVE e(src, dst) AS (VALUES {_AS_SQL(_EDGES)}), n AS (SELECT src AS node FROM e UNION SELECT dst FROM e),
    d(node, depth) AS (SELECT node, 0 FROM n WHERE node NOT IN (SELECT dst FROM e) UNION ALL SELECT e.dst, d.depth + 1 FROM d JOIN e ON e.src = d.node)
    SELECT node, max(depth)::INT AS layer FROM d GROUP BY node""")
def dag_layers(spark, sf_dir):
    from gridloom.plans.pipeline import Pipeline

    p = Pipeline("edges")
    for a, b in _EDGES:
        p.add(a)
        p.add(b, after=[a])
    rows = [(node, k) for k, layer in enumerate(p.topological_layers()) for node in layer]
    return spark.createDataFrame(rows, "node string, layer int")


# The engine itself: what goes through a cube, its catalog, producers, adapters and streams ----


def _cube(spark: SparkSession, n: int = 32):
    """A new cube in the folder that all executors share; it goes when the driver's JVM ends."""
    from gridloom.sources.store import Cube

    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{folder.rstrip('/')}/cube-{uuid.uuid4().hex[:12]}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return Cube(spark, path, Grid(32614, 500.0, n, n, 0.0, n * 500.0), tile=n // 2)


def _timed(cells: DataFrame) -> DataFrame:
    return cells.select(_stamp("t").alias("t"), "y", "x", _near("value").alias("value"))


_TIMED = "strftime(t, '%Y-%m-%d %H:%M:%S') AS t, y, x, round(value + 1e-7, 4) AS value"


@query(f"WITH e AS ({E()}) SELECT {_TIMED} FROM e WHERE t >= (SELECT min(t) + INTERVAL 2 DAY FROM e) AND t <= (SELECT min(t) + INTERVAL 9 DAY FROM e)")
def cube_window(spark, sf_dir):
    """A time variable written to a cube and a window of it read."""
    cube = _cube(spark, 8)
    cube.write_time("w", _steps(spark, sf_dir), dtype="double")
    first = cube.times("w")[0]
    return _timed(cube.read_window("w", first + timedelta(days=2), first + timedelta(days=9)))


@query(f"WITH e AS ({E()}), d AS (SELECT DISTINCT t FROM e ORDER BY t LIMIT 4) SELECT {_TIMED} FROM e WHERE t IN (SELECT t FROM d)")
def cube_append(spark, sf_dir):
    """Four steps appended, each sent twice."""
    cube, steps = _cube(spark, 8), _steps(spark, sf_dir).persist()
    for r in steps.select("t").distinct().orderBy("t").limit(4).collect():
        for _ in range(2):
            cube.append_step("w", r.t, steps.where(F.col("t") == F.lit(r.t)).drop("t"), dtype="double")
    steps.unpersist()
    return _timed(cube.read_time("w"))


@query(f"WITH g AS ({G()}), h AS ({G(where="l_returnflag = 'R'")}) SELECT g.y, g.x, round(least(g.value, CASE WHEN g.y < 20 THEN h.value * 0.9 END) + 1e-7, 4) AS value FROM g LEFT JOIN h ON h.y = g.y AND h.x = g.x")
def cube_tile_merge(spark, sf_dir):
    """The least of what tiles hold and what is merged into some of them."""
    cube = _cube(spark)
    cube.write_static("g", _grid(spark, sf_dir), dtype="double")
    part = _grid(spark, sf_dir, where="l_returnflag = 'R'").where("y < 20").withColumn("value", F.col("value") * 0.9)
    cube.write_tiles("g", part, MergePolicy.MONOTONE_MIN)
    return cube.read_static("g").select("y", "x", _near("value").alias("value"))


@query("SELECT * FROM (VALUES ('a', 3, 500.0::DOUBLE), ('b', 1, 30.0::DOUBLE)) t(variable, version, native_res_m)")
def cube_catalog(spark, sf_dir):
    """Latest versions and resolutions after bulk writes and a merge of tiles."""
    cube, cells = _cube(spark), _grid(spark, sf_dir)
    cube.write_static("a", cells)
    cube.write_static("a", cells)
    cube.write_static("b", cells, native_res_m=30.0)
    cube.write_tiles("a", cells.limit(1))
    rows = [(v, cube.catalog.latest_version(v), cube.catalog.native_resolution(v)) for v in cube.catalog.list_variables()]
    return spark.createDataFrame(rows, "variable string, version int, native_res_m double")


@query(_blocks(2, "avg"))
def adapter_fetch(spark, sf_dir):
    """A needed variable that its producer makes, fetched at half the resolution."""
    from gridloom.model import VarSpec
    from gridloom.plans.adapter import DataAdapter
    from gridloom.plans.contracts import FunctionProducer, ProducerRegistry

    cube = _cube(spark)
    made = FunctionProducer(lambda inputs, request: _grid(spark, sf_dir), [VarSpec("price", dtype="double")], name="prices")
    adapter = DataAdapter(["price"])
    adapter.resolve(cube, ProducerRegistry([made]))
    cells = adapter.fetch(cube, target_pixel_m=1000, spatial_method="mean")["price"]
    return cells.withColumn("value", _near("value"))


@query("SELECT * FROM (VALUES (1, 'after_broken', 'error'), (1, 'broken', 'error'), (1, 'price', 'ok'), (1, 'spread', 'ok'), (2, 'after_broken', 'error'), (2, 'broken', 'error'), (2, 'price', 'skipped'), (2, 'spread', 'skipped')) t(run, step, status)")
def runner_steps(spark, sf_dir):
    """A pipeline run twice: what is there is skipped, what is behind a failure isn't tried."""
    from gridloom.model import VarSpec
    from gridloom.plans.contracts import FunctionProducer, ProducerRegistry
    from gridloom.plans.pipeline import Pipeline
    from gridloom.plans.runner import PipelineRunner

    def broken(inputs, request):
        raise OSError("gone")

    cube = _cube(spark)
    double = lambda inputs, request: inputs["price"].withColumn("value", F.col("value") * 2)
    producers = ProducerRegistry([
        FunctionProducer(lambda inputs, request: _grid(spark, sf_dir), [VarSpec("price")], name="price"),
        FunctionProducer(double, [VarSpec("spread")], ["price"], name="spread"),
        FunctionProducer(broken, [VarSpec("none")], ["price"], name="broken"),
        FunctionProducer(double, [VarSpec("last")], ["none"], name="after_broken"),
    ])
    runner = PipelineRunner(producers, verbose=False)
    pipeline = Pipeline.from_targets(["spread", "last"], producers)
    rows = [(run, s.name, s.status) for run in (1, 2) for s in runner.run(cube, pipeline, result_path=False).steps]
    return spark.createDataFrame(rows, "run int, step string, status string")


@query(f"""
    WITH g AS ({DENSE})
    SELECT a.y, a.x, round(avg(b.value) + 1e-7, 4) AS value FROM g a JOIN g b ON abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY a.y, a.x""")
def tiled_means(spark, sf_dir):
    """Means of 3 x 3 cells by a tiled producer, whose tiles see a halo of one cell."""
    from gridloom.model import Capabilities, Request, VarSpec
    from gridloom.plans.contracts import TiledProducer

    class Means(TiledProducer):
        name, tile = "means", 16
        produces, requires = (VarSpec("mean", dtype="double"),), (VarSpec("price"),)
        capabilities = Capabilities(halo_cells=1, tile_parallel=True)

        def process(self, rows, tile):
            import numpy as np

            field = rows.pivot(index="y", columns="x", values="price")
            padded = np.pad(field.to_numpy(float), 1, constant_values=np.nan)
            near = np.stack([padded[i : i + field.shape[0], j : j + field.shape[1]] for i in range(3) for j in range(3)])
            n = np.isfinite(near).sum(0)
            mean = np.where(n, np.nansum(near, 0) / np.maximum(n, 1), np.nan)
            return rows.assign(value=mean[rows.y - field.index[0], rows.x - field.columns[0]])

    cube = _cube(spark)
    cube.write_static("price", _grid(spark, sf_dir), dtype="double")
    Means().run(cube, Request())
    return cube.read_static("mean").select("y", "x", _near("value").alias("value"))


@query("SELECT (user_id % 8)::INT AS y, (event_id % 8)::INT AS x, min(value) AS value FROM events GROUP BY 1, 2")
def stream_minimum(spark, sf_dir):
    """Events streamed into a static variable by the least-value policy."""
    from gridloom.streaming import ingest

    events = _table(spark, sf_dir, "events")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    cells = stream.select((F.col("user_id") % 8).cast("int").alias("y"), (F.col("event_id") % 8).cast("int").alias("x"), "value")
    cube = _cube(spark, 8)
    cube.init_static("low", dtype="double")
    ingest.merge_stream(cells, cube, "low", MergePolicy.MONOTONE_MIN, f"{cube.root}/stream").awaitTermination()
    return cube.read_static("low")


@query(_blocks(4, "avg"))
def resample_mean(spark, sf_dir):
    return regrid.resample(_grid(spark, sf_dir), 500.0, 2000.0, 32, 32, "mean").withColumn("value", _near("value"))


@query(f"SELECT {_AROUND.x0}::DOUBLE AS x0, {_AROUND.y1}::DOUBLE AS y1, 32614 AS epsg, 1000.0::DOUBLE AS pixel_m, ceil((c.x + 50000) / 1000) - floor((c.x - 50000) / 1000) AS width, ceil((c.y + 50000) / 1000) - floor((c.y - 50000) / 1000) AS height FROM (SELECT {geo.to_utm(-96.797, 32.776, 32614)[0]}::DOUBLE AS x, {geo.to_utm(-96.797, 32.776, 32614)[1]}::DOUBLE AS y) c")
def grid_snap(spark, sf_dir):
    g = Grid.around(-96.797, 32.776, 50_000, 1000)
    return spark.createDataFrame([(float(g.x0), float(g.y1), g.crs_epsg, float(g.pixel_m), float(g.width), float(g.height))], "x0 double, y1 double, epsg int, pixel_m double, width double, height double")
