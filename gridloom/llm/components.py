"""Connected components by hooking to the least neighbour and contracting.

Each round gives every node the least of itself and its neighbours as parent,
shortens the parents by pointer jumping, and replaces the edges' ends by them;
edges within a tree vanish. Rounds end when no edge is left, about the logarithm
of the longest chain. Each step is an equi-join of written tables, which adaptive
execution can split where a node has many edges; each round ends with written
tables, and nothing goes to the driver but the number of edges left.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.scratch import remove, written


_TURN = -(2**63)


def ordered_key(number: Column, rest: Column) -> Column:
    """Bytes that sort as (number, rest) do; ``rest`` is binary."""
    return F.concat(F.unhex(F.lpad(F.hex(number.bitwiseXOR(F.lit(_TURN))), 16, "0")), rest)


def number_of(key: Column) -> Column:
    """The number in an ``ordered_key``."""
    return F.conv(F.hex(F.substring(key, 1, 8)), 16, -10).cast("long").bitwiseXOR(F.lit(_TURN))


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.where("u <> v").select("u", "v").unionAll(edges.where("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()


def _jumped(parents: DataFrame) -> DataFrame:
    above = parents.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
    return parents.join(above, "parent", "left").select("node", F.coalesce("grand", "parent").alias("parent"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node with an edge; root is the least node reachable.

    ``edges``: columns u and v of one orderable type; loops and repeats are
    allowed. No edges give no rows.
    """
    left = written(_both_ways(edges), "edges")
    roots, nodes = None, 0
    while many := left.count():
        nodes = nodes or many
        least = left.groupBy("u").agg(F.min("v").alias("least"))
        hooked = least.select(F.col("u").alias("node"), F.least("u", "least").alias("parent")).persist(StorageLevel.DISK_ONLY)
        once = _jumped(hooked).persist(StorageLevel.DISK_ONLY)
        parents = written(_jumped(once), "parents", nodes)
        moved = left
        for end in ("u", "v"):
            to = parents.select(F.col("node").alias(end), F.col("parent").alias("to"))
            moved = moved.join(to, end).drop(end).withColumnRenamed("to", end)
        fewer = written(moved.where("u <> v").select("u", "v").distinct(), "edges", many)
        if roots is None:
            roots = parents.select("node", F.col("parent").alias("root"))
        else:
            to = parents.select(F.col("node").alias("root"), F.col("parent").alias("to"))
            roots = written(roots.join(to, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "roots", nodes)
        for done in (hooked, once):
            done.unpersist()
        remove(left.sparkSession, left)
        left = fewer
    return roots if roots is not None else left.select(F.col("u").alias("node"), F.col("v").alias("root"))
