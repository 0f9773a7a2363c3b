"""What cells hold after a write meets an earlier one: a keyed full outer join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.model import MergePolicy


def merged(old: Column, new: Column, policy: MergePolicy, written: Column) -> Column:
    """The cell's value; ``written`` tells whether the write holds the cell.

    The least and greatest skip missing values. A sum takes a missing old value
    as 0 and keeps a missing new one. The last writer, and union, take the write
    as it is, missing values too.
    """
    value = {
        MergePolicy.MONOTONE_MIN: F.least(old, new),
        MergePolicy.MONOTONE_MAX: F.greatest(old, new),
        MergePolicy.ACCUMULATE: F.coalesce(old, F.lit(0.0)) + new,
    }.get(MergePolicy(policy), new)
    return F.when(written, value).otherwise(old)


def merge_cells(existing: DataFrame | None, incoming: DataFrame, policy: MergePolicy, keys: tuple[str, ...] = ("y", "x")) -> DataFrame:
    """``incoming`` merged into ``existing`` by key; cells of either side only are kept."""
    policy = MergePolicy(policy)
    if existing is None:
        return incoming.select(*keys, "value")
    if policy in (MergePolicy.LAST_WRITER, MergePolicy.UNION):  # only keys of the old side are compared
        untouched = existing.join(incoming.select(*keys), list(keys), "left_anti")
        return untouched.select(*keys, "value").unionByName(incoming.select(*keys, "value"))
    kind = existing.schema["value"].dataType
    new = incoming.select(*keys, F.col("value").alias("new"), F.lit(True).alias("written"))
    both = existing.select(*keys, F.col("value").alias("old")).join(new, list(keys), "full_outer")
    clean = lambda c: F.when(~F.isnan(c), c)
    value = merged(clean(F.col("old").cast("double")), clean(F.col("new").cast("double")), policy, F.coalesce("written", F.lit(False)))
    return both.select(*keys, value.cast(kind).alias("value"))


def accumulated(writes: DataFrame, policy: MergePolicy, keys: tuple[str, ...] = ("y", "x"), sequence: str = "seq") -> DataFrame:
    """The outcome of many writes at once: an aggregate, combined before the shuffle."""
    value = F.col("value")
    out = {
        MergePolicy.MONOTONE_MIN: F.min(value),
        MergePolicy.MONOTONE_MAX: F.max(value),
        MergePolicy.ACCUMULATE: F.sum(value),
    }.get(MergePolicy(policy), F.max_by(F.struct(value), F.col(sequence))["value"])
    return writes.groupBy(*keys).agg(out.alias("value"))
