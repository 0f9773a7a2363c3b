"""Streams of cells into a cube: idempotent appends, and merge policies as running state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gridloom.model import MergePolicy
from gridloom.operators import merge
from gridloom.sources.store import Cube


def running_merge(cells: DataFrame, policy: MergePolicy, keys: tuple[str, ...] = ("y", "x"), sequence: str = "seq") -> DataFrame:
    """Every cell's value over the stream so far, for update or complete mode."""
    return merge.accumulated(cells, policy, keys, sequence)


def windowed_means(cells: DataFrame, window: str, late: str) -> DataFrame:
    """Means of cells over windows of time; rows later than ``late`` are dropped."""
    timed = cells.withWatermark("t", late)
    return timed.groupBy(F.window("t", window), "y", "x").agg(F.avg("value").alias("value")).select(F.col("window.start").alias("t"), "y", "x", "value")


def append_steps(cells: DataFrame, cube: Cube, variable: str, checkpoint: str, **note) -> StreamingQuery:
    """Write each new step of a stream (t, y, x, value) once, however often it is sent.

    A step is taken from the batch that first brings it. A batch that is run
    again after a failure finds its steps in the catalog and writes nothing. The
    number of steps of a batch, not of cells, reaches the driver.
    """

    def write(batch: DataFrame, _: int) -> None:
        batch = batch.withColumn("t", F.col("t").cast("timestamp_ntz")).dropDuplicates(["t", "y", "x"]).persist()
        try:
            for row in batch.select("t").distinct().orderBy("t").collect():
                cube.append_step(variable, row.t, batch.where(F.col("t") == F.lit(row.t)).drop("t"), **note)
        finally:
            batch.unpersist()

    return cells.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merge_stream(cells: DataFrame, cube: Cube, variable: str, policy: MergePolicy, checkpoint: str) -> StreamingQuery:
    """Merge a stream (y, x, value) into a static variable, tile by tile.

    The least and greatest may be merged any number of times. Sums count a batch
    again if it is run again after a failure, so they aren't taken.
    """
    if policy not in (MergePolicy.MONOTONE_MIN, MergePolicy.MONOTONE_MAX):
        raise ValueError("only the least and greatest survive a batch that is run again")

    def write(batch: DataFrame, _: int) -> None:
        cube.write_tiles(variable, merge.accumulated(batch, policy), policy)

    return cells.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
