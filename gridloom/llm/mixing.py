"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight schedule, piecewise linear over training time 0..1.
Its integral is the source's share of the mix; shares are filled like water up
to a cap in passes over the source. A document copy begins at a token offset of
its source (passes times the source's size, plus the sizes before it), and the
time at which the source's cumulative token demand reaches that offset is the
copy's training position: the inverse of the integrated schedule, a quadratic
on each piece. Documents are then range-sorted by position.

Offsets are prefix sums in two levels, so no source meets in one task: sums
within (source, hash prefix), and sums of those sums over at most 4096 prefixes
of a source. Everything is built of DataFrame functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.scratch import FEW, kept, partitions, row_key

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Schedule:
    """A source's weight: ``weight`` times a curve through ``knots`` (time, height).

    Knots run from time 0 to 1 in rising order, heights are not negative. The
    curve is scaled to integrate to ``weight``.
    """

    weight: float
    knots: tuple[tuple[float, float], ...] = ((0.0, 1.0), (1.0, 1.0))

    def pieces(self) -> list[tuple[float, float, float, float]]:
        """(start time, share before it, height at the start, slope), for an integral of 1."""
        area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(self.knots, self.knots[1:]))
        if not area > 0:
            raise ValueError("a schedule must integrate to more than 0")
        out, before = [], 0.0
        for (t0, h0), (t1, h1) in zip(self.knots, self.knots[1:]):
            if t1 <= t0 or min(h0, h1) < 0:
                raise ValueError("knots must rise in time and not fall below 0")
            out.append((t0, before, h0 / area, (h1 - h0) / area / (t1 - t0)))
            before += (t1 - t0) * (h0 + h1) / 2 / area
        return out


#: Sources take these in turn by code point: general text fades, rare text grows.
CURRICULUM = (
    Schedule(5, ((0.0, 1.5), (1.0, 0.5))),
    Schedule(2, ((0.0, 1.0), (1.0, 1.0))),
    Schedule(1, ((0.0, 0.2), (0.5, 0.6), (1.0, 2.2))),
)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, curriculum: tuple[Schedule, ...], cap: int) -> DataFrame:
    """One row per source: size, target and schedule pieces.

    ``sizes``: source, source_size. The fill level solves sum(min(cap * size,
    level * weight)) = sum(size): with the sources in order of cap * size /
    weight, it is the first level that fills no later source. Sources are few,
    and their totals meet in one window.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    kinds = F.array(*[F.lit(int(s.weight)) if float(s.weight).is_integer() else F.lit(float(s.weight)) for s in curriculum])
    kind = F.pmod("rank", F.lit(len(curriculum))).cast("int")
    weighed = ranked.withColumn("kind", kind).withColumn("weight", kinds[F.col("kind")]).withColumn("most", F.col("source_size") * cap)
    by_ratio = Window.orderBy(F.col("most") / F.col("weight"), "rank")
    before, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    levels = (
        weighed.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0))) / F.sum("weight").over(after))
        .withColumn("fits", F.col("level") * F.col("weight") <= F.col("most"))
        .withColumn("level", F.min_by("level", F.when(F.col("fits"), F.col("most") / F.col("weight"))).over(everything))
    )
    pieces = F.array(*[
        F.array(*[F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(("t0", "g0", "h0", "slope"), p)]) for p in s.pieces()])
        for s in curriculum
    ])
    target = F.coalesce(F.least(F.col("most").cast("double"), F.col("level") * F.col("weight")), F.col("most").cast("double"))
    return levels.select("source", "source_size", target.alias("target"), pieces[F.col("kind")].alias("pieces"))


def position(pieces: Column, share: Column) -> Column:
    """The time at which the integrated schedule reaches ``share`` of its whole."""
    piece = F.element_at(F.filter(pieces, lambda p: p["g0"] <= share), -1)
    rest = share - piece["g0"]
    root = F.sqrt(F.greatest(F.lit(0.0), piece["h0"] * piece["h0"] + 2 * piece["slope"] * rest))
    below = piece["h0"] + root
    return F.least(F.lit(1.0), piece["t0"] + F.when(below > 0, 2 * rest / below).otherwise(F.lit(0.0)))


def mix_sources(docs: DataFrame, curriculum: tuple[Schedule, ...] = CURRICULUM, cap: int = 3, size: Column | None = None) -> DataFrame:
    """The mix, one row per input row, range-sorted by first training position.

    Columns: doc_id, source, size, source_size, target, copies (times the mix
    takes the whole document), taken (copies * size), positions (of each copy),
    first_position (null if not taken) and row_key (128 bits of all columns).
    Within a source documents come in the order of md5(doc_id); copy k is taken
    if its middle lies before the source's target, so the words taken differ
    from the target by half a document at most, and no document is taken more
    than ``cap`` times. ``size`` defaults to the number of words.

    Null text has size 0 and is not taken; null sources form one source, the
    last; rows repeating an id, null ids included, are documents of their own.
    Other columns only tell rows apart; no rows give no rows. With no words at
    all, targets are 0.
    """
    mixed = _mix(docs, curriculum, cap, size)
    return mixed.orderBy(F.col("first_position").asc_nulls_last(), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))


def _mix(docs: DataFrame, curriculum: tuple[Schedule, ...], cap: int, size: Column | None) -> DataFrame:
    slim = kept(
        docs.select(
            F.col("doc_id"),
            F.col("source").cast("string").alias("source"),
            (word_count(F.col("text")) if size is None else size).alias("size"),
            F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("place"),
            row_key(docs).alias("row_key"),
        ).withColumn("part", F.substring("place", 1, 3))
    )
    key = [F.coalesce("source", F.lit("")).alias("s"), F.col("source").isNull().alias("none"), "part"]
    keyed = slim.select("doc_id", "source", "size", "place", "row_key", *key)
    # 4096 rows a source at most, however many documents
    parts = kept(keyed.groupBy("s", "none", "part").agg(F.sum("size").alias("part_size")).coalesce(FEW))
    ahead = Window.partitionBy("s", "none").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.withColumn("start", F.coalesce(F.sum("part_size").over(ahead), F.lit(0))).drop("part_size")
    sources = parts.groupBy("s", "none").agg(F.sum("part_size").alias("source_size"))
    sources = sources.withColumn("source", F.when(~F.col("none"), F.col("s")))
    targets = source_targets(sources.select("source", "source_size"), curriculum, cap)
    targets = targets.withColumn("s", F.coalesce("source", F.lit(""))).withColumn("none", F.col("source").isNull()).drop("source")
    heads = starts.join(targets, ["s", "none"])
    within = Window.partitionBy("s", "none", "part").orderBy("place", "size", "row_key").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.col("start") + F.col("inner")
    passes = F.sequence(F.lit(0), F.lit(cap - 1))
    return (
        keyed.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
        .join(heads, ["s", "none", "part"])
        .withColumn("begins", F.transform(passes, lambda k: k * F.col("source_size") + offset))
        .withColumn("begins", F.filter("begins", lambda b: (F.col("size") > 0) & (b + F.col("size") / 2 <= F.col("target"))))
        .withColumn("positions", F.transform("begins", lambda b: position(F.col("pieces"), b / F.col("target"))))
        .withColumn("copies", F.size("positions"))
        .withColumn("first_position", F.element_at(F.when(F.col("copies") > 0, F.col("positions")), 1))
        .select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "positions", "first_position", "row_key")
    )


def training_order(mixed: DataFrame) -> DataFrame:
    """Every taken copy of ``mix_sources``'s rows, range-sorted by position."""
    copies = mixed.select("doc_id", "source", "size", F.posexplode("positions").alias("copy", "position"))
    return copies.orderBy("position", "source", "doc_id", "copy")


def mixed_documents(docs: DataFrame, curriculum: tuple[Schedule, ...] = CURRICULUM, cap: int = 3) -> DataFrame:
    """The mix itself: ``docs``' rows, each as often as it is taken, in training order.

    Positions are times, through which tokens pass evenly: equal parts of time
    make partitions of about equal size, in order, without a sample. Rows that
    are alike in every column are one document, taken as often as they are
    together. Columns may have any names; no rows give no rows.
    """
    spark = docs.sparkSession
    taken = _mix(docs, curriculum, cap, None).where("copies > 0")
    plan = taken.groupBy("row_key").agg(F.flatten(F.collect_list("positions")).alias("positions"), F.count(F.lit(1)).alias("alike"))
    held = docs.select(row_key(docs).alias("by"), F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("row"))

    def met(which) -> DataFrame:
        return held.join(plan.where(which).hint("shuffle_hash"), F.col("by") == F.col("row_key"))

    once = met(F.col("alike") == 1).unionAll(met(F.col("alike") > 1).dropDuplicates(["by"]))
    copies = once.select("row", "by", F.explode("positions").alias("at"))
    n = partitions(spark)
    turn = F.least(F.lit(n - 1), F.floor(F.col("at") * n)).cast("int")
    ordered = copies.repartitionById(n, turn).sortWithinPartitions("at", "by")
    return ordered.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])
