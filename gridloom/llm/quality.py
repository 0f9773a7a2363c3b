"""Quality classifier: naive Bayes support vectors.

Features are n-gram indicators, hashed into ``SIZE`` places: runs of one and two
words in lower case, and runs of one to three word shapes (case, digits, marks,
and whether the word repeats the one before). Each indicator is scaled by the
log-count ratio of the classes; a linear hinge-loss model over the scaled,
length-normalised vectors is fitted by dual coordinate descent, and its margin
becomes a probability by a logistic curve fitted on rows that it hasn't seen.

The fit takes at most ``LABELLED`` labelled rows of each class, chosen by a hash
of their id. Only labels and texts are read; the model then scores every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.batches import lean, trim
from gridloom.llm.scratch import ship
from gridloom.llm.textkernel import Words, grams, mixed, slices, words_of

#: Places of hashed features, labelled rows of each class, and rows that hold a feature at least.
SIZE, LABELLED, SEEN = 1 << 20, 2500, 3
#: Of the labelled rows, every so manieth fits the curve; cost of the descent.
CURVE, COST = 4, 1.0
#: The descent ends when no dual's projected gradient in a pass exceeds this, or after so many passes.
GRADIENT, PASSES = 0.01, 100

_UPPER = np.zeros(256, bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_LOWER = np.zeros(256, bool)
_LOWER[ord("a") : ord("z") + 1] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[ord("0") : ord("9") + 1] = True
_SIGNS = np.where(_UPPER | _LOWER | _DIGIT | (np.arange(256) >= 128), 0, mixed(np.arange(256, dtype=np.uint64), 41)).astype(np.uint64)


def _shapes(w: Words, h: np.ndarray) -> np.ndarray:
    """A number for each word's case, digits, marks, and whether it is the one before again."""
    at = w.bounds[:-1]
    upper, lower = _UPPER[w.data], _LOWER[w.data]
    lead = np.flatnonzero(w.data[:-1] == 0xC3)  # U+00C0 to U+00FF
    upper[lead] |= w.data[lead + 1] < 0x9F
    lower[lead] |= w.data[lead + 1] >= 0x9F
    ups, lows = np.add.reduceat(upper.astype(np.int32), at), np.add.reduceat(lower.astype(np.int32), at)
    digits = np.add.reduceat(_DIGIT[w.data].astype(np.int32), at)
    marks = np.add.reduceat(_SIGNS[w.data], at)
    case = np.minimum(ups, 2) * 3 + np.minimum(lows, 2)
    again = np.zeros(len(h), np.int64)
    again[1:] = h[1:] == h[:-1]
    again[w.first[:-1][w.counts > 0]] = 0
    return mixed(marks + (case * 4 + np.minimum(digits, 1) * 2 + again).astype(np.uint64), 43)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct features, ascending, and where each text's begin."""
    w = words_of(texts, lower=False)
    n = len(texts)
    if not len(w.bounds) - 1:
        return np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
    low = Words(np.where(_UPPER[w.data], w.data + 32, w.data).astype(np.uint8), w.bounds, w.first)
    h = low.hashes()
    owner = np.repeat(np.arange(n), w.counts)
    keys = []
    for kind, (sequence, size) in enumerate([(h, 1), (h, 2), *((_shapes(w, h), k) for k in (1, 2, 3))]):
        g = mixed(grams(sequence, size), 50 + kind) % np.uint64(SIZE)
        whole = owner[: len(g)] == owner[size - 1 :]
        keys.append(owner[: len(g)][whole] * SIZE + g[whole].astype(np.int64))
    found = np.sort(np.concatenate(keys))
    new = np.ones(len(found), bool)
    new[1:] = found[1:] != found[:-1]
    found = found[new]
    return found % SIZE, np.searchsorted(found, np.arange(n + 1) * SIZE)


@dataclass
class Model:
    """score = logistic(slope * (weights . x / |ratio . x|) + shift), x being indicators."""

    weights: np.ndarray
    ratio: np.ndarray
    bias: float
    slope: float
    shift: float

    def margins(self, places: np.ndarray, first: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(self.weights[places], dtype=np.float64)])
        norms = np.concatenate([[0.0], np.cumsum(np.square(self.ratio[places], dtype=np.float64))])
        total, norm = np.diff(sums[first]), np.sqrt(np.maximum(np.diff(norms[first]), 0))
        return np.where(norm > 1e-9, total / np.maximum(norm, 1e-9), 0.0) + self.bias

    def scores(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.shift, -30, 30)))


def _descent(rows: list[np.ndarray], values: list[np.ndarray], signs: np.ndarray, costs: np.ndarray, passes: int) -> tuple[np.ndarray, float]:
    """Weights and bias of least hinge loss plus half their square, by dual coordinates."""
    w, bias = np.zeros(SIZE), 0.0
    dual, rng = np.zeros(len(rows)), np.random.default_rng(11)
    norms = np.array([v @ v for v in values]) + 1
    for _ in range(passes):
        steepest = 0.0
        for i in rng.permutation(len(rows)):
            at, x, y = rows[i], values[i], signs[i]
            slack = y * (w[at] @ x + bias) - 1
            # at a bound only the way back counts
            steepest = max(steepest, -slack if not dual[i] else slack if dual[i] == costs[i] else abs(slack))
            new = min(max(dual[i] - slack / norms[i], 0.0), costs[i])
            if new != dual[i]:
                step = (new - dual[i]) * y
                w[at] += step * x
                bias += step
                dual[i] = new
        if steepest < GRADIENT:
            break
    return w, bias


def _curve(margins: np.ndarray, labels: np.ndarray, share: float) -> tuple[float, float]:
    """Slope and shift of the logistic curve, with classes weighed to ``share`` of label 1."""
    good = labels == 1
    weight = np.where(good, share / max(good.sum(), 1), (1 - share) / max((~good).sum(), 1))
    target = np.where(good, (good.sum() + 1) / (good.sum() + 2), 1 / ((~good).sum() + 2))
    slope, shift = 1.0, 0.0
    for _ in range(200):  # Newton's method, damped
        p = 1 / (1 + np.exp(-np.clip(slope * margins + shift, -30, 30)))
        error, curve = weight * (p - target), weight * p * (1 - p)
        gradient = np.array([error @ margins + 1e-6 * slope, error.sum()])
        hessian = np.array([[curve @ margins**2 + 1e-6, curve @ margins], [curve @ margins, curve.sum() + 1e-9]])
        step = np.linalg.solve(hessian + 1e-7 * np.eye(2), gradient)
        step *= min(1.0, 2 / max(np.abs(step).max(), 1e-12))
        slope, shift = slope - step[0], shift - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(slope), float(shift)


def fitted(rows: list[np.ndarray], labels: np.ndarray, share: float) -> Model:
    """A model of documents' feature places and labels (0 and 1); ``share``: label 1 among all labels."""
    if not len(rows) or labels.min() == labels.max():  # nothing to tell apart
        only = float(labels[0]) if len(rows) else 0.5
        zeros = np.zeros(SIZE, np.float32)
        return Model(zeros, zeros, 0.0, 0.0, 30.0 * (2 * only - 1))
    train = np.arange(len(rows)) % CURVE > 0
    if labels[train].min() == labels[train].max() or labels[~train].min() == labels[~train].max():
        train[:] = True
    counts = np.ones((2, SIZE))
    for r, y, t in zip(rows, labels, train):
        if t:
            counts[y][r] += 1
    seen = counts.sum(0) - 2 >= SEEN
    ratio = np.where(seen, np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum()), 0.0)
    known = [r[ratio[r] != 0] for r in rows]
    values = [ratio[r] / max(np.linalg.norm(ratio[r]), 1e-9) for r in known]
    pick = np.flatnonzero(train)
    signs = np.where(labels == 1, 1.0, -1.0)
    many = np.bincount(labels[train], minlength=2)
    costs = COST * len(pick) / (2 * np.maximum(many, 1))[labels]
    w, bias = _descent([known[i] for i in pick], [values[i] for i in pick], signs[pick], costs[pick], PASSES)
    margins = np.array([w[r] @ v + bias for r, v in zip(known, values)])
    checked = ~train if (~train).any() else train
    slope, shift = _curve(margins[checked], labels[checked], share)
    return Model((w * ratio).astype(np.float32), ratio.astype(np.float32), bias, slope, shift)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


@lean
def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, 1):
            places, first = features(part.column("text"))
            rows = [places[a:b].astype(np.int32).tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
            yield pa.RecordBatch.from_arrays([part.column("quality"), part.column("place"), pa.array(rows, pa.binary())], ["quality", "place", "features"])


def train_quality(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on labels of rows that aren't held out.

    Labels other than 0 and 1, null ids, ids labelled both ways and labels
    without a document are passed over; labels and ids that repeat count once
    (an id with several texts by the least of them).
    """
    ship(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("quality")).where("quality in (0, 1) and id is not null")
    known = known.where(~held_out(F.col("id"))).groupBy("id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).where("quality = most").drop("most")
    share = known.agg(F.avg("quality")).first()[0]
    place = F.xxhash64("id")
    picked = [known.where(F.col("quality") == y).withColumn("place", place).orderBy("place", "id").limit(LABELLED) for y in (0, 1)]
    # 2 * LABELLED rows at most; of an id that repeats, the least text counts
    some = F.broadcast(picked[0].unionAll(picked[1]))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text")).join(some, "id")
    texts = texts.groupBy("id", "quality", "place").agg(F.min("text").alias("text")).select("quality", "text", "place")
    rows = texts.mapInArrow(_featured, "quality int, place long, features binary").toArrow()
    rows = sorted(zip(rows.column("place").to_pylist(), rows.column("features").to_pylist(), rows.column("quality").to_pylist()))
    model = fitted([np.frombuffer(f, np.int32) for _, f, _ in rows], np.array([y for _, _, y in rows], np.int64), share if share is not None else 0.5)
    del rows
    trim()
    return model


@lean
def _scored(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, batch.schema.get_field_index("text_in")):
            scores = model.scores(model.margins(*features(part.column("text_in"))))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(scores)], [*part.schema.names[:-1], "score"])


def _wide_scores(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """c0, c1 .. (the columns ``keep``) and score."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)  # SIZE numbers, however many documents
    wide = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], F.col("text").alias("text_in"))
    schema = ", ".join([*(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)), "score double"])
    return wide.mapInArrow(lambda it: _scored(it, shared.value), schema)


def score_quality(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of every row of ``docs`` and its text's score, 0 to 1.

    Null and empty texts, which have no features, get the curve's value at the
    model's bias. Columns may have any names; no rows give no rows.
    """
    return _wide_scores(docs, model, keep).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], "score")


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from a score of 0.5 on)."""
    scored = score_quality(docs, train_quality(docs, labels), ["doc_id"])
    return scored.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """``docs`` without those that score below ``least``."""
    scored = _wide_scores(docs, train_quality(docs, labels), docs.columns)
    return scored.where(F.col("score") >= least).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
