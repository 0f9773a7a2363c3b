"""Embedding near-dedup by product quantisation over coarse inverted lists.

1. Vectors that are alike in every component are one class; one row stands for it.
2. A bounded sample trains coarse centroids and, on the residuals, a codebook
   for each subspace. All vectors are indexed: nearest list, codes of the
   residual, and the distance between the vector and what its codes stand for.
3. Sufficient probes: of unit vectors, a linked pair is no further apart than
   ``reach``. Where its lists differ, the plane between both centroids lies
   between them, and their distances from it add up to ``reach`` at most: with
   probes to half of it, one of them probes the other's list. Each vector probes
   all lists whose plane is within a margin, which is measured: on pairs of the
   sample at the very cosine, turned towards other vectors of the sample, the
   least margin that finds ``RECALL`` of them, and never more than half, with
   which all are found. A pair that both sides find counts in the lesser list.
4. Table lookups sum the distance between query and codes (asymmetric). It errs
   by the stored distance at most, so a pair beyond ``reach`` plus that is none.
   The rest is checked by its exact cosine.
5. Blocks of lists meet blocks of probes, so no list meets in one task. A pair
   of blocks returns how many vectors each class is linked with and a spanning
   forest of its links, not the links. Components follow from the forests.

Step 4 loses no link, and step 3 at most the share it has measured.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.batches import Forest, groups, lean
from gridloom.llm.components import components, number_of, ordered_key
from gridloom.llm.scratch import kept, partitions, ship

#: Vectors that train the index, lists at most, codewords, and dimensions of a subspace.
SAMPLE, LISTS, CODES, SUBSPACE = 20_000, 4096, 128, 4
#: Share of pairs at the cosine itself that probes must find (1: all, by the half), and pairs that measure it.
RECALL, PAIRS = 0.995, 4000
#: Rows of a list's block and of a block of probes.
BLOCK, PROBES = 512, 2048
_LAST = 2**63 - 1


def _units(column: pa.Array) -> np.ndarray:
    """Rows of equal length, without nulls, as unit vectors."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _square_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T, 0)


def _means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centers = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = np.concatenate([_square_distances(part, centers).argmin(1) for part in np.array_split(x, max(1, len(x) // 4096))])
        count = np.bincount(near, minlength=len(centers))
        total = np.zeros_like(centers)
        np.add.at(total, near, x)
        centers = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centers)
    return centers


def _turned(x: np.ndarray, cosine: float, rng: np.random.Generator) -> np.ndarray:
    """For each row a unit vector at ``cosine`` to it, in the direction of one other row or between two."""
    n = len(x)
    to = x[rng.permutation(n)] - x[rng.permutation(n)] * rng.integers(0, 2, n)[:, None]
    to -= (to * x).sum(1)[:, None] * x
    length = np.linalg.norm(to, axis=1, keepdims=True)
    return np.where(length > 1e-9, cosine * x + math.sqrt(max(0.0, 1 - cosine * cosine)) * to / np.maximum(length, 1e-9), x)


@dataclass
class Index:
    centers: np.ndarray  # lists x dimensions
    books: list[np.ndarray]  # for each subspace: codewords x its dimensions
    cuts: list[tuple[int, int]]
    reach: float
    margin: float = 0.5  # of reach

    @staticmethod
    def trained(x: np.ndarray, lists: int, cosine: float) -> Index:
        """An index of the sample ``x``; every fourth row only measures the margin."""
        rng = np.random.default_rng(7)
        held = np.arange(len(x)) % 4 == 3
        fit = x[~held]
        centers = _means(fit, lists, 8, rng)
        rest = fit - centers[_square_distances(fit, centers).argmin(1)]
        cuts = [(a, min(a + SUBSPACE, x.shape[1])) for a in range(0, x.shape[1], SUBSPACE)]
        index = Index(centers, [_means(rest[:, a:b], CODES, 6, rng) for a, b in cuts], cuts, math.sqrt(max(0.0, 2 - 2 * cosine)))
        if RECALL < 1 and held.any() and index.reach > 0:
            a = x[held][rng.integers(0, held.sum(), PAIRS)]
            b = _turned(a, cosine, rng)
            (near_a, planes_a), (near_b, planes_b) = index.planes(a), index.planes(b)
            rows = np.arange(PAIRS)
            least = np.where(near_a == near_b, 0.0, np.minimum(planes_a[rows, near_b], planes_b[rows, near_a]))
            index.margin = float(min(0.5, max(0.0, np.quantile(least, RECALL)) / index.reach))
        return index

    def planes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest lists, and distances to the planes that part them from all others."""
        far = _square_distances(x, self.centers)
        near = far.argmin(1)
        between = np.sqrt(_square_distances(self.centers, self.centers))[near]
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = (far - far[np.arange(len(x)), near][:, None]) / (2 * between)
        # centroids that coincide share their vectors: no plane divides them
        return near, np.where(np.isnan(plane), 0.0, plane)

    def placed(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """Nearest lists, codes, distances to the codes' vectors, and other lists to probe."""
        near, plane = self.planes(x)
        rest = x - self.centers[near]
        codes = np.stack([_square_distances(rest[:, a:b], book).argmin(1) for (a, b), book in zip(self.cuts, self.books)], 1).astype(np.uint8)
        error = np.linalg.norm(rest - self.decoded(codes), axis=1)
        open_ = plane <= self.margin * self.reach + 1e-7
        open_[np.arange(len(x)), near] = False
        return near, codes, error, [np.flatnonzero(row) for row in open_]

    def probes(self, x: np.ndarray, own: int, lists: np.ndarray) -> np.ndarray:
        """Whether each row of ``x``, of list ``own``, probes the list beside it."""
        far = lambda c: ((x - c) ** 2).sum(1)
        between = np.sqrt(((self.centers[lists] - self.centers[own]) ** 2).sum(1))
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = (far(self.centers[lists]) - far(self.centers[own])) / (2 * between)
        return np.where(np.isnan(plane), 0.0, plane) <= self.margin * self.reach + 1e-7

    def decoded(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([book[codes[:, k]] for k, book in enumerate(self.books)], 1)

    def looked_up(self, queries: np.ndarray, list_: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances of queries (of any list) to coded vectors of one list."""
        rest = queries - self.centers[list_]
        out = np.zeros((len(queries), len(codes)))
        for k, ((a, b), book) in enumerate(zip(self.cuts, self.books)):
            out += _square_distances(rest[:, a:b], book)[:, codes[:, k]]
        return out


@lean
def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors = batch.column("embedding")
        flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
        ends = np.append(0, np.cumsum([len(v) for v in vectors]))
        names = [hashlib.blake2b(flat[a:b].tobytes(), digest_size=16).digest() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(names, pa.binary()), vectors], ["vec_id", "class", "embedding"])


_PLACED = "list int, role int, own int, v binary, size long, embedding {}, codes binary, error double"


@lean
def _placed(batches: Iterator[pa.RecordBatch], index: Index) -> Iterator[pa.RecordBatch]:
    """Each vector as a member of its list (role 0) and as a probe of others (role 1)."""
    for whole in batches:
        for start in range(0, whole.num_rows, 1024):
            batch = whole.slice(start, 1024)
            near, codes, error, probes = index.placed(_units(batch.column("embedding")))
            at = np.repeat(np.arange(len(near)), [1 + len(p) for p in probes])
            lists = np.concatenate([np.append(n, p) for n, p in zip(near, probes)])
            role = np.ones(len(at), np.int32)
            role[np.append(0, np.cumsum([1 + len(p) for p in probes])[:-1])] = 0
            rows = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(lists, pa.int32()), pa.array(role), pa.array(near[at], pa.int32()), rows.column("v"), rows.column("size"), rows.column("embedding"),
                    pa.array([codes[i].tobytes() if r == 0 else None for i, r in zip(at, role)], pa.binary()), pa.array(error[at]),
                ],
                ["list", "role", "own", "v", "size", "embedding", "codes", "error"],
            )


@lean
def _compared(batches: Iterator[pa.RecordBatch], index: Index, cosine: float) -> Iterator[pa.RecordBatch]:
    """Of each pair of blocks: (v, links) and (v, other end of a forest's link)."""
    for cell in groups(batches, "cell"):
        role = cell.column("side").to_numpy(zero_copy_only=False)
        members, queries = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
        if not len(members) or not len(queries):
            continue
        list_, within = cell.column("list")[0].as_py(), cell.column("within")[0].as_py()
        x = _units(cell.column("embedding"))
        ids, size = cell.column("v").to_pylist(), cell.column("size").to_numpy(zero_copy_only=False)
        codes = np.frombuffer(b"".join(cell.column("codes")[int(k)].as_py() for k in members), np.uint8).reshape(len(members), -1)
        most = (index.reach + cell.column("error").to_numpy(zero_copy_only=False)[members] + 1e-6) ** 2
        a, b = np.nonzero(index.looked_up(x[queries], list_, codes) <= most[None])
        q, m = queries[a], members[b]
        if within:  # both sides are of this list: a pair is compared once
            name = np.array(ids, object)
            once = name[q] < name[m]
            q, m = q[once], m[once]
        hit = np.zeros(len(q), bool)
        for start in range(0, len(q), 65_536):
            part = slice(start, start + 65_536)
            hit[part] = np.einsum("ij,ij->i", x[q[part]], x[m[part]]) >= cosine
        q, m = q[hit], m[hit]
        if not within:  # where both probe the other's list, the lesser list counts the pair
            own = cell.column("own").to_numpy(zero_copy_only=False)[q]
            counts = (list_ < own) | ~index.probes(x[m], list_, own)
            q, m = q[counts], m[counts]
        links = np.bincount(q, size[m], len(ids)).astype(np.int64) + np.bincount(m, size[q], len(ids)).astype(np.int64)
        # a member may stand on both sides of a cell; its first row is its node
        first: dict[bytes, int] = {}
        node = [first.setdefault(v, k) for k, v in enumerate(ids)]
        forest = Forest(len(ids))
        ends = [(ids[i], ids[j]) for i, j in zip(q.tolist(), m.tolist()) if forest.join(node[i], node[j])]
        linked = np.flatnonzero(links)
        v = [ids[k] for k in linked] + [u for u, _ in ends]
        other = [None] * len(linked) + [w for _, w in ends]
        yield pa.RecordBatch.from_arrays(
            [pa.array(v, pa.binary()), pa.array([*links[linked].tolist(), *[0] * len(ends)], pa.int64()), pa.array(other, pa.binary())],
            ["v", "links", "other"],
        )


def _similar(members: DataFrame, cosine: float) -> DataFrame:
    """(v, links, other) of one vector length; ``members``: v, class, size, embedding."""
    spark = members.sparkSession
    total = members.count()
    sample = members.orderBy(F.xxhash64("class"), "v").limit(SAMPLE).select("embedding").toArrow()
    lists = max(1, min(LISTS, round(math.sqrt(total))))
    index = Index.trained(_units(sample.column(0).combine_chunks()), lists, cosine)
    shared = spark.sparkContext.broadcast(index)  # bounded by LISTS and CODES
    placed = members.select("v", "size", "embedding").mapInArrow(lambda it: _placed(it, shared.value), _PLACED.format(members.schema["embedding"].dataType.simpleString()))
    placed = kept(placed)
    sizes = placed.groupBy("list").agg(F.sum(1 - F.col("role")).alias("own"), F.sum("role").alias("probes"))
    sizes = F.broadcast(sizes.select("list", F.ceil(F.col("own") / BLOCK).alias("blocks"), F.ceil(F.col("probes") / PROBES).alias("turns")))  # LISTS rows at most
    sized = placed.join(sizes, "list").withColumn("block", F.pmod(F.xxhash64("v"), F.greatest("blocks", F.lit(1))))
    sized = sized.withColumn("turn", F.pmod(F.xxhash64("v"), F.greatest("turns", F.lit(1))))
    none = F.array().cast("array<bigint>")
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(none)
    keep = ["list", "own", "v", "size", "embedding", "codes", "error"]
    member, probe = F.col("role") == 0, F.col("role") == 1

    def side(rows: DataFrame, block, turn, within: bool, which: int) -> DataFrame:
        return rows.select(*keep, block, turn, F.lit(within).alias("within"), F.lit(which).alias("side"))

    block, turn = F.col("block"), F.col("turn")
    within = side(sized.where(member), block, F.explode(upto(F.col("blocks"))).alias("turn"), True, 0).unionAll(
        side(sized.where(member), F.explode(upto(F.col("blocks"))).alias("block"), block.alias("turn"), True, 1)
    )
    across = side(sized.where(member), block, F.explode(upto(F.col("turns"))).alias("turn"), False, 0).unionAll(
        side(sized.where(probe), F.explode(upto(F.col("blocks"))).alias("block"), turn, False, 1)
    )
    cells = within.unionAll(across).withColumn("cell", F.xxhash64("list", "block", "turn", "within"))
    cells = cells.repartition(4 * partitions(spark), "cell").sortWithinPartitions("cell")
    return cells.mapInArrow(lambda it: _compared(it, shared.value, cosine), "v binary, links long, other binary")


def embedding_dedup(vectors: DataFrame, cosine: float = 0.9) -> DataFrame:
    """Vectors linked by a cosine of ``cosine`` or more, in double precision.

    One row per input row: vec_id, n_links (other rows linked directly),
    component_id (the smallest vec_id reachable, its own included) and kept
    (vec_id = component_id). Vectors that are null, empty, zero, or hold null or
    non-finite components are linked with nothing, nor are vectors of different
    lengths. Null ids count as the largest. Rows repeating an id are vectors of
    their own. Other columns are ignored; no rows give no rows.
    """
    spark = vectors.sparkSession
    ship(spark)
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    kind = vectors.schema["embedding"].dataType.simpleString()
    kind = kind if kind == "array<float>" else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"))
    usable = rows.where(F.coalesce(fine, F.lit(False)))
    named = kept(usable.mapInArrow(_classes, f"vec_id long, class binary, embedding {kind}"))
    members = named.groupBy("class").agg(
        F.min(F.coalesce("vec_id", F.lit(_LAST))).alias("d"), F.count(F.lit(1)).alias("size"), F.first("embedding").alias("embedding")
    )
    members = kept(members.withColumn("v", ordered_key(F.col("d"), F.col("class"))))
    lengths = [r[0] for r in members.select(F.size("embedding")).distinct().collect()]
    empty = spark.createDataFrame([], "v binary, links long, other binary")
    found = empty
    for n in lengths:
        found = found.unionAll(_similar(members.where(F.size("embedding") == n), cosine))
    found = kept(found)
    links = found.where("other is null").groupBy("v").agg(F.sum("links").alias("links"))
    roots = components(found.where("other is not null").select(F.col("v").alias("u"), F.col("other").alias("v")))
    known = members.select("class", "v", "d", "size").join(links, "v", "left").join(roots.withColumnRenamed("node", "v"), "v", "left")
    known = known.select("class", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce(number_of(F.col("root")), "d").alias("least"))
    least = F.coalesce(F.when(F.col("least") != _LAST, F.col("least")), F.col("vec_id"))
    stays = F.col("vec_id").eqNullSafe(least)
    linked = named.select("vec_id", "class").join(known, "class").select("vec_id", "n_links", least.alias("component_id"), stays.alias("kept"))
    alone = rows.where(~F.coalesce(fine, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    return linked.unionAll(alone)
