"""Near-dedup by a chosen-path set similarity join over word shingles.

1. Each document becomes a set of shingle hashes and a signature of minwise
   values. Documents with one set are one class; its row with the smallest
   doc_id stands for it, and only these rows are compared.
2. Trees: every tree starts with all classes and has minwise values of its own,
   so trees are independent. A node above ``LEAF`` rows branches by one of its
   tree's values, another at each level, and its path may choose a second one,
   with a probability that makes a linked pair at the threshold meet in one
   child on average. Node sizes come from counts with map-side combine; only
   rows of oversize nodes go on. ``TREES`` trees raise the recall.
3. A leaf compares all its signatures and splits into clusters of rows whose
   estimates allow a link. Clusters that several leaves find are kept once.
4. Full sets are made again from the texts of clustered rows, and each cluster
   confirms links on them, as exact counts. A cluster with more than ``SHINGLES``
   shingles is dealt into blocks, of which every two meet. Within a cluster, rows that are
   already connected need no further link; every other pair that the estimate
   allows is confirmed or refused, so no group's pairs are emitted.
5. Connected components of the links, joined back through the classes.

A node that is still too large at ``DEPTH`` agrees in that many minwise values;
it is cut into blocks, and every block meets every other one in a leaf of its own,
so no pair of the node is left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.batches import Forest, groups, lean
from gridloom.llm.components import components, number_of, ordered_key
from gridloom.llm.scratch import kept, partitions, ship, text_key, written
from gridloom.llm.textkernel import grams, mixed, slices, words_of
from gridloom.llm.token_counts import byte_slices

#: Trees, levels of a tree, values for second branches, and rows of a leaf.
TREES, DEPTH, SECOND, LEAF = 8, 12, 4, 800
#: Minwise values of a tree and of a signature.
OWN = DEPTH + SECOND
VALUES = TREES * OWN
#: Shingles of a cluster that are numbered at once (larger ones compare set by set), and that meet in one worker.
NUMBERED, SHINGLES = 4_000_000, 8_000_000
_LAST = 2**63 - 1
_SALTS = (mixed(np.arange(2 * VALUES, dtype=np.uint64), 5) >> np.uint64(32)).astype(np.uint32)
_XOR, _ODD = _SALTS[:VALUES], _SALTS[VALUES:] | np.uint32(1)


def _sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, ascending, and where each text's begin."""
    w = words_of(texts, lower=True)
    h, n = w.hashes(), w.counts
    g = grams(h, size)
    many = np.maximum(n - size + 1, 0)
    owner = np.repeat(np.arange(len(n)), many)
    at = np.arange(many.sum()) + np.repeat(w.first[:-1] - (np.cumsum(many) - many), many)
    values = g[at] if len(at) else np.zeros(0, np.uint64)
    few = np.flatnonzero((n > 0) & (n < size))
    if len(few):  # the whole sequence is one shingle
        whole = [mixed(grams(h[w.first[i] : w.first[i + 1]], int(n[i])), int(n[i]))[0] for i in few.tolist()]
        owner, values = np.concatenate([owner, few]), np.concatenate([values, np.array(whole, np.uint64)])
    order = np.lexsort((values, owner))
    owner, values = owner[order], values[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    owner, values = owner[new], values[new]
    return values, np.searchsorted(owner, np.arange(len(n) + 1))


def _signatures(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """16 bits of each minwise value, one row for each set that isn't empty."""
    starts = first[:-1][np.diff(first) > 0]
    out = np.zeros((len(starts), VALUES), np.uint16)
    short = (values >> np.uint64(32)).astype(np.uint32)
    for k in range(VALUES if len(starts) else 0):
        out[:, k] = mixed(np.minimum.reduceat((short ^ _XOR[k]) * _ODD[k], starts).astype(np.uint64), 3) & np.uint64(0xFFFF)
    return out


_DOCS = "doc_id long, t binary, n long, class binary, signature binary"


@lean
def _sketched(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, 2):
            values, first = _sets(part.column("text"), size)
            n = np.diff(first)
            signatures = iter(_signatures(values, first))
            classes, sketches = [], []
            for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
                classes.append(hashlib.blake2b(values[a:b].tobytes(), digest_size=16).digest() if b > a else None)
                sketches.append(next(signatures).tobytes() if b > a else None)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("t"), pa.array(n, pa.int64()), pa.array(classes, pa.binary()), pa.array(sketches, pa.binary())],
                ["doc_id", "t", "n", "class", "signature"],
            )


@lean
def _branched(batches: Iterator[pa.RecordBatch], again: float, level: int) -> Iterator[pa.RecordBatch]:
    """Children of (path, tree, row, signature): one of the tree's values, and a second one for some paths."""
    for batch in batches:
        path = batch.column("path").to_numpy(zero_copy_only=False).view(np.uint64)
        if not len(path):
            continue
        tree = batch.column("tree").to_numpy(zero_copy_only=False).astype(np.int64)
        sketch = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint16).reshape(-1, VALUES)
        some = np.flatnonzero((mixed(path, 23) >> np.uint64(11)).astype(np.float64) / 2**53 < again)
        rows = np.concatenate([np.arange(len(path)), some])
        chosen = np.repeat([level, DEPTH + level % SECOND], [len(path), len(some)])
        value = sketch[rows, tree[rows] * OWN + chosen].astype(np.uint64)
        keys = mixed(mixed(path[rows] + chosen.astype(np.uint64), 25) + value, 27)
        at = pa.array(rows)
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), batch.column("tree").take(at), batch.column("v").take(at)], ["path", "tree", "v"])


def _allowed(sketch: np.ndarray, n: np.ndarray, i: int, least: int, similar: tuple[int, int]) -> np.ndarray:
    """Rows after ``i`` that may be linked to it by estimate and size."""
    a, b = similar
    rest = n[i + 1 :]
    sized = (b * np.minimum(rest, n[i]) >= a * np.maximum(rest, n[i])).nonzero()[0] + i + 1
    return sized[(sketch[sized] == sketch[i]).sum(axis=1) >= least]


def _meetings(group: list[bytes], n: list[int], most: int) -> Iterator[list[bytes]]:
    """The group, or where its sets hold more than ``most`` shingles every two blocks of it."""
    if sum(n) <= most:
        yield group
        return
    blocks = [group[a:b] for a, b in byte_slices(n, most // 2)]
    for i, block in enumerate(blocks):
        for other in blocks[i + 1 :]:
            yield block + other


@lean
def _clustered(batches: Iterator[pa.RecordBatch], least: int, similar: tuple[int, int], most: int) -> Iterator[pa.RecordBatch]:
    keys: list[bytes] = []
    rows: list[bytes] = []
    for leaf in groups(batches, "path"):
        ids = leaf.column("v").to_pylist()
        unique = sorted({v: k for k, v in enumerate(ids)}.items())
        if len(unique) < 2:
            continue
        pick = [k for _, k in unique]
        ids = [v for v, _ in unique]
        signatures = leaf.column("signature")
        sketch = np.frombuffer(b"".join(signatures[k].as_py() for k in pick), np.uint16).reshape(-1, VALUES)
        n = leaf.column("n").to_numpy(zero_copy_only=False)[pick]
        forest = Forest(len(ids))
        for i in range(len(ids) - 1):
            for j in _allowed(sketch, n, i, least, similar).tolist():
                forest.join(i, j)
        members: dict[int, list[int]] = {}
        for i in range(len(ids)):
            members.setdefault(forest.find(i), []).append(i)
        for cluster in members.values():
            for group in _meetings([ids[i] for i in cluster], n[cluster].tolist(), most) if len(cluster) > 1 else ():
                keys += [hashlib.blake2b(b"".join(group), digest_size=16).digest()] * len(group)
                rows += group
        if len(rows) > 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(rows, pa.binary())], ["cluster", "v"])
            keys, rows = [], []
    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(rows, pa.binary())], ["cluster", "v"])


@lean
def _full_sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, 0):
            values, first = _sets(part.column("text"), size)
            sets = [values[a:b].tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
            yield pa.RecordBatch.from_arrays([part.column("v"), part.column("clusters"), pa.array(sets, pa.large_binary()).cast(pa.binary())], ["v", "clusters", "shingles"])


def _counter(sets: list[np.ndarray], n: np.ndarray, first: np.ndarray):
    """A function of i and others: how many members set i shares with each other set."""
    if first[-1] > NUMBERED:
        return lambda i, others: [len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for j in others]
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    mark = np.zeros(int(codes.max()) + 1, np.int64)

    def common(i: int, others: list[int]) -> list[int]:
        own = codes[first[i] : first[i + 1]]
        mark[own] = 1
        length = n[others]
        ends = np.cumsum(length)
        spots = np.arange(ends[-1]) + np.repeat(first[others] - (ends - length), length)
        both = np.add.reduceat(mark[codes[spots]], ends - length)
        mark[own] = 0
        return both.tolist()

    return common


@lean
def _confirmed(batches: Iterator[pa.RecordBatch], least: int, similar: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """Links of each cluster that connect it as all its links do."""
    a, b = similar
    for cluster in groups(batches, "cluster"):
        unique = sorted({v: k for k, v in enumerate(cluster.column("v").to_pylist())}.items())
        ids = [v for v, _ in unique]
        column = cluster.column("shingles")
        sets = [np.frombuffer(column[k].as_py(), np.uint64) for _, k in unique]
        n = np.array([len(s) for s in sets])
        first = np.append(0, np.cumsum(n))
        parts = list(byte_slices(n.tolist(), NUMBERED // 4))
        sketch = np.concatenate([_signatures(np.concatenate(sets[i:j]), first[i : j + 1] - first[i]) for i, j in parts])
        common = _counter(sets, n, first)
        forest, links = Forest(len(ids)), []
        for i in range(len(ids) - 1):
            others = [j for j in _allowed(sketch, n, i, least, similar).tolist() if forest.find(j) != forest.find(i)]
            for j, both in zip(others, common(i, others) if others else ()):
                if b * both >= a * int(n[i] + n[j] - both) and forest.join(i, j):
                    links.append((ids[i], ids[j]))
        if links:
            u, v = zip(*links)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary())], ["u", "v"])


def similarity_links(classes: DataFrame, keyed: DataFrame, size: int, similar: tuple[int, int]) -> DataFrame:
    """Links (u, v) between classes; ``keyed``: d, t, text."""
    spark = classes.sparkSession
    share = similar[0] / similar[1]
    again = min(1.0, 1 / share - 1)
    # estimates of pairs at the threshold fall below this about once in 100,000 times
    least = max(1, int(VALUES * share - 4.3 * (VALUES * share * (1 - share)) ** 0.5))
    spread, most = partitions(spark), SHINGLES
    slim = classes.select("v", "signature")
    roots = F.array(*[F.struct(F.lit(int(x)).alias("path"), F.lit(k).alias("tree")) for k, x in enumerate(mixed(np.arange(TREES, dtype=np.uint64), 31).view(np.int64))])
    rows = slim.select(F.inline(roots), "v", "signature")
    leaves, many = [], slim.count() * TREES
    for level in range(DEPTH):
        rows = rows.select("path", "tree", "v", "signature")
        paths = rows.mapInArrow(lambda it, level=level: _branched(it, again, level), "path long, tree int, v binary").persist(StorageLevel.DISK_ONLY)
        sizes = paths.groupBy("path").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
        rows = written(paths.join(sizes, "path"), "grown", many)
        paths.unpersist()
        leaves.append(rows.where(F.col("rows") <= LEAF).select("path", "v"))
        large = rows.where(F.col("rows") > LEAF)
        many = large.count()
        if not many:
            break
        if level == DEPTH - 1:  # blocks by hash of about half a leaf: a leaf holds two, and each two share one
            dealt = large.withColumn("blocks", F.ceil(F.col("rows") * 2 / LEAF)).withColumn("block", F.pmod(F.xxhash64("v"), F.col("blocks")))
            dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("block <> other")
            leaves.append(dealt.select(F.xxhash64("path", F.least("block", "other"), F.greatest("block", "other")).alias("path"), "v"))
            break
        rows = large.join(slim, "v")
    together = leaves[0]
    for more in leaves[1:]:
        together = together.unionAll(more)
    compared = together.join(classes.select("v", "n", "signature"), "v").repartition(spread, "path").sortWithinPartitions("path")
    clusters = compared.mapInArrow(lambda it: _clustered(it, least, similar, most), "cluster binary, v binary")
    wanted = clusters.distinct().join(classes.select("v", "d", "t"), "v").groupBy("d", "t", "v").agg(F.collect_list("cluster").alias("clusters"))
    # the wanted rows are built into a hash table; the texts stream past it unsorted
    texts = keyed.join(wanted.hint("shuffle_hash"), ["d", "t"]).select("text", "v", "clusters")
    sets = texts.mapInArrow(lambda it: _full_sets(it, size), "v binary, clusters array<binary>, shingles binary")
    gathered = sets.select(F.explode("clusters").alias("cluster"), "v", "shingles").repartition(spread, "cluster").sortWithinPartitions("cluster")
    return gathered.mapInArrow(lambda it: _confirmed(it, least, similar), "u binary, v binary")


def near_dedup(docs: DataFrame, size: int = 5, similar: tuple[int, int] = (80, 100), with_key: bool = False) -> DataFrame:
    """Components of documents whose shingle sets have a Jaccard similarity of ``similar`` or more.

    Shingles are ``size`` words in lower case (A-Z); fewer words are one shingle.
    One row per input row: doc_id, n_shingles, component_id (the smallest doc_id
    reachable by links, its own included) and kept (doc_id = component_id).
    Without text or words a document has no shingles and is linked with nothing.
    Null ids count as the largest, and stay null as a component's id. Rows that
    repeat an id are compared as documents of their own. Other columns are
    ignored; no rows give no rows. ``with_key`` adds the text's digest, t.
    """
    ship(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("t"), "text")
    sketched = kept(slim.mapInArrow(lambda it: _sketched(it, size), _DOCS))
    d = F.coalesce("doc_id", F.lit(_LAST))
    classes = (
        sketched.where(F.col("class").isNotNull()).groupBy("class")
        .agg(F.min(F.struct(d.alias("d"), "t")).alias("least"), F.first("n").alias("n"), F.first("signature").alias("signature"))
        .select("class", "least.d", "least.t", "n", "signature")
        .withColumn("v", ordered_key(F.col("d"), F.col("class")))
    )
    classes = kept(classes)
    keyed = slim.select(F.coalesce("doc_id", F.lit(_LAST)).alias("d"), "t", "text")
    links = kept(similarity_links(classes, keyed, size, similar))
    roots = components(links)
    whole = classes.select("class", "v", "d").join(roots, F.col("v") == F.col("node"), "left")
    reached = whole.select("class", F.coalesce(number_of(F.col("root")), "d").alias("least"))
    out = sketched.select("doc_id", "t", F.col("n").alias("n_shingles"), "class").join(reached, "class", "left")
    least = F.coalesce(F.when(F.col("least") != _LAST, F.col("least")), F.col("doc_id"))
    stays = F.col("doc_id").eqNullSafe(least).alias("kept")
    return out.select("doc_id", "n_shingles", least.alias("component_id"), stays, *(["t"] if with_key else []))


def near_deduplicated(docs: DataFrame, size: int = 5, similar: tuple[int, int] = (80, 100)) -> DataFrame:
    """``docs`` with one document of each component, that of the smallest doc_id.

    Of rows that repeat its id and text one stays; documents without words all
    stay. Columns may have any names.
    """
    rows = near_dedup(docs, size, similar, with_key=True)
    keep = rows.where("kept").select(F.coalesce("doc_id", F.lit(_LAST)).alias("to_d"), F.col("t").alias("to_t"), (F.col("n_shingles") == 0).alias("bare")).distinct()
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("row")
    held = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("d"), text_key(F.col("text")).alias("t"), row)
    met = held.join(keep.hint("shuffle_hash"), (F.col("d") == F.col("to_d")) & (F.col("t") == F.col("to_t")))
    each = F.when(F.col("bare"), F.monotonically_increasing_id())
    once = met.withColumn("each", each).dropDuplicates(["d", "t", "each"])
    return once.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])
