"""Line dedup by a suffix array over line-ID sequences.

A document's lines that aren't blank form a sequence of line IDs (128-bit
hashes). Texts that are equal are one sequence; its document with the smallest
doc_id stands for them, and the others repeat it as a whole.

1. Prefix doubling ranks the suffixes: all lines are sorted by ID, and a line's
   rank is the place where its equals begin. Round by round, suffixes that share
   a rank at depth h are sorted by the rank of the suffix h lines on, until none
   share one; the ranks are then the suffix array. Suffixes that are alone keep
   their rank and aren't sorted again; lines that occur once never take part.
2. A sort is by range over all executors with the line's place as the last key,
   so equal keys may fall into several chunks. Each chunk is numbered by itself,
   and the counts at chunks' edges, carried over on the driver (two rows for each
   ``CHUNK`` rows), make the numbers global.
3. Where a sort splits suffixes of one rank, two neighbours of the suffix array
   are known to share h lines; how many more, less than h, is found by comparing
   their ranks at the depths h/2, h/4 .. 1. These are the longest common prefixes.
4. One scan each way over the array turns the prefixes' intervals into, for each
   suffix, the longest run of lines that also starts earlier. A chunk passes on
   the earliest suffix for each length of prefix, no more entries than lengths.
5. A run that isn't part of the run one line before is maximal. Maximal runs with
   text enough are deleted: the first copy stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.batches import lean
from gridloom.llm.scratch import FILE_ROWS, kept, partitions, ship, text_key, written

WORD = r"[^\x20\x09-\x0D]"
BLANK = " \t\n\x0b\x0c\r"
#: Characters of a run that is deleted, at least.
LEAST_CHARS = 40
#: Rows that are numbered at once.
CHUNK = 1 << 18
_LAST = 2**63 - 1
_LEAD_CLASS, _LEAD, _TAIL, _FIRST, _FINAL, _MORE = (1 << k for k in range(6))


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, pa.Table]]:
    """A partition's rows in tables of ``size`` rows with ascending numbers."""
    held, rows, number = [], 0, 0
    for batch in batches:
        while batch.num_rows:
            take = batch.slice(0, size - rows)
            batch = batch.slice(take.num_rows)
            held.append(take)
            rows += take.num_rows
            if rows == size:
                yield number, pa.Table.from_batches(held)
                held, rows, number = [], 0, number + 1
    if held:
        yield number, pa.Table.from_batches(held)


def _runs(new: np.ndarray) -> np.ndarray:
    """Each row's place in its run; ``new`` marks where runs begin."""
    at = np.arange(len(new))
    return at - np.maximum.accumulate(np.where(new, at, 0))


_PLACED = "chunk long, flags int, sharing long, in_class long, in_group long, prev long, p long, s long, rank long, next long, more long"


@lean
def _numbered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (rank, next, more, p), and their places in runs of equal ranks and of equal keys."""
    for piece, table in _chunks(batches, size):
        part, p, rank, following, more = (table.column(n).to_numpy() for n in ("part", "p", "rank", "next", "more"))
        class_, group = np.ones(len(p), bool), np.ones(len(p), bool)
        class_[1:] = rank[1:] != rank[:-1]
        group[1:] = class_[1:] | (following[1:] != following[:-1]) | (more[1:] != more[:-1])
        in_class, in_group, at = _runs(class_), _runs(group), np.arange(len(p))
        flags = np.where(at == in_class, _LEAD_CLASS, 0) | np.where(at == in_group, _LEAD, 0)
        flags[np.flatnonzero(group)[-1] :] |= _TAIL
        flags[:-1] |= np.where(group[1:], 0, _MORE)
        flags[0] |= _FIRST
        flags[-1] |= _FINAL
        sharing = np.zeros(len(p), np.int64)  # rows of the chunk that share a key, at its last row
        sharing[-1] = np.count_nonzero((in_group > 0) | (flags & _MORE > 0))
        made = [
            pa.array((part.astype(np.int64) << 24) + piece), pa.array(flags.astype(np.int32)), pa.array(sharing), pa.array(in_class), pa.array(in_group),
            pa.array(np.append(-1, p[:-1]), mask=np.append(True, following[:-1] < 0)),
        ]
        names = ["p", "s", "rank", "next", "more"]
        yield from pa.Table.from_arrays([*made, *table.select(names).columns], ["chunk", "flags", "sharing", "in_class", "in_group", "prev", *names]).to_batches()


def _carried(edges: list) -> tuple[list[tuple], int]:
    """For each chunk: how many rows of its first class and of its first key stand before it,
    whether its last key goes on, and the suffix before. Also how many rows share a key, at least
    (one of either side where a key goes on).
    """
    chunks: dict[int, list] = {}
    for row in edges:
        ends = chunks.setdefault(row.chunk, [None, None])
        if row.flags & _FIRST:
            ends[0] = row
        if row.flags & _FINAL:
            ends[1] = row
    out, shared, before = [], 0, None
    for chunk, (first, final) in sorted(chunks.items()):
        class_ = group = 0
        prev = None
        if before:
            last, n_class, n_group = before
            if last.rank == first.rank:
                class_ = n_class
                group = n_group if (last.next, last.more) == (first.next, first.more) else 0
            prev = last.p if last.next >= 0 else None
            if group:
                out[-1][3] = True
                shared += 2
        shared += final.sharing
        out.append([chunk, class_, group, False, prev])
        n_class = final.in_class + 1 + (class_ if final.flags & _LEAD_CLASS else 0)
        before = final, n_class, final.in_group + 1 + (group if final.flags & _LEAD else 0)
    return [tuple(r) for r in out], shared


def _ranked(rows: DataFrame, tag: str, many: int | None = None) -> tuple[DataFrame, int]:
    """``rows`` (p, s, rank, next, more; about ``many``) with their new ranks, and how many suffixes still share one.

    Columns: p, s, rank, many (others share it), opens (it is the first of its
    rank and parts its old class there), next, prev (the suffix before it).
    """
    spark = rows.sparkSession
    keys = ["rank", "next", "more", "p"]
    size, parts = CHUNK, partitions(spark)
    if many is not None:
        parts = min(parts, many // FILE_ROWS + 1)
    spread = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    table = spread.select("s", *keys, F.spark_partition_id().alias("part")).mapInArrow(lambda it: _numbered(it, size), _PLACED)
    table = table.persist(StorageLevel.DISK_ONLY)
    flag = lambda f: F.col("flags").bitwiseAND(f) != 0
    carries, shared = _carried(table.where(flag(_FIRST | _FINAL)).collect())  # two rows a chunk
    held = F.broadcast(spark.createDataFrame(carries, "chunk long, c_class long, c_group long, goes_on boolean, c_prev long"))
    group = F.col("in_group") + F.when(flag(_LEAD), F.col("c_group")).otherwise(0)
    new = F.col("rank") + F.col("in_class") + F.when(flag(_LEAD_CLASS), F.col("c_class")).otherwise(0) - group
    others = (group > 0) | flag(_MORE) | (flag(_TAIL) & F.col("goes_on"))
    prev = F.when(flag(_FIRST), F.col("c_prev")).otherwise(F.col("prev"))
    opens = (group == 0) & (new > F.col("rank"))
    made = table.join(held, "chunk").select("p", "s", new.alias("rank"), others.alias("many"), opens.alias("opens"), "next", prev.alias("prev"))
    if many is None:  # of the first sort only the lines that repeat go on
        made = made.where("many")
    ranked = written(made, tag, many)
    table.unpersist()
    return ranked, shared


def _united(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for more in frames[1:]:
        out = out.unionAll(more)
    return out


def suffix_array(lines: DataFrame) -> DataFrame:
    """The suffixes of repeated lines: p, s, rank (their order) and lcp (lines shared with the one before).

    ``lines``: p (place of the line; a sequence's lines follow each other), s
    (where its sequence begins), a and b (the line's ID).
    """
    spark = lines.sparkSession
    first, shared = _ranked(lines.select("p", "s", F.lit(0).cast("long").alias("rank"), F.col("a").alias("next"), F.col("b").alias("more")), "suffixes1")
    levels = [first.where("many").select("p", "s", "rank")]  # suffixes by depth, where others share their rank
    alone, splits, counts, h = [], [], [], 1
    while shared:
        counts.append(shared)
        now = _united([levels[-1], *alone]).select((F.col("p") - h).alias("p"), "s", F.col("rank").alias("next"))
        ahead = levels[-1].join(now, ["p", "s"], "left")
        rows = ahead.select("p", "s", "rank", F.coalesce("next", -1 - F.col("p")).alias("next"), F.lit(0).cast("long").alias("more"))
        ranked, shared = _ranked(rows, f"suffixes{2 * h}", shared)
        alone.append(ranked.where("not many").select("p", "s", "rank"))
        known = (F.col("next") >= 0) & F.col("prev").isNotNull()
        split = ranked.where("opens").select(F.col("rank").alias("at"), F.lit(h).cast("long").alias("lcp"), F.when(known, F.col("prev") + h).alias("x"), F.when(known, F.col("p") + h).alias("y"))
        splits.append(split)
        levels.append(ranked.where("many").select("p", "s", "rank"))
        h *= 2
    if not alone:
        return spark.createDataFrame([], "p long, s long, rank long, lcp long")
    lcp = [s.where("x is null").select("at", "lcp") for s in splits] + [splits[0].where("x is not null").select("at", "lcp")]
    open_ = None
    for k in range(len(splits) - 2, -1, -1):  # may share 2**k lines more
        none = F.lit(None).cast("long")  # where x's and y's sequences begin, once they are met: runs end with them
        more = splits[k + 1].where("x is not null").select("at", "lcp", "x", "y", none.alias("in_x"), none.alias("in_y"))
        open_ = more if open_ is None else open_.unionAll(more)
        mine = [levels[k].select(F.col("p").alias(c), F.col("s").alias(f"s_{c}"), F.col("rank").alias(f"r_{c}")) for c in ("x", "y")]
        seen = open_.join(mine[0], "x", "left").join(mine[1], "y", "left")
        within = [F.coalesce(F.col(f"in_{c}") == F.col(f"s_{c}"), F.lit(True)) for c in ("x", "y")]
        equal = F.coalesce((F.col("r_x") == F.col("r_y")) & within[0] & within[1], F.lit(False))
        step = F.when(equal, 2**k).otherwise(0)
        begun = [F.when(equal, F.col(f"s_{c}")).otherwise(F.col(f"in_{c}")).alias(f"in_{c}") for c in ("x", "y")]
        open_ = seen.select("at", *[(F.col(c) + step).alias(c) for c in ("lcp", "x", "y")], *begun)
        if k and k % 4 == 0:  # plans of a bounded length
            open_ = written(open_, "prefixes", counts[k + 1])
    if open_ is not None:
        lcp.append(open_.select("at", "lcp"))
    return _united(alone).join(_united(lcp), F.col("rank") == F.col("at"), "left").select("p", "s", "rank", F.coalesce("lcp", F.lit(0)).alias("lcp"))


_Front = list[tuple[int, int]]  # (lines shared, earliest place), both rising
_WHOLE = 1 << 62


def _meet(front: _Front, lcp: int) -> None:
    """From now on no more than ``lcp`` lines are shared."""
    least = None
    while front and front[-1][0] >= lcp:
        least = front.pop()[1]
    if least is not None and lcp:
        front.append((lcp, least))


def _scan(places: list[int], lcps: list[int], front: _Front) -> list[int]:
    """For each suffix the lines it shares with an earlier one in ``front`` or before it; changes ``front``."""
    out = []
    for p, lcp in zip(places, lcps):
        _meet(front, lcp)
        while front and front[-1][1] > p:
            front.pop()
        out.append(front[-1][0] if front else 0)
        front.append((_WHOLE, p))
    return out


def _pieces(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, pa.Table, list[int], list[int]]]:
    for piece, table in _chunks(batches, size):
        yield (int(table.column("part")[0].as_py()) << 24) + piece, table, table.column("p").to_pylist(), table.column("lcp").to_pylist()


@lean
def _fronts(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """What each chunk passes on to the right and to the left."""
    for chunk, _, p, lcp in _pieces(batches, size):
        right: _Front = []
        left: _Front = []
        _scan(p, [0, *lcp[1:]], right)
        _scan(p[::-1], [0, *lcp[:0:-1]], left)
        flat = [[x for pair in f for x in pair] for f in (right, left)]
        yield pa.RecordBatch.from_pydict({"chunk": [chunk], "link": [lcp[0]], "inner": [min(lcp[1:], default=_WHOLE)], "right": [flat[0]], "left": [flat[1]]})


def _passed(rows: list) -> dict[int, tuple[_Front, _Front, int]]:
    """What reaches each chunk from the left and from the right, and the lines it shares with the next one."""
    rows = sorted(rows, key=lambda r: r.chunk)
    links = [r.link for r in rows] + [0]
    reach: list[list[_Front]] = [[], []]
    for side, order in enumerate((range(len(rows)), range(len(rows) - 1, -1, -1))):
        front: _Front = []
        for i in order:
            reach[side].append(list(front))
            # through a chunk no more than its least prefix is shared; its own suffixes come on top
            _meet(front, min(rows[i].inner, links[i + side]))
            flat = rows[i].left if side else rows[i].right
            own = list(zip(flat[::2], flat[1::2]))
            while front and front[-1][1] > own[0][1]:
                front.pop()
            front += own
    return {r.chunk: (a, b, link) for r, a, b, link in zip(rows, reach[0], reversed(reach[1]), links[1:])}


@lean
def _longest(batches: Iterator[pa.RecordBatch], size: int, passed: dict) -> Iterator[pa.RecordBatch]:
    for chunk, table, p, lcp in _pieces(batches, size):
        before, behind, link = passed[chunk]
        left = _scan(p, lcp, list(before))
        right = _scan(p[::-1], [link, *lcp[:0:-1]], list(behind))[::-1]
        length = np.maximum(left, right)
        s = table.column("s").to_numpy()
        span = (np.array(p) - s) << 32 | length
        yield from pa.Table.from_arrays([pa.array(s[length > 0]), pa.array(span[length > 0])], ["s", "span"]).to_batches()


def earlier_runs(suffixes: DataFrame) -> DataFrame:
    """(s, span) of each suffix of which a run of lines starts earlier too; span: first line << 32 | lines of the longest one."""
    spark, size = suffixes.sparkSession, CHUNK
    spread = suffixes.repartitionByRange(partitions(spark), "rank").sortWithinPartitions("rank")
    placed = kept(spread.select("rank", "p", "s", "lcp", F.spark_partition_id().alias("part")))
    flat = "chunk long, link long, inner long, right array<long>, left array<long>"
    # a row a chunk; its fronts have no more entries than there are lengths of prefixes in it
    passed = spark.sparkContext.broadcast(_passed(placed.mapInArrow(lambda it: _fronts(it, size), flat).collect()))
    return placed.mapInArrow(lambda it: _longest(it, size, passed.value), "s long, span long")


@lean
def _started(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The place of each sequence's first line: its partition, then the lines before it there."""
    total = 0
    for batch in batches:
        n = batch.column("n").to_numpy().astype(np.int64)
        ends = total + np.cumsum(n)
        total = int(ends[-1]) if len(ends) else total
        start = (batch.column("part").to_numpy().astype(np.int64) << 40) + ends - n
        yield pa.RecordBatch.from_arrays([batch.column("t"), batch.column("d"), pa.array(start), batch.column("lines")], ["t", "d", "s", "lines"])


def repeated_runs(docs: DataFrame) -> DataFrame:
    """(d, t, spans) of documents with lines of which runs start earlier too; ``docs``: d, t (the text's key), text.

    spans: first line << 32 | lines of the longest such run, among lines that
    aren't blank; each copy of a text is one such run from its first line on.
    """
    spark = docs.sparkSession
    full = F.filter(F.split("text", "\n"), lambda line: line.rlike(WORD))
    ids = F.transform(full, lambda line: F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b")))
    rows = kept(docs.select("d", "t", ids.alias("lines")).where(F.size("lines") > 0))
    texts = rows.groupBy("t").agg(F.min("d").alias("d"), F.first("lines").alias("lines"))
    order = texts.select("t", "d", F.size("lines").alias("n"), "lines").repartitionByRange(partitions(spark), "d", "t").sortWithinPartitions("d", "t")
    kind = "array<struct<a:bigint,b:bigint>>"
    sequences = kept(order.select("t", "d", "n", "lines", F.spark_partition_id().alias("part")).mapInArrow(_started, f"t binary, d long, s long, lines {kind}"))
    each = sequences.select("s", F.posexplode("lines").alias("pos", "line")).select((F.col("s") + F.col("pos")).alias("p"), "s", "line.a", "line.b")
    runs = earlier_runs(suffix_array(each)).groupBy("s").agg(F.collect_list("span").alias("spans"))
    own = sequences.select("s", "t", "d").join(runs, "s").select("d", "t", "spans")
    copies = rows.select("d", "t", F.size("lines").cast("long").alias("n")).join(sequences.select("t", F.col("d").alias("least")), "t").where("d > least")
    return own.unionAll(copies.select("d", "t", F.array("n").alias("spans")).distinct())


def _edited(text: str | None, spans: list[int] | None, least: int) -> tuple[str | None, int, int, int, int]:
    """The text without its maximal runs of ``least`` characters, its lines that aren't blank, those deleted, runs, and the longest's lines."""
    lines = (text or "").split("\n")
    full = [i for i, line in enumerate(lines) if line.strip(BLANK)]
    if not spans:
        return text, len(full), 0, 0, 0
    s = np.array(spans, np.int64)
    length = np.zeros(len(full) + 1, np.int64)
    length[s >> 32] = s & 0xFFFFFFFF
    if len(spans) == 1 and length[0] == len(full):  # a copy of a whole text
        length[:-1] = np.arange(len(full), 0, -1)
    begins = np.flatnonzero(length[:-1] * (length[:-1] >= np.append(1, length[:-2])))
    ends = begins + length[begins]
    chars = np.append(0, np.cumsum([len(lines[i]) for i in full]))
    enough = chars[ends] - chars[begins] >= least
    begins, ends = begins[enough], ends[enough]
    step = np.bincount(begins, minlength=len(full) + 1) - np.bincount(ends, minlength=len(full) + 1)
    gone = {full[k] for k in np.flatnonzero(np.cumsum(step)[: len(full)] > 0).tolist()}
    kept_lines = "\n".join(line for i, line in enumerate(lines) if i not in gone) if gone else text
    return kept_lines, len(full), len(gone), len(begins), int((ends - begins).max(initial=0))


_MADE = ("edited_text", "n_lines", "n_removed", "n_runs", "longest_run")


@lean
def _edit(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [_edited(t, s, least) for t, s in zip(batch.column("text_in").to_pylist(), batch.column("spans_in").to_pylist())]
        made = list(zip(*out)) if out else [()] * 5
        columns = [batch.column(i) for i in range(batch.num_columns - 2)]
        columns += [pa.array(made[0], pa.string()), *(pa.array(m, pa.int64()) for m in made[1:])]
        yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-2], *(f"made_{n}" for n in _MADE)])


def _deduped(docs: DataFrame, keep: list[str], least_chars: int) -> DataFrame:
    """Every row: c0, c1 .. (the columns ``keep``), and made_ columns."""
    ship(docs.sparkSession)
    keyed = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("d"),
        text_key(F.col("text")).alias("t"),
        "text",
        F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)]).alias("row"),
    )
    spans = repeated_runs(keyed.select("d", "t", "text"))
    # the spans are built into a hash table; the texts stream past it unsorted
    joined = keyed.join(spans.hint("shuffle_hash"), ["d", "t"], "left")
    wide = joined.select("row.*", F.col("text").alias("text_in"), F.col("spans").alias("spans_in"))
    fields = [T.StructField(f"c{i}", docs.schema[c].dataType) for i, c in enumerate(keep)]
    fields += [T.StructField(f"made_{n}", T.LongType() if k else T.StringType()) for k, n in enumerate(_MADE)]
    return wide.mapInArrow(lambda it: _edit(it, least_chars), T.StructType(fields))


def line_dedup(docs: DataFrame, keep: list[str], least_chars: int = LEAST_CHARS) -> DataFrame:
    """Delete later copies of maximal repeated line runs.

    A run repeats if the same lines also start in a smaller doc_id (null ids are
    the largest) or earlier in the document; it is maximal if it isn't part of
    the longest such run from the line before. Maximal runs of ``least_chars``
    characters (line ends aside) are deleted, whatever their number of lines.
    Blank lines are no part of runs and stay.

    One row per input row: the columns ``keep`` of ``docs``, then edited_text,
    n_lines (that aren't blank), n_removed, n_runs (deleted) and longest_run (its
    lines). Null text stays null with 0 lines. Rows that repeat id and text are
    one document and get the same result; rows that share an id with another
    text come in the order of the text's digest. Columns may have any names; no
    rows give no rows.
    """
    made = _deduped(docs, keep, least_chars)
    return made.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], *[F.col(f"made_{n}").alias(n) for n in _MADE])


def deduplicated(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """``docs`` with edited texts; documents of which nothing is left are dropped."""
    rest = [c for c in docs.columns if c != "text"]
    made = _deduped(docs, rest, least_chars)
    left = (F.col("made_n_removed") == 0) | F.col("made_edited_text").rlike(WORD)
    whole = made.where(F.coalesce(left, F.lit(True)))
    at = {c: f"c{i}" for i, c in enumerate(rest)}
    return whole.select(*[F.col(at.get(c, "made_edited_text")).alias(c) for c in docs.columns])


def line_report(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """doc_id, n_lines, n_removed, n_runs, longest_run and kept_sha256 (of the edited text; null as empty)."""
    edited = line_dedup(docs, ["doc_id"], least_chars)
    digest = F.sha2(F.coalesce("edited_text", F.lit("")).cast("binary"), 256)
    return edited.select(F.col("doc_id").cast("long").alias("doc_id"), "n_lines", "n_removed", "n_runs", "longest_run", digest.alias("kept_sha256"))
