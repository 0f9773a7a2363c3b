"""Best-fit packing of tokenised documents into sequences of fixed capacity.

Texts are encoded in Arrow batches; only piece lengths and checksums leave the
workers. The packing is planned on the histogram of piece lengths, which has at
most ``capacity`` entries however large the corpus: pieces above one third of
the capacity go at most two to a bin, so they are paired greedily (the longest
with the longest that fits, which leaves the fewest bins); shorter pieces, from
long to short, go to the bin with the smallest gap that takes them. The plan is
a list of runs "the r-th to s-th piece of this length go to these bins at this
offset". Pieces then find their run by their rank within their length, which
comes from prefix sums in two levels: no length meets in one task.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.batches import lean
from gridloom.llm.scratch import FEW, kept, ship
from gridloom.llm.textkernel import Words, slices, words_of

#: Units whose ids a worker remembers.
MEMO_ROOM = 150_000
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1)]] = True
_MARK = np.zeros(256, bool)
_MARK[[b for b in range(0x21, 0x7F) if not chr(b).isalnum() and chr(b) != "'"]] = True


def units_of(texts: pa.Array) -> Words:
    """Words (A-Z lowered) cut where a letter and a mark meet.

    Letters are a-z and the two-byte letters U+00C0 to U+00FF; marks are ASCII
    ones but the apostrophe. The tokenizer cuts there too, whatever surrounds.
    """
    w = words_of(texts, lower=True)
    letter, mark = _LETTER[w.data], _MARK[w.data]
    pair = (w.data[:-1] == 0xC3) & (w.data[1:] != 0x97) & (w.data[1:] != 0xB7)
    letter[:-1] |= pair
    letter[1:] |= pair
    cut = np.zeros(len(w.data), bool)
    cut[1:] = (letter[:-1] & mark[1:]) | (mark[:-1] & letter[1:])
    cut[w.bounds[:-1]] = True
    starts = np.flatnonzero(cut)
    return Words(w.data, np.append(starts, len(w.data)), np.searchsorted(starts, w.bounds[w.first]))


class WordIds:
    """Token ids of texts, for a tokenizer that lowers case and drops white space.

    A text's ids are those of its ``units_of``. Each batch's units are looked up
    once, in a bounded memo; unknown runs of letters are encoded many at a time
    with a space between them and told apart by the tokens that end a word
    (where the ends don't add up, and for other units, one by one). Texts that
    hold an added token's string are encoded whole, as are all with ``whole``,
    for other tokenizers.
    """

    def __init__(self, file: str, whole: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.added = [str(t) for t in (x.content for x in self.tokenizer.get_added_tokens_decoder().values())]
        self.whole = whole
        self.forget()

    def forget(self) -> None:
        self.memo: dict[bytes, int] = {}
        self.store, self.used = np.zeros(1 << 16, "<u4"), 0
        self.spans = np.zeros((2, 1 << 14), np.int64)  # first id and number of ids of each unit

    def ids(self, parts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def _keep(self, units: list[bytes], ids: np.ndarray, lengths: np.ndarray) -> None:
        n, end = len(self.memo), self.used + len(ids)
        if end > len(self.store):
            self.store = np.concatenate([self.store, np.zeros(end, "<u4")])
        if n + len(units) > self.spans.shape[1]:
            self.spans = np.concatenate([self.spans, np.zeros((2, n + len(units)), np.int64)], axis=1)
        self.store[self.used : end] = ids
        self.spans[0, n : n + len(units)] = self.used + np.cumsum(lengths) - lengths
        self.spans[1, n : n + len(units)] = lengths
        self.memo.update(zip(units, range(n, n + len(units))))
        self.used = end

    def learn(self, units: list[bytes]) -> None:
        runs = [u for u in units if u.isalpha() or not u.isascii() and u.decode().isalpha()]
        rest = list(set(units).difference(runs))
        for i in range(0, len(runs), 500):
            chunk = runs[i : i + 500]
            ids = self.ids([b" ".join(chunk).decode()])[0]
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(chunk):
                self._keep(chunk, ids, np.diff(ends, prepend=0))
            else:
                rest += chunk
        for i in range(0, len(rest), 10_000):
            chunk = rest[i : i + 10_000]
            ids = self.ids([u.decode() for u in chunk])
            self._keep(chunk, np.concatenate(ids), np.array([len(x) for x in ids], np.int64))

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit bytes; null is empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = np.full(len(texts), self.whole)
        for token in self.added:
            odd |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        alone = dict(zip(np.flatnonzero(odd).tolist(), self.ids(texts.filter(pa.array(odd)).to_pylist())))
        if alone:
            texts = pc.if_else(pa.array(odd), "", texts)
        if len(self.memo) > MEMO_ROOM:
            self.forget()
        units = units_of(texts)
        coded = units.dictionary()
        kinds = coded.dictionary.to_pylist()
        self.learn([u for u in kinds if u not in self.memo])
        number = np.fromiter(map(self.memo.__getitem__, kinds), np.int64, len(kinds))[coded.indices.to_numpy()]
        first, n = self.spans[0, number], self.spans[1, number]
        ends = np.cumsum(n)
        ids = self.store[np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - n), n)].tobytes()
        cuts = np.append(0, ends)[units.first] * 4
        return [alone[i].tobytes() if i in alone else ids[a:b] for i, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist()))]


_encoders: dict[tuple[str, bool], WordIds] = {}


@lean
def _pieces(batches: Iterator[pa.RecordBatch], file: str, capacity: int, end_id: int, whole: bool) -> Iterator[pa.RecordBatch]:
    encoder = _encoders.get((file, whole)) or _encoders.setdefault((file, whole), WordIds(file, whole))
    end, step = int(end_id).to_bytes(4, "little"), 4 * capacity
    for batch in batches:
        rows = []
        for part in slices(batch, 1):
            for doc, tokens in zip(part.column(0).to_pylist(), encoder.encode(part.column(1))):
                tokens += end
                for n, at in enumerate(range(0, len(tokens), step)):
                    piece = tokens[at : at + step]
                    rows.append((doc, n, at // 4, len(piece) // 4, zlib.crc32(piece)))
        columns = list(zip(*rows)) or [[]] * 5
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])


def token_pieces(docs: DataFrame, file: str, capacity: int = 2048, end_id: int = 0, whole: bool = False) -> DataFrame:
    """Each document's ids and ``end_id``, cut into pieces of ``capacity`` only where longer."""
    ship(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return slim.mapInArrow(lambda it: _pieces(it, file, capacity, end_id, whole), PIECE)


class _Bins:
    """Open bins by gap: runs of (first bin, how many, filled)."""

    def __init__(self):
        self.by_gap: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.gaps: list[int] = []

    def put(self, gap: int, first: int, n: int) -> None:
        if gap > 0 and n > 0:
            if gap not in self.by_gap or not self.by_gap[gap]:
                insort(self.gaps, gap)
            self.by_gap[gap].append((first, n))

    def take(self, length: int, most: int) -> tuple[int, int, int] | None:
        """(gap, first bin, bins) of the smallest gap that takes ``length``."""
        i = bisect_left(self.gaps, length)
        if i == len(self.gaps):
            return None
        gap = self.gaps[i]
        first, n = self.by_gap[gap].pop()
        if n > most:
            self.by_gap[gap].append((first + most, n - most))
            n = most
        if not self.by_gap[gap]:
            self.gaps.pop(i)
        return gap, first, n


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (length, first rank, pieces, first bin, offset) and the number of bins."""
    left = dict(counts)
    ranks: dict[int, int] = defaultdict(int)
    runs, bins, opened = [], _Bins(), 0

    def place(length: int, n: int, first: int, offset: int) -> None:
        runs.append((length, ranks[length], n, first, offset))
        ranks[length] += n
        left[length] -= n

    large = sorted(x for x in left if 3 * x > capacity)
    while large:
        a = large[-1]
        if not left[a]:
            large.pop()
            continue
        i = bisect_left(large, capacity - a + 1) - 1
        while i >= 0 and not left[large[i]]:
            large.pop(i)
            i -= 1
        b = large[i] if i >= 0 else None
        if b == a and left[a] == 1:
            b = large[i - 1] if i > 0 and left[large[i - 1]] else None
            while b is None and i > 0:
                i -= 1
                b = large[i] if left[large[i]] else None
        n = left[a] if b is None else left[a] // 2 if a == b else min(left[a], left[b])
        place(a, n, opened, 0)
        if b is not None:
            place(b, n, opened, a)
        bins.put(capacity - a - (b or 0), opened, n)
        opened += n
    for length in sorted((x for x in left if 3 * x <= capacity), reverse=True):
        while left[length]:
            if spot := bins.take(length, left[length]):
                gap, first, n = spot
                place(length, n, first, capacity - gap)
                bins.put(gap - length, first, n)
            else:
                fit = capacity // length
                full, rest = divmod(left[length], fit)
                for k in range(fit if full else 0):
                    place(length, full, opened, k * length)
                bins.put(capacity - fit * length, opened, full)
                opened += full
                for k in range(rest):
                    place(length, 1, opened, k * length)
                if rest:
                    bins.put(capacity - rest * length, opened, 1)
                    opened += 1
    return runs, opened


@lean
def _assign(batches: Iterator[pa.RecordBatch], tables: dict[int, tuple]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lengths, ranks = batch.column("length").to_numpy(zero_copy_only=False), batch.column("rank").to_numpy(zero_copy_only=False)
        bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for length in np.unique(lengths):
            here = np.flatnonzero(lengths == length)
            first_rank, first_bin, offset = tables[int(length)]
            run = np.searchsorted(first_rank, ranks[here], "right") - 1
            bins[here] = first_bin[run] + ranks[here] - first_rank[run]
            offsets[here] = offset[run]
        keep = [batch.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(bins), pa.array(offsets)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """``pieces`` with sequence_id and offset; ``pieces`` should be a kept or written table.

    Reruns agree but for pieces that are alike in every column.
    """
    spark = pieces.sparkSession
    ship(spark)
    part = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(1024)).cast("int")
    slotted = pieces.withColumn("part", part)
    # 1024 rows a length at most
    parts = kept(slotted.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")).coalesce(FEW))
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    runs, _ = plan(counts, capacity)
    lists: dict[int, list] = defaultdict(list)
    for length, rank, n, first, offset in runs:
        lists[length].append((rank, first, offset))
    tables = {k: tuple(np.array(c, np.int64) for c in zip(*sorted(v))) for k, v in lists.items()}
    ahead = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    heads = parts.withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0))).drop("n")
    inner = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "start", "ids_crc32"))
    ranked = slotted.withColumn("inner", inner).join(heads, ["length", "part"]).withColumn("rank", F.col("before") + F.col("inner") - 1)
    shared = spark.sparkContext.broadcast(tables)  # its size depends on the capacity, not on the corpus
    columns = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return columns.mapInArrow(lambda it: _assign(it, shared.value), PIECE + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, file: str, capacity: int = 2048, end_id: int = 0, whole: bool = False) -> DataFrame:
    """One row per piece of every document, packed into few sequences.

    doc_id, piece (from 0), start, length, ids_crc32, sequence_id, offset
    (gapless from 0 in a sequence). Null and empty texts are the end id alone.
    Rows repeating an id are documents of their own. Other columns are ignored;
    no rows give no rows.
    """
    return pack(kept(token_pieces(docs, file, capacity, end_id, whole)), capacity)
