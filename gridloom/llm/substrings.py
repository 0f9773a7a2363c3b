"""Substring dedup by super-k-mers.

A window is ``size`` consecutive words of one document. Its minimiser is the
least hash among its runs of ``GRAM`` words; consecutive windows that share it
travel as one packed string to the minimiser's bucket, where equal windows are
found exactly: words become dictionary codes, windows are sorted by a hash of
the codes, and neighbours are compared code by code.

* Before it travels, a packed string that repeats within a task's slice of text
  is dropped: all its windows start earlier in the first one.
* Minimisers that many packed strings share (a common passage with ever other
  surroundings) are found first, from counts of each slice. Their windows travel
  one by one to buckets chosen by the window itself, so no bucket grows with a
  passage's copies by more than one string for each slice.
* Buckets are as many as the packed strings' bytes ask for, which the same counts
  give; a task takes several, one at a time.

A document is known by its id and a 64-bit hash of its text; without an id, by two
such hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.batches import lean
from gridloom.llm.scratch import kept, partitions, ship
from gridloom.llm.textkernel import Words, grams, mixed, slices, words_of

GRAM = 3
#: Bytes of text in which packed strings that repeat are dropped before they travel.
SLICE = 6 << 20
#: Bytes of packed strings in a bucket and in a task, about, before compression.
BUCKET_BYTES, TASK_BYTES = 6 << 20, 48 << 20
#: A slice reports minimisers with so many packed strings.
REPORTED = 8
#: A minimiser is hot from this many reported strings on, or from the share below.
LEAST_HOT = 500
_WHO = ("none", "doc", "print")
_CODEC = pa.Codec("zstd", 5)


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All numbers of the ranges [start, start + length), one after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def _window_starts(w: Words, size: int) -> np.ndarray:
    n = np.maximum(w.counts - size + 1, 0)
    return _ranges(w.first[:-1], n)


def _least(g: np.ndarray, n: int) -> np.ndarray:
    """The least of each ``n`` neighbours."""
    out, length = g, 1
    while 2 * length <= n:
        out = np.minimum(out[: len(out) - length], out[length:])
        length *= 2
    m = len(g) - n + 1
    return np.minimum(out[:m], out[n - length : n - length + m])


class _Runs:
    """Packed strings of a slice: first window, windows, minimiser, in document order."""

    def __init__(self, batch: pa.RecordBatch, size: int, hot: np.ndarray):
        who = [batch.column(c).to_numpy(zero_copy_only=False) for c in _WHO]
        order = np.lexsort(who[::-1])
        # rows that repeat id and text are one document
        again = np.zeros(len(order), bool)
        again[1:] = np.all([c[order][1:] == c[order][:-1] for c in who], axis=0)
        text = batch.column("text")
        for k in np.flatnonzero(again).tolist():
            again[k] = text[int(order[k])].as_py() == text[int(order[k - 1])].as_py()
        order = order[~again]
        self.who = [c[order] for c in who]
        self.words = words_of(text.take(pa.array(order)))
        h = self.words.hashes()
        at = _window_starts(self.words, size)
        if not len(at):
            self.start = self.n = self.key = at
            return
        least = _least(grams(h, min(GRAM, size)), size - min(GRAM, size) + 1)[at]
        whole = grams(h, size)
        new = np.ones(len(at), bool)
        new[1:] = (least[1:] != least[:-1]) | (at[1:] != at[:-1] + 1)
        start = np.flatnonzero(new)
        n = np.diff(np.append(start, len(at)))
        self.start, self.n, self.key = at[start], n, least[start]
        if len(hot):
            burst = np.isin(self.key, hot)
            single = _ranges(self.start[burst], n[burst])
            # a document's order is its start's order, so sorting by start restores it
            self.start = np.concatenate([self.start[~burst], single])
            self.n = np.concatenate([n[~burst], np.ones(len(single), np.int64)])
            self.key = np.concatenate([self.key[~burst], mixed(whole[single], 7)])
            order = np.argsort(self.start, kind="stable")
            self.start, self.n, self.key = self.start[order], self.n[order], self.key[order]
        self.sign = mixed(whole[self.start] * np.uint64(3) + whole[self.start + self.n - 1], 3) + self.n.astype(np.uint64)

    def repeats(self, size: int) -> tuple[np.ndarray, bytes, np.ndarray, np.ndarray]:
        """Whether each string equals an earlier one of the slice; the text and its places."""
        text, at = self.words.spaced()
        begin, end = at[self.start], at[self.start + self.n + size - 1] - 1
        text = text.tobytes()
        order = np.argsort(self.sign, kind="stable")
        same = np.zeros(len(order), bool)
        same[1:] = self.sign[order][1:] == self.sign[order][:-1]
        repeat, first = np.zeros(len(order), bool), -1
        for k in np.flatnonzero(same | np.append(same[1:], False)):
            i = order[k]
            if not same[k]:
                first = i
            elif text[begin[i] : end[i]] == text[begin[first] : end[first]]:
                repeat[i] = True
        return repeat, text, begin, end


@lean
def _reports(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Frequent minimisers of each slice, and under the null key its number of strings and their bytes."""
    for batch in batches:
        for part in slices(batch, 3, SLICE):
            runs = _Runs(part, size, np.zeros(0, np.uint64))
            if not len(runs.start):
                continue
            repeat, _, begin, end = runs.repeats(size)
            length = int((end - begin)[~repeat].sum())
            keys, n = np.unique(runs.key[~repeat], return_counts=True)
            often = n >= REPORTED
            out = [None, *keys[often].view(np.int64).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64()), pa.array([int(n.sum()), *n[often].tolist()], pa.int64()), pa.array([length] + [0] * int(often.sum()), pa.int64())], ["key", "n", "bytes"])


_FIELDS = (("none", np.int8), ("doc", np.int64), ("print", np.int64), ("start", np.int32), ("n", np.int32), ("bytes", np.int32))


@lean
def _packed(batches: Iterator[pa.RecordBatch], size: int, buckets: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, 3, SLICE):
            runs = _Runs(part, size, hot)
            if not len(runs.start):
                continue
            repeat, text, begin, end = runs.repeats(size)
            bucket = (mixed(runs.key, 11) % np.uint64(buckets)).astype(np.int64)
            doc = np.searchsorted(runs.words.first, runs.start, "right") - 1
            order = np.argsort(bucket, kind="stable")
            columns = {
                **{k: c[doc][order] for k, c in zip(_WHO, runs.who)},
                "start": (runs.start - runs.words.first[doc])[order],
                "n": runs.n[order],
                "bytes": np.where(repeat, 0, end - begin)[order],
            }
            cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1))
            pieces = [text[a:b] if keep else b"" for a, b, keep in zip(begin[order].tolist(), end[order].tolist(), (~repeat[order]).tolist())]
            out_bucket, payload = [], []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                head = b"".join(columns[k][a:b].astype(t).tobytes() for k, t in _FIELDS)
                out_bucket.append(int(bucket[order[a]]))
                raw = head + b"".join(pieces[a:b])
                payload.append((b - a).to_bytes(4, "little") + len(raw).to_bytes(4, "little") + _CODEC.compress(raw, asbytes=True))
            yield pa.RecordBatch.from_arrays([pa.array(out_bucket, pa.int32()), pa.array(payload, pa.binary())], ["bucket", "payload"])


def _unpacked(payloads: list[bytes]) -> tuple[dict[str, np.ndarray], list[bytes]]:
    heads: dict[str, list] = {k: [] for k, _ in _FIELDS}
    texts = []
    for p in payloads:
        n, size, at = int.from_bytes(p[:4], "little"), int.from_bytes(p[4:8], "little"), 0
        raw = _CODEC.decompress(p[8:], size, asbytes=True)
        for k, t in _FIELDS:
            heads[k].append(np.frombuffer(raw, t, n, at))
            at += n * np.dtype(t).itemsize
        for length in heads["bytes"][-1].tolist():
            texts.append(raw[at : at + length])
            at += length
    return {k: np.concatenate(v) for k, v in heads.items()}, texts


def _same_as_before(codes: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Whether each window equals one that stands before it in ``at``, exactly."""
    w = grams(mixed(codes.astype(np.uint64), 1), size)[at]
    order = np.argsort(w, kind="stable")
    w = w[order]
    tie = np.zeros(len(w), bool)
    tie[1:] = w[1:] == w[:-1]
    there = np.flatnonzero(tie)
    a, b = at[order[there]], at[order[there - 1]]
    equal = np.ones(len(there), bool)
    for k in range(size):
        equal &= codes[a + k] == codes[b + k]
    out = np.zeros(len(w), bool)
    out[order[there]] = True
    if not equal.all():  # two windows share a hash: those groups are compared by their codes
        clash = np.isin(w, w[there[~equal]])
        seen: set[bytes] = set()
        for i in np.sort(order[clash]):
            key = codes[at[i] : at[i] + size].tobytes()
            out[i] = key in seen
            seen.add(key)
    return out


def _bucket(group: pa.Table, size: int) -> pa.Table:
    heads, texts = _unpacked(group.column("payload").to_pylist())
    # a string that another slice sent of a row with the same id and text is one with this; known repeats stand first
    order = np.lexsort((heads["bytes"], heads["start"], heads["print"], heads["doc"], heads["none"]))
    place = np.stack([heads[k][order].astype(np.int64) for k in (*_WHO, "start")])
    again = np.zeros(len(order), bool)
    again[1:] = (place[:, 1:] == place[:, :-1]).all(axis=0)
    for k in np.flatnonzero(again).tolist():
        i, j = order[k - 1], order[k]
        again[k] = not heads["bytes"][i] or texts[i] == texts[j]
    order = order[~again]
    heads = {k: v[order].astype(np.int64) for k, v in heads.items()}
    texts = [texts[i] for i in order]
    sent = heads["bytes"] > 0
    n = heads["n"]
    words = words_of(pa.array([t for t in texts if t], pa.binary()))
    spots = _ranges(words.first[:-1], n[sent])
    owner = np.repeat(np.flatnonzero(sent), n[sent])
    dup = _same_as_before(words.codes(), spots, size) if len(spots) else np.zeros(0, bool)
    # intervals of windows: those found here, and the strings that were known to repeat
    where = heads["start"][owner] + spots - np.repeat(words.first[:-1], n[sent])
    new = dup.copy()
    new[1:] &= ~(dup[:-1] & (owner[1:] == owner[:-1]))
    last = dup.copy()
    last[:-1] &= ~(dup[1:] & (owner[1:] == owner[:-1]))
    who = np.concatenate([owner[new], np.flatnonzero(~sent)])
    a = np.concatenate([where[new], heads["start"][~sent]])
    b = np.concatenate([where[last], heads["start"][~sent] + n[~sent] - 1])
    return pa.table({
        "none": pa.array(heads["none"][who].astype(np.int32)),
        "doc": pa.array(heads["doc"][who]),
        "print": pa.array(heads["print"][who]),
        "span": pa.array(a << 32 | b + size),
    })


def _removed_words(spans: list[int] | None, n: int) -> np.ndarray | None:
    if not spans:
        return None
    s = np.array(spans, np.int64)
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, s >> 32, 1)
    np.add.at(step, s & 0xFFFFFFFF, -1)
    return np.cumsum(step)[:n] > 0


@lean
def _kept(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc, text, spans in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()), batch.column("spans").to_pylist()):
            words = (text.as_py() or b"").split()
            gone = _removed_words(spans, len(words))
            n = 0 if gone is None else int(gone.sum())
            if n:
                kept = [w for w, g in zip(words, gone.tolist()) if not g]
                out.append((doc, len(words), n, b" ".join(kept)))
            else:
                out.append((doc, len(words), 0, b" ".join(words)))
        ids, n_words, n_removed, texts = zip(*out) if out else ((),) * 4
        columns = {
            "doc_id": pa.array(ids, pa.int64()),
            "n_words": pa.array(n_words, pa.int64()),
            "n_removed": pa.array(n_removed, pa.int64()),
            "kept_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
        }
        if with_text:
            columns["kept_text"] = pa.array(texts, pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_pydict(columns)


def substring_dedup(docs: DataFrame, size: int = 20, with_text: bool = False) -> DataFrame:
    """Remove each word covered by a window whose words also start earlier.

    Earlier: in a smaller doc_id (null ids are the largest), or in the same
    document at a smaller start. All windows are judged on the input. One row
    per input row: doc_id, n_words, n_removed, kept_sha256 (of the kept words
    joined by one space) and, ``with_text``, kept_text. Null text has no words.
    Rows that repeat id and text are one document and get the same result; rows
    that share an id with another text come in the order of a hash of the text.
    Other columns are ignored; no rows give no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    known = F.col("doc_id").cast("long")
    mark = F.xxhash64("text")
    other = F.xxhash64(F.lit(1), "text")
    slim = docs.select(known.isNull().cast("int").alias("none"), F.coalesce(known, other).alias("doc"), mark.alias("print"), "text", known.alias("doc_id"))
    with_words = slim.where(F.length("text") >= 2 * size - 1).select(*_WHO, "text")
    reports = with_words.mapInArrow(lambda it: _reports(it, size), "key long, n long, bytes long")
    counts = kept(reports.groupBy("key").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes")))
    total, length = counts.where("key is null").agg(F.sum("n"), F.sum("bytes")).first()
    buckets = max(partitions(spark), -(-(length or 0) // BUCKET_BYTES))
    tasks = max(partitions(spark), -(-(length or 0) // TASK_BYTES))
    least = max(LEAST_HOT, (total or 0) // (2 * buckets))
    # at most 2 keys for each bucket can hold that share of all strings
    hot = [r["key"] for r in counts.where((F.col("key").isNotNull()) & (F.col("n") >= least)).select("key").collect()]
    hot_keys = np.array(hot, np.int64).view(np.uint64)
    sent = with_words.mapInArrow(lambda it: _packed(it, size, buckets, hot_keys), "bucket int, payload binary").repartition(tasks, "bucket")
    found = sent.groupBy("bucket").applyInArrow(lambda t: _bucket(t, size), "none int, doc long, print long, span long")
    spans = found.groupBy(*_WHO).agg(F.collect_list("span").alias("spans"))
    # the spans are built into a hash table; the texts stream past it unsorted
    joined = slim.join(spans.hint("shuffle_hash"), list(_WHO), "left")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return joined.select("doc_id", "text", "spans").mapInArrow(lambda it: _kept(it, with_text), schema)
