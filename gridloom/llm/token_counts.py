"""Token counts of whole texts, as a SentencePiece model gives them.

Arrow batches hold texts and the functions return lengths only. Texts are handled
in slices balanced by bytes. They are split at safe boundaries: a space after a
non-space. No piece of a model whose pieces hold the space mark only in front
can merge across such a boundary, so the counts of the segments add up to the
count of the text; the model is checked for that property, and without it whole
texts are encoded. Segments repeat, so each worker keeps a bounded memo of them;
those of a slice that it lacks are encoded together, in batches of equal bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.batches import lean
from gridloom.llm.scratch import ship

MARK = "▁"
#: Segments a worker remembers, and the longest that it remembers.
MEMO_ROOM, MEMO_LENGTH = 300_000, 64
#: Bytes of text handled at once in a worker, and of segments in a batch.
SLICE_BYTES, BATCH_BYTES = 4 << 20, 256 << 10
_SEGMENT = re.compile(r" *[^ ]+| +")


class TokenCounter:
    """Counts as ``len(processor.encode(text))`` does."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = (self.processor.id_to_piece(i) for i in range(self.processor.vocab_size()))
        encode = self.processor.encode
        self.splits = (
            all(MARK not in p.lstrip(MARK) for p in pieces)
            and encode("a", out_type=str)[0].startswith(MARK)
            and encode(" a ", out_type=str, num_threads=1) == encode(" a", out_type=str) + [MARK]
        )
        self.memo: dict[str, int] = {}

    def _segments(self, text: str) -> tuple[list[str], int]:
        """Segments without the space in front, and the spaces that are pieces of their own."""
        if not text:
            return [], 0
        if not self.splits or MARK in text:
            return [text], 0
        words = text.split(" ")
        if "" not in words:
            return words, 0
        # the model puts a space in front of the text; each segment carries one in front
        found = _SEGMENT.findall(" " + text)
        return [s[1:] for s in found if s != " "], found.count(" ")

    def counts(self, texts: list[str]) -> list[int]:
        parts = [self._segments(t) for t in texts]
        memo = self.memo
        fresh = list({s for segments, _ in parts for s in segments}.difference(memo))
        for start, end in byte_slices([len(s) for s in fresh], BATCH_BYTES):
            batch = fresh[start:end]
            memo.update(zip(batch, map(len, self.processor.encode(batch, num_threads=1))))
        out = [sum(map(memo.__getitem__, segments)) + alone for segments, alone in parts]
        if len(memo) > MEMO_ROOM:
            memo.clear()
        for s in fresh:
            if len(s) > MEMO_LENGTH:
                memo.pop(s, None)
        return out


def byte_slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Runs of neighbours that sum to ``most`` at most, or single larger ones."""
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > most:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


_counters: dict[str, TokenCounter] = {}


@lean
def _counts(batches: Iterator[pa.RecordBatch], model_file: str, limit: int) -> Iterator[pa.RecordBatch]:
    counter = _counters.get(model_file) or _counters.setdefault(model_file, TokenCounter(model_file))
    for batch in batches:
        texts = batch.column(1)
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
        tokens: list[int] = []
        for start, end in byte_slices(sizes, SLICE_BYTES):
            tokens += counter.counts([t or "" for t in texts.slice(start, end - start).to_pylist()])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
            ["doc_id", "n_bytes", "n_tokens", "over_limit"],
        )


def token_counts(docs: DataFrame, model_file: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit of every row's whole text.

    Tokens are those of the model without begin, end or other added tokens;
    nothing is truncated. Null and empty texts have 0 bytes and tokens. Rows
    repeat as they do in ``docs``; other columns are ignored, and no rows give
    no rows.
    """
    ship(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return slim.mapInArrow(lambda it: _counts(it, model_file, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
