import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gridloom.llm.packing import WordIds, pack_documents, plan
from gridloom.llm.token_counts import TokenCounter, byte_slices, token_counts

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
counter = TokenCounter(PIECES)
plain = sentencepiece.SentencePieceProcessor(model_file=PIECES)
ids = WordIds(WORDS)
tokenizer = Tokenizer.from_file(WORDS)
texts = st.lists(st.sampled_from(["a", " ", "  ", "\n", "the ", "<s>", "</s>", "▁", "<|endoftext|>", "É", "́", "　", "\x1c", "'s", "12", "\U0001f600", "Word", ",", ".", "ü", "×", "=", "\u0338", "—", "(", "'", "ΑΣ", "İ", "<|ENDOFTEXT|>"]), max_size=14).map("".join) | st.text(max_size=40)


@settings(max_examples=400, deadline=None)
@given(texts)
def test_counts_are_the_librarys(text):
    assert counter.splits and counter.counts([text])[0] == len(plain.encode(text))


@settings(max_examples=400, deadline=None)
@given(texts)
def test_ids_are_the_librarys(text):
    assert np.frombuffer(ids.encode(pa.array([text, None, "b" + text]))[0], "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_counts_of_awkward_rows(awkward, nothing):
    got = sorted(token_counts(awkward, PIECES, limit=10).collect(), key=str)
    want = [(r.doc_id, len((r.text or "").encode()), n := len(plain.encode(r.text or "")), n > 10) for r in awkward.collect()]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert token_counts(nothing, PIECES).count() == 0


def test_slices_of_texts_and_batches_of_segments(monkeypatch):
    import gridloom.llm.token_counts as module

    rows = ["one two  three", "", "a" * 500 + " b", "two one", "▁ x", " lead", "tail ", "one two  three"]
    want = [len(plain.encode(t)) for t in rows]
    assert TokenCounter(PIECES).counts(rows) == want
    monkeypatch.setattr(module, "BATCH_BYTES", 6)
    monkeypatch.setattr(module, "MEMO_ROOM", 3)
    few = TokenCounter(PIECES)
    assert few.counts(rows) == want and few.counts(rows) == want and not few.memo


def test_byte_slices():
    assert list(byte_slices([5, 5, 20, 1, 1], 10)) == [(0, 2), (2, 3), (3, 5)]
    assert list(byte_slices([], 10)) == []


def best_fit_decreasing(counts, capacity):
    gaps = []
    for length in sorted((k for k, v in counts.items() for _ in range(v)), reverse=True):
        fits = [g for g in gaps if g >= length]
        if fits:
            gaps.remove(min(fits))
        gaps.append((min(fits) if fits else capacity) - length)
    return len(gaps)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 30), max_size=25))
def test_plans_place_each_piece_once_without_overlap(counts):
    runs, bins = plan(counts, 60)
    seen, placed = defaultdict(set), defaultdict(list)
    for length, rank, n, first, offset in runs:
        for k in range(n):
            assert rank + k not in seen[length]
            seen[length].add(rank + k)
            placed[first + k].append((offset, length))
    assert {k: len(v) for k, v in seen.items()} == counts and all(v == set(range(len(v))) for v in seen.values())
    assert sorted(placed) == list(range(bins))
    for items in placed.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 60
    assert bins <= best_fit_decreasing(counts, 60) + 1


def test_packing_round_trip(awkward, nothing):
    docs = awkward.where("doc_id is null or doc_id < 104 or doc_id > 104")
    rows = pack_documents(docs, WORDS, capacity=64).collect()
    want = defaultdict(list)
    for r in docs.collect():
        t = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [0]
        for n, at in enumerate(range(0, len(t), 64)):
            part = t[at : at + 64]
            want[r.doc_id, n].append((at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    got = defaultdict(list)
    fill = defaultdict(list)
    for r in rows:
        got[r.doc_id, r.piece].append((r.start, r.length, r.ids_crc32))
        fill[r.sequence_id].append((r.offset, r.length))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    for items in fill.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 64
    assert pack_documents(nothing, WORDS).count() == 0
