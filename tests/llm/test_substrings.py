import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.llm import substrings
from gridloom.llm.substrings import substring_dedup
from gridloom.llm.textkernel import grams, words_of

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.none() | st.text(st.sampled_from("ab \n\x0b\x1cé\U0001f600Z"), max_size=20), max_size=6))
def test_words(texts):
    w = words_of(pa.array(texts, pa.string()))
    want = [WORD.findall((t or "").encode()) for t in texts]
    data = w.data.tobytes()
    got = [[data[w.bounds[i] : w.bounds[i + 1]] for i in range(a, b)] for a, b in zip(w.first[:-1], w.first[1:])]
    assert got == want
    flat = [x for t in want for x in t]
    assert len(set(flat)) == len(set(zip(flat, w.codes().tolist()))) == len(set(w.codes().tolist()))
    assert len(set(w.hashes().tolist())) == len(set(flat))


def test_grams_tell_runs_apart():
    h = np.array([1, 2, 3, 1, 2, 3, 1, 2], np.uint64)
    for n in range(1, 9):
        g = grams(h, n)
        runs = [tuple(h[i : i + n]) for i in range(len(h) - n + 1)]
        assert len(g) == len(runs) and all((g[i] == g[j]) == (runs[i] == runs[j]) for i in range(len(g)) for j in range(len(g)))


def brute(rows, size):
    """rows: (doc_id, text); ids differ, None is the largest."""
    seen, gone = set(), {}
    for doc, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        words = WORD.findall((text or "").encode())
        gone[doc] = set()
        for i in range(len(words) - size + 1):
            key = tuple(words[i : i + size])
            if key in seen:
                gone[doc].update(range(i, i + size))
            seen.add(key)
    out = []
    for doc, text in rows:
        words = WORD.findall((text or "").encode())
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone[doc])
        out.append((doc, len(words), len(gone[doc]), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def made(seed, n=120):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["é", "the"]
    passage = " ".join(rng.choices(vocabulary, k=70))
    texts = []
    for _ in range(n):
        t = " ".join(rng.choices(vocabulary, k=rng.randint(0, 90)))
        for _ in range(rng.randint(0, 2)):
            t += rng.choice([" ", "\n\n"]) + (passage if rng.random() < 0.5 else rng.choice(texts or [""])) + " " + rng.choice(vocabulary)
        texts.append(rng.choice([t, t, t.replace(" ", "  ")]))
    texts += [None, "", "la " * 100, passage, passage]
    ids = rng.sample(range(10_000), len(texts) - 1) + [None]
    return list(zip(ids, texts))


def test_matches_brute_force(spark, monkeypatch):
    from tests.llm.conftest import frame

    rows = made(1)
    docs = frame(spark, [(i, t, None) for i, t in rows]).repartition(5)
    want = brute(rows, 20)
    assert sorted(map(tuple, substring_dedup(docs).collect()), key=str) == want
    monkeypatch.setattr(substrings, "LEAST_HOT", 1)
    assert sorted(map(tuple, substring_dedup(docs.coalesce(1)).collect()), key=str) == want
    assert sorted(map(tuple, substring_dedup(docs, size=3).collect()), key=str) == brute(rows, 3)


def test_colliding_window_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(substrings, "grams", lambda h, n: np.zeros(len(h) - n + 1, np.uint64))
    codes = np.array([1, 2, 3, 1, 2, 4, 1, 2, 3], np.int32)
    got = substrings._same_as_before(codes, np.arange(7), 3)
    assert got.tolist() == [False] * 6 + [True]


def test_repeated_rows_are_one_document(spark, monkeypatch):
    from tests.llm.conftest import frame

    a, b = (" ".join(f"{c}{i}" for i in range(50)) for c in "ab")
    rows = [(1, a), (2, b + " x " + b), (3, a + " new"), (None, b)]
    want = sorted(brute(rows, 20) * 3, key=str)
    docs = frame(spark, [(i, t, None) for i, t in rows * 3])
    for least_hot in (500, 1):
        monkeypatch.setattr(substrings, "LEAST_HOT", least_hot)
        for parts in (1, 4):
            assert sorted(map(tuple, substring_dedup(docs.repartition(parts)).collect()), key=str) == want


def test_awkward_rows(spark, awkward, nothing):
    rows = substring_dedup(awkward, with_text=True).collect()
    assert len(rows) == awkward.count()
    text = {(r.doc_id, r.kept_sha256): r.kept_text for r in rows}
    assert all(hashlib.sha256(t.encode()).hexdigest() == k[1] for k, t in text.items())
    assert [r.n_removed for r in rows if r.doc_id == 103] == [59_980 + 19]
    assert substring_dedup(nothing).count() == 0
