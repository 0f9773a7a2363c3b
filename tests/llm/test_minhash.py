import random
import re

import numpy as np

from gridloom.llm import minhash
from gridloom.llm.minhash import near_dedup

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingles(text, size):
    words = WORD.findall((text or "").encode().lower())
    return {tuple(words[i : i + size]) for i in range(max(len(words) - size + 1, 1))} if words else set()


def brute(rows, size, similar):
    """rows: (doc_id, text) with ids that differ; None is the largest and keeps itself as an id only where alone."""
    sets = [shingles(t, size) for _, t in rows]
    up = list(range(len(rows)))
    rank = lambda i: (rows[i][0] is None, rows[i][0] or 0)

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and similar[1] * both >= similar[0] * (len(a) + len(sets[j]) - both):
                x, y = sorted((find(i), find(j)), key=rank)
                up[y] = x
    return sorted(((rows[i][0], len(sets[i]), rows[find(i)][0], find(i) == i) for i in range(len(rows))), key=str)


def made(seed, n=250):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = [rng.choices(vocabulary, k=rng.randint(3, 160)) for _ in range(40)]
    rows = []
    for i in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append(" ".join(words) if rng.random() < 0.8 else rng.choice(rows or ["x"]).upper())
    rows += [None, "", " \n", "one", "One", "one two", "ONE TWO", "two one", "é É", "e", "one two three", "one  two\nthree"]
    return list(zip([*rng.sample(range(10_000), len(rows) - 1), None], rows))


def test_matches_brute_force(spark, monkeypatch):
    from tests.llm.conftest import frame

    rows = made(1)
    docs = frame(spark, [(i, t, None) for i, t in rows]).repartition(3)
    for size, similar in ((3, (85, 100)), (5, (80, 100))):
        assert sorted(map(tuple, near_dedup(docs, size, similar).collect()), key=str) == brute(rows, size, similar)
    values = [np.unique(np.random.default_rng(k).integers(0, 50, 30).astype(np.uint64)) for k in range(5)]
    n = np.array([len(v) for v in values])
    plain = minhash._counter(values, n, np.append(0, np.cumsum(n)))(1, [2, 4])
    monkeypatch.setattr(minhash, "NUMBERED", 0)
    assert plain == minhash._counter(values, n, np.append(0, np.cumsum(n)))(1, [2, 4])
    monkeypatch.setattr(minhash, "LEAF", 6)  # deep trees, and blocks at their ends
    monkeypatch.setattr(minhash, "DEPTH", 4)
    want, got = brute(rows, 3, (85, 100)), sorted(map(tuple, near_dedup(docs, 3, (85, 100)).collect()), key=str)
    assert sum(a == b for a, b in zip(want, got)) >= 0.95 * len(want)


def test_oversize_nodes_lose_no_pair(spark, monkeypatch):
    from tests.llm.conftest import frame

    rng = random.Random(4)
    template = [f"t{i}" for i in range(150)]
    rows = []
    for k in range(90):  # ten versions of a template, whose ids aren't the least, and variants of them
        words = list(template)
        for at in [15 * (k % 10)] if k < 10 else rng.sample(range(2, 148), 2):
            words[at] = f"v{k}-{at}"
        rows.append((1000 + k if k < 10 else 2 * k + 1, " ".join(words)))
    monkeypatch.setattr(minhash, "LEAF", 6)
    monkeypatch.setattr(minhash, "DEPTH", 1)
    docs = frame(spark, [(i, t, None) for i, t in rows])
    want = brute(rows, 3, (87, 100))
    assert sum(kept for *_, kept in want) < len(want) / 2
    assert sorted(map(tuple, near_dedup(docs, 3, (87, 100)).collect()), key=str) == want


def test_awkward_rows(spark, awkward, nothing):
    rows = near_dedup(awkward).collect()
    assert len(rows) == awkward.count()
    assert all(r.component_id == r.doc_id and r.kept for r in rows if not r.n_shingles)
    assert all(r.component_id is None or r.doc_id is None or r.component_id <= r.doc_id for r in rows)
    assert near_dedup(nothing).count() == 0
