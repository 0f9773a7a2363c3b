import numpy as np
import pytest

from gridloom.llm import vectors
from gridloom.llm.vectors import embedding_dedup

SCHEMA = "vec_id long, embedding array<float>, label int, class string, size long"


def made(seed, n=600, dims=24):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims)).astype(np.float32)
    for i in range(1, n):
        if rng.random() < 0.6:  # near, far and equal copies around the threshold
            j = rng.integers(0, i)
            x[i] = x[j] + rng.choice([0, 0.05, 0.3, 0.45, 0.5, 0.6]) * rng.normal(size=dims)
            if rng.random() < 0.2:
                x[i] = x[j] * rng.choice([1, 3])
    rows = [(int(k), v.tolist()) for k, v in zip(rng.permutation(n * 2)[:n], x)]
    rows += [(5000, None), (5001, []), (5002, [0.0] * dims), (5003, [1.0, None]), (5004, [float("nan")] * dims), (5005, [float("inf")] + [0.0] * (dims - 1)), (5006, [1.0, 2.0]), (5007, [2.0, 4.0]), (None, x[0].tolist()), (None, None)]
    return rows


def brute(rows, cosine):
    usable = [k for k, (_, v) in enumerate(rows) if v and None not in v and np.isfinite(v).all() and np.any(v)]
    rank = lambda k: (rows[k][0] is None, rows[k][0] or 0)
    up, links = list(range(len(rows))), [0] * len(rows)

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    units = {k: np.array(rows[k][1], np.float64) / np.linalg.norm(np.array(rows[k][1], np.float64)) for k in usable}
    for i in usable:
        for j in usable:
            if i < j and len(units[i]) == len(units[j]) and units[i] @ units[j] >= cosine:
                links[i] += 1
                links[j] += 1
                a, b = sorted((find(i), find(j)), key=rank)
                up[b] = a
    out = [(rows[k][0], links[k], rows[find(k)][0], rows[k][0] == rows[find(k)][0]) for k in range(len(rows))]
    return sorted(out, key=str)


def test_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "RECALL", 1.0)
    rows = made(2)
    frame = spark.createDataFrame([(i, v, None, "c", 7) for i, v in rows], SCHEMA).repartition(3)
    want = brute([(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v]) for i, v in rows], 0.9)
    assert sorted(map(tuple, embedding_dedup(frame).collect()), key=str) == want
    monkeypatch.setattr(vectors, "BLOCK", 7)
    monkeypatch.setattr(vectors, "PROBES", 11)
    monkeypatch.setattr(vectors, "SAMPLE", 200)
    assert sorted(map(tuple, embedding_dedup(frame).collect()), key=str) == want


def of_kind(kind, n, rng):
    if kind == "isotropic":
        return rng.normal(size=(n, 48))
    if kind == "clustered":
        return rng.normal(size=(60, 48))[rng.integers(0, 60, n)] + 0.35 * rng.normal(size=(n, 48))
    dims = int(kind)
    return rng.normal(size=(n, dims)) @ rng.normal(size=(dims, 48))  # in a space of few dimensions


@pytest.mark.parametrize("kind", ["isotropic", "clustered", "4", "8"])
def test_recall_of_probes(kind):
    """Of pairs at the cosine itself that neither trained nor measured the index."""
    rng = np.random.default_rng(12)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    x = unit(of_kind(kind, 6000, rng))
    index = vectors.Index.trained(x[:4000], 70, 0.9)
    a = x[4000:]
    b = vectors._turned(a, 0.9, rng)
    (near_a, _, _, probes_a), (near_b, _, _, probes_b) = index.placed(a), index.placed(b)
    found = [p == q or q in u or p in v for p, q, u, v in zip(near_a, near_b, probes_a, probes_b)]
    assert np.mean(found) >= 0.98 and index.margin <= 0.5
    # links of the table itself, where there are any
    c = a @ a.T
    i, j = np.nonzero(np.triu(c >= 0.9, 1))
    if len(i) > 100:
        pick = rng.integers(0, len(i), 2000)
        assert np.mean([near_a[p] == near_a[q] or near_a[q] in probes_a[p] or near_a[p] in probes_a[q] for p, q in zip(i[pick], j[pick])]) >= 0.98


def test_links_far_from_the_plane_are_found(spark, monkeypatch):
    monkeypatch.setattr(vectors, "RECALL", 1.0)
    # on a circle links lie across the planes: one end far from it, the other right behind it
    angles = np.random.default_rng(6).uniform(0, 2 * np.pi, 150)
    rows = [(k, [float(np.float32(np.cos(a))), float(np.float32(np.sin(a)))]) for k, a in enumerate(angles)]
    frame = spark.createDataFrame([(i, v, None, "c", 7) for i, v in rows], SCHEMA)
    assert sorted(map(tuple, embedding_dedup(frame).collect()), key=str) == brute(rows, 0.9)


def test_no_rows(spark):
    assert embedding_dedup(spark.createDataFrame([], SCHEMA)).count() == 0
