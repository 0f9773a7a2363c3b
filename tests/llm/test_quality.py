import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from gridloom.llm.quality import SIZE, _descent, accepted, features, fitted, quality_report


def made(spark, n=900):
    rng = random.Random(4)
    words = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        t = " ".join(rng.choices(words, k=rng.randint(5, 80)))
        if not good:
            t = rng.choice([t.upper() + "!!", t.replace(" ", "$$$ "), " ".join([rng.choice(words)] * 40), t.replace(" ", " | ")])
        rows.append((i, t, None))
        if rng.random() < 0.8:
            labels.append((i, int(good), 0))
    labels += [(5, 1, 0), (5, 0, 0), (None, 1, 0), (6, None, 0), (7, 9, 0), (10_000, 0, 1), labels[0]]
    return rows, labels, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    from tests.llm.conftest import frame

    rows, labels, table = made(spark)
    docs = frame(spark, [*rows, (20_000, None, None), (20_001, "", None), (20_001, "", None)]).repartition(3)
    got = quality_report(docs, table).collect()
    assert len(got) == len(rows) + 3 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    truth = {i: q for i, q, _ in labels if q in (0, 1)}
    out = [r for r in got if r.held_out and r.doc_id in truth and r.doc_id != 5]
    assert np.mean([r.predicted == truth[r.doc_id] for r in out]) > 0.97
    again = {r.doc_id: r.score for r in quality_report(docs.repartition(5), table).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-9 for r in got)
    kept = accepted(docs, table)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.predicted}


def test_held_out_labels_are_not_read(spark):
    from tests.llm.conftest import frame

    rows, labels, table = made(spark, 300)
    docs = frame(spark, rows)
    turned = spark.createDataFrame([(i, 1 - q if q in (0, 1) and zlib.crc32(str(i).encode()) % 3 == 1 else q, t) for i, q, t in labels], table.schema)
    score = lambda t: sorted((r.doc_id, r.score) for r in quality_report(docs, t).collect())
    assert score(table) == score(turned)


def test_edges(spark, awkward, nothing):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality_report(awkward, none).collect()} == {0.5}
    assert quality_report(nothing, none).count() == 0
    one = spark.createDataFrame([(0, 1, 0), (2, 1, 0), (3, 1, 0)], none.schema)
    assert all(r.predicted for r in quality_report(awkward, one).collect())


def test_features_are_distinct_and_of_one_text():
    texts = ["a b a b", None, "", "A b", "a b a b c"]
    places, first = features(pa.array(texts, pa.string()))
    sets = [places[a:b].tolist() for a, b in zip(first[:-1], first[1:])]
    assert sets[1] == sets[2] == [] and all(s == sorted(set(s)) for s in sets)
    assert features(pa.array(["a b a b"]))[0].tolist() == sets[0]
    assert places.max() < SIZE


def test_descent_finds_the_widest_margin():
    x = [np.array([1.0]), np.array([3.0])]
    w, bias = _descent([np.array([0])] * 2, x, np.array([-1.0, 1.0]), np.array([100.0, 100.0]), 400)
    # of all w, bias with margins of 1, least w^2 + bias^2
    assert abs(w[0] * 3 + bias - 1) < 1e-2 and abs(w[0] + bias + 1) < 1e-2
    model = fitted([np.array([1, 2]), np.array([3, 4])] * 20, np.array([0, 1] * 20), 0.5)
    assert model.scores(model.margins(np.array([3, 4]), np.array([0, 2])))[0] > 0.8


def plain_features(text):
    """Runs of one and two words in lower case, and of one to three word shapes."""
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    low = [bytes(b + 32 if 65 <= b <= 90 else b for b in w) for w in words]
    shapes = []
    for i, w in enumerate(words):
        n = {"up": 0, "low": 0, "digit": 0}
        marks = Counter()
        for k, b in enumerate(w):
            c = chr(b)
            if c.isascii() and c.isalnum():
                n["digit" if c.isdigit() else "up" if c.isupper() else "low"] += 1
            elif b < 128:
                marks[b] += 1
            elif b == 0xC3 and k + 1 < len(w):
                n["up" if w[k + 1] < 0x9F else "low"] += 1
        shapes.append((min(n["up"], 2), min(n["low"], 2), min(n["digit"], 1), frozenset(marks.items()), i > 0 and low[i] == low[i - 1]))
    return {(kind, size, *seq[i : i + size]) for kind, seq, sizes in (("word", low, (1, 2)), ("shape", shapes, (1, 2, 3))) for size in sizes for i in range(len(seq) - size + 1)}


def test_features_match_a_plain_version():
    rng = random.Random(3)
    kinds = ["alpha", "Alpha", "ALPHA", "b2", "2b", "99", "x!", "!x", "$$", "é", "É", "Émile", "naïve", "\U0001f600", "a-b", "A-B"]
    texts = [" ".join(rng.choices(kinds, k=rng.randint(0, 30))) for _ in range(40)] + [None, "", " \n\t", "y" * 200_000, "w " * 30_000]
    places, first = features(pa.array(texts, pa.string()))
    got = [set(places[a:b].tolist()) for a, b in zip(first[:-1], first[1:])]
    want = [plain_features(t) for t in texts]
    assert [len(g) for g in got] == [len(w) for w in want]
    assert all(len(a & b) == len(x & y) for a, x in zip(got, want) for b, y in zip(got, want))


def test_ratios_and_scores_match_a_plain_version():
    rng = np.random.default_rng(2)
    labels = rng.integers(0, 2, 60)
    rows = [np.unique(np.concatenate([rng.integers(0, 30, 6), rng.integers(30 + 20 * y, 60 + 20 * y, 6)])) for y in labels]
    model = fitted(rows, labels, 0.5)
    train = [k for k in range(60) if k % 4]  # the others fit the curve
    held = {y: Counter(int(f) for k in train if labels[k] == y for f in rows[k]) for y in (0, 1)}
    total = {y: SIZE + sum(held[y].values()) for y in (0, 1)}
    for f in range(90):
        seen = held[0][f] + held[1][f] >= 3
        want = math.log((held[1][f] + 1) / total[1]) - math.log((held[0][f] + 1) / total[0]) if seen else 0.0
        assert abs(model.ratio[f] - want) < 1e-5
    for r in rows:
        norm = math.sqrt(sum(float(model.ratio[f]) ** 2 for f in r))
        margin = sum(float(model.weights[f]) for f in r) / norm + model.bias
        want = 1 / (1 + math.exp(-max(-30, min(30, model.slope * margin + model.shift))))
        assert abs(model.scores(model.margins(r, np.array([0, len(r)])))[0] - want) < 1e-5
    # the dual's solution: each training row is on the right side of its margin or has a weight within its cost
    share = [sum(labels[k] == y for k in train) for y in (0, 1)]
    values = {k: np.array([model.ratio[f] for f in rows[k]]) / np.linalg.norm(model.ratio[rows[k]]) for k in train}
    w, bias = _descent([rows[k] for k in train], [values[k] for k in train], np.where(labels[train] == 1, 1.0, -1.0), np.array([len(train) / 2 / share[labels[k]] for k in train]), 1000)
    assert np.allclose(w[:90] * model.ratio[:90], model.weights[:90], atol=0.05)


def test_ids_that_repeat_count_once(spark):
    from tests.llm.conftest import frame

    rows, _, table = made(spark, 200)
    score = lambda docs: {r.doc_id: r.score for r in quality_report(docs, table).collect()}
    again = [(i, t + " more", s) for i, t, s in rows[:50]] * 3
    assert abs(score(frame(spark, rows + again))[199] - score(frame(spark, rows))[199]) < 1e-9


def test_any_column_names(spark):
    _, _, table = made(spark, 100)
    docs = spark.createDataFrame([(1, "some text", 0.5, 1, "x", "y"), (2, None, None, None, None, None)], "doc_id long, text string, score double, c0 int, text_in string, quality string")
    none = spark.createDataFrame([], table.schema)
    assert accepted(docs, none).dtypes == docs.dtypes and accepted(docs, none).count() == 2
