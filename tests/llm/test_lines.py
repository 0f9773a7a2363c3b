import random

from gridloom.llm import lines
from gridloom.llm.components import components
from gridloom.llm.lines import deduplicated, line_dedup

BLANK = " \t\n\x0b\x0c\r"


def brute(rows, least):
    """(doc_id, edited text, lines, removed, runs, longest run) with ids that differ; None is the largest."""
    seen: set[tuple] = set()
    out = []
    for doc, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        lines = (text or "").split("\n")
        full = [i for i, x in enumerate(lines) if x.strip(BLANK)]
        words = [lines[i] for i in full]
        longest, mine = [], set()
        for k in range(len(full)):  # all runs of a document from each of its lines, against those that start earlier
            n = 0
            while k + n < len(full) and tuple(words[k : k + n + 1]) in seen:
                n += 1
            longest.append(n)
            seen.update(tuple(words[k:e]) for e in range(k + 1, len(full) + 1))
        runs = [(k, n) for k, n in enumerate(longest) if n and (not k or longest[k - 1] <= n) and sum(map(len, words[k : k + n])) >= least]
        gone = {full[i] for k, n in runs for i in range(k, k + n)}
        edited = "\n".join(x for i, x in enumerate(lines) if i not in gone) if text is not None else None
        out.append((doc, edited, len(full), len(gone), len(runs), max((n for _, n in runs), default=0)))
    return sorted(out, key=str)


def made(seed):
    rng = random.Random(seed)
    kinds = [f"line {i}" for i in range(12)] + ["x" * 30, "y" * 30, "", " \t", "é"]
    texts = ["\n".join(rng.choices(kinds, k=rng.randint(0, 12))) for _ in range(80)]
    texts += [None, "", "\n\n", "line 1\n" * 40, texts[0], texts[1] + "\nnew"]
    return list(zip([*rng.sample(range(1000), len(texts) - 1), None], texts))


def test_matches_brute_force(spark, monkeypatch):
    from tests.llm.conftest import frame

    rows = made(3)
    docs = frame(spark, [(i, t, None) for i, t in rows]).repartition(5)
    for chunk, least in ((lines.CHUNK, 20), (1, 1)):
        monkeypatch.setattr(lines, "CHUNK", chunk)
        got = line_dedup(docs, ["doc_id"], least).collect()
        assert sorted(map(tuple, got), key=str) == brute(rows, least)


def test_long_runs_across_chunks(spark, monkeypatch):
    from tests.llm.conftest import frame

    rng = random.Random(8)
    base = [f"{rng.random()}" for _ in range(90)]
    rows = []
    for k in range(12):  # long runs with a line changed here and there, and a line that all share many times
        body = base[rng.randint(0, 20) : rng.randint(60, 90)]
        body[rng.randrange(len(body))] = f"own {k}"
        rows.append((k * 3, "\n".join(body + ["common"] * rng.randint(0, 9))))
    monkeypatch.setattr(lines, "CHUNK", 10)
    got = line_dedup(frame(spark, [(i, t, None) for i, t in rows]), ["doc_id"], 30).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 30)
    assert max(r.longest_run for r in got) > 16


def test_runs_end_with_their_documents(spark):
    from tests.llm.conftest import frame

    # ends that are followed by equal lines in the next documents
    rows = [(k, "\n".join(["head", "a", "b", "c", "d", "e", "f"][: 7 - k % 3] if k % 2 else ["b", "c", "d", "e", "f", f"own {k}"])) for k in range(9)]
    rows += [(20 + k, "\n".join([*"abcdefgh"][k % 4 : 5 + k % 3])) for k in range(14)]
    got = line_dedup(frame(spark, [(i, t, None) for i, t in rows]), ["doc_id"], 1).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 1)


def test_rows_with_equal_ids(spark):
    from tests.llm.conftest import frame

    one, two = "a long line of some words that repeats\nx", "a long line of some words that repeats\ny"
    rows = [(1, one, None), (1, one, None), (1, two, None), (None, one, None), (None, one, None), (2, "other", None)]
    got = sorted((r.doc_id is None, r.n_removed, r.edited_text) for r in line_dedup(frame(spark, rows), ["doc_id"], 30).collect())
    assert [g[1] for g in got[:4]] == [0, 0, 0, 1] and [g[1:] for g in got[4:]] == [(2, ""), (2, "")]


def test_awkward_rows_keep_their_columns(spark, awkward, nothing):
    got = deduplicated(awkward, 20)
    assert got.dtypes == awkward.dtypes
    assert deduplicated(nothing).count() == 0
    clean = {r.doc_id for r in awkward.collect() if r.doc_id in (100, 101, 102, 104)}
    assert clean <= {r.doc_id for r in got.collect()}


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, x) for x in range(200, 300)] + [(rng.randint(400, 520), rng.randint(400, 520)) for _ in range(90)] + [(9, 9)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in edges:
        if u != v:
            a, b = find(u), find(v)
            root[max(a, b)] = min(a, b)
    got = components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r.node: r.root for r in got} == {x: find(x) for x in list(root)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
