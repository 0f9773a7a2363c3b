import hashlib
import re
from collections import defaultdict

import pytest

from gridloom.llm.exact_dedup import DigestIndex, exact_dedup
from gridloom.llm.mixing import CURRICULUM, Schedule, mix_sources, mixed_documents, training_order
from gridloom.llm.scratch import new_path
from gridloom.llm.secrets import BASE_RULES, BlobLedger, Rule, secret_spans

BASE = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    ("access", re.compile(r"(AKIA[A-Z0-9]+)"), 1, 20),
    ("hex", re.compile(r"([0-9a-f]+)"), 1, 24),
]
CASES = [
    "token=token: abcdefgh", "PassWord = 'hunter2hunter2' api_key:\"abc\"", "AKIA" + "A" * 15, "xxAKIA" + "B" * 16 + "z", "AKIAAKIA" + "Z" * 14,
    "f" * 23, "0" * 24 + "g" + "a" * 30, "\U0001f600é secret:abcdef", "secret=" + "ab12" * 8, "toKen=abcdefgh", "token==abcdef", "secret:\nabcdefg", "tokentoken=abcdef token=abcdef",
]


def spans_of(text):
    found = []
    for order, (kind, pattern, group, least) in enumerate(BASE):
        for m in pattern.finditer(text):
            low = kind != "assign" or all(c.isascii() or c not in m.group(1) for c in m.group(1))
            if low and len(m.group(group)) >= least:
                found.append((m.start(), order, m.end(), kind))
    return sorted(found)


def test_spans_match_brute_force(spark, awkward, nothing):
    from tests.llm.conftest import frame

    docs = awkward.unionByName(frame(spark, [(1000 + i, t, None) for i, t in enumerate(CASES)]))
    got = secret_spans(docs).collect()
    want = []
    for r in docs.collect():
        s = spans_of(r.text or "")
        listed = ",".join(f"{k}:{a}:{b}" for a, _, b, k in s)
        n = [sum(x[3] == k for x in s) for k in ("assign", "access", "hex")]
        want.append((r.doc_id, *n, hashlib.sha256(listed.encode()).hexdigest(), listed))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert secret_spans(nothing).count() == 0


def test_ledger_scans_only_what_is_new(spark):
    from tests.llm.conftest import frame

    ledger = BlobLedger(spark, new_path(spark, "ledger-test"))
    first = frame(spark, [(1, "secret: abcdef", None), (2, "secret: abcdef", None)])
    assert [len(r.found) for r in ledger.scan(first).collect()] == [1, 1]
    assert ledger.rows().count() == 3
    more = first.unionByName(frame(spark, [(3, "nothing", None)]))
    assert sorted((r.doc_id, len(r.found)) for r in ledger.scan(more).collect()) == [(1, 1), (2, 1), (3, 0)]
    assert ledger.rows().count() == 6
    newer = (*BASE_RULES, Rule("pin", r"(pin [0-9]+)", 1, 5, version=2))
    ledger.scan(more, newer)
    assert ledger.rows().count() == 8


def test_exact_dedup(spark, awkward, nothing):
    rows = exact_dedup(awkward).collect()
    groups = defaultdict(list)
    for r in awkward.collect():
        groups[hashlib.sha256((r.text or "").encode()).hexdigest()].append(r.doc_id)
    assert len(rows) == awkward.count()
    for digest, ids in groups.items():
        own = [r for r in rows if r.text_sha256 == digest]
        keep = max((i for i in ids if i is not None), default=None)
        assert sorted(map(str, (r.doc_id for r in own))) == sorted(map(str, ids))
        assert {r.keep_id for r in own} == {keep} and {r.group_size for r in own} == {len(ids)}
        assert [r.doc_id for r in own if r.kept] == [keep]
    assert exact_dedup(nothing).count() == 0


def test_digest_index_is_incremental(spark):
    from tests.llm.conftest import frame

    index = DigestIndex(spark, new_path(spark, "index-test"), 3)
    index.ingest(frame(spark, [(1, "a", None), (2, "b", None)])).count()
    rows = index.ingest(frame(spark, [(8, "a", None), (9, "c", None), (10, "c", None)])).collect()
    assert sorted((r.doc_id, r.keep_id, r.kept) for r in rows) == [(8, 1, False), (9, 10, False), (10, 10, True)]
    assert index.rows().count() == 3
    plan = index.rows().groupBy("digest").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    index.close()


def test_digest_index_is_reopened(spark):
    from tests.llm.conftest import frame

    path = new_path(spark, "index-test")
    known = [(i, f"text {i}", None) for i in range(200)]
    index = DigestIndex(spark, path, 5)
    index.ingest(frame(spark, known[:120])).count()
    index.ingest(frame(spark, known[100:])).count()
    index.close()
    later = spark.newSession()
    later.conf.set("spark.sql.shuffle.partitions", "3")
    with pytest.raises(ValueError):
        DigestIndex(later, path, 8)
    index = DigestIndex(later, path)
    assert index.buckets == 5 and index.rows().count() == 200
    index.compact()
    assert index.rows().count() == 200 and len(index.rows().inputFiles()) <= 5
    rows = index.ingest(frame(later, [(1000 + i, t, s) for i, t, s in known] + [(5000, "new", None)])).collect()
    assert [r.doc_id for r in rows if r.kept] == [5000]
    index.close()
    assert DigestIndex(later, path).rows().count() == 201


def test_alike_and_clashing_rows_are_mixed(spark):
    from tests.llm.conftest import clashing, frame

    texts = clashing(spark)
    rows = [(None, t, "s") for t in texts * 4] + [(7, t, "s") for t in texts] + [(7, texts[0], "s")]
    docs = frame(spark, rows)
    got = mixed_documents(docs).collect()
    assert sorted(map(str, got)) == sorted(map(str, docs.collect()))


def level(sizes, weights, cap=3):
    target, free, left = {}, set(sizes), float(sum(sizes.values()))
    while free:
        unit = left / sum(weights[s] for s in free)
        over = {s for s in free if unit * weights[s] > cap * sizes[s]}
        if not over:
            return target | {s: unit * weights[s] for s in free}
        target |= {s: cap * sizes[s] for s in over}
        left -= sum(cap * sizes[s] for s in over)
        free -= over
    return target


def test_mixing(awkward, nothing):
    rows = mix_sources(awkward).collect()
    assert len(rows) == awkward.count()
    sizes = defaultdict(int)
    for r in awkward.collect():
        sizes[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    targets = level(sizes, {s: CURRICULUM[i % 3].weight for i, s in enumerate(order)})
    for s in sizes:
        own = [r for r in rows if r.source == s]
        assert own[0].source_size == sizes[s] and own[0].target == pytest.approx(targets[s])
        assert abs(sum(r.taken for r in own) - targets[s]) <= max(r.size for r in own) / 2 + 1e-6
        assert all(0 <= r.taken <= 3 * r.size for r in own)
    again = mix_sources(awkward.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))
    assert mix_sources(nothing).count() == 0
    copies = [r.position for r in training_order(mix_sources(awkward)).collect()]
    assert copies == sorted(copies) and len(copies) == sum(r.copies for r in rows)
    first = [r.positions[0] for r in rows if r.positions]
    assert first == sorted(first)


def test_positions_invert_the_schedule(spark):
    from tests.llm.conftest import frame

    docs = frame(spark, [(i, "w " * 10, "s") for i in range(200)])
    schedule = Schedule(1, ((0.0, 0.0), (0.5, 1.0), (1.0, 0.0)))
    rows = mix_sources(docs, (schedule,)).collect()
    got = sorted(p for r in rows for p in r.positions)
    for k, p in enumerate(got):
        share = 2 * p * p if p <= 0.5 else 1 - 2 * (1 - p) ** 2
        assert share == pytest.approx(k / 200, abs=1e-9)
