"""Each stage against a plain version of itself, over its own input."""

import os
import re
from collections import Counter, defaultdict

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from gridloom.llm.queries import tokenizer
from gridloom.llm.scratch import written
from tests.llm.test_lines import brute as plain_lines
from tests.llm.test_minhash import brute as plain_links

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the synthetic tables")


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], DATA), "test"))
    return out


def texts(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_columns(stages):
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for df in stages[1:-1]:
        assert df.dtypes == stages[0].dtypes


def test_quality_keeps_what_is_good(spark, stages):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    before, after = dict(texts(stages[0])), dict(texts(stages[1]))
    assert after.items() <= before.items()
    assert sum(d in after for d, q in labels.items() if q == 1) >= 0.98 * sum(q == 1 for q in labels.values())
    assert sum(d in after for d, q in labels.items() if q == 0) <= 0.2 * sum(q == 0 for q in labels.values())


def test_line_dedup(stages):
    want = {d: t for d, t, _, n, *_ in plain_lines(texts(stages[1]), 40) if not n or re.search(r"[^\x20\x09-\x0D]", t)}
    assert dict(texts(stages[2])) == want


def test_minhash(stages):
    rows = texts(stages[2])
    want = {d for d, _, _, kept in plain_links(rows, 5, (80, 100)) if kept}
    assert dict(texts(stages[3])) == {d: t for d, t in rows if d in want}


def test_mixing(stages):
    before, after = {r.doc_id: r for r in stages[3].collect()}, stages[4].collect()
    copies = Counter(r.doc_id for r in after)
    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    assert max(copies.values()) <= 3 and all(before[r.doc_id] == r for r in after)
    total = sum(map(size, before.values()))
    assert abs(sum(map(size, after)) - total) <= 0.1 * total


def test_packing(stages):
    tok = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    want = Counter()
    for r in stages[4].collect():
        n = len(tok.encode(r.text or "", add_special_tokens=False).ids) + 1
        want.update((r.doc_id, k, min(2048, n - 2048 * k)) for k in range(-(-n // 2048)))
    rows = stages[5].collect()
    assert Counter((r.doc_id, r.piece, r.length) for r in rows) == want
    fill = defaultdict(list)
    for r in rows:
        fill[r.sequence_id].append((r.offset, r.length))
    for items in fill.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(fill) <= -(-sum(r.length for r in rows) // 2048) * 1.15 + 2


def test_awkward_rows_pass_every_stage(spark, awkward, nothing):
    for docs in (awkward.drop("size", "rank", "blob"), nothing.drop("size", "rank", "blob")):
        for _, stage in corpus_pipeline.STAGES:
            docs = written(stage(spark, docs, DATA), "test")
        docs.count()


def test_run(spark, stages):
    assert corpus_pipeline.run(spark, DATA).count() == stages[-1].count()
