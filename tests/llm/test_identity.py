"""Rows that only a 32-bit hash of their text would take for one another."""

import pytest

from gridloom.llm.lines import line_dedup
from gridloom.llm.minhash import near_dedup, near_deduplicated
from gridloom.llm.substrings import substring_dedup
from tests.llm.conftest import clashing, frame


@pytest.fixture(scope="module")
def texts(spark):
    return clashing(spark)


def test_lines(spark, texts):
    rows = [(None, f"{t}\nthe same line in both of them") for t in texts] * 2
    got = {(r.edited_text, r.n_removed) for r in line_dedup(frame(spark, [(i, t, None) for i, t in rows]), ["doc_id"], 20).collect()}
    assert len(got) == 2 and sorted(n for _, n in got) == [0, 1] and all(t.startswith("some words of a text") for t, _ in got)


def test_minhash(spark, texts):
    docs = frame(spark, [(None, t, None) for t in texts * 4] + [(7, t, None) for t in texts] + [(8, texts[0], None)])
    got = near_dedup(docs, 3, (85, 100)).collect()
    assert len(got) == 11 and {r.component_id for r in got} == {7}
    assert sorted(r.text for r in near_deduplicated(docs, 3, (99, 100)).collect()) == sorted(texts)


def test_substrings(spark, texts):
    passage = " ".join(f"w{i}" for i in range(30))
    docs = frame(spark, [(None, f"{passage} {t}", None) for t in texts] * 3)
    got = {(r.n_removed, r.kept_text) for r in substring_dedup(docs, with_text=True).collect()}
    assert len(got) == 2 and min(n for n, _ in got) == 0 and max(n for n, _ in got) >= 30
    assert sum(passage in t for _, t in got) == 1
