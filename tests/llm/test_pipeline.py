"""The corpus pipeline: each stage on its own input against a plain version."""

from __future__ import annotations

import collections
import re

import duckdb
import pytest

import corpus_pipeline
from codeloom.llm.common import saved, table
from codeloom.llm.mixing import OP6_SQL
from codeloom.llm.queries import QUERIES
from tests.llm.test_operators import brute_classes

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """name: the rows that the stage gets and those it returns."""
    docs, out = table(spark, SF, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        after = saved(stage(spark, docs, SF), f"test-{name}")
        out[name] = docs.toPandas(), after.toPandas()
        docs = after
    return out


def plain_line_dedup(texts: dict[int, str]) -> dict[int, str]:
    seqs, seen, gone = {}, set(), collections.defaultdict(set)
    for i, t in texts.items():
        seqs[i] = [(k, s) for k, s in enumerate(t.split("\n")) if s.strip(" ")]
    for i in sorted(seqs):
        rows = seqs[i]
        for at in range(len(rows)):
            for n in (1, 2, 3, 4):
                window = tuple(s for _, s in rows[at : at + n])
                if len(window) < n or n < 4 and sum(len(re.findall(r"[^\x20\x09-\x0D]+", s)) for s in window) < 50:
                    continue
                if window in seen:
                    gone[i].update(k for k, _ in rows[at : at + n])
                seen.add(window)
    return {i: "\n".join(s for k, s in enumerate(t.split("\n")) if k not in gone[i]) for i, t in texts.items()}


def test_columns(stages):
    assert list(stages) == ["quality", "line_dedup", "near_duplicates", "mixing", "packing"]
    for name, (before, after) in stages.items():
        assert len(after) and (name == "packing" or list(after.columns) == list(before.columns))


def test_quality(spark, stages):
    before, after = stages["quality"]
    good = {r["doc_id"] for r in QUERIES["op2_quality_classifier"](spark, SF).where("predicted = 1").collect()}
    assert sorted(after.doc_id) == sorted(i for i in before.doc_id if i in good) and len(after) < len(before)


def test_lines(stages):
    before, after = stages["line_dedup"]
    texts = {i: t or "" for i, t in zip(before.doc_id, before.text)}
    want = plain_line_dedup(texts)
    want = {i: t for i, t in want.items() if t == texts[i] or t.strip()}
    assert dict(zip(after.doc_id, after.text.fillna(""))) == want and any(want[i] != texts[i] for i in want)


def test_near_duplicates(stages):
    before, after = stages["near_duplicates"]
    classes = brute_classes(dict(zip(before.doc_id, before.text)))
    assert sorted(after.doc_id) == sorted(i for i, (_, first) in classes.items() if i == first) and len(after) < len(before)


def test_mixing(stages):
    before, after = stages["mixing"]
    c = duckdb.connect()
    c.register("documents", before)
    want = c.execute(f"select doc_id, count(*) as n from ({OP6_SQL}) group by doc_id").df()
    assert collections.Counter(after.doc_id) == collections.Counter(dict(zip(want.doc_id, want.n)))


def test_packing(stages):
    before, after = stages["packing"]
    assert collections.Counter(before.doc_id) == collections.Counter(after.doc_id[after.piece == 0])
    for _, s in after.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]] and s.length.sum() <= 2048
