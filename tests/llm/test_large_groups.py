"""Groups of many similar sets, compared block against block, against plain classes."""

from __future__ import annotations

import numpy as np
import pytest

from codeloom.llm import jaccard
from tests.llm.test_operators import brute_classes


def texts(rng, groups: int, most: int, edits: int) -> dict[int, str]:
    """Near copies of some texts, up to about the threshold, in which chains lead beyond any one text's reach."""
    word, out = lambda: "".join(rng.choice(list("abcdefgh"), 6)), {}
    for _ in range(groups):
        t = [word() for _ in range(120)]
        for _ in range(int(rng.integers(2, most))):
            t = list(t)
            for _ in range(int(rng.integers(0, edits))):
                t[int(rng.integers(0, len(t)))] = word()
            out[len(out)] = " ".join(t)
    return out


@pytest.mark.parametrize("block", [2, 5])
def test_block_against_block(spark, monkeypatch, block):
    old = jaccard.verified
    monkeypatch.setattr(jaccard, "verified", lambda *a: old(*a, block=block))
    docs = texts(np.random.default_rng(block), 8, 40, 3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similar_classes(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()}
    assert got == brute_classes(docs)
