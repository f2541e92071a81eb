"""Suffix ranks, longest earlier copies and maximal runs of lines against plain searches."""

from __future__ import annotations

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.llm import lines

COLUMNS = "doc_id long, text string"


def plain_copies(docs: dict[int, list[str]]) -> dict[tuple[int, int], int]:
    """(document, place): the longest run from there that begins earlier too."""
    places = [(d, i) for d in sorted(docs) for i in range(len(docs[d]))]
    out = {}
    for k, (d, i) in enumerate(places):
        best = 0
        for e, j in places[:k]:
            n = 0
            while i + n < len(docs[d]) and j + n < len(docs[e]) and docs[d][i + n] == docs[e][j + n]:
                n += 1
            best = max(best, n)
        if best:
            out[d, i] = best
    return out


def plain_deleted(docs, min_lines: int, min_words: int) -> dict[int, set[int]]:
    out = collections.defaultdict(set)
    for (d, i), n in plain_copies(docs).items():
        if n >= min_lines or sum(len(x.split()) for x in docs[d][i : i + n]) >= min_words:
            out[d] |= set(range(i, i + n))
    return out


def some_docs(rng) -> dict[int, list[str]]:
    """Runs of 1 to 13 lines dealt into documents, some twice into one, of few different lines."""
    line = lambda k: f"line {k} " + "word " * (k % 5) * 4
    runs = [[line(int(k)) for k in rng.integers(0, 40, int(n))] for n in rng.integers(1, 14, 10)]
    docs = {}
    for d in range(40):
        out = []
        for _ in range(int(rng.integers(0, 4))):
            out += runs[int(rng.integers(0, len(runs)))] if rng.random() < 0.7 else [line(int(k)) for k in rng.integers(0, 300, 4)]
        docs[d] = out
    docs[40] = ["same"] * 23
    docs[41] = ["same"] * 9
    return docs


def frame(spark, docs):
    return spark.createDataFrame([(d, "\n\n".join(x) if d % 3 else "\n".join(x)) for d, x in docs.items()], COLUMNS)


def test_copies_and_runs(spark):
    docs = some_docs(np.random.default_rng(1))
    seq = lines.line_sequence(frame(spark, docs)).cache()
    want = plain_copies(docs)
    levels = lines.doubled(seq)
    found = lines.longest_copies(levels).collect()
    assert {(r["doc"], r["at"]): r["lines"] for r in found} == want and max(levels) <= max(want.values()) < 2 * max(levels)
    for r in found:
        f, n = r["first"], r["lines"]
        assert docs[f["doc"]][f["at"] : f["at"] + n] == docs[r["doc"]][r["at"] : r["at"] + n] and (f["doc"], f["at"]) < (r["doc"], r["at"])
    covered, ends = collections.defaultdict(list), {}
    for r in sorted(lines.repeated_runs(seq).collect(), key=lambda r: (r["doc"], r["at"])):
        assert r["at"] + r["lines"] > ends.get(r["doc"], 0) and want[r["doc"], r["at"]] == r["lines"]
        ends[r["doc"]] = r["at"] + r["lines"]
        covered[r["doc"]] += range(r["new"], r["at"] + r["lines"])
    gone = plain_deleted(docs, 4, 50)
    assert {d: x for d, x in covered.items() if x} == {d: sorted(x) for d, x in gone.items() if x}


@pytest.mark.parametrize(("min_lines", "min_words"), [(4, 50), (6, 20)])
def test_deletions(spark, min_lines, min_words):
    docs = some_docs(np.random.default_rng(2))
    gone = plain_deleted(docs, min_lines, min_words)
    for r in lines.line_dedup(frame(spark, docs), min_lines, min_words).collect():
        left = [x for i, x in enumerate(docs[r["doc_id"]]) if i not in gone[r["doc_id"]]]
        assert [x for x in r["text"].split("\n") if x.strip()] == left and r["n_deleted"] == len(gone[r["doc_id"]])


def test_ranks_are_the_order_of_suffixes(spark):
    docs = some_docs(np.random.default_rng(3))
    seq = lines.line_sequence(frame(spark, docs)).cache()
    ids = {(r["doc"], r["at"]): (r["id"], r["id2"]) for r in seq.collect()}
    for h, rows in lines.doubled(seq).items():
        ranks = {(r["doc"], r["at"]): r["rank"] for r in rows.collect()}
        window = {p: tuple(ids[p[0], p[1] + k] for k in range(h)) for p in ranks}
        order = sorted(ranks, key=window.get)
        assert [window[p] for p in order] == [window[p] for p in sorted(ranks, key=lambda p: (ranks[p], order.index(p)))]
        assert all((window[a] == window[b]) == (ranks[a] == ranks[b]) for a, b in zip(order, order[1:]))


def test_heavy_lines(spark):
    """A line in a third of all rows is joined by broadcast, with the same result."""
    docs = {d: [f"own {d}", "common", f"other {d % 50}", "common", "x", "y", "z", "w"][: 3 + d % 6] for d in range(300)}
    seq = lines.line_sequence(frame(spark, docs)).cache()
    key = lambda df: {(r["doc"], r["at"]): (r["rank"], tuple(r["first"])) for r in df.collect()}
    assert key(lines.intervals(seq, ["id", "id2"], heavy=10)) == key(lines.intervals(seq, ["id", "id2"], heavy=1))


def test_odd_rows_and_names(spark):
    run = "\n".join(f"line {k} of the run" for k in range(5))
    rows = [(1, run), (1, run), (1, f"head\n{run}"), (2, f"{run}\nb"), (None, run), (3, None), (4, ""), (5, " \n\t\n"), (None, None)]
    d = spark.createDataFrame(rows, COLUMNS).withColumns({c: F.lit("mine") for c in ("__marks", "doc", "of", "at", "n", "flags", "row", "rank", "first", "n_lines", "n_deleted", "a.b")})
    got = lines.line_dedup(d)
    assert sorted(got.columns) == sorted(d.columns)
    out = collections.Counter((r["doc_id"], r["text"], r["n_lines"], r["n_deleted"]) for r in got.collect())
    assert out[3, None, 0, 0] == out[4, "", 0, 0] == out[5, " \n\t\n", out_lines(" \n\t\n"), 0] == out[None, run, 0, 0] == out[None, None, 0, 0] == 1
    assert out[2, "b", 6, 5] == 1
    # of the two texts of id 1 one keeps the run, and both copies of the other are treated alike
    assert (out[1, run, 5, 0], out[1, "head", 6, 5]) == (2, 1) or (out[1, "", 5, 5], out[1, f"head\n{run}", 6, 0]) == (2, 1)
    assert {r["flags"] for r in got.collect()} == {"mine"}
    assert lines.line_dedup(d.limit(0)).count() == 0
    assert lines.line_dedup(spark.createDataFrame([(1, "a\nb"), (2, "c")], COLUMNS)).agg(F.sum("n_deleted")).first()[0] == 0


def out_lines(text: str) -> int:
    """Lines with more than blanks; a tab alone is a line."""
    return sum(bool(x.strip(" ")) for x in text.split("\n"))
