"""The distributed tree against all pairs, on odd vectors and on shapes that levels split differently."""

from __future__ import annotations

import numpy as np
import pytest

from codeloom.llm import embeddings


def plain(rows, least: float = 0.98):
    """{place: (links, component)} by all pairs; rows: (id, vector, label)."""
    good = [k for k, (i, v, label) in enumerate(rows) if i is not None and label is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    out = {k: (0, rows[k][0]) for k in range(len(rows))}
    for size, label in {(len(rows[k][1]), rows[k][2]) for k in good}:
        ks = [k for k in good if (len(rows[k][1]), rows[k][2]) == (size, label)]
        x = embeddings.unit(embeddings.scaled(np.array([rows[k][1] for k in ks], float)))
        near = x @ x.T >= least
        np.fill_diagonal(near, False)
        least_id, changed = np.array([rows[k][0] for k in ks]), True
        while changed:
            new = np.minimum(least_id, np.where(near, least_id[None], np.iinfo(np.int64).max).min(axis=1))
            changed, least_id = (new != least_id).any(), new
        out |= {k: (int(near[j].sum()), int(least_id[j])) for j, k in enumerate(ks)}
    return out


def same(spark, rows, **kw):
    df = spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], label, "x") for i, v, label in rows], "vec_id long, embedding array<double>, label int, node string")
    got = sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"])) for r in embeddings.near_duplicates(df, **kw).collect())
    want = plain(rows)
    assert got == sorted((str(rows[k][0]), n, str(c)) for k, (n, c) in want.items())
    return sum(n for n, _ in want.values())


def test_shapes(spark):
    rng = np.random.default_rng(1)
    groups = [c + 0.05 * rng.normal(size=(int(n), 8)) for c, n in zip(rng.normal(size=(25, 8)), rng.integers(1, 40, 25))]
    tight = 1 + 0.01 * rng.normal(size=(150, 8))  # all within the distance: a dense leaf with guests around it
    around = 1 + 0.12 * rng.normal(size=(120, 8))
    loose = rng.normal(size=(200, 8))
    rows = [(k, v, int(k % 7 == 0)) for k, v in enumerate(np.concatenate((*groups, tight, around, loose)).tolist())]
    assert same(spark, rows, chunk=16) > 10_000


def test_repeated_ids_and_extreme_sizes(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(6, 4))
    rows = [(k % 5, (c + 0.02 * rng.normal(size=4)).tolist(), 0) for k, c in enumerate(np.repeat(base, 4, axis=0))]
    rows += [(100 + k, (base[k] * s).tolist(), 0) for k, s in enumerate((1e-200, 1e200, 1e-320, 1e307, 5e-324, -1e-200))]
    rows += [(200, [1e-200, 0, 0, 0], 0), (201, [1e200, 0, 0, 0], 0), (202, [0, 0, 0, 0], 0), (203, None, 0), (204, [], 0), (205, [1.0, None], 0), (206, [float("inf"), 1, 1, 1], 0), (None, base[0].tolist(), 0), (207, base[0].tolist(), None), (208, [1.0, 2.0], 0), (208, [1.0, 2.0], 0)]
    rows = [r for r in rows if r[0] not in (102, 104)] + [(102, [3e-320, -2e-320, 1e-320, 5e-320], 0), (104, [5e-324, 0, 0, 5e-324], 0)]
    assert same(spark, rows) > 20


@pytest.mark.parametrize("deepest", [0, 1])
def test_leaves_that_stay_large(spark, monkeypatch, deepest):
    old = embeddings.leaves
    monkeypatch.setattr(embeddings, "leaves", lambda *a: old(*a, deepest=deepest))
    rng = np.random.default_rng(3)
    assert same(spark, [(k, v, 0) for k, v in enumerate((rng.normal(size=(1, 6)) + 0.1 * rng.normal(size=(120, 6))).tolist())], chunk=16) > 100


def test_samples_that_miss_a_node(spark, monkeypatch):
    old = embeddings._children
    monkeypatch.setattr(embeddings, "_children", lambda large, distance, chunk, fan, sample: old(large, distance, chunk, fan, 2))
    rng = np.random.default_rng(4)
    same(spark, [(k, v, k % 9) for k, v in enumerate(rng.normal(size=(400, 4)).tolist())], chunk=16)


def test_visits_lose_no_partner():
    rng = np.random.default_rng(5)
    for _ in range(20):
        x = embeddings.unit(rng.normal(size=(1, 12)) * rng.random() * 2 + rng.normal(size=(300, 12)))
        centres = embeddings.spread(x[:60], 12)
        home, may, _ = embeddings.visits(x, centres, 0.5)
        near = np.sqrt(np.maximum(0, 2 - 2 * x @ x.T)) <= 0.5
        for i, j in zip(*np.nonzero(near)):
            assert may[i, home[j]] and may[j, home[i]]
