"""The quality classifier's vectors, pools and network against plain loops."""

from __future__ import annotations

import collections
import math

import numpy as np

from codeloom.llm import quality, words
from codeloom.llm.queries import QUERIES

TEXTS = ["the cat saw the dog", "", "Dogs and cats, 42 of them!\nthe the", None, "a b c d e f g a b"]


def ids(text: str) -> list[int]:
    """Each word's id, by its own hash."""
    return [int(next(words.word_hashes([w.encode()]))[0] % np.uint64(quality.WORDS)) for w in (text or "").split()]


def test_context_sums(spark):
    want, index = collections.defaultdict(lambda: np.zeros(quality.DIM)), quality.index_vectors(quality.WORDS)
    for t in TEXTS:
        w = ids(t)
        for i, x in enumerate(w):
            for j in range(max(0, i - 2), min(len(w), i + 3)):
                if j != i:
                    want[x] += index[w[j]]
    got = quality.context_sums(spark.createDataFrame([(t or "",) for t in TEXTS], "text string").repartition(3))
    assert {int(k) for k in np.flatnonzero(got.any(axis=1))} == {k for k, v in want.items() if v.any()}
    assert all(np.allclose(got[k], v) for k, v in want.items())


def test_pools():
    rng = np.random.default_rng(1)
    pooler = quality.Pooler(rng.normal(size=(quality.WORDS, quality.DIM)).astype(np.float32))
    got = pooler([(t or "").encode() for t in TEXTS])
    for t, row in zip(TEXTS, got):
        w = ids(t)
        if not w:
            assert not row.any()
            continue
        mean = sum(pooler.words[x].astype(float) for x in w) / len(w)
        assert np.allclose(row[: 2 * quality.DIM], mean, atol=1e-5)
        assert np.allclose(row[-3:], [np.linalg.norm(mean[: quality.DIM]), len(set(w)) / len(w), math.log1p(len(w)) / 8], atol=1e-5)
    one = pooler([b"x " * 700_000])[0]
    assert np.allclose(one[: 2 * quality.DIM], pooler.words[ids("x")[0]], atol=1e-3)


def test_network_and_temperature():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 5))
    y = (x[:, 0] + 0.5 * x[:, 1] ** 2 - 0.5 + 0.7 * rng.normal(size=900) > 0).astype(float)  # noisy
    n = quality.Network(5).fit(x, y)
    a, b, c, d = n.p
    plain = [sum(math.tanh(sum((r[i] - n.mean[i]) / n.scale[i] * a[i, h] for i in range(5)) + b[h]) * c[h] for h in range(len(b))) + d[0] for r in x[:20]]
    assert np.allclose(n.logits(x[:20]), plain) and np.allclose(n.scores(x[:20]), [1 / (1 + math.exp(-z / n.temperature)) for z in plain])
    z, t = rng.normal(size=(4000, 5)), n.temperature
    truth = (z[:, 0] + 0.5 * z[:, 1] ** 2 - 0.5 + 0.7 * rng.normal(size=4000) > 0).astype(float)
    loss = lambda s: -np.mean(truth * np.log(s) + (1 - truth) * np.log(1 - s))
    assert np.mean((n.scores(z) > 0.5) == truth) > 0.65
    calibrated = loss(n.scores(z))
    n.temperature = 0.25
    assert t > 0.25 and calibrated < loss(n.scores(z))


def test_word_vectors_tell_alone(spark, monkeypatch):
    """Without the shapes and summary numbers the pooled word vectors still tell most labels."""
    call = quality.Pooler.__call__

    def words_only(self, texts):
        out = call(self, texts)
        out[:, 2 * quality.DIM :] = 0
        return out

    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    pooler, _ = quality.learn(docs, labels)
    fold = {r["doc_id"]: (r["text"], r["quality"]) for r in docs.join(labels, "doc_id").collect()}
    held = {r["doc_id"] for r in QUERIES["op2_quality_classifier"](spark, sf).where("held_out").select("doc_id").collect()}
    part = lambda inside: [v for k, v in sorted(fold.items()) if (k in held) != inside]
    x, z = (words_only(pooler, [(t or "").encode() for t, _ in part(k)]).astype(float) for k in (True, False))
    n = quality.Network(pooler.size).fit(x, np.array([float(q) for _, q in part(True)]))
    right = np.mean((n.scores(z) >= 0.3) == [q == 1 for _, q in part(False)])
    print(f"held-out share right by word vectors alone: {right:.3f}")
    assert right > 0.8
