"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network.

Every term has a sparse ternary index vector, drawn from its hash. A term's context vector is the sum of
the index vectors of the terms near it in a bounded sample; its word vector joins both. Terms are words
and, beside each word, its shape (letter case, symbols, edges, length, whether it repeats the word
before), so that unseen words still say something. A document is pooled as the mean of its word vectors
and of its shape vectors, with how far these means are from random text's and its length.
A network of one hidden layer, in numpy, scores the pool; a temperature fitted on rows that it hasn't
seen makes its scores probabilities.

Defined results: a null text counts as empty; an empty text has an all-zero pool, which the network
scores like any other. Where one label alone was given, every score is that label's smoothed share;
without labels 0.5. Repeated rows get equal scores, rows with a null id like any others; very long texts are
pooled whole, piece by piece, at eight bytes a word; equal logits at the threshold are accepted; an empty
table gives an empty result. Only the key and text columns are read, so further columns, whatever their
names, don't matter; `accepted` passes all columns on.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from codeloom.llm.common import table
from codeloom.llm.labelled import labelled_sample, trains
from codeloom.llm.words import U, blocks, hashed, pieces, spans, utf8

WORDS, SHAPES, DIM = 1 << 15, 1 << 12, 32
_CLASS = np.zeros((5, 256), np.int32)  # upper case, letter, digit, symbol, bar
_CLASS[0, 65:91] = 1
_CLASS[1, 65:91] = _CLASS[1, 97:123] = _CLASS[1, 128:] = 1
_CLASS[2, 48:58] = 1
_CLASS[3, [b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,;:'\"()-?"]] = 1


def index_vectors(n: int, dim: int = DIM, ones: int = 6, seed: int = 7) -> np.ndarray:
    """n sparse ternary vectors."""
    rng = np.random.Generator(np.random.PCG64(seed))
    out = np.zeros((n, dim), np.float32)
    at = np.argsort(rng.random((n, dim)), axis=1)[:, :ones]
    np.put_along_axis(out, at, rng.choice(np.array([-1, 1], np.float32), (n, ones)), axis=1)
    return out


def _terms(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word ids, shape ids and word starts of a block."""
    lo, hi = spans(buf)
    h = hashed(buf, lo, hi)
    if not lo.size:
        return np.empty(0, np.int64), np.empty(0, np.int64), lo
    n = hi - lo
    sums = [np.add.reduceat(c[buf], np.ravel(np.column_stack((lo, hi)))[: 2 * lo.size - (hi[-1] == buf.size)])[::2] for c in _CLASS[:4]]
    upper, letters, digits, symbols = (np.asarray(s) for s in sums)
    first_up = _CLASS[0][buf[lo]]
    same = np.zeros(lo.size, np.int64)
    same[1:] = h[1:] == h[:-1]
    shape = np.minimum(n, 15) // 3
    for part, size in ((np.where(upper == 0, 0, np.where((upper == 1) & (first_up == 1), 1, np.where(upper * 2 > letters, 3, 2))), 4), (np.minimum(symbols, 3), 4), ((digits > 0).astype(int), 2), ((letters == 0).astype(int), 2), (same, 2), (_CLASS[3][buf[hi - 1]], 2)):
        shape = shape * size + part
    return (h % U(WORDS)).astype(np.int64), (shape % SHAPES).astype(np.int64), lo


def _by_doc(texts: list[bytes]):
    """(first text, word ids, shape ids, counts by text) of each block."""
    for first, last, data in blocks(texts):
        if last - first == 1:
            got = [_terms(buf)[:2] for _, buf in pieces(data)]
            w, s = (np.concatenate([g[k] for g in got]) if got else np.empty(0, np.int64) for k in (0, 1))
            yield first, w, s, np.array([w.size])
        else:
            w, s, lo = _terms(np.frombuffer(data, np.uint8))
            cuts = np.searchsorted(lo, np.cumsum([len(t) + 1 for t in texts[first:last]]))
            yield first, w, s, np.diff(np.concatenate(([0], cuts)))


def context_sums(sample: DataFrame, window: int = 2, groups: int = 32) -> np.ndarray:
    """Sums, over the sample, of the index vectors of each word's neighbours (words x dim).

    Each task adds up its part; parts of the matrix are added by group, each bounded by tasks x its size.
    """
    import pyarrow as pa

    step = WORDS // groups

    def run(batches):
        index, total = index_vectors(WORDS), np.zeros((WORDS, DIM), np.float32)
        for b in batches:
            for _, w, _, counts in _by_doc(utf8(b.column(0))):
                doc = np.repeat(np.arange(counts.size), counts)
                order = np.argsort(w, kind="stable")
                starts = np.flatnonzero(np.diff(w[order], prepend=-1))
                for d in range(1, window + 1):
                    near = np.zeros((w.size, DIM), np.float32)
                    ok = doc[d:] == doc[:-d]
                    near[d:][ok] += index[w[:-d][ok]]
                    near[:-d][ok] += index[w[d:][ok]]
                    if w.size:
                        total[w[order][starts]] += np.add.reduceat(near[order], starts, axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(groups), pa.int32()), pa.array([total[g * step : (g + 1) * step].tobytes() for g in range(groups)], pa.binary())], names=["part", "sums"])

    def add(key, t):
        total = sum((np.frombuffer(x, np.float32) for x in t.column("sums").to_pylist()), np.zeros(step * DIM, np.float32))
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "sums": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

    rows = sample.select("text").mapInArrow(run, "part int, sums binary").groupBy("part").applyInArrow(add, "part int, sums binary").collect()
    out = np.zeros((WORDS, DIM), np.float32)
    for r in rows:  # the matrix: a fixed 4 MB
        out[r["part"] * step : (r["part"] + 1) * step] = np.frombuffer(r["sums"], np.float32).reshape(step, DIM)
    return out


class Pooler:
    def __init__(self, context: np.ndarray):
        size = np.linalg.norm(context, axis=1, keepdims=True)
        self.words = np.hstack((index_vectors(WORDS), 2.0 * context / np.maximum(size, 1e-6))).astype(np.float32)
        self.shapes = index_vectors(SHAPES, seed=11)
        self.size = 3 * DIM + 3

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        out = np.zeros((len(texts), self.size), np.float32)
        for first, w, s, counts in _by_doc(texts):
            lo = np.concatenate(([0], np.cumsum(counts)[:-1]))
            for i, (at, n) in enumerate(zip(lo.tolist(), counts.tolist())):
                if not n:
                    continue
                a, k = np.unique(w[at : at + n], return_counts=True)
                b, m = np.unique(s[at : at + n], return_counts=True)
                row = out[first + i]
                row[: 2 * DIM] = k.astype(np.float32) @ self.words[a] / n
                row[2 * DIM : 3 * DIM] = m.astype(np.float32) @ self.shapes[b] / n
                row[-3:] = np.linalg.norm(row[:DIM]), a.size / n, np.log1p(n) / 8
        return out


class Network:
    """Pool to probability: scaled inputs, tanh hidden layer, temperature."""

    def __init__(self, size: int, hidden: int = 32, seed: int = 3):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.mean, self.scale, self.temperature = np.zeros(size), np.ones(size), 1.0
        self.p = [rng.normal(0, size**-0.5, (size, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
        self.prior: float | None = 0.5

    def logits(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.p
        return np.tanh((x - self.mean) / self.scale @ a + b) @ c + d

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 30, rate: float = 3e-3, decay: float = 1e-4, batch: int = 128, seed: int = 5) -> Network:
        if not len(y) or y.min() == y.max():
            self.prior = (y.sum() + 1) / (len(y) + 2)
            return self
        self.prior = None
        rng = np.random.Generator(np.random.PCG64(seed))
        order = rng.permutation(len(y))
        apart, rest = order[: len(y) // 5], order[len(y) // 5 :]
        if len({*y[rest].tolist()}) < 2:
            rest = order
        self.mean, self.scale = x[rest].mean(axis=0), x[rest].std(axis=0) + 1e-3
        m, v, t = [np.zeros_like(p) for p in self.p], [np.zeros_like(p) for p in self.p], 0
        for _ in range(epochs):
            for part in np.array_split(rng.permutation(rest), max(1, len(rest) // batch)):
                z = (x[part] - self.mean) / self.scale
                h = np.tanh(z @ self.p[0] + self.p[1])
                g = (1 / (1 + np.exp(-np.clip(h @ self.p[2] + self.p[3], -30, 30))) - y[part]) / len(part)
                back = np.outer(g, self.p[2]) * (1 - h**2)
                grads = [z.T @ back + decay * self.p[0], back.sum(axis=0), h.T @ g + decay * self.p[2], np.array([g.sum()])]
                t += 1
                for k, grad in enumerate(grads):
                    m[k] += 0.1 * (grad - m[k])
                    v[k] += 0.001 * (grad**2 - v[k])
                    self.p[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        if apart.size:
            z, want = self.logits(x[apart]), y[apart]
            grid = np.geomspace(0.25, 8, 61)
            loss = [np.mean(np.logaddexp(0, np.where(want == 1, -z, z) / t)) for t in grid]
            self.temperature = float(grid[int(np.argmin(loss))])
        return self


def train(sample: DataFrame, window: int = 2) -> tuple[Pooler, Network]:
    """From (text, label) rows: a bounded sample."""
    import pyarrow as pa

    pooler = Pooler(context_sums(sample, window))
    held = sample.sparkSession.sparkContext.broadcast(pooler)  # a fixed 9 MB

    def run(batches):
        for b in batches:
            x = held.value(utf8(b.column(0)))
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), b.column(1), b.column(2)], names=["x", "label", "doc_id"])

    kind = sample.schema["doc_id"].dataType.simpleString()
    rows = sample.select("text", "label", "doc_id").mapInArrow(run, f"x binary, label int, doc_id {kind}").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["x"]))
    x = np.array([np.frombuffer(r["x"], np.float32) for r in rows], np.float64).reshape(len(rows), pooler.size)
    return pooler, Network(pooler.size).fit(x, np.array([r["label"] for r in rows], np.float64))


def score(docs: DataFrame, model: tuple[Pooler, Network], threshold: float = 0.3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score, predicted of every whole text; one pass, no shuffle."""
    import pyarrow as pa

    frame = docs.select(key, text)
    kind = frame.schema[key].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        pooler, network = held.value
        for b in batches:
            s = network.scores(pooler(utf8(b.column(1))).astype(np.float64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32())], names=[key, "score", "predicted"])

    return frame.mapInArrow(run, f"`{key}` {kind}, score double, predicted int")


def accepted(docs: DataFrame, model: tuple[Pooler, Network], threshold: float = 0.3, text: str = "text") -> DataFrame:
    """The rows of docs whose own text score() predicts 1 for, whatever their id; one pass, no shuffle."""
    import pyarrow as pa

    held, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)

    def run(batches):
        pooler, network = held.value
        for b in batches:
            yield b.filter(pa.array(network.scores(pooler(utf8(b.column(at))).astype(np.float64)) >= threshold, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def learn(docs: DataFrame, labels: DataFrame, rows: int = 12_000) -> tuple[Pooler, Network]:
    """A model from at most about `rows` labelled documents outside the held-out fold."""
    return train(labelled_sample(docs.where(trains()), labels.where(trains()), "quality", rows))


def op2_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = score(docs, learn(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (~trains()).alias("held_out"), "score", "predicted")
