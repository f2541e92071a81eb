"""Counterfactual-regularised toxicity classifier.

A logistic model over the presence of words and word beginnings. Each sentence of a labelled text that names
a group (an identity term) is written again with every such term swapped for another; the loss adds the
squared change of the score between the two sentences, so that a group's mere mention neither raises nor
lowers it. Terms that the labelled texts don't name are swapped as sentences of their own, so they too are
held level. What a swap changes, as features, is summed over all sentences before it is collected: one row
for each different change, at most terms x terms x the words beside them that share a beginning.

Every setting is chosen by cross-validation within the rows that may be learned from (`cross_validated`).

Defined results: a null text counts as empty, with the score that the model gives to no word at all;
with one label alone every score is its smoothed share, without labels 0.5. Repeated rows get equal
scores, rows with a null id like any others; very long texts are scored whole, block by block; an empty
table gives an empty result. Only the key and text columns are read, so further columns, whatever their
names, don't matter.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import table
from codeloom.llm.labelled import labelled_sample, trains
from codeloom.llm.words import U, blocks, hashed, mix, utf8

#: Neutral group mentions, swapped for each other.
IDENTITY_TERMS = (
    "women", "men", "girls", "boys", "christians", "muslims", "jews", "hindus", "buddhists", "atheists",
    "gay", "straight", "lesbian", "transgender", "black", "white", "asian", "latino", "african", "european",
    "immigrants", "refugees", "natives", "disabled", "elderly", "young",
    "frauen", "männer", "christen", "muslime", "juden", "femmes", "hommes", "chrétiens", "musulmans", "juifs",
    "mujeres", "hombres", "cristianos", "musulmanes", "judíos",
)
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
BEGINNINGS = (5, 6, 7, 8)


_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
_RUN = re.compile("[0-9A-Za-z\\x80-\U0010ffff]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def swapped(text: str, swaps: int = 4) -> list[tuple[str, list[str]]]:
    """Each sentence of the text that names a group, with `swaps` other versions of it, by a hash of the sentence."""
    out, terms = [], set(IDENTITY_TERMS)
    for sentence in _SENTENCE.split(text):
        if any(w.translate(_LOWER) in terms for w in _RUN.findall(sentence)):
            at, n = zlib.crc32(sentence.encode("utf-8", "replace")), len(IDENTITY_TERMS)
            others = [IDENTITY_TERMS[(at + k * (1 + at // n % (n - 1))) % n] for k in range(swaps)]
            out.append((sentence, [_RUN.sub(lambda m, o=o: o if m[0].translate(_LOWER) in terms else m[0], sentence) for o in others]))
    return out


def features(texts: list[bytes]):
    """For each text its distinct feature hashes: words of letters and digits, and their beginnings."""
    for first, last, data in blocks(texts):
        buf = np.frombuffer(data, np.uint8)
        inside = np.concatenate(([False], _WORD[buf], [False]))
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        lo, hi = edges[0::2], edges[1::2]
        n = hi - lo
        found, at = [hashed(buf, lo, hi)], [lo]
        for k in BEGINNINGS:
            longer = n > k
            found.append(mix(hashed(buf, lo[longer], lo[longer] + k) + U(k)))
            at.append(lo[longer])
        h, at = np.concatenate(found), np.concatenate(at)
        ends = np.cumsum([len(t) + 1 for t in texts[first:last]])
        doc = np.searchsorted(ends, at, side="right")
        order = np.argsort(doc, kind="stable")
        cuts = np.searchsorted(doc[order], np.arange(last - first + 1))
        h = h[order]
        for i in range(last - first):
            yield np.unique(h[cuts[i] : cuts[i + 1]])


class Model:
    def __init__(self, vocabulary: np.ndarray):
        self.vocabulary, self.w, self.b, self.prior = vocabulary, np.zeros(vocabulary.size), 0.0, 0.5

    def positions(self, hashes: np.ndarray) -> np.ndarray:
        if not self.vocabulary.size:
            return np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), self.vocabulary.size - 1)
        return at[self.vocabulary[at] == hashes]

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(texts), self.prior)
        z = np.array([self.w[self.positions(h)].sum() for h in features(texts)]) + self.b
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def change(self, one: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Features that one sentence has and the other lacks, as position + 1, or less, as -(position + 1)."""
        a, b = self.positions(one), self.positions(other)
        return np.concatenate((np.setdiff1d(a, b) + 1, -(np.setdiff1d(b, a) + 1))).astype(np.int32)

    def carriers(self) -> list[np.ndarray]:
        """The changes of sentences that are an identity term alone, to none and to the next ones."""
        terms = list(features([t.encode() for t in IDENTITY_TERMS]))
        none = np.empty(0, np.uint64)
        return [self.change(t, o) for k, t in enumerate(terms) for o in (none, *(terms[(k + j) % len(terms)] for j in (1, 5, 11, 17)))]

    def fit(self, rows: list[np.ndarray], y: np.ndarray, changes: list[tuple[np.ndarray, int]] = (), swap: float = 5.0, decay: float = 3e-5, steps: int = 600, rate: float = 0.05) -> Model:
        """rows: positions of each labelled text's features. changes: what swaps change, with their numbers.
        swap: weight of the counterfactual penalty."""
        if not len(y) or y.min() == y.max():
            self.prior = (y.sum() + 1) / (len(y) + 2)
            return self
        self.prior = None
        changes = [c for c in [*changes, *((d, 1) for d in self.carriers())] if c[0].size]
        weight = np.array([n for _, n in changes], np.float64) / max(1, sum(n for _, n in changes))
        pdoc, flat = np.repeat(np.arange(len(changes)), [d.size for d, _ in changes]), np.concatenate([np.empty(0, np.int32), *(d for d, _ in changes)]).astype(np.int64)
        pfeat, psign = np.abs(flat) - 1, np.sign(flat).astype(np.float64)
        doc, feat = np.repeat(np.arange(len(rows)), [r.size for r in rows]), np.concatenate(rows).astype(np.int64)
        size, m, v = self.vocabulary.size + 1, 0.0, 0.0
        w = np.zeros(size)
        w[-1] = np.log(y.mean() / (1 - y.mean()))
        for step in range(1, steps + 1):
            z = np.bincount(doc, w[feat], len(rows)) + w[-1]
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(rows)
            grad = decay * w
            grad[-1] = g.sum()
            grad[:-1] += np.bincount(feat, g[doc], size - 1)
            change = weight * np.bincount(pdoc, w[pfeat] * psign, len(changes))  # change of the score's logit
            grad[:-1] += 2 * swap * np.bincount(pfeat, change[pdoc] * psign, size - 1)
            m = 0.9 * m + 0.1 * grad
            v = 0.999 * v + 0.001 * grad**2
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        self.w, self.b = w[:-1], float(w[-1])
        return self


def vocabulary(sample: DataFrame, size: int = 600, least: int = 5, gain_from: float = 25.0) -> np.ndarray:
    """The features that tell the labels apart best (chi-square over the sample, from a least value), the best
    first. The identity terms' own, which Model needs too, aren't among what is added here."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            marks = np.array(b.column(1).to_pylist(), np.int64)
            sets = list(features(utf8(b.column(0))))
            if sets:
                h, inverse = np.unique(np.concatenate(sets), return_inverse=True)
                mark = np.repeat(marks, [s.size for s in sets])
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.bincount(inverse, mark, h.size).astype(np.int64)), pa.array(np.bincount(inverse, minlength=h.size).astype(np.int64))], names=["term", "pos", "n"])

    terms = sample.select("text", "label").mapInArrow(run, "term long, pos long, n long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n")).where(f"n >= {least}")
    one = sample.agg(F.sum("label").alias("p"), F.count("*").alias("n")).first()
    rate = (one["p"] or 0) / max(1, one["n"])
    expected = F.col("n") * rate
    gain = (F.col("pos") - expected) * (F.col("pos") - expected) / (expected + 1e-9)
    best = terms.where(gain >= gain_from).orderBy(gain.desc(), "term").limit(size).select("term").collect()  # bounded by size
    return np.array([r["term"] for r in best], np.int64).view(np.uint64)


def with_terms(chosen: np.ndarray) -> np.ndarray:
    return np.unique(np.concatenate([chosen, *features([t.encode() for t in IDENTITY_TERMS])]))


def prepared(sample: DataFrame, model: Model) -> tuple[list[np.ndarray], np.ndarray, list[tuple[np.ndarray, int]]]:
    """Positions and label of each row, in a fixed order, and what swaps in all rows' sentences change."""
    import pyarrow as pa

    held = sample.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            got = [held.value.positions(h).astype(np.int32).tobytes() for h in features(utf8(b.column(0)))]
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.binary()), b.column(1), b.column(2)], names=["x", "label", "doc_id"])

    def swaps(batches):
        for b in batches:
            found: dict[bytes, int] = {}
            for text in b.column(0).to_pylist():
                for sentence, others in swapped(text or ""):
                    first, *rest = features([t.encode("utf-8", "replace") for t in (sentence, *others)])
                    for o in rest:
                        d = held.value.change(first, o).tobytes()
                        found[d] = found.get(d, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["d", "n"])

    kind = sample.schema["doc_id"].dataType.simpleString()
    rows = sample.select("text", "label", "doc_id").mapInArrow(run, f"x binary, label int, doc_id {kind}").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["x"]))
    found = sample.select("text").mapInArrow(swaps, "d binary, n long").groupBy("d").agg(F.sum("n").alias("n")).collect()
    changes = sorted((bytes(r["d"]), r["n"]) for r in found)
    return [np.frombuffer(r["x"], np.int32) for r in rows], np.array([r["label"] for r in rows], np.float64), [(np.frombuffer(d, np.int32), n) for d, n in changes]


def train(sample: DataFrame, **kw) -> Model:
    """From (doc_id, text, label) rows: a bounded sample."""
    model = Model(with_terms(vocabulary(sample)))
    return model.fit(*prepared(sample, model), **kw)


def cross_validated(sample: DataFrame, sizes=(300, 600, 1200), gains=(10.0, 25.0), decays=(3e-5, 1e-4, 1e-3), folds: int = 4) -> list[tuple[float, tuple]]:
    """(F1 at 0.5, (size, gain_from, decay)) of each setting, best first, by folds of the sample alone.

    A fold's rows have no part in its vocabulary, its swaps or its fit."""
    fold, hits = F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(folds)), {}
    for k in range(folds):
        inside, outside = sample.where(fold != k).persist(), sample.where(fold == k).persist()
        for gain in gains:
            ranked = vocabulary(inside, max(sizes), gain_from=gain)
            for size in sizes:
                model = Model(with_terms(ranked[:size]))
                x, y, changes = prepared(inside, model)
                z, want, _ = prepared(outside, model)
                for decay in decays:
                    model.fit(x, y, changes, decay=decay)
                    got = np.array([model.w[p].sum() + model.b > 0 for p in z])
                    h = hits.setdefault((size, gain, decay), np.zeros(3))
                    h += [(got & (want == 1)).sum(), (got & (want == 0)).sum(), (~got & (want == 1)).sum()]
        inside.unpersist()
        outside.unpersist()
    return sorted(((float(2 * a / max(1, 2 * a + b + c)), key) for key, (a, b, c) in hits.items()), reverse=True)


def score(docs: DataFrame, model: Model, threshold: float = 0.5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score, predicted of every whole text; one pass, no shuffle."""
    import pyarrow as pa

    frame = docs.select(key, text)
    kind = frame.schema[key].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the vocabulary's size

    def run(batches):
        for b in batches:
            s = held.value.scores(utf8(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32())], names=[key, "score", "predicted"])

    return frame.mapInArrow(run, f"`{key}` {kind}, score double, predicted int")


def op4_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(labelled_sample(docs.where(trains()), labels.where(trains()), "toxic", 12_000))
    return score(docs, model).select("doc_id", (~trains()).alias("held_out"), "score", "predicted")
