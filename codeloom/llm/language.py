"""Language ID by rank-order n-gram profiles.

A text's profile is the list of its most frequent letter n-grams (1 to 3 letters, a blank at word
edges), most frequent first. A language's profile comes in the same way from labelled texts. The
prediction is the language with the least out-of-place distance: the sum, over the text's n-grams,
of the distance between ranks, or the profile's length where the language lacks the n-gram.

Defined results: `und` with score 0 for a null text or one without a letter, and for every text where
no labelled text was given; equal distances go to the language first by name. Labelled texts without
letters teach nothing. Repeated rows get equal results, rows with a null id like any others; a very long
text counts whole, block by block; an empty table gives an empty result. Only the key, text and lang columns
are read, so further columns, whatever their names, don't matter. What is collected and broadcast is one
rate and `size` n-grams a language: the number of languages is taken to be bounded.
"""

from __future__ import annotations

import unicodedata

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.llm.common import saved, table

UND = "und"
_BITS = 21
_tables: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point its lower-case letter, or 0 where it is no letter."""
    if not _tables:
        t = np.zeros(0x110000, np.uint64)
        for c in range(0x110000):
            ch = chr(c)
            if unicodedata.category(ch)[0] == "L":
                low = ch.lower()
                t[c] = ord(low) if len(low) == 1 else c
        _tables.append(t)
    return _tables[0]


def grams(text: str | None, block: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of the whole text, packed into 63 bits, with counts."""
    keys, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
    if not text:
        return keys, counts
    table, carry = _letters(), np.zeros(1, np.uint64)
    for at in range(0, len(text), block):
        code = table[np.frombuffer(text[at : at + block].encode("utf-32-le", "replace"), np.uint32)]
        last = at + block >= len(text)
        c = np.concatenate((carry, code, np.zeros(int(last), np.uint64)))
        fresh = carry.size  # n-grams end in this block
        keep = np.ones(c.size, bool)
        keep[1:] = (c[1:] != 0) | (c[:-1] != 0)  # blanks in a row are one
        fresh = int(keep[:fresh].sum())
        c = c[keep]
        two, three = c[:-1] | c[1:] << np.uint64(_BITS), None
        one = c[fresh:]
        parts = [one[one != 0]]
        ends2 = np.arange(1, c.size) >= fresh
        parts.append(two[ends2 & (c[:-1] + c[1:] != 0)])
        if c.size > 2:
            three = two[:-1] | c[2:] << np.uint64(2 * _BITS)
            ends3 = np.arange(2, c.size) >= fresh
            parts.append(three[ends3 & (c[1:-1] != 0)])
        k, n = np.unique(np.concatenate(parts), return_counts=True)
        if keys.size:
            both = np.concatenate((keys, k))
            keys, inverse = np.unique(both, return_inverse=True)
            counts = np.bincount(inverse, np.concatenate((counts, n)), keys.size).astype(np.int64)
        else:
            keys, counts = k, n.astype(np.int64)
        carry = c[-2:]
    return keys, counts


def top(keys: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent n-grams in order; of equally frequent ones the smaller first."""
    if keys.size > 4 * size:
        at = np.flatnonzero(counts >= np.partition(counts, keys.size - size)[keys.size - size])
        keys, counts = keys[at], counts[at]
    return keys[np.lexsort((keys, -counts))[:size]]


class Profiles:
    """Rank tables of all languages, for scoring."""

    def __init__(self, ranked: dict[str, list[int]], size: int):
        self.langs, self.size = sorted(ranked), size
        self.keys = np.unique(np.array([g for v in ranked.values() for g in v], np.uint64))
        self.ranks = np.full((len(self.langs), self.keys.size + 1), -1, np.int32)
        for i, lang in enumerate(self.langs):
            self.ranks[i, np.searchsorted(self.keys, np.array(ranked[lang], np.uint64))] = np.arange(len(ranked[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        k, n = grams(text)
        if not k.size or not self.langs:
            return UND, 0.0
        mine = top(k, n, self.size)
        at = np.searchsorted(self.keys, mine)
        at[(at == self.keys.size) | (self.keys[np.minimum(at, self.keys.size - 1)] != mine)] = self.keys.size
        ranks = self.ranks[:, at]
        far = np.where(ranks < 0, self.size, np.minimum(self.size, np.abs(ranks - np.arange(mine.size))))
        d = far.sum(axis=1) / (mine.size * self.size)
        best = int(np.argmin(d))
        # 1 where the text fits one language wholly, 1/L where it fits all alike
        near = np.maximum(1.0 - d, 1e-9) ** 4
        return self.langs[best], float(near[best] / near.sum())


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", size: int = 300, per_lang: int = 4000, seed: str = "profile") -> Profiles:
    """Profiles from at most about per_lang rows of each language (a stated bound), chosen by a hash of the text."""
    import pyarrow as pa

    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    n = rows.groupBy("lang").count()
    share = F.least(F.lit(1.0), F.lit(float(per_lang)) / F.col("count"))
    rates = {r["lang"]: r["share"] for r in n.select("lang", share.alias("share")).collect()}  # one row a language
    if not rates:
        return Profiles({}, size)
    draw = F.pmod(F.xxhash64(F.lit(seed), "text"), F.lit(1 << 30)) / float(1 << 30)
    rate = F.create_map(*[F.lit(x) for kv in rates.items() for x in kv])
    chosen = rows.where(draw < rate[F.col("lang")])

    def count(batches):
        held: dict[str, dict[int, int]] = {}

        def out():
            flat = [(lang, g, c) for lang, d in held.items() for g, c in d.items()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in flat], pa.string()), pa.array([x[1] for x in flat], pa.int64()), pa.array([x[2] for x in flat], pa.int64())], names=["lang", "gram", "n"])

        for b in batches:
            for t, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                d = held.setdefault(lang, {})
                k, c = grams(t)
                for g, x in zip(k.tolist(), c.tolist()):
                    d[g] = d.get(g, 0) + x
            if sum(map(len, held.values())) > 300_000:
                yield out()
        yield out()

    totals = saved(chosen.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "profile")
    # the top of each slice of a language, then of the language: one job, and no task holds all n-grams of one
    order = [F.desc("n"), F.asc("gram")]
    sliced = totals.withColumn("k", F.row_number().over(Window.partitionBy("lang", F.pmod("gram", F.lit(16))).orderBy(*order))).where(F.col("k") <= size)
    best = sliced.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("k") <= size)
    ranked: dict[str, list[int]] = {}
    for r in sorted(best.select("lang", "k", "gram").collect()):  # at most languages x size
        ranked.setdefault(r["lang"], []).append(r["gram"])
    return Profiles(ranked, size)


def identify(docs: DataFrame, profiles: Profiles, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred, score of every whole text; one pass, no shuffle."""
    import pyarrow as pa

    frame = docs.select(key, text)
    kind = frame.schema[key].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast(profiles)  # at most languages x size ranks

    def run(batches):
        for b in batches:
            got = [held.value.predict(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=[key, "lang_pred", "score"])

    return frame.mapInArrow(run, f"`{key}` {kind}, lang_pred string, score double")


def held_out(key: str = "doc_id"):
    """The rows that nothing may be learned from: crc32 of the id as text divides by 5."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(True))


def op9_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    profiles = learn(docs.where(~held_out()))
    out = identify(docs, profiles)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
