"""Stages of the corpus pipeline on rows that the given tables don't hold."""

from __future__ import annotations

import collections

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from codeloom.llm.common import table
from codeloom.llm.mixing import draws
from codeloom.llm.quality import learn, score

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], COLUMNS)


def words(name: str, n: int = 40) -> str:
    return " ".join(f"{name}{k}" for k in range(n))


def ids_and_texts(df):
    return collections.Counter((r["doc_id"], r["text"]) for r in df.collect())


@pytest.fixture(scope="module")
def verdicts(spark):
    """The documents, and two ids without a label: of an accepted text and of a rejected one."""
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    scored = score(docs, learn(docs, labels)).join(docs, "doc_id").join(labels.select("doc_id"), "doc_id", "left_anti")
    return docs, *(scored.where(f"predicted = {p}").orderBy("doc_id").select("doc_id", "text").first() for p in (1, 0))


def test_quality_judges_each_row(spark, verdicts):
    docs, good, bad = verdicts
    more = docs.union(frame(spark, [(good["doc_id"], bad["text"], "x"), (good["doc_id"], good["text"], "x")]))
    got = ids_and_texts(corpus_pipeline.quality(spark, more, SF).where(F.col("doc_id") == good["doc_id"]))
    assert got == {(good["doc_id"], good["text"]): 2}


def test_near_duplicates_reduces_repeated_rows(spark):
    a, near = words("a"), words("a", 39)
    rows = [(1, a), (1, a), (1, a), (2, near), (3, words("b")), (3, words("c")), (4, words("d")), (4, words("d", 39)), (5, a), (5, words("e")), (6, ""), (6, "")]
    got = ids_and_texts(corpus_pipeline.near_duplicates(spark, frame(spark, [(i, t, "x") for i, t in rows]), SF))
    assert set(got.values()) == {1} and sum(i == 4 for i, _ in got) == 1
    assert {x for x in got if x[0] != 4} == {(1, a), (3, words("b")), (3, words("c")), (5, words("e")), (6, "")}


def test_mix_draws_repeated_rows_as_often_as_they_are_there(spark):
    rows = [(i, words(f"s{i}", 10 + i % 3), "small") for i in range(20)] + [(i, words(f"l{i}"), "large") for i in range(100, 160)]
    docs = frame(spark, rows + rows[:1] * 4 + rows[30:31] * 9 + [(1, words("other", 11), "small")])
    want = draws(docs).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens")).collect()
    got = corpus_pipeline.mix(spark, docs, SF).withColumn("tokens", F.size(F.split("text", " "))).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and sum(r["n"] for r in want) > docs.count() / 2


def test_quality_judges_rows_without_id(spark, verdicts):
    docs, good, bad = verdicts
    more = docs.union(frame(spark, [(None, bad["text"], "x"), (None, good["text"], "x"), (None, good["text"], "x")]))
    assert ids_and_texts(corpus_pipeline.quality(spark, more, SF).where("doc_id is null")) == {(None, good["text"]): 2}


def test_lines_leaves_rows_without_id(spark):
    run = "\n".join(words(f"r{k}", 5) for k in range(4))
    got = ids_and_texts(corpus_pipeline.lines(spark, frame(spark, [(1, run, "x"), (None, run, "x"), (None, run, "x"), (None, None, "x")]), SF))
    assert got == {(1, run): 1, (None, run): 2, (None, None): 1}


def test_near_duplicates_keeps_rows_without_id(spark):
    rows = [(1, words("a"), "x"), (2, words("a"), "x"), (None, words("a"), "x"), (None, words("a"), "x"), (None, None, "x"), (3, None, "x")]
    got = ids_and_texts(corpus_pipeline.near_duplicates(spark, frame(spark, rows), SF))
    assert got == {(1, words("a")): 1, (None, words("a")): 2, (None, None): 1, (3, None): 1}


def test_mix_draws_rows_with_nulls(spark):
    rows = [(i, words(f"l{i}"), "large") for i in range(40)] + [(None, words("n"), "large"), (None, words("n"), "large"), (None, words("m"), None), (90, words("k"), None), (None, None, "large")]
    docs = frame(spark, rows)
    want = {tuple(r) for r in draws(docs).groupBy("doc_id", "source").agg(F.count("*").alias("n")).collect()}
    got = corpus_pipeline.mix(spark, docs, SF)
    assert {tuple(r) for r in got.groupBy("doc_id", F.coalesce("source", F.lit("")).alias("source")).agg(F.count("*").alias("n")).collect()} == want
    assert {n for i, s, n in want if i is None} and {r["text"] for r in got.where("doc_id is null").collect()} >= {words("m")}


def test_packing_holds_rows_without_id(spark):
    docs = frame(spark, [(1, words("a"), "x"), (None, words("n"), "x"), (None, words("m"), "x")])
    got = corpus_pipeline.sequences(spark, docs, SF)
    assert got.where("doc_id is null and piece = 0").count() == 2 and got.where("piece = 0").count() == 3
