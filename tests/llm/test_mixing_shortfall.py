"""What a document too long for the room left costs its source."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.llm import mixing


def test_shortfall_is_less_than_a_document(spark):
    rows = [(i, "w " * (1 + 997 * i % 300), f"s{i % 3}") for i in range(0, 90)] + [(900 + i, "w " * 2000, "s0") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    counted = mixing.counted(docs)
    totals = counted.groupBy("source").agg(F.sum("tokens").alias("total"))
    quota = {r["source"]: r["quota"] for r in mixing.weights(totals, 0.97, 4.0, 1.0).collect()}
    longest = {r["source"]: r["n"] for r in counted.groupBy("source").agg(F.max("tokens").alias("n")).collect()}
    drawn = {r["source"]: r["n"] for r in mixing.draws(docs, block_tokens=500).groupBy("source").agg(F.sum("tokens").alias("n")).collect()}
    assert all(0 <= quota[s] - drawn[s] < longest[s] for s in quota) and any(quota[s] > drawn[s] for s in quota)
