"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import saved


def connected_components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(id, component) of every id in the edges (a, b): component is the smallest id that links reach.

    Each round hangs every node's larger neighbours, then its smaller ones, on the smallest neighbour.
    Minima are combined before the shuffle and stored, so that a hub's joins can be split; nothing is
    collected but two numbers a round.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    e, before = saved(e, "edges"), None
    for _ in range(most_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = saved(both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m")), "stars")
        # large star: (u > v) hangs u on v's least neighbour
        large = e.join(low.withColumnRenamed("u", "v"), "v").select("u", F.col("m").alias("v")).where("u != v").distinct()
        large = saved(large, "large")
        # small star: u's smaller neighbours and u itself hang on the least of them
        least = saved(large.groupBy("u").agg(F.min("v").alias("m")), "stars")
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        e = saved(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (now["n"], now["h"]) == before:
            break
        before = (now["n"], now["h"])
    else:
        raise RuntimeError(f"components still change after {most_rounds} rounds")
    roots = e.select(F.col("v").alias("id")).distinct()
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots.select("id", F.col("id").alias("component")))
