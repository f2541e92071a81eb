"""Transitive closure of an edge table, for graphs that are one large table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.session import cut


def closure(edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(program_id, l, r): all paths of one edge or more. Path doubling: each round joins the newest paths
    with all paths, on both sides, so rounds grow with the logarithm of the longest path; beyond most_rounds,
    paths of 2^64 edges, it raises. Cycles end it too. Each round writes its new paths once; all paths are
    the rounds' tables together."""
    key = ["program_id", "l", "r"]
    step = lambda a, b: a.select("program_id", "l", F.col("r").alias("m")).join(b.select("program_id", F.col("l").alias("m"), "r"), ["program_id", "m"]).select(*key)
    new = every = cut(edges.select(*key).distinct())
    for k in range(most_rounds):
        found = step(new, every)
        if k:  # at first both are the edges
            found = found.union(step(every, new))
        new = cut(found.distinct().join(every, key, "left_anti"))
        if new.isEmpty():
            return every
        every = every.union(new)
    raise RuntimeError(f"closure not complete after {most_rounds} rounds")
