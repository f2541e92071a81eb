"""A bounded sample of labelled documents, for the two classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import saved


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, rows: int = 20_000, tasks: int = 16, seed: str = "sample") -> DataFrame:
    """(doc_id, text, label) of about `rows` labelled documents at most, chosen by a hash of the id.

    The bound makes the broadcast of the chosen labels and all later training steps constant in size.
    A null label or id is no label; of two labels for a document the greater counts.
    """
    have = labels.where(f"doc_id is not null and `{target}` is not null").groupBy("doc_id").agg(F.max(target).cast("int").alias("label"))
    n = labels.where(f"`{target}` is not null").count()
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    few = have.where(draw < min(1.0, rows / max(1, n)))
    got = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(few), "doc_id")
    return saved(saved(got, "labelled").repartition(tasks, "doc_id"), "sample")


def trains(key: str = "doc_id"):
    """Rows that a model may learn from."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 != 0, F.lit(False))
