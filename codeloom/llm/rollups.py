"""Token counts as delta-maintained rollups.

A change is a signed row: an insert adds a document's tokens, a delete takes them away, a revision adds
the difference of the new and the old count. `Rollup.commit` sums a batch of changes by source, language
and tokenizer version (partly before the shuffle, so a hot source costs no more than others), writes the
sums to a staging folder and renames that to the batch's name, which fails where the name is taken: of
several writers of one batch exactly one adds it, a repeated commit changes nothing, and a write that broke
off leaves nothing but its staging folder. Every `fold_after` batches their sums are added to the totals
held so far and stored as the next snapshot, by the same rename; the folded batches' sums are then removed,
their names stay. Totals are the latest snapshot plus the few batches after it and never look at documents,
or at batches that are folded, again. Everything lies in a folder that all machines share.

Defined results: nulls in source or language are a group of their own; null counts, and those of null or
empty texts, are 0; a key whose documents and tokens have both come to 0 isn't listed; without batches the
totals are empty, and a batch without changes adds nothing. Repeated rows in a batch count as often as they
come, whatever their ids, null ones too. Very long texts count whole. Only the named columns are read, so
further columns, whatever their names, don't matter.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.bpe import default_path, encoder
from codeloom.llm.common import saved, shared_dir, table
from codeloom.llm.words import spans

KEYS = ("source", "lang", "tokenizer_version")
SUMS = "source string, lang string, tokenizer_version string, docs long, tokens long"


def inserts(counted: DataFrame, version: str, tokens: str) -> DataFrame:
    return _change(counted, version, F.lit(1), F.col(tokens))


def deletes(counted: DataFrame, version: str, tokens: str) -> DataFrame:
    return _change(counted, version, F.lit(-1), -F.col(tokens))


def revisions(counted: DataFrame, version: str, old: str, new: str) -> DataFrame:
    return _change(counted, version, F.lit(0), F.coalesce(F.col(new), F.lit(0)) - F.coalesce(F.col(old), F.lit(0)))


def _change(counted: DataFrame, version: str, docs, tokens) -> DataFrame:
    return counted.select("source", "lang", F.lit(version).alias("tokenizer_version"), docs.cast("long").alias("docs"), F.coalesce(tokens, F.lit(0)).cast("long").alias("tokens"))


def _sum(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))


class Rollup:
    """path: a folder of the rollup's own. Names in it: batch=<name>, snapshot=<number>, staging-<random>."""

    def __init__(self, spark: SparkSession, path: str, fold_after: int = 8):
        self.spark, self.path, self.fold_after = spark, path.rstrip("/"), fold_after

    def _path(self, *names: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *names]))

    @property
    def _fs(self):
        return self._path().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, prefix: str, *under: str) -> list[str]:
        path = self._path(*under)
        if not self._fs.exists(path):
            return []
        found = [s.getPath().getName() for s in self._fs.listStatus(path)]
        return sorted(n[len(prefix) :] for n in found if n.startswith(prefix))

    def _take_name(self, staging: str, name: str) -> bool:
        """Renames the staging folder; False, and the folder gone, where the name is taken."""
        from py4j.protocol import Py4JJavaError

        sc = self.spark.sparkContext
        fs = sc._jvm.org.apache.hadoop.fs
        context = fs.FileContext.getFileContext(self._fs.getUri(), sc._jsc.hadoopConfiguration())
        try:
            context.rename(self._path(staging), self._path(name), sc._gateway.new_array(getattr(fs, "Options$Rename"), 0))
            return True
        except Py4JJavaError:
            self._fs.delete(self._path(staging), True)
            if not self._fs.exists(self._path(name)):
                raise
            return False

    def committed(self, batch: str) -> bool:
        last = self._latest()
        return self._fs.exists(self._path(f"batch={batch}", "sums")) or (last is not None and self._fs.exists(self._path(f"snapshot={last}", "held", batch)))

    def batches(self) -> list[str]:
        last = self._latest()
        return sorted(self._folded(last) | set(self._after(last)))

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """True if this call added the batch, False if it was there already."""
        if not batch.replace("-", "").replace("_", "").isalnum():
            raise ValueError(f"not a batch name: {batch!r}")
        if self.committed(batch):
            return False
        staging = f"staging-{uuid.uuid4().hex}"
        _sum(changes).write.parquet(f"{self.path}/{staging}/sums")
        if self._fs.exists(self._path(f"batch={batch}")) and not self.committed(batch):
            self._fs.delete(self._path(f"batch={batch}"), True)  # a folder without sums: none of this class's
        added = self._take_name(staging, f"batch={batch}")
        if added and len(self._after(self._latest())) >= self.fold_after:
            self.fold()
        return added

    def _latest(self) -> str | None:
        return max(self._names("snapshot="), default=None)

    def _folded(self, snapshot: str | None) -> set[str]:
        """The batches that a snapshot holds: their names lie in it, one file each."""
        return set() if snapshot is None else set(self._names("", f"snapshot={snapshot}", "held"))

    def _after(self, snapshot: str | None) -> list[str]:
        held = self._folded(snapshot)
        return [b for b in self._names("batch=") if b not in held and self._fs.exists(self._path(f"batch={b}", "sums"))]

    def _rows(self, snapshot: str | None, after: list[str]) -> DataFrame:
        paths = [f"{self.path}/batch={b}/sums" for b in after] + ([] if snapshot is None else [f"{self.path}/snapshot={snapshot}/sums"])
        return self.spark.read.schema(SUMS).parquet(*paths) if paths else self.spark.createDataFrame([], SUMS)

    def fold(self) -> bool:
        """Adds the batches after the latest snapshot to it; False where there are none, or another writer was first."""
        last = self._latest()
        after = self._after(last)
        if not after:
            return False
        staging = f"staging-{uuid.uuid4().hex}"
        _sum(self._rows(last, after)).write.parquet(f"{self.path}/{staging}/sums")
        self._fs.mkdirs(self._path(staging, "held"))
        for b in sorted(self._folded(last) | set(after)):
            self._fs.createNewFile(self._path(staging, "held", b))
        if not self._take_name(staging, f"snapshot={int(last or 0) + 1:012d}"):
            return False
        # a reader may still hold the last snapshot and its batches: only what that one held goes now
        for b in self._folded(last):
            self._fs.delete(self._path(f"batch={b}", "sums"), True)
        for old in self._names("snapshot=")[:-2]:
            self._fs.delete(self._path(f"snapshot={old}"), True)
        return True

    def totals(self) -> DataFrame:
        last = self._latest()
        return _sum(self._rows(last, self._after(last))).where("docs != 0 or tokens != 0")


def counted(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """docs' doc_id, source and lang with n_words (runs without white space) and n_bpe of every whole text."""
    import pyarrow as pa

    path = path or default_path()

    def run(batches):
        e = encoder(path)
        for b in batches:
            texts = [t or "" for t in b.column(3).to_pylist()]
            words = [spans(np.frombuffer(t.encode(), np.uint8))[0].size for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(words, pa.int64()), pa.array([e.ids(t).size for t in texts], pa.int64())], names=["doc_id", "source", "lang", "n_words", "n_bpe"])

    frame = docs.select("doc_id", F.col("source").cast("string"), F.col("lang").cast("string"), F.col(text))
    return frame.mapInArrow(run, f"doc_id {frame.schema['doc_id'].dataType.simpleString()}, source string, lang string, n_words long, n_bpe long")


def op10_token_counts(spark, sf_dir):
    """Loads every document under two tokenizer versions, revises one to count an end id a document,
    deletes the documents labelled as low quality, repeats two commits, and returns the totals. Every two
    batches are folded into a snapshot."""
    c = saved(counted(table(spark, sf_dir, "documents")), "counts")
    bad = table(spark, sf_dir, "labels").where("quality = 0").select("doc_id").distinct()
    gone = c.join(bad, "doc_id", "left_semi").withColumn("n_end", F.col("n_bpe") + 1)
    rollup = Rollup(spark, f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}", fold_after=2)
    ended = revisions(c.withColumn("n_end", F.col("n_bpe") + 1), "byte_bpe_50k", "n_bpe", "n_end")
    batches = {
        "0001-words": inserts(c, "words-1", "n_words"),
        "0002-bpe": inserts(c, "byte_bpe_50k", "n_bpe"),
        "0003-end-ids": ended,
        "0004-low-quality": deletes(gone, "words-1", "n_words").unionByName(deletes(gone, "byte_bpe_50k", "n_end")),
    }
    for name in [*batches, "0003-end-ids", "0001-words"]:
        rollup.commit(name, batches[name])
    return rollup.totals()
