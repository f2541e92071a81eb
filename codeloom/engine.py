"""The engine: load programs, ask queries."""

from __future__ import annotations

import logging
import time
from heapq import heapreplace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators.relations import RUN, LocalRelations, P, Relations, distances
from codeloom.plans.answers import Answers
from codeloom.plans.planner import Planner
from codeloom.plans.pql import Query, QuerySyntaxError, listing, parse_query
from codeloom.session import cut, dropped, workers_find_us
from codeloom.sources.facts import FactTables, fact_tables, local_facts, parsed, read_programs
from codeloom.sources.shapes import read_program
from codeloom.sources.simple import Facts, ProgramError, parse_program

log = logging.getLogger("codeloom")
#: Texts of more characters are large programs: their pairs may be too many for one task.
LARGE = 8192
#: Characters that a task answers for, at least and at most, where there are enough for all cores.
SHARE = 1 << 17, 1 << 23
#: How much more than a core's share of the texts a core may read, task after task, before they are dealt anew.
EVEN = 1.25


def longest(sizes: list[int], cores: int) -> int:
    """What the busiest core reads if each takes the next of the tasks when it is done."""
    read = [0] * cores
    for size in sizes:
        heapreplace(read, read[0] + size)
    return max(read)


class Engine:
    """Answers queries over one program or a corpus. A program that can't be parsed has no answers.

    A corpus's texts are written once, in the shared folder, and a query reads them in one pass: the task that
    holds a program's text parses it and finds its answers, so no fact is stored or moved. Large programs, and
    a corpus with `keep`, are answered from stored fact tables, by a plan of joins. Results read the texts
    when they are computed; release() removes them.

    keep: relations that are computed within programs stay cached between queries, until release().
    timings: (step, seconds) of reading and planning queries and, for evaluate(), of running them.
    """

    def __init__(self, spark: SparkSession, facts: FactTables, errors: DataFrame | None = None, keep: bool = False):
        self.spark, self.facts, self.errors = spark, facts, errors
        self.relations = Relations(facts, keep)
        self.sources: DataFrame | None = None
        self._texts: tuple[DataFrame, int, Engine | None] | None = None
        self.timings: list[tuple[str, float]] = []

    @classmethod
    def load(cls, spark: SparkSession, program: str) -> Engine:
        """One program, parsed here; of one that can't be parsed, the error."""
        try:
            parsed_here, error = parse_program(program), None
        except ProgramError as e:
            parsed_here, error = Facts(), str(e)
        facts = local_facts(spark, parsed_here)
        if error is not None:
            facts.program = facts.program.where(F.lit(False))
        errors = spark.createDataFrame([] if error is None else [("program", error)], f"{P} string, error string")
        out = cls(spark, facts, errors, keep=True)
        out.relations = LocalRelations(facts, parsed_here)
        return out

    @classmethod
    def read(cls, spark: SparkSession, path: str, keep: bool = False) -> Engine:
        return cls.corpus(spark, read_programs(spark, path), keep)

    @classmethod
    def corpus(cls, spark: SparkSession, sources: DataFrame, keep: bool = False) -> Engine:
        """sources: (program_id, text)."""
        bundle = parsed(sources).persist()
        out = cls(spark, fact_tables(bundle), bundle.where("error is not null").select(P, "error"), keep)
        out.sources = None if keep else sources
        return out

    def _timed(self, step: str, began: float) -> None:
        self.timings.append((step, time.perf_counter() - began))
        log.debug("%s: %.3f s", *self.timings[-1])

    def query(self, pql: str) -> DataFrame:
        """(program_id, c1, ..) or, for BOOLEAN, (program_id, result); no rows on a syntax error."""
        began = time.perf_counter()
        try:
            q = parse_query(pql)
        except QuerySyntaxError as e:
            log.debug("syntax error: %s", e)
            return self.facts.program.where(F.lit(False)).select(P, F.lit(None).cast("string").alias("c1"))
        self._timed("read", began)
        log.debug("query\n%s", listing(q))
        began = time.perf_counter()
        by_text = self.sources is not None and (q.boolean or not q.invalid)
        out = self._answered(q) if by_text else self.query_plan(q)
        self._timed("plan", began)
        return out

    def _read(self) -> tuple[DataFrame, int, Engine | None]:
        """The texts of small programs, the tasks they are dealt to (0: they stay as they lie, which is even enough), and
        an engine of the large ones if there are any."""
        if self._texts is None:
            rows = self.sources.select(F.col(P).cast("string").alias(P), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
            rows = cut(rows.withColumn("size", F.length("text")))
            # the sizes are read without the texts, by the tasks that would read these
            held = rows.groupBy(F.spark_partition_id()).agg(F.sum("size"), F.max("size")).collect()
            size, most = sum(r[1] for r in held), max((r[2] for r in held), default=0)
            least_share, most_share = SHARE
            cores = self.spark.sparkContext.defaultParallelism
            tasks = max(-(-size // most_share), min(4 * cores, -(-size // least_share)), 1)
            if size > cores * least_share and longest([r[1] for r in sorted(held)], cores) <= EVEN * size / cores:
                tasks = 0  # texts needn't move; few are gathered, so that few tasks start
            large = None
            if most > LARGE:
                large = Engine.corpus(self.spark, rows.where(F.col("size") > LARGE).select(P, "text"), keep=True)
                large.relations.keep = False
                rows = rows.where(F.col("size") <= LARGE)
            self._texts = rows.select(P, "text"), tasks, large
        return self._texts

    def _answered(self, q: Query) -> DataFrame:
        """The rows of the planner's plan, found in the tasks that hold the programs' texts."""
        import pyarrow as pa

        workers_find_us(self.spark)
        rows, tasks, large = self._read()
        answers = Answers(q)
        types = ["boolean"] if q.boolean else answers.types
        names = ["result"] if q.boolean else [f"c{k + 1}" for k in range(len(types))]
        kinds = [{"boolean": pa.bool_(), "string": pa.string(), "int": pa.int32()}[t] for t in types]

        def run(batches):
            import gc

            was = gc.get_threshold()
            gc.set_threshold(100_000, 20, 20)  # programs and their facts hold no circles
            try:
                yield from found_in(batches)
            finally:
                gc.set_threshold(*was)

        def found_in(batches):
            import numpy as np

            ids, counts, columns = [], [], [[] for _ in types]  # columns: in parts, one for each id

            def column(parts, kind):
                if parts and any(isinstance(x, np.ndarray) for x in parts):
                    return pa.array(np.concatenate([np.asarray(x, np.int32) for x in parts]), kind)
                return pa.array([x for part in parts for x in part], kind)

            def out():
                of = pa.array(ids, pa.string()).take(pa.array(np.repeat(np.arange(len(ids)), counts)))
                return pa.RecordBatch.from_arrays([of, *map(column, columns, kinds)], names=[P, *names])

            size = 0
            for b in batches:
                for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    try:
                        facts = read_program(text)
                    except ProgramError:
                        continue
                    if not q.boolean and i is None:
                        continue  # no program that clauses can name
                    for found in [[[answers.holds(facts)]]] if q.boolean else answers.columns(facts):
                        ids.append(i)
                        counts.append(len(found[0]))
                        for c, more in zip(columns, found):
                            c.append(more)
                        size += counts[-1]
                        if size >= RUN:
                            yield out()
                            ids, counts, columns, size = [], [], [[] for _ in types], 0
            yield out()

        schema = f"{P} string, " + ", ".join(f"{n} {t}" for n, t in zip(names, types))
        found = (rows.repartition(tasks) if tasks else rows).mapInArrow(run, schema)
        return found if large is None else found.union(large.query_plan(q))

    def query_plan(self, q: Query) -> DataFrame:
        """The query as a plan of joins of fact tables."""
        return Planner(self.relations).plan(q)

    def strings(self, pql: str) -> DataFrame:
        """(program_id, answer): cells joined by a blank, booleans as TRUE and FALSE."""
        rows = self.query(pql)
        cells = [F.upper(F.col(c).cast("string")) if c == "result" else F.col(c).cast("string") for c in rows.columns if c != P]
        return rows.select(P, F.concat_ws(" ", *cells).alias("answer"))

    def evaluate(self, pql: str) -> list[str]:
        """The answers of a single program, at the edge of the engine."""
        rows, began = self.strings(pql), time.perf_counter()
        out = sorted(r["answer"] for r in rows.collect())
        self._timed("run", began)
        return out

    def distances(self) -> DataFrame:
        """(program_id, l, r, steps): the fewest steps of Next from one statement to another."""
        return distances(self.facts)

    def release(self) -> None:
        self.relations.release()
        if self._texts is not None:
            rows, _, large = self._texts
            if large is not None:
                large.release()
            dropped(rows)
            self._texts = None
