"""Relations over the facts, each a DataFrame (program_id, l, r), built when first asked for.

What follows from the places of statements is window functions and sequences; relations along control flow
and calls are computed within each program (operators/flow.py). Where programs are flat, lists of statements
without containers or calls, all but their closures are window functions too, split by variable, so that a
long program is no unit of work. Relations of statements may carry lk and rk, the kinds of both sides.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.operators.flow import BLOCK, KERNELS, TYPES, WIDE, Program
from codeloom.operators.within import Pairs
from codeloom.session import workers_find_us
from codeloom.sources.facts import PACKED, FactTables
from codeloom.sources.simple import Facts

P = "program_id"
#: Pairs that a task holds before it passes them on.
RUN = 200_000


class Relations:
    """keep: relations that are computed within programs are cached for further queries, until release();
    else only those that a query uses more than once."""

    def __init__(self, facts: FactTables, keep: bool = False):
        self.facts, self.keep, self._held, self._cached = facts, keep, {}, []

    def __getitem__(self, name: str) -> DataFrame:
        return self.between(name)

    def between(self, name: str, left: int | None = None, right: int | None = None, again: bool = False) -> DataFrame:
        """The relation; with left or right only its pairs from or to that statement, found from there."""
        own = getattr(self, f"_flat_{name}", None) if self.facts.flat else getattr(self, f"_{name}", None)
        own = own or getattr(self, f"_{name}", None)
        key = name if own else (name, left, right)
        if key not in self._held:
            made = own() if own else self._kernel(name, left, right)
            if (self.keep or again) and not own:
                self._cached.append(made.persist())
            self._held[key] = made
        return self._held[key]

    def release(self) -> None:
        for df in self._cached:
            df.unpersist()
        self._held.clear()
        self._cached.clear()

    def _follows(self) -> DataFrame:
        order = Window.partitionBy(P, "list_id").orderBy("pos")
        rows = self.facts.stmt.select(P, F.col("stmt_no").alias("l"), F.lead("stmt_no").over(order).alias("r"), F.col("kind").alias("lk"), F.lead("kind").over(order).alias("rk"))
        return rows.where("r is not null")

    def _follows_t(self) -> DataFrame:
        a = self.facts.stmt.select(P, "list_id", F.col("stmt_no").alias("l"), F.col("pos").alias("lp"), F.col("kind").alias("lk"))
        b = self.facts.stmt.select(P, "list_id", F.col("stmt_no").alias("r"), F.col("pos").alias("rp"), F.col("kind").alias("rk"))
        return a.join(b, [P, "list_id"]).where("lp < rp").select(P, "l", "r", "lk", "rk")

    def _parent(self) -> DataFrame:
        return self.facts.stmt.where("parent_stmt is not null").select(P, F.col("parent_stmt").alias("l"), F.col("stmt_no").alias("r"))

    def _parent_t(self) -> DataFrame:
        # statements count in source order, so those within a container are a range
        inside = F.explode(F.sequence(F.col("stmt_no") + 1, F.col("last_inside")))
        return self.facts.stmt.where("last_inside > stmt_no").select(P, F.col("stmt_no").alias("l"), inside.alias("r"))

    def _calls(self) -> DataFrame:
        return self.facts.stmt.where("callee is not null").select(P, F.col("proc_name").alias("l"), F.col("callee").alias("r")).distinct()

    def _next(self) -> DataFrame:
        return self.facts.cfg_next.select(P, F.col("src").alias("l"), F.col("dst").alias("r"))

    def _condition_uses(self) -> DataFrame:
        return self.facts.direct_uses.where("in_condition").select(P, F.col("stmt_no").alias("l"), F.col("var").alias("r")).distinct()

    # --- flat programs

    def _flat_calls_t(self) -> DataFrame:
        return self._calls()

    def _flat_next(self) -> DataFrame:
        return self._follows()

    def _flat_next_t(self) -> DataFrame:
        return self._follows_t()

    def _flat_next_bip(self) -> DataFrame:
        return self._follows()

    def _flat_next_bip_t(self) -> DataFrame:
        return self._follows_t()

    def _flat_uses_s(self) -> DataFrame:
        return self.facts.direct_uses.select(P, F.col("stmt_no").alias("l"), F.col("var").alias("r")).distinct()

    def _flat_modifies_s(self) -> DataFrame:
        return self.facts.direct_modifies.select(P, F.col("stmt_no").alias("l"), F.col("var").alias("r")).distinct()

    def _flat_by_proc(self, direct: DataFrame) -> DataFrame:
        names = self.facts.proc.select(P, F.col("proc_name").alias("l"))
        return names.join(direct.select(P, F.col("var").alias("r")).distinct(), P).select(P, "l", "r")

    def _flat_uses_p(self) -> DataFrame:
        return self._flat_by_proc(self.facts.direct_uses)

    def _flat_modifies_p(self) -> DataFrame:
        return self._flat_by_proc(self.facts.direct_modifies)

    def _flat_affects(self) -> DataFrame:
        """Of each use the last statement before it that gives the variable a value, where that is an assignment."""
        place = self.facts.stmt.select(P, "stmt_no", "pos", "kind")
        sets = self.facts.direct_modifies.join(place, [P, "stmt_no"]).select(P, "var", "pos", F.lit(0).alias("reads"), F.struct("stmt_no", "kind").alias("set"), F.lit(None).cast("int").alias("r"))
        reads = self.facts.direct_uses.join(place.where("kind = 'assign'"), [P, "stmt_no"]).select(P, "var", "pos", F.lit(1).alias("reads"), F.lit(None).cast(sets.schema["set"].dataType).alias("set"), F.col("stmt_no").alias("r"))
        before = Window.partitionBy(P, "var").orderBy("pos", F.desc("reads")).rowsBetween(Window.unboundedPreceding, -1)
        rows = sets.union(reads).withColumn("set", F.last("set", ignorenulls=True).over(before))
        return rows.where("reads = 1 and set.kind = 'assign'").select(P, F.col("set.stmt_no").alias("l"), "r")

    def _flat_affects_bip(self) -> DataFrame:
        return self._flat_affects()

    # --- within programs

    def _kernel(self, name: str, left: int | None, right: int | None) -> DataFrame:
        """A relation that is computed within each program, from one constant where there is one. A program
        of more than BLOCK statements is dealt to several tasks, by blocks of targets, for what may hold all pairs."""
        import pyarrow as pa

        rows = self.facts.packed
        workers_find_us(rows.sparkSession)
        types = [pa.int32() if t == "int" else pa.string() for t in TYPES[name]]
        wide = name in WIDE and left is None and right is None

        def run(batches):
            ids, ls, rs, size = [], [], [], 0

            def out():
                index = pa.array(np.repeat(np.arange(len(rs)), [len(x) for x in rs]))
                columns = [pa.array(ids, pa.string()).take(index), pa.array(ls, types[0]).take(index), pa.array([x for part in rs for x in part], types[1])]
                return pa.RecordBatch.from_arrays(columns, names=[P, "l", "r"])

            for b in batches:
                for k in range(b.num_rows):
                    i, part, *lists = (c[0].as_py() for c in b.slice(k, 1).columns)
                    program = Program(*([tuple(x.values()) for x in items or []] for items in lists))
                    more = {"part": part} if wide else {}
                    for x, found in KERNELS[name](program, left=left, right=right, **more):
                        if right is not None:
                            found = [y for y in found if y == right]
                        for at in range(0, len(found), RUN):
                            ids.append(i)
                            ls.append(x)
                            rs.append(found[at : at + RUN])
                            size += len(rs[-1])
                            if size >= RUN:
                                yield out()
                                ids, ls, rs, size = [], [], [], 0
            yield out()

        if left is not None:
            rows = rows.where(F.exists("stmts", lambda x: x["stmt_no"] == left))
        if right is not None:
            rows = rows.where(F.exists("stmts", lambda x: x["stmt_no"] == right))
        one = rows.select(P, F.lit(None).cast("int").alias("part"), *PACKED)
        schema = f"{P} string, l {TYPES[name][0]}, r {TYPES[name][1]}"
        if not wide:
            return one.mapInArrow(run, schema)
        # nodes: statements, and less than twice as many beside them (the ends and insides of procedures)
        large = rows.where(F.size("stmts") > BLOCK).select(P, F.explode(F.sequence(F.lit(0), (3 * F.size("stmts") / BLOCK).cast("int"))).alias("part"), *PACKED)
        return one.where(F.size("stmts") <= BLOCK).mapInArrow(run, schema).union(large.repartition(P, "part").mapInArrow(run, schema))


def distances(facts: FactTables) -> DataFrame:
    """(program_id, l, r, steps): the fewest steps of control flow from l to r."""
    import pyarrow as pa

    workers_find_us(facts.packed.sparkSession)

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                i, *lists = (c[0].as_py() for c in b.slice(k, 1).columns)
                for n, found in Program(*([tuple(x.values()) for x in items or []] for items in lists)).distances():
                    yield pa.RecordBatch.from_arrays([pa.array([i] * len(found), pa.string()), pa.array([n] * len(found), pa.int32()), *(pa.array([f[c] for f in found], pa.int32()) for c in (0, 1))], names=[P, "l", "r", "steps"])

    return facts.packed.select(P, *PACKED).mapInArrow(run, f"{P} string, l int, r int, steps int")


class LocalRelations(Relations):
    """Relations of one program of at most `most` statements, found here and held as local tables, whose sizes
    the planner knows: queries then need no shuffle to join them. Larger programs take the way of a corpus."""

    def __init__(self, facts: FactTables, parsed: Facts, most: int = 1024):
        super().__init__(facts, keep=True)
        self.small, self.pairs = len(parsed.stmts) <= most, Pairs(parsed)

    def between(self, name: str, left: int | None = None, right: int | None = None, again: bool = False) -> DataFrame:
        if not self.small:
            return super().between(name, left, right, again)
        if name not in self._held:
            self._held[name] = self._local(name)
        return self._held[name]

    def _local(self, name: str) -> DataFrame:
        import pyarrow as pa

        pairs, types = self.pairs.of(name), Pairs.types(name)
        kinds, kind = [pa.int32() if t == "int" else pa.string() for t in types], {s[0]: s[1] for s in self.pairs.facts.stmts}
        columns = {P: pa.array(["program"] * len(pairs), pa.string()), "l": pa.array([p[0] for p in pairs], kinds[0]), "r": pa.array([p[1] for p in pairs], kinds[1])}
        for k, t in enumerate(types):
            if t == "int":
                columns[f"{'lr'[k]}k"] = pa.array([kind[p[k]] for p in pairs], pa.string())
        return self.facts.program.sparkSession.createDataFrame(pa.table(columns))
