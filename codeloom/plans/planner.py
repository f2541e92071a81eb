"""A query as one Spark plan.

Clauses become relations over their synonyms; each synonym that is returned or named stands on its entity's
scan. Synonyms that share a relation form components. A component is an inner equi-join, cut to its returned
synonyms and made distinct before components meet, so unrelated parts never multiply before they must;
components without returned synonyms, and clauses without synonyms, are left-semi joins on the program.
Everything is keyed by program_id: one plan answers a query for a whole corpus.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators.flow import OF_STATEMENTS
from codeloom.operators.relations import P, Relations
from codeloom.plans.pql import Clause, Query, Ref

#: Entities whose every value of that kind may stand in a relation: the relation's column needs no scan.
WIDE = ("stmt", "prog_line", "procedure", "variable", "constant")
#: Relations whose both sides are assignments.
OF_ASSIGNS = ("affects", "affects_t", "affects_bip", "affects_bip_t")
#: A statement number beyond this is none.
MOST = 2**31 - 1


def column(synonym: str) -> str:
    return f"s_{synonym}"


class Planner:
    def __init__(self, relations: Relations):
        self.r, self.f = relations, relations.facts

    def scan(self, entity: str, name: str) -> DataFrame:
        if entity in ("stmt", "prog_line"):
            return self.f.stmt.select(P, F.col("stmt_no").alias(name))
        if entity == "procedure":
            return self.f.proc.select(P, F.col("proc_name").alias(name))
        if entity == "constant":
            return self.f.const.select(P, F.col("value").alias(name)).distinct()
        if entity == "variable":
            return self.f.direct_uses.select(P, "var").union(self.f.direct_modifies.select(P, "var")).distinct().withColumnRenamed("var", name)
        return self.f.stmt.where(F.col("kind") == entity).select(P, F.col("stmt_no").alias(name))

    def attribute(self, entity: str, name: str, attribute: str | None, value: str) -> DataFrame:
        """(program_id, synonym, value): the attribute, typed as it is."""
        if entity == "call" and attribute == "procName":
            return self.f.stmt.where("kind = 'call'").select(P, F.col("stmt_no").alias(name), F.col("callee").alias(value))
        if entity in ("read", "print") and attribute == "varName":
            return self.f.stmt.where(F.col("kind") == entity).select(P, F.col("stmt_no").alias(name), F.col("operand_var").alias(value))
        return self.scan(entity, name).withColumn(value, F.col(name))

    def _pick(self, rows: DataFrame, refs: list[tuple[str, Ref]]) -> DataFrame:
        """rows filtered by constants and cut to the synonyms' columns; one synonym twice must agree."""
        keep: dict[str, str] = {}
        for c, ref in refs:
            if ref.kind in ("number", "text"):
                if rows.schema[c].dataType.typeName() == "string":
                    rows = rows.where(F.col(c) == ref.value)
                else:
                    rows = rows.where(F.col(c) == int(ref.value)) if int(ref.value) <= MOST else rows.where(F.lit(False))
            elif ref.kind == "synonym":
                if ref.value in keep:
                    rows = rows.where(F.col(c) == F.col(keep[ref.value]))
                else:
                    keep[ref.value] = c
        # pairs are distinct as they come, and stay so unless a wildcard drops a side
        out = rows.select(P, *(F.col(c).alias(column(s)) for s, c in keep.items()))
        return out.distinct() if any(ref.kind == "any" for _, ref in refs) else out

    @staticmethod
    def _from_constants(c: Clause) -> tuple:
        """The relation of a clause, and the statements that it is looked up from."""
        at = [int(r.value) if c.name in OF_STATEMENTS and r.kind == "number" and int(r.value) <= MOST else None for r in c.args]
        return c.name, at[0], at[1] if at[0] is None else None

    def relation(self, q: Query, c: Clause, again: bool = False) -> tuple[DataFrame, set[str]]:
        """The clause's rows, and the synonyms whose values in them are of their entity for certain."""
        if c.kind == "relation":
            rows, sure = self.r.between(*self._from_constants(c), again), set()
            for side, ref in zip("lr", c.args):
                entity = q.declared.get(ref.value) if ref.kind == "synonym" else None
                if entity == "assign" and c.name in OF_ASSIGNS:
                    sure.add(ref.value)
                elif entity not in (None, *WIDE) and f"{side}k" in rows.columns:
                    rows = rows.where(F.col(f"{side}k") == entity)
                    sure.add(ref.value)
            return self._pick(rows, list(zip("lr", c.args))), sure
        if c.kind == "pattern":
            if c.name == "assign":
                rows = self.f.assign_expr
                if c.args[2] is not None:
                    rows = rows.where(F.col("rhs_key") == c.args[2] if c.exact else F.array_contains("rhs_subtrees", c.args[2]))
                rows = rows.select(P, F.col("stmt_no").alias("l"), F.col("lhs").alias("r"))
            else:
                rows = self.r["condition_uses"].join(self.scan(c.name, "l"), [P, "l"], "left_semi")
            return self._pick(rows, [("l", c.args[0]), ("r", c.args[1])]), {c.args[0].value}
        return self._compared(q, c), set()

    def _compared(self, q: Query, c: Clause) -> DataFrame:
        sides = []
        for k, ref in enumerate(c.args):
            if ref.kind == "synonym":
                rows = self.attribute(q.declared[ref.value], f"x{k}", ref.attribute, "v")
                sides.append(rows.select(P, f"x{k}", F.col("v").cast("string").alias("v")))
        values = [r.value for r in c.args if r.kind != "synonym"]
        if not sides:
            return self.f.program.where(F.lit(values[0] == values[1]))
        if values:
            k = next(k for k, r in enumerate(c.args) if r.kind == "synonym")
            return self._pick(sides[0].where(F.col("v") == values[0]), [(f"x{k}", c.args[k])])
        both = sides[0].join(sides[1], [P, "v"])
        return self._pick(both, [("x0", c.args[0]), ("x1", c.args[1])])

    def components(self, q: Query) -> list[tuple[set[str], DataFrame]]:
        """(returned synonyms, rows); rows have the program and the returned synonyms."""
        returned = {r.value for r in q.result}
        times = Counter(self._from_constants(c) for c in q.clauses if c.kind == "relation")
        found = [self.relation(q, c, c.kind == "relation" and times[self._from_constants(c)] > 1) for c in q.clauses]
        frames, sure = [({c[2:] for c in f.columns if c != P}, f) for f, _ in found], set().union(*(s for _, s in found))
        named = set().union(returned, *(s for s, _ in frames))
        for s in sorted(named):
            if s not in sure and (q.declared[s] not in WIDE or not any(s in syns for syns, _ in frames)):
                frames.append(({s}, self.scan(q.declared[s], column(s))))
        # a synonym that nothing else names goes before its rows meet others
        times_named = Counter(s for syns, _ in frames for s in syns)
        for k, (syns, f) in enumerate(frames):
            if syns - (keep := {s for s in syns if s in returned or times_named[s] > 1}):
                frames[k] = keep, f.select(P, *sorted(column(s) for s in keep)).distinct()
        out = [(set(), f.select(P).distinct()) for syns, f in frames if not syns]
        left = sorted(((s, f) for s, f in frames if s), key=lambda x: len(x[0]))
        while left:
            syns, rows = left.pop(0)
            syns = set(syns)
            while (k := next((k for k, (s, _) in enumerate(left) if s & syns), None)) is not None:
                s, f = left.pop(k)
                rows = rows.join(f, [P, *sorted(column(x) for x in s & syns)], "left_semi" if s <= syns else "inner")
                syns |= s
            keep = syns & returned
            rows = rows.select(P, *sorted(column(s) for s in keep))
            out.append((keep, rows if keep == syns else rows.distinct()))
        return out

    def plan(self, q: Query) -> DataFrame:
        """BOOLEAN: (program_id, result) of every program; else (program_id, c1, ..), distinct."""
        types = {s: "string" if e in ("variable", "procedure", "constant") else "int" for s, e in q.declared.items()}
        if q.boolean:
            if q.invalid:
                return self.f.program.select(P, F.lit(False).alias("result"))
            good = reduce(lambda a, c: a.join(c[1].select(P).distinct(), P, "left_semi"), self.components(q), self.f.program)
            return self.f.program.join(good.withColumn("found", F.lit(True)), P, "left").select(P, F.col("found").isNotNull().alias("result"))
        if q.invalid:
            return self.f.program.where(F.lit(False)).select(P, *(F.lit(None).cast("string").alias(f"c{k + 1}") for k in range(len(q.result))))
        rows = self.f.program
        for keep, frame in sorted(self.components(q), key=lambda c: len(c[0])):
            rows = rows.join(frame, P, "inner" if keep else "left_semi")
        out, exact = [], {r.value for r in q.result} == {r.value for r in q.result if r.attribute is None or q.declared[r.value] not in ("call", "read", "print") or r.attribute == "stmt#"}
        for k, ref in enumerate(q.result):
            entity = q.declared[ref.value]
            if (ref.attribute, entity) in (("procName", "call"), ("varName", "read"), ("varName", "print")):
                rows = rows.join(self.attribute(entity, column(ref.value), ref.attribute, f"a{k}"), [P, column(ref.value)])
                out.append(F.col(f"a{k}").alias(f"c{k + 1}"))
            else:
                out.append(F.col(column(ref.value)).cast(types[ref.value]).alias(f"c{k + 1}"))
        # components are distinct, so their product is, unless an attribute joins values
        return rows.select(P, *out) if exact else rows.select(P, *out).distinct()
