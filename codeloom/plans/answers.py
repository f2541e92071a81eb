"""A query's answers over one program after another, each found in the task that holds its text.

The rows are those of the planner's plan. Clauses are read from the cheapest on, and one without rows ends a
program's search. Synonyms that aren't returned go as soon as all clauses with them are joined, so what is held
is no more than pairs; parts that share no synonym meet in the result alone, which leaves in bounded runs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice, product

from codeloom.operators.within import Pairs, pairs
from codeloom.plans.planner import MOST, WIDE, Planner
from codeloom.plans.pql import Clause, Query, Ref
from codeloom.sources.shapes import Shaped
from codeloom.sources.simple import Facts

#: Rows that leave at once.
RUN = 100_000
#: Relations by their cost, those not named first.
COST = {k: n for n, k in enumerate(("uses_p", "modifies_p", "uses_s", "modifies_s", "calls_t", "follows_t", "parent_t", "affects", "next_bip", "affects_t", "next_t", "affects_bip", "next_bip_t", "affects_bip_t"), 1)}
#: Attributes that aren't the synonym's own value, and their places in a statement's facts.
OTHER = {("call", "procName"): 8, ("read", "varName"): 7, ("print", "varName"): 7}

Frame = tuple[tuple, list]


def _project(frame: Frame, keep: set[str]) -> Frame:
    """The frame's rows cut to the synonyms, each once."""
    syns, rows = frame
    at = [k for k, s in enumerate(syns) if s in keep]
    if len(at) == len(syns):
        return frame
    if len(at) == 1:
        k = at[0]
        return (syns[k],), list(dict.fromkeys((r[k],) for r in rows))
    return tuple(syns[k] for k in at), list(dict.fromkeys(tuple(r[k] for k in at) for r in rows))


def _join(a: Frame, b: Frame) -> Frame:
    """Rows of both that agree in the synonyms they share."""
    if (len(b[0]), len(b[1])) > (len(a[0]), len(a[1])):
        a, b = b, a
    shared = [s for s in b[0] if s in a[0]]
    new = [k for k, s in enumerate(b[0]) if s not in a[0]]
    of_a, of_b = [a[0].index(s) for s in shared], [b[0].index(s) for s in shared]
    if not new:
        if len(of_a) == 1:
            k, held = of_a[0], {r[of_b[0]] for r in b[1]}
            return a[0], [r for r in a[1] if r[k] in held]
        held = {tuple(r[k] for k in of_b) for r in b[1]}
        return a[0], [r for r in a[1] if tuple(r[k] for k in of_a) in held]
    by: dict = {}
    if len(of_a) == len(new) == 1:
        i, j, k = of_a[0], of_b[0], new[0]
        for r in b[1]:
            by.setdefault(r[j], []).append(r[k])
        return (*a[0], b[0][k]), [(*r, x) for r in a[1] for x in by.get(r[i], ())]
    for r in b[1]:
        by.setdefault(tuple(r[k] for k in of_b), []).append(tuple(r[k] for k in new))
    return (*a[0], *(b[0][k] for k in new)), [(*r, *more) for r in a[1] for more in by.get(tuple(r[k] for k in of_a), ())]


class Answers:
    def __init__(self, q: Query):
        self.q = q
        self.returned = {r.value for r in q.result}
        self.clauses = sorted(q.clauses, key=lambda c: COST.get(c.name, 0) if c.kind == "relation" else 0)
        named = {r.value for c in q.clauses for r in c.args if isinstance(r, Ref) and r.kind == "synonym"}
        self.alone = sorted(self.returned - named)
        self.single = self._single()

    @property
    def types(self) -> list[str]:
        """Of the result's columns."""
        return ["string" if self.q.declared[r.value] in ("variable", "procedure", "constant") or (self.q.declared[r.value], r.attribute) in OTHER else "int" for r in self.q.result]

    def _values(self, p: Pairs, entity: str) -> list:
        f = p.facts
        if entity in ("stmt", "prog_line"):
            return list(range(1, len(p.kinds) + 1))
        if entity == "procedure":
            return [x[0] for x in f.procs]
        if entity == "constant":
            return [x[0] for x in f.consts]
        if entity == "variable":
            return list(dict.fromkeys([u[1] for u in f.uses] + [m[1] for m in f.modifies]))
        return [n for n, kind in enumerate(p.kinds, 1) if kind == entity]

    def _attributes(self, p: Pairs, ref: Ref) -> list[tuple]:
        """(value, attribute as text) of a synonym."""
        entity = self.q.declared[ref.value]
        at = OTHER.get((entity, ref.attribute))
        if at is not None:
            return p.named(entity, at)
        return [(v, str(v)) for v in self._values(p, entity)]

    def _pick(self, p: Pairs, rows: list[tuple], refs: list[Ref], of_statements: tuple = ()) -> Frame:
        """Pairs filtered by constants and by the kinds of statements, and cut to the synonyms."""
        keep: dict[str, int] = {}
        for k, ref in enumerate(refs):
            if ref.kind in ("number", "text"):
                value = int(ref.value) if ref.kind == "number" else ref.value
                rows = [] if ref.kind == "number" and value > MOST else [r for r in rows if r[k] == value]
            elif ref.kind == "synonym":
                if (entity := self.q.declared[ref.value]) not in WIDE and k in of_statements:
                    kinds = p.kinds
                    rows = [r for r in rows if kinds[r[k] - 1] == entity]
                if ref.value in keep:
                    rows = [r for r in rows if r[0] == r[1]]
                else:
                    keep[ref.value] = k
        if len(keep) == 2:
            return tuple(keep), rows
        return tuple(keep), list(dict.fromkeys((r[k],) for r in rows for k in keep.values())) if keep else rows

    def _frame(self, p: Pairs, c: Clause) -> Frame:
        if c.kind == "relation":
            name, left, right = Planner._from_constants(c)
            return self._pick(p, p.of(name, left, right), c.args, tuple(k for k, t in enumerate(Pairs.types(name)) if t == "int"))
        if c.kind == "pattern":
            if c.name == "assign":
                key = c.args[2]
                rows = [(n, lhs) for n, lhs, own, subtrees in p.facts.assigns if key is None or (own == key if c.exact else key in subtrees)]
            else:
                rows = p.of("condition_uses")
            return self._pick(p, rows, c.args[:2], (0,))
        synonyms = [r for r in c.args if r.kind == "synonym"]
        texts = [r.value for r in c.args if r.kind != "synonym"]
        if not synonyms:
            return (), [()] if texts[0] == texts[1] else []
        rows = self._attributes(p, synonyms[0])
        if texts:
            return (synonyms[0].value,), [(v,) for v, a in rows if a == texts[0]]
        by: dict = {}
        for v, a in self._attributes(p, synonyms[1]):
            by.setdefault(a, []).append(v)
        return self._pick(p, [(v, w) for v, a in rows for w in by.get(a, ())], synonyms)

    def _parts(self, p: Pairs) -> list[Frame] | None:
        """Rows of the returned synonyms, by parts that share none; None without an answer."""
        frames: list[Frame] = []
        for c in self.clauses:
            frame = self._frame(p, c)
            if not frame[1]:
                return None
            if frame[0]:
                frames.append(frame)
        for s in self.alone:
            frames.append(((s,), [(v,) for v in self._values(p, self.q.declared[s])]))
            if not frames[-1][1]:
                return None
        every = {s for syns, _ in frames for s in syns}
        for s in sorted(every - self.returned, key=lambda s: sum(s in syns for syns, _ in frames)):
            with_it = sorted((f for f in frames if s in f[0]), key=lambda f: (len(f[0]), len(f[1])))
            frames = [f for f in frames if s not in f[0]]
            one = with_it[0]
            for f in with_it[1:]:
                one = _join(one, f)
            one = _project(one, set(one[0]) - {s})
            if not one[1]:
                return None
            if one[0]:
                frames.append(one)
        out: list[Frame] = []
        frames.sort(key=lambda f: (len(f[0]), len(f[1])))
        while frames:
            one = frames.pop(0)
            while (k := next((k for k, f in enumerate(frames) if set(f[0]) & set(one[0])), None)) is not None:
                one = _join(one, frames.pop(k))
            if not one[1]:
                return None
            out.append(one)
        return out

    def holds(self, facts: Facts | Shaped) -> bool:
        return not self.q.invalid and self._parts(pairs(facts)) is not None

    def _single(self) -> Clause | None:
        """The only clause, of a relation, if its two synonyms of any kind are the result."""
        if len(self.clauses) != 1 or (c := self.clauses[0]).kind != "relation" or any(r.attribute for r in self.q.result):
            return None
        args = [r.value for r in c.args if r.kind == "synonym"]
        return c if len(set(args)) == 2 and args == [r.value for r in self.q.result] else None

    def columns(self, facts: Facts | Shaped) -> Iterator[list]:
        """The result's columns, in runs of rows, as sequences or arrays; rows are distinct."""
        p = pairs(facts)
        if (c := self.single) is not None:
            yield from self._runs(p, c)
            return
        parts = self._parts(p)
        if parts is None:
            return
        order: list[int] = []  # places in the result, part by part
        found = []
        for syns, rows in parts:
            mine = [k for k, r in enumerate(self.q.result) if r.value in syns]
            at = [(syns.index(self.q.result[k].value), OTHER.get((self.q.declared[self.q.result[k].value], self.q.result[k].attribute))) for k in mine]
            if [k for k, _ in at] != list(range(len(syns))) or any(o is not None for _, o in at):
                stmts = p.facts.stmts if any(o is not None for _, o in at) else []
                rows = list(dict.fromkeys(tuple(r[k] if o is None else stmts[r[k] - 1][o] for k, o in at) for r in rows))
            order += mine
            found.append(rows)
        where = [order.index(k) for k in range(len(order))]
        if len(found) == 1:
            rows = iter(found[0])
        else:
            rows = (tuple(x for part in rows for x in part) for rows in product(*found))
        while some := list(islice(rows, RUN)):
            columns = list(zip(*some))
            yield [columns[k] for k in where]

    def _runs(self, p: Pairs, c: Clause) -> Iterator[list]:
        """One relation leaves as it is found."""
        kinds = [None if (e := self.q.declared[r.value]) in WIDE else e for r in c.args]
        # affects are between assignments whatever is asked for
        kinds = [None if k == "assign" and c.name.startswith("affects") else k for k in kinds]
        if not any(kinds) and (found := p.of_shape(c.name)) is not None:
            if len(found[0]):
                yield list(found)
            return
        ls: list = []
        rs: list = []
        of = p.kinds if any(kinds) else []
        for x, ys in p.runs(c.name):
            if kinds[0] and of[x - 1] != kinds[0]:
                continue
            if kinds[1]:
                ys = [y for y in ys if of[y - 1] == kinds[1]]
            ls += [x] * len(ys)
            rs += ys
            if len(rs) >= RUN:
                yield [ls, rs]
                ls, rs = [], []
        if rs:
            yield [ls, rs]
