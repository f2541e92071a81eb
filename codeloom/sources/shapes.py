"""Programs read by the shapes of their procedures.

A procedure's shape is its text with every name and number left open; keywords stay, as names too. What follows
from the shape alone (statements, lists, control flow, places of names) is found once, by the reader of tokens, and
kept for further procedures. Texts are cut behind each `;`, `{` and `}`, and the words of a segment are kept too, as
most come again and again: a procedure costs the looking up of its segments, a short one of its text. What follows
from the shapes of all procedures and the names of these and of calls is a plan, kept for narrow programs. Names that are given twice, missing or
called in circles are looked for in each program. A text that isn't understood so goes to parse_program, which has
the last word.
"""

from __future__ import annotations

import re
from functools import cached_property
from itertools import accumulate, chain, count
from operator import itemgetter

import numpy as np

from codeloom.sources.simple import END, Facts, ProgramError, _Program, _run, _tree, parse_program

_HEAD = re.compile(r"[ \t\r\n]*procedure[ \t\r\n]+[A-Za-z][A-Za-z0-9]*[ \t\r\n]*\{")
_WORD = re.compile(r"([A-Za-z][A-Za-z0-9]*|[0-9]+)")
_KEYWORDS = {w: w for w in ("procedure", "if", "then", "else", "while", "read", "print", "call")}
#: What is kept between programs: words and pairs of shapes, classes of words, segments of short texts, call graphs.
_MOST_HELD, _MOST_CLASSES, _MOST_TEXTS, _LONGEST, _MOST_GRAPHS, _WIDEST = 4_000_000, 100_000, 50_000, 256, 4_000, 32
#: Statements of a procedure whose pairs are kept.
SMALL = 250
#: Where texts are cut between procedures, characters of procedures that are kept whole and how many; plans, and their procedures at most.
_CUT, _SHORT, _MOST_SHORT, _MOST_PLANS, _NARROW = "}\nprocedure ", 112, 20_000, 8_000, 6


class _Classes(dict):
    """Of a word: itself for a keyword, else whether it is a name, a number or none."""

    def __missing__(self, word: str) -> str:
        found = _KEYWORDS.get(word) or ("x" if word[0].isalpha() else "00" if word[0] == "0" and len(word) > 1 else "0")
        if len(self) >= _MOST_CLASSES:
            self.clear()
        self[word] = found
        return found


class Shape:
    """Facts of one procedure, by its own statement numbers; names and numbers as places among its words."""

    def __init__(self, between: list[str], classes: list[str]):
        words = [c if c in _KEYWORDS else f"x{k}" if c == "x" else "00" if c == "00" else str(10**6 + k) for k, c in enumerate(classes)]
        at: dict[str, int] = {}
        for k, w in enumerate(words):
            at.setdefault(w, k)
        r = _Program("".join(x for pair in zip(between, [*words, ""]) for x in pair))
        r.take("procedure")
        r.proc = r.name()
        r.take("{")
        r.flow(_run(r.body(None)))
        if r.items[r.at] != END:
            raise ProgramError("text after the procedure")
        f = self.facts = r.f
        place = lambda name: None if name is None else at[name]
        self.size, self.lists = len(f.stmts), r.lists
        self.stmts = [(*s[:2], *s[3:7], place(s[7]), place(s[8])) for s in f.stmts]
        self.calls = [(s[0], at[s[8]]) for s in f.stmts if s[8] is not None]
        self.slot = {n: k for k, (n, _) in enumerate(self.calls)}
        self.modifies = [(n, at[v]) for n, v in f.modifies]
        self.uses: list[tuple[int, tuple[int, ...], bool]] = []
        for n, kind, *_, operand, _ in self.stmts:
            if kind == "print":
                self.uses.append((n, (operand,), False))
            elif n in f.trees and (names := f.trees[n].names):
                self.uses.append((n, tuple(at[v] for v in names), kind != "assign"))
        self.numbers = [at[v] for v in r.values]
        self.assigns = []
        for n, lhs, _, _ in f.assigns:
            parts = _WORD.split(f.trees[n].canon)
            self.assigns.append((n, at[lhs], "%s".join(x.replace("%", "%%") for x in parts[::2]), tuple(at[w] for w in parts[1::2])))
        self.reads = {n: w for n, w, _ in self.uses}
        self.writes = {n: (w,) for n, w in self.modifies}
        self.next: dict[int, list[int]] = {}
        for a, b in f.nexts:
            self.next.setdefault(a, []).append(b)
        self._reads, self._writes = ((*(k for at in x.values() for k in at),) for x in (self.reads, self.writes))
        self.kinds = [s[1] for s in self.stmts]
        self._static: dict = {}
        self._lists: dict[str, tuple[list, list]] = {}

    @cached_property
    def leaves(self) -> list[int]:
        """Statements that control leaves the procedure from."""
        tail: dict = {}
        for n, kind, of, *_ in self.stmts:
            tail[of] = n  # the last of each list
        of_if: dict = {}
        for n in tail.values():
            of_if.setdefault(self.stmts[n - 1][4], []).append(n)
        found, todo = [], list(of_if[None])
        while todo:
            n = todo.pop()
            if self.stmts[n - 1][1] == "if":
                todo += of_if[n]
            else:
                found.append(n)
        return sorted(found)

    @cached_property
    def only(self) -> list[int]:
        """Of each statement, the only one that may come next, 0 if none does; -1 where ways part and at a loop's head,
        so that no way along it comes back."""
        out = [0] * (self.size + 1)
        for n, kind, *_ in self.stmts:
            then = self.next.get(n, ())
            out[n] = -1 if kind == "while" or len(then) > 1 else then[0] if then else 0
        return out

    @cached_property
    def assigned(self) -> list[tuple[int, int]]:
        """Assignments and the places of their variables, the last first."""
        return [(n, k) for n, k, *_ in reversed(self.assigns)]

    @cached_property
    def read_by_assigns(self) -> list[tuple[int, ...]]:
        """Of each statement, places of the variables that it reads if it is an assignment."""
        out: list[tuple[int, ...]] = [()] * (self.size + 1)
        for n, *_ in self.assigns:
            out[n] = self.reads.get(n, ())
        return out

    def static(self, name: str) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a relation that follows from the shape alone."""
        if (found := self._static.get(name)) is None:
            from codeloom.operators.flow import reach
            from codeloom.operators.within import Pairs

            if name == "next_t":
                pairs = [(x, y) for x, ys in reach(self.next) for y in ys]
            elif name == "next_plain":  # but for steps from calls
                pairs = [p for p in self.facts.nexts if p[0] not in self.slot]
            else:
                pairs = getattr(Pairs(self.facts), f"_{name}")()
            both = np.array(pairs, np.int32).reshape(-1, 2)
            found = self._static[name] = np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])
            _keep(2 * len(pairs))
        return found

    def listed(self, name: str) -> tuple[list, list]:
        """The same as lists."""
        if (found := self._lists.get(name)) is None:
            ls, rs = self.static(name)
            found = self._lists[name] = ls.tolist(), rs.tolist()
            _keep(4 * len(ls))
        return found

    def touched(self, reads: bool) -> tuple[int, ...]:
        """Places of all variables that its statements use or set themselves."""
        return self._reads if reads else self._writes

    def inside(self, reads: bool) -> list[tuple[int, tuple[int, ...], tuple[int, ...]]]:
        """(statement, places of its variables and those of statements within it, calls among these), where there are any."""
        name = "reads" if reads else "writes"
        if (found := self._static.get(name)) is None:
            of: dict[int, tuple[dict, dict]] = {}
            for s in self.stmts:
                n, at = s[0], s[0]
                while at is not None:
                    mine = of.setdefault(at, ({}, {}))
                    mine[0].update(dict.fromkeys(getattr(self, name).get(n, ())))
                    if n in self.slot:
                        mine[1][self.slot[n]] = None
                    at = self.stmts[at - 1][4]
            found = self._static[name] = [(n, tuple(w), tuple(c)) for n, (w, c) in sorted(of.items()) if w or c]
            _keep(sum(len(w) + len(c) + 2 for _, w, c in found))
        return found


_classes = _Classes()
_shapes: dict[tuple, Shape | None] = {}
_texts: dict[str, tuple[int, tuple[str, ...], bool]] = {}
_kinds: dict[tuple, int] = {}
_numbers = count()  # never given twice
_graphs: dict[tuple, tuple | None] = {}
_short: tuple[dict[str, tuple], ...] = {}, {}, {}, {}  # of a procedure that is the first, another, the only one, the last
_roles: dict[tuple, int] = {}
_plans: dict[tuple, Plan] = {}
_held = 0
_first, _second, _third = itemgetter(0), itemgetter(1), itemgetter(2)


def _keep(size: int) -> None:
    global _held
    _held += size
    if _held > _MOST_HELD:
        _shapes.clear()
        _texts.clear()
        _kinds.clear()
        _roles.clear()
        _plans.clear()
        for texts in _short:
            texts.clear()
        _held = 0


def _segment(text: str) -> tuple[int, tuple[str, ...], bool]:
    """A number for all that it is but for names and numbers, its words, and whether it begins a procedure."""
    parts = _WORD.split(text)
    words = tuple(parts[1::2])
    key = (*parts[::2], *map(_classes.__getitem__, words))
    if (number := _kinds.get(key)) is None:
        _keep(len(key))
        number = _kinds[key] = next(_numbers)
    found = number, words, _HEAD.fullmatch(text) is not None
    if len(text) <= _LONGEST:
        if len(_texts) >= _MOST_TEXTS:
            _texts.clear()
        _texts[text] = found
    return found


def _made(segments: list[str], last: bool) -> Shape | None:
    """The shape of a procedure, of a program's last one or another; None of what is no procedure."""
    text = ";".join(segments if last else [*segments, ""]).replace("{;", "{").replace("};", "}")
    parts = _WORD.split(text)
    _keep(20 * len(parts))
    try:
        return Shape(parts[::2], list(map(_classes.__getitem__, parts[1::2])))
    except ProgramError:
        return None


def _graph(calls: tuple[tuple[int, ...], ...]) -> tuple[list[int], list[list[int]]] | None:
    """Procedures, each after all that it calls, and what each reaches; None where calls go in a circle."""
    if calls in _graphs:
        return _graphs[calls]
    below: dict[int, set] = {}
    left = [set(c) for c in calls]
    callers: list[list[int]] = [[] for _ in calls]
    for p, qs in enumerate(left):
        for q in qs:
            callers[q].append(p)
    counts, order = [len(qs) for qs in left], []
    todo = [p for p, n in enumerate(counts) if not n]
    while todo:
        p = todo.pop()
        order.append(p)
        below[p] = left[p].union(*(below[q] for q in left[p]))
        for c in callers[p]:
            counts[c] -= 1
            if not counts[c]:
                todo.append(c)
    found = None if len(order) < len(calls) else (order, [sorted(below[p]) for p in range(len(calls))])
    if len(calls) <= _WIDEST:
        if len(_graphs) >= _MOST_GRAPHS:
            _graphs.clear()
        _graphs[calls] = found
    return found


class Plan:
    """What follows from the shapes of a program's procedures, their names and those of calls."""

    def __init__(self, shapes: list[Shape], names: list[str], calls: tuple, graph: tuple):
        self.names, self.calls = names, calls  # calls: of each procedure, the places of its callees, call by call
        self.order, self.below = graph
        self.bases = [0, *accumulate(s.size for s in shapes)]
        self.small = all(s.size <= SMALL for s in shapes)


class Shaped:
    """A program's facts, made of its procedures when they are asked for; the same as those of parse_program, but for
    their order and the trees."""

    def __init__(self, parts: list[tuple[Shape, list[str]]], plan: Plan):
        self.names, self.calls, self.order, self.below, self.small = plan.names, plan.calls, plan.order, plan.below, plan.small
        self.parts = [(shape, words, b) for (shape, words), b in zip(parts, plan.bases)]
        self.size = plan.bases[-1]

    @cached_property
    def procs(self) -> list[tuple]:
        return [(p, k) for k, p in enumerate(self.names)]

    @cached_property
    def stmts(self) -> list[tuple]:
        out, lists = [], 0
        for (shape, w, b), proc in zip(self.parts, self.names):
            out += [(n + b, kind, proc, of + lists, pos, None if parent is None else parent + b, last + b, None if v is None else w[v], None if q is None else w[q]) for n, kind, of, pos, parent, last, v, q in shape.stmts]
            lists += shape.lists
        return out

    @cached_property
    def nexts(self) -> list[tuple]:
        return [(x + b, y + b) for shape, _, b in self.parts for x, y in shape.facts.nexts]

    @cached_property
    def uses(self) -> list[tuple]:
        return [(n + b, v, inside) for shape, w, b in self.parts for n, at, inside in shape.uses for v in ((w[at[0]],) if len(at) == 1 else sorted({w[k] for k in at}))]

    @cached_property
    def modifies(self) -> list[tuple]:
        return [(n + b, w[k]) for shape, w, b in self.parts for n, k in shape.modifies]

    @cached_property
    def assigns(self) -> list[tuple]:
        """(statement, variable, the right side's key, keys of its subtrees)."""
        out = []
        for shape, w, b in self.parts:
            for n, lhs, form, at in shape.assigns:
                e = _tree(form % tuple([w[k] for k in at]), False)
                out.append((n + b, w[lhs], e.key, e.subtrees))
        return out

    @cached_property
    def consts(self) -> list[tuple]:
        return [(v,) for v in sorted({w[k] for shape, w, _ in self.parts for k in shape.numbers})]


def _part(segments: list[str], found: list[tuple], last: bool) -> tuple | None:
    """(number for shape, name and calls, shape, words) of a procedure; None of what is no procedure."""
    key = tuple(map(_first, found)), last
    if key not in _shapes:
        made = _made(segments, last)  # which may drop what is kept
        _shapes[key] = made
    if (shape := _shapes[key]) is None:
        return None
    words = list(chain.from_iterable(map(_second, found)))
    key = shape, words[1], *[words[k] for _, k in shape.calls]
    if (number := _roles.get(key)) is None:
        _keep(10 + len(key))
        number = _roles[key] = next(_numbers)
    return number, shape, words


def _looked_up(segments: list[str]) -> list[tuple]:
    found = list(map(_texts.get, segments))
    if not all(found):
        found = [f or _texts.get(s) or _segment(s) for f, s in zip(found, segments)]
    return found


def _segments(text: str) -> list[str]:
    return text.replace("{", "{;").replace("}", "};").split(";")


def _by_procedure(text: str) -> list[tuple] | None:
    """The parts of a text that is cut between all its procedures, and only there; else None."""
    pieces = text.split(_CUT)
    end, out = len(pieces) - 1, []
    for k, piece in enumerate(pieces):
        held = _short[(k > 0) + 2 * (k == end)]
        if (part := held.get(piece)) is None:
            segments = _segments(f"\nprocedure {piece}" if k else piece)
            if k < end:
                segments[-1] += "}"
            found = _looked_up(segments)
            heads = list(map(_third, found))
            if not heads[0] or sum(heads) > 1 or (part := _part(segments, found, k == end)) is None:
                return None
            if len(piece) <= _SHORT:
                if len(held) >= _MOST_SHORT:
                    held.clear()
                held[piece] = part
        out.append(part)
    return out


def _by_heads(text: str) -> list[tuple] | None:
    """The parts of any text; None of what isn't understood."""
    segments = _segments(text)
    found = _looked_up(segments)
    starts = [k for k, (_, _, head) in enumerate(found) if head]
    if not starts or starts[0]:
        return None
    out, end = [], len(found)
    for a, b in zip(starts, [*starts[1:], end]):
        if (part := _part(segments[a:b], found[a:b], b == end)) is None:
            return None
        out.append(part)
    return out


def _plan(parts: list[tuple]) -> Plan | None:
    names = {w[1]: k for k, (_, _, w) in enumerate(parts)}
    if len(names) < len(parts):
        return None
    try:
        calls = tuple([tuple([names[w[k]] for _, k in shape.calls]) for _, shape, w in parts])
    except KeyError:
        return None
    graph = _graph(calls)
    return None if graph is None else Plan([shape for _, shape, _ in parts], list(names), calls, graph)


def read_program(text: str) -> Shaped | Facts:
    """A program by the shapes of its procedures, or as parse_program finds it."""
    if "\0" in text:
        return parse_program(text)
    parts = _by_procedure(text) or _by_heads(text)
    if parts is None:
        return parse_program(text)
    kept = len(parts) <= _NARROW
    key = tuple(map(_first, parts)) if kept else ()
    plan = _plans.get(key) if kept else None
    if plan is None:
        if (plan := _plan(parts)) is None:
            return parse_program(text)
        if kept:
            _keep(40 * len(parts))
            if len(_plans) >= _MOST_PLANS:
                _plans.clear()
            _plans[key] = plan
    return Shaped([part[1:] for part in parts], plan)
