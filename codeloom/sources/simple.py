"""Front end of the SIMPLE language: one program text to fact rows.

`parse_program` gives the facts of a program as plain lists; `parse_expression` the tree of an arithmetic
expression. Equal trees have equal keys: a name or number is its own key, any other tree's is a digest of its
operator and its parts' keys, so a key is short whatever the depth. Readers are generators on a stack of
their own (`_run`), so nesting has no limit but memory. Errors raise ProgramError.

Most texts are read a statement at a time (`_quick`), with the trees of short expressions and conditions kept
for further programs; a text that isn't understood so goes to the reader of tokens, which has the last word.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Generator
from dataclasses import dataclass, field

_TOKEN = re.compile(r"[ \t\r\n]*(?:([A-Za-z][A-Za-z0-9]*)|([0-9]+)|(==|!=|<=|>=|&&|\|\||[{}()<>;=+\-*/%!]))")
_BLANK = re.compile(r"[ \t\r\n]*")
RELATIONAL = {"<", ">", "<=", ">=", "==", "!="}
END = ("end", "")


class ProgramError(ValueError):
    """The text is no valid program or expression."""


def tokens(text: str) -> list[tuple[str, str]]:
    text, at, out = text.split("\0", 1)[0], 0, []
    while True:
        m = _TOKEN.match(text, at)
        if not m:
            if _BLANK.match(text, at).end() < len(text):
                raise ProgramError(f"unexpected text at {at}: {text[at : at + 10]!r}")
            return [*out, END]
        name, number, sign = m.groups()
        if number and len(number) > 1 and number[0] == "0":
            raise ProgramError(f"number with a leading zero: {number}")
        out.append(("name", name) if name else ("number", number) if number else ("sign", sign))
        at = m.end()


class Expr:
    """A tree. kind: value, relation or logic; op: the operator, empty for a name or number, ! for a negation."""

    __slots__ = ("key", "kind", "op", "left", "right", "names", "numbers", "subtrees")

    def __init__(self, op: str, left: Expr | None, right: Expr | None, kind: str = "value", text: str = ""):
        self.op, self.left, self.right, self.kind = op, left, right, kind
        self.key = text or "#" + hashlib.md5(" ".join((op, *(x.key for x in (left, right) if x))).encode()).hexdigest()
        self.names: set[str] = set()  # of the whole expression, at its root
        self.numbers: set[str] = set()
        self.subtrees: set[str] = set()  # keys of all arithmetic subtrees

    def __eq__(self, other) -> bool:
        return isinstance(other, Expr) and (self.key, self.kind) == (other.key, other.kind)

    __hash__ = None

    @property
    def canon(self) -> str:
        """The fully parenthesised text."""
        out: list[str] = []
        todo: list = [self]
        while todo:
            e = todo.pop()
            if isinstance(e, str):
                out.append(e)
            elif not e.op:
                out.append(e.key)
            elif e.op == "!":
                todo += [*reversed(e.left.within), "!"]
            elif e.kind == "logic":
                todo += [*reversed(e.right.within), f" {e.op} ", *reversed(e.left.within)]
            else:
                todo += [")", e.right, f" {e.op} ", e.left, "("]
        return "".join(out)

    @property
    def within(self) -> list:
        """Itself within parentheses; those that it has are enough."""
        return [self] if self.op and self.kind != "logic" else ["(", self, ")"]

    @property
    def grouped(self) -> str:
        return self.canon if self.op and self.kind != "logic" else f"({self.canon})"


def _run(reader: Generator):
    """What the reader returns; the readers that it yields are run in its place first."""
    stack, value = [reader], None
    while stack:
        try:
            stack.append(stack[-1].send(value))
            value = None
        except StopIteration as e:
            stack.pop()
            value = e.value
    return value


class _Reader:
    def __init__(self, text: str):
        self.items, self.at = tokens(text), 0
        self.names: set[str] = set()
        self.numbers: set[str] = set()
        self.subtrees: set[str] = set()

    def peek(self) -> str:
        return self.items[self.at][1]

    def take(self, *signs: str) -> str:
        kind, text = self.items[self.at]
        if signs and (text not in signs or kind == "end"):
            raise ProgramError(f"expected {' or '.join(signs)}, found {text or 'the end'!r}")
        self.at += 1
        return text

    def name(self) -> str:
        kind, text = self.items[self.at]
        if kind != "name":
            raise ProgramError(f"expected a name, found {text or 'the end'!r}")
        self.at += 1
        return text

    def whole(self, reader: Generator) -> Expr:
        """The expression that the reader gives, with its names, numbers and subtrees."""
        self.names, self.numbers, self.subtrees = set(), set(), set()
        e = _run(reader)
        e.names, e.numbers, e.subtrees = self.names, self.numbers, self.subtrees
        return e

    def join(self, op: str, a: Expr, b: Expr) -> Expr:
        e = Expr(op, a, b)
        self.subtrees.add(e.key)
        return e

    # arithmetic: sums of products of atoms, left to right
    def sum(self, first: Expr | None = None):
        total = sign = None
        while True:
            left = first or (yield from self.atom())
            first = None
            while self.peek() in ("*", "/", "%"):
                op = self.take()
                left = self.join(op, left, (yield from self.atom()))
            total = left if total is None else self.join(sign, total, left)
            if self.peek() not in ("+", "-"):
                return total
            sign = self.take()

    def atom(self):
        kind, text = self.items[self.at]
        if kind in ("name", "number"):
            self.at += 1
            (self.names if kind == "name" else self.numbers).add(text)
            self.subtrees.add(text)
            return Expr("", None, None, text=text)
        self.take("(")
        inside = yield self.sum()
        self.take(")")
        return inside

    # conditions; inside parentheses a plain value may stand too
    def condition(self, inside: bool = False):
        if self.peek() == "!":
            self.take()
            self.take("(")
            part = yield self.condition(True)
            self.take(")")
            return Expr("!", part, None, "logic")
        left, grouped = None, self.peek() == "("
        if grouped:
            self.take("(")
            left = yield self.condition(True)
            self.take(")")
            if self.peek() in ("+", "-", "*", "/", "%"):
                if left.kind != "value":
                    raise ProgramError("a condition can't be calculated with")
                left, grouped = (yield self.sum(left)), False
        else:
            left = yield self.sum()
        if self.peek() == ")" and inside:
            return left
        if self.peek() in RELATIONAL:
            if left.kind != "value":
                raise ProgramError("conditions can't be compared")
            op = self.take()
            return Expr(op, left, (yield self.sum()), "relation")
        if not grouped:
            raise ProgramError(f"expected a comparison, found {self.peek() or 'the end'!r}")
        op = self.take("&&", "||")
        self.take("(")
        right = yield self.condition(True)
        self.take(")")
        return Expr(op, left, right, "logic")


def parse_expression(text: str) -> Expr:
    r = _Reader(text)
    out = r.whole(r.sum())
    if r.items[r.at] != END:
        raise ProgramError(f"text after the expression: {r.peek()!r}")
    return out


@dataclass
class Facts:
    """Rows by fact table; statements count from 1 in source order."""

    procs: list[tuple] = field(default_factory=list)  # proc_name, proc_idx
    stmts: list[tuple] = field(default_factory=list)  # stmt_no, kind, proc_name, list_id, pos, parent_stmt, last_inside, operand_var, callee
    uses: list[tuple] = field(default_factory=list)  # stmt_no, var, in_condition
    modifies: list[tuple] = field(default_factory=list)  # stmt_no, var
    assigns: list[tuple] = field(default_factory=list)  # stmt_no, lhs, rhs_key, rhs_subtrees
    consts: list[tuple] = field(default_factory=list)  # value
    nexts: list[tuple] = field(default_factory=list)  # src, dst
    trees: dict[int, Expr] = field(default_factory=dict)  # conditions and right sides, for printing


class _Program(_Reader):
    def __init__(self, text: str):
        super().__init__(text)
        self.f, self.lists, self.values = Facts(), 0, set()

    def run(self) -> Facts:
        seen = set()
        while self.items[self.at] != END:
            self.take("procedure")
            self.proc = self.name()
            if self.proc in seen:
                raise ProgramError(f"two procedures named {self.proc}")
            seen.add(self.proc)
            self.f.procs.append((self.proc, len(self.f.procs)))
            self.take("{")
            self.flow(_run(self.body(None)))
        self.f.consts = [(v,) for v in sorted(self.values)]
        self.calls()
        return self.f

    def body(self, parent: int | None):
        """The statements up to the closing brace, as (number, kind, inner lists)."""
        self.lists += 1
        mine, out = self.lists, []
        while not out or self.peek() != "}":
            word, n = self.name(), len(self.f.stmts) + 1
            kind = "assign" if self.peek() == "=" else word
            if kind not in ("assign", "read", "print", "call", "if", "while"):
                raise ProgramError(f"no statement begins with {word!r}")
            self.f.stmts.append(())
            target = callee = None
            inner: list[list[tuple]] = []
            if kind == "assign":
                self.take("=")
                rhs = self.f.trees[n] = self.whole(self.sum())
                self.f.modifies.append((n, word))
                self.f.assigns.append((n, word, rhs.key, sorted(rhs.subtrees)))
                self.note(n, rhs, False)
            elif kind in ("if", "while"):
                self.take("(")
                self.f.trees[n] = self.whole(self.condition())
                self.note(n, self.f.trees[n], True)
                self.take(")")
                if kind == "if":
                    self.take("then")
                for k in range(2 if kind == "if" else 1):
                    if k:
                        self.take("else")
                    self.take("{")
                    inner.append((yield self.body(n)))
            elif kind == "call":
                callee = self.name()
            else:
                target = self.name()
                (self.f.modifies.append((n, target)) if kind == "read" else self.f.uses.append((n, target, False)))
            if not inner:
                self.take(";")
            self.f.stmts[n - 1] = (n, kind, self.proc, mine, len(out), parent, len(self.f.stmts), target, callee)
            out.append((n, kind, inner))
        self.take("}")
        return out

    def note(self, n: int, e: Expr, in_condition: bool) -> None:
        self.f.uses += [(n, v, in_condition) for v in sorted(e.names)]
        self.values |= e.numbers

    def flow(self, body: list[tuple]) -> None:
        """Control flow of a procedure; after: where control goes at a list's end."""
        todo: list[tuple[list[tuple], int | None]] = [(body, None)]
        while todo:
            rows, after = todo.pop()
            for k, (n, kind, inner) in enumerate(rows):
                then = rows[k + 1][0] if k + 1 < len(rows) else after
                for part in inner:
                    self.f.nexts.append((n, part[0][0]))
                    todo.append((part, n if kind == "while" else then))
                if kind != "if" and then is not None:
                    self.f.nexts.append((n, then))

    def calls(self) -> None:
        to: dict[str, set[str]] = {p[0]: set() for p in self.f.procs}
        for s in self.f.stmts:
            if s[8] is not None:
                if s[8] not in to:
                    raise ProgramError(f"no procedure named {s[8]}")
                to[s[2]].add(s[8])
        callers: dict[str, list[str]] = {p: [] for p in to}
        for p, called in to.items():
            for q in called:
                callers[q].append(p)
        left = {p: len(q) for p, q in to.items()}
        leaves, done = [p for p, n in left.items() if not n], 0
        while leaves:  # peel off procedures whose callees are all gone
            done += 1
            for p in callers[leaves.pop()]:
                left[p] -= 1
                if not left[p]:
                    leaves.append(p)
        if done < len(to):
            raise ProgramError("cyclic or recursive calls")


#: Trees by their texts, of statements read before; no more than so many, of no more than so many characters.
_trees: dict[tuple[bool, str], Expr] = {}
_MOST_TREES, _LONGEST = 20_000, 120
_W = r"[ \t\r\n]*"
_N = "[A-Za-z][A-Za-z0-9]*"
_NEXT = re.compile(
    rf"{_W}(?:({_N}){_W}=(?!=)([^;]*);"  # an assignment
    rf"|(read|print|call)[ \t\r\n]+({_N}){_W};"
    rf"|(if|while){_W}(\([^{{}};]*\)){_W}(then{_W})?\{{"
    rf"|(\}})(?:{_W}(else){_W}\{{)?)"
)
_HEAD = re.compile(rf"{_W}procedure[ \t\r\n]+({_N}){_W}\{{")


def _tree(text: str, is_condition: bool) -> Expr:
    e = _trees.get((is_condition, text))
    if e is None:
        r = _Reader(text)
        if is_condition:
            r.take("(")
        e = r.whole(r.condition() if is_condition else r.sum())
        if is_condition:
            r.take(")")
        if r.items[r.at] != END:
            raise ProgramError(f"text after the expression: {r.peek()!r}")
        if len(text) <= _LONGEST:
            if len(_trees) >= _MOST_TREES:
                _trees.clear()
            _trees[is_condition, text] = e
    return e


def _quick(text: str) -> Facts | None:
    """The facts that _Program finds, or None where it has to say."""
    text = text.split("\0", 1)[0]
    r = _Program("")
    f, at, end, names = r.f, 0, len(text.rstrip(" \t\r\n")), set()
    stmts, uses, modifies = f.stmts, f.uses, f.modifies
    while at < end:
        head = _HEAD.match(text, at)
        if not head or head[1] in names:
            return None
        proc, at = head[1], head.end()
        names.add(proc)
        f.procs.append((proc, len(f.procs)))
        r.lists += 1
        # of each open list: container, its kind, its list and rows, then this list and its rows
        mine, out, parent, open_ = r.lists, [], None, []
        while True:
            m = _NEXT.match(text, at)
            if not m:
                return None
            at, n = m.end(), len(stmts) + 1
            lhs, rhs, word, name, kind, condition, then, close, other = m.groups()
            if lhs:
                e = f.trees[n] = _tree(rhs, False)
                modifies.append((n, lhs))
                f.assigns.append((n, lhs, e.key, sorted(e.subtrees)))
                uses += [(n, v, False) for v in sorted(e.names)]
                r.values |= e.numbers
                stmts.append((n, "assign", proc, mine, len(out), parent, n, None, None))
                out.append((n, "assign", ()))
            elif word:
                if word == "read":
                    modifies.append((n, name))
                elif word == "print":
                    uses.append((n, name, False))
                stmts.append((n, word, proc, mine, len(out), parent, n, *((None, name) if word == "call" else (name, None))))
                out.append((n, word, ()))
            elif kind:
                if (kind == "if") != bool(then):
                    return None
                e = f.trees[n] = _tree(condition, True)
                uses += [(n, v, True) for v in sorted(e.names)]
                r.values |= e.numbers
                stmts.append((n, kind, proc, mine, len(out), parent, n, None, None))
                inner: list[list[tuple]] = []
                out.append((n, kind, inner))
                open_.append((parent, mine, out, kind, inner))
                r.lists += 1
                mine, out, parent = r.lists, [], n
            else:
                if not out or not open_ and other:
                    return None
                if not open_:
                    break
                _, _, _, kind, inner = open_[-1]
                inner.append(out)
                if (kind == "if" and len(inner) == 1) != bool(other):
                    return None
                if other:
                    r.lists += 1
                    mine, out = r.lists, []
                else:
                    stmts[parent - 1] = (*stmts[parent - 1][:6], len(stmts), None, None)
                    parent, mine, out, _, _ = open_.pop()
        r.flow(out)
    f.consts = [(v,) for v in sorted(r.values)]
    r.calls()
    return f


def parse_program(text: str) -> Facts:
    try:
        found = _quick(text)
    except ProgramError:
        found = None
    return _Program(text).run() if found is None else found
