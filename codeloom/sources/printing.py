"""Programs printed back from their facts: compact on one line, or laid out with statement numbers.

The compact form parses to the same facts. Parentheses are those of the expression trees, not of the source.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.session import workers_find_us
from codeloom.sources.simple import Facts, ProgramError, parse_program

#: Fixed values of the layout: columns for the statement number, columns a level.
GUTTER, INDENT = 3, 4


def _layout(facts: Facts, compact: bool) -> Iterator[tuple[int, int | None, str]]:
    """(depth, statement number, text) of each printed line."""
    lists, inner = defaultdict(list), defaultdict(list)
    for s in facts.stmts:
        owner = s[2] if s[5] is None else s[5]
        if s[3] not in lists:
            inner[owner].append(s[3])
        lists[s[3]].append(s)

    def statement(n: int, kind: str, operand: str, callee: str) -> str:
        e = facts.trees.get(n)
        if kind == "assign":
            return f"{lhs[n]} = {e.canon};"
        if kind in ("if", "while"):
            condition = e.grouped if compact else f"({e.canon})"
            return f"{kind}{condition}" + (("then" if compact else " then") if kind == "if" else "")
        return f"{kind} {callee if kind == 'call' else operand};"

    lhs = {n: name for n, name, _, _ in facts.assigns}
    for name, _ in facts.procs:
        yield 0, None, f"procedure {name}"
        # what is still to come, last first: a line, or the list to open at a depth
        todo: list[tuple] = [(0, None, None, inner[name][0])]
        while todo:
            depth, n, text, opened = todo.pop()
            if opened is None:
                yield depth, n, text
                continue
            yield depth, None, "{"
            todo.append((depth, None, "}", None))
            for n, kind, _, _, _, _, _, operand, callee in reversed(lists[opened]):
                for k, part in reversed(list(enumerate(sorted(inner[n])))):
                    todo.append((depth + 1, None, None, part))
                    if k:
                        todo.append((depth + 1, None, "else", None))
                todo.append((depth + 1, n, statement(n, kind, operand, callee), None))


def program_text(facts: Facts, compact: bool = True) -> str:
    rows = _layout(facts, compact)
    if compact:
        return "".join(text for _, _, text in rows)
    return "".join(f"{'' if n is None else f'{n:02d}':{GUTTER}}{' ' * INDENT * depth}{text}\n" for depth, n, text in rows)


def printed(sources: DataFrame, compact: bool = True) -> DataFrame:
    """(program_id, listing) of sources (program_id, text); null for a program that can't be parsed."""
    import pyarrow as pa

    workers_find_us(sources.sparkSession)

    def listing(text: str | None) -> str | None:
        try:
            return program_text(parse_program(text or ""), compact)
        except ProgramError:
            return None

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([listing(t) for t in b.column(1).to_pylist()], pa.string())], names=["program_id", "listing"])

    return sources.select(F.col("program_id").cast("string"), F.col("text").cast("string")).mapInArrow(run, "program_id string, listing string")
