"""Case files: suites of queries over one program with their expected answers.

A case is five parts, each on a line: `number - comment`, declarations (on more lines where they need them),
the query from `Select` on, the answers separated by commas (`none` or nothing: no answer; cells of a tuple
separated by blanks) and a time limit in milliseconds. Blank lines between cases don't count.
"""

from __future__ import annotations

import re
import time
from dataclasses import dataclass
from pathlib import PurePosixPath

from pyspark.sql import SparkSession

from codeloom.engine import Engine

_HEAD = re.compile(r"\s*(\d+)\s*-\s?(.*)")


@dataclass(frozen=True)
class Case:
    suite: str
    case_id: int
    comment: str
    declarations: str
    select: str
    expected: frozenset[str]
    timeout_ms: int

    @property
    def query(self) -> str:
        return f"{self.declarations}\n{self.select}"


@dataclass(frozen=True)
class Outcome:
    case: Case
    answers: frozenset[str]
    seconds: float

    @property
    def missing(self) -> frozenset[str]:
        return self.case.expected - self.answers

    @property
    def additional(self) -> frozenset[str]:
        return self.answers - self.case.expected

    @property
    def passed(self) -> bool:
        return self.answers == self.case.expected and self.seconds * 1000 <= self.case.timeout_ms


def parse_cases(text: str, suite: str = "") -> list[Case]:
    lines = [x.rstrip("\r") for x in text.split("\n")]
    out, at = [], 0
    while at < len(lines):
        if not lines[at].strip():
            at += 1
            continue
        head = _HEAD.fullmatch(lines[at])
        if not head:
            raise ValueError(f"line {at + 1} is no head of a case: {lines[at]!r}")
        # a limit is a line of digits with a case or nothing after it
        end = next((k for k in range(at + 4, len(lines)) if lines[k].strip().isdigit() and all(not x.strip() or _HEAD.fullmatch(x) for x in _next_full(lines, k))), None)
        if end is None:
            raise ValueError(f"the case on line {at + 1} has no time limit")
        body = lines[at + 1 : end - 1]
        first = next((k for k, x in enumerate(body) if x.lstrip().startswith("Select")), min(1, len(body) - 1))
        answers = lines[end - 1].strip()
        expected = frozenset() if answers.lower() == "none" else frozenset(" ".join(x.split()) for x in answers.split(",") if x.strip())
        out.append(Case(suite, int(head[1]), head[2], "\n".join(body[:first]), "\n".join(body[first:]), expected, int(lines[end])))
        at = end + 1
    return out


def _next_full(lines: list[str], k: int) -> list[str]:
    return [x for x in lines[k + 1 :] if x.strip()][:1]


def read_cases(spark: SparkSession, path: str) -> list[Case]:
    """The cases of text files, each file a suite of its own name."""
    rows = spark.read.text(path, wholetext=True).selectExpr("input_file_name() as file", "value").collect()  # as many as the files named
    return [c for r in sorted(rows) for c in parse_cases(r["value"], PurePosixPath(r["file"]).stem)]


def run_cases(spark: SparkSession, program: str, cases: list[Case]) -> list[Outcome]:
    """Each case's answers over the program, which is read once; answers are compared as sets."""
    engine, out = Engine.load(spark, program), []
    for c in cases:
        began = time.perf_counter()
        answers = frozenset(engine.evaluate(c.query))
        out.append(Outcome(c, answers, time.perf_counter() - began))
    engine.release()
    return out
