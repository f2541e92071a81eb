from __future__ import annotations

import pytest

from codeloom.plans.pql import listing, parse_query
from codeloom.sources.cases import parse_cases, read_cases, run_cases

PROGRAM = "procedure main { read a; while (a > 0) { b = a + 1; a = a - 1; } print b; }"
SUITE = """1 - statements of a kind
assign a;
Select a
3, 4
60000

2 - tuples, declared on two lines
stmt s;
variable v;
Select <s, v> such that Uses(s, v) with s.stmt# = 3
3 a
60000
3 - nothing
stmt s;
Select s such that Follows(s, 1)
none
60000
4 - truth
stmt s;
Select BOOLEAN such that Next*(s, s)
TRUE
60000
5 - not a query
stmt s;
select s

60000
6 - wrong on purpose, with 7 - a dash
stmt s;
Select s such that Parent(2, s)
3,5
60000
7 - no time
stmt s;
Select s such that Parent(2, s)
3,4
0
"""


def test_cases_run(spark, tmp_path):
    (tmp_path / "suite.txt").write_text(SUITE)
    cases = read_cases(spark, str(tmp_path / "suite.txt"))
    assert [c.case_id for c in cases] == [1, 2, 3, 4, 5, 6, 7] and {c.suite for c in cases} == {"suite"}
    assert cases[1].declarations == "stmt s;\nvariable v;" and cases[4].expected == frozenset()
    got = run_cases(spark, PROGRAM, cases)
    assert [o.passed for o in got] == [True] * 5 + [False] * 2
    assert got[5].missing == {"5"} and got[5].additional == {"4"}
    assert got[6].answers == {"3", "4"}


@pytest.mark.parametrize("text", ["what is this\n", "1 - cut\nstmt s;\nSelect s\n"])
def test_broken_case_files(text):
    with pytest.raises(ValueError):
        parse_cases(text)
    assert parse_cases("\n\n") == []


def test_query_listing():
    q = parse_query('assign a; print q; Select <a, q.varName> pattern a("x", "y") such that Next*(_, 3) with q.varName = "x"')
    assert listing(q).splitlines()[:4] == ["declare assign a", "declare print q", "select a, q.varName", 'pattern assign(a, "x", y) exactly']
    assert listing(parse_query("Select BOOLEAN such that Uses(_, s)")).splitlines()[-1].startswith("invalid: ")
