from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codeloom.operators.flow import KERNELS, Program, adjacent, reach
from codeloom.plans.pql import QuerySyntaxError, parse_query
from codeloom.sources.printing import printed, program_text
from codeloom.sources.simple import ProgramError, parse_expression, parse_program


def test_expressions():
    assert parse_expression("y * 2 + x * (a + 1) * b").canon == "((y * 2) + ((x * (a + 1)) * b))"
    assert "(1 * b)" not in parse_expression("(a + 1) * b").subtrees
    assert parse_expression("a - b - c").canon == "((a - b) - c)"
    for bad in ("", "a +", "-a", "(a", "a b", "01", "a + 1;"):
        with pytest.raises(ProgramError):
            parse_expression(bad)


@pytest.mark.parametrize("condition", ["x > 1", "(x) > 1", "((x + 1)) * 2 > 1", "!(x == 1)", "(x == 1) && (y < 2)", "((x == 1) || (y < 2)) && (!(z > 1))", "(x) && (y)", "!(x)"])
def test_conditions(condition):
    assert parse_program(f"procedure p {{ while ({condition}) {{ a = 1; }} }}").stmts[0][1] == "while"


@pytest.mark.parametrize("condition", ["x", "(x > 1)", "x > 1 && y > 1", "(x > 1) > 2", "x > y > z", "!x == 1", "(x > 1) + 1 > 2", ""])
def test_bad_conditions(condition):
    with pytest.raises(ProgramError):
        parse_program(f"procedure p {{ while ({condition}) {{ a = 1; }} }}")


@pytest.mark.parametrize("text", ["procedure p { }", "procedure p { if (x > 1) then { a = 1; } }", "procedure p { call p; }", "procedure p { call q; }", "procedure p { a = 1; } procedure p { a = 1; }", "procedure p { a = 01; }", "procedure p { a = 1 }", "procedure p { a = 1; # }"])
def test_bad_programs(text):
    with pytest.raises(ProgramError):
        parse_program(text)


def test_keywords_as_names():
    f = parse_program("procedure while { if = 2; read = if; read read; call call; } procedure call { while = 1; }")
    assert [s[1] for s in f.stmts] == ["assign", "assign", "read", "call", "assign"]
    assert not parse_program("").procs


@pytest.mark.parametrize("text", ["Select", "stmt s Select s", "stmt s; Select s such  that Follows(s, _)", "stmt s; Select s such that Parent *(s, _)", "stmt s; Select s such that Follows(s, \"x\")", "procedure p; Select p such that Calls(p, 1)", "assign a; Select a pattern a(_, )", "assign a; Select a pattern a(_, \"+\")", "stmt s; Select s with s.stmt# = 01", "stmt s; select s", "Stmt s; Select s", "stmt s; Select s;", "stmt s; Select s such that Uses(s, 1)", "stmt s; Select s.name", "stmt s; Selects s"])
def test_syntax_errors(text):
    with pytest.raises(QuerySyntaxError):
        parse_query(text)


@pytest.mark.parametrize("text", ["Select s", "stmt s, s; Select s", "stmt s; Select s.value", "variable v; Select v such that Follows(v, _)", "stmt s; Select s such that Uses(_, \"x\")", "stmt s; Select s pattern s(_, _)", "stmt s; Select s with s = 1", "stmt s; Select s with s.stmt# = \"x\"", "prog_line n; Select n.stmt#", "stmt s; Select s pattern t(_"])
def test_semantic_errors(text):
    assert parse_query(text).invalid


def test_synonyms_named_like_keywords():
    q = parse_query("stmt such, BOOLEAN; variable pattern; Select <such, BOOLEAN> such that Follows(such, BOOLEAN) and Uses(such, pattern)")
    assert not q.invalid and not q.boolean and len(q.clauses) == 2


def program(text: str) -> Program:
    f = parse_program(text)
    return Program([(s[0], s[1], s[2], s[3], s[4], s[5], s[8]) for s in f.stmts], f.nexts, [u[:2] for u in f.uses], f.modifies)


def pairs(runs) -> set[tuple]:
    return {(x, y) for x, ys in runs for y in ys}


def test_nested_tail_calls():
    p = program("procedure a { if (k > 0) then { call b; } else { while (k > 1) { call c; } } call c; } procedure b { call c; } procedure c { k = k + 1; }")
    found = pairs(p.next_bip())
    assert (7, 5) in found and (7, 3) in found and (7, 2) not in found and (2, 5) not in found
    assert (7, 7) in pairs(p.affects_bip())
    assert pairs(reach(adjacent([(1, 2), (2, 1)]))) == {(1, 1), (1, 2), (2, 1), (2, 2)}


_NAMES = st.sampled_from(["a", "b2", "if", "while", "read", "then"])
_VALUES = st.recursive(_NAMES | st.integers(0, 99).map(str), lambda v: st.tuples(v, st.sampled_from("+-*/%"), v).map(lambda t: f"({t[0]} {t[1]} {t[2]})"), max_leaves=5)
_RELATIONS = st.tuples(_VALUES, st.sampled_from(["<", ">", "<=", ">=", "==", "!="]), _VALUES).map(" ".join)
_CONDITIONS = st.recursive(_RELATIONS, lambda c: c.map(lambda x: f"!({x})") | st.tuples(c, st.sampled_from(["&&", "||"]), c | _VALUES).map(lambda t: f"({t[0]}) {t[1]} ({t[2]})"), max_leaves=4)
_PLAIN = st.tuples(_NAMES, _VALUES).map(lambda t: f"{t[0]} = {t[1]};") | st.tuples(st.sampled_from(["read", "print"]), _NAMES).map(lambda t: f"{t[0]} {t[1]};")
_STATEMENTS = st.recursive(
    st.lists(_PLAIN, min_size=1, max_size=3).map(" ".join),
    lambda b: st.lists(_PLAIN | st.tuples(_CONDITIONS, b).map(lambda t: f"while ({t[0]}) {{ {t[1]} }}") | st.tuples(_CONDITIONS, b, b).map(lambda t: f"if ({t[0]}) then {{ {t[1]} }} else {{ {t[2]} }}"), min_size=1, max_size=3).map(" ".join),
    max_leaves=4,
)


@settings(max_examples=150, deadline=None)
@given(_STATEMENTS, _STATEMENTS)
def test_printed_programs_parse_to_the_same_facts(one, two):
    facts = parse_program(f"procedure p {{ {one} }} procedure while {{ {two} call p; }}")
    again = parse_program(program_text(facts))
    assert again == facts and program_text(again) == program_text(facts)


def test_layout():
    text = "procedure p { while ((x > 1) && (!(y == 2))) { if (x < (y)) then { call q; } else { read z; } } } procedure q { a = b * (c + 1); }"
    assert program_text(parse_program(text)) == "procedure p{while((x > 1) && (!(y == 2))){if(x < y)then{call q;}else{read z;}}}procedure q{a = (b * (c + 1));}"
    assert program_text(parse_program(text), compact=False).splitlines() == [
        "   procedure p",
        "   {",
        "01     while((x > 1) && (!(y == 2)))",
        "       {",
        "02         if((x < y)) then",
        "           {",
        "03             call q;",
        "           }",
        "           else",
        "           {",
        "04             read z;",
        "           }",
        "       }",
        "   }",
        "   procedure q",
        "   {",
        "05     a = (b * (c + 1));",
        "   }",
    ]


def test_printed(spark):
    d = spark.createDataFrame([("1", "procedure p{a=1;}"), ("2", "procedure"), ("3", None), ("4", "procedure p { a = " + "(" * 5000 + "1" + ")" * 5000 + "; }")], "program_id string, text string")
    assert {r["program_id"]: r["listing"] for r in printed(d).collect()} == {"1": "procedure p{a = 1;}", "2": None, "3": "", "4": "procedure p{a = 1;}"}
