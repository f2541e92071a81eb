"""Programs read by the shapes of their procedures against the reader of tokens and the kernels."""

from __future__ import annotations

import numpy as np
import pytest

from codeloom.operators.flow import KERNELS
from codeloom.operators.within import PLAIN, Pairs, ShapedPairs, pairs
from codeloom.sources import shapes
from codeloom.sources.shapes import Shaped, read_program
from codeloom.sources.simple import Facts, ProgramError, parse_program
from tests.test_answers import ODD
from tests.test_flow import some_program

MORE = [
    "procedure p { if = if + then; while (call > 0) { print = 1; } call q; } procedure q { read procedure; procedure = procedure % 7; }",
    "procedure then { a = a + a * 7 - 7; if (a > a) then { call then2; } else { while (b == c) { call then2; } } } procedure then2 { print a; }",
    "x procedure p { a = 1; }", "procedure p { a = 1; } procedure", "procedure p { a = 1; }procedure q{call r;}", "procedure p{call q;}procedure q{call p;}", "procedure p { a = 12ab; }", "procedure p{a=(b+%d)%s;}", "procedure p{a=b%s+d%2;}",
]


def _said(f, text):
    try:
        x = f(text)
    except ProgramError as e:
        return str(e)
    return {k: [(*r[:3], sorted(r[3])) if k == "assigns" else tuple(r) for r in sorted(getattr(x, k), key=lambda r: tuple(map(str, r)))] for k in ("procs", "stmts", "uses", "modifies", "assigns", "consts", "nexts")}


def test_facts_are_the_readers():
    rng = np.random.default_rng(21)
    for text in ODD + MORE + [some_program(rng) for _ in range(150)]:
        assert _said(read_program, text) == _said(parse_program, text), text
    assert isinstance(read_program(MORE[0]), Shaped) and isinstance(read_program(MORE[0] + "\0x"), Facts)


@pytest.mark.parametrize("name", [*KERNELS, *PLAIN])
def test_pairs_are_the_kernels(name):
    rng = np.random.default_rng(22)
    for text in [MORE[0], MORE[1], *(some_program(rng) for _ in range(60))]:
        got, want = ShapedPairs(read_program(text)).of(name), Pairs(parse_program(text)).of(name)
        assert len(got) == len(set(got)) and set(got) == set(want), text


def test_a_shape_is_found_once(monkeypatch):
    """Names and numbers don't matter, nor do the other procedures (F6 orders_next_t)."""
    made = []
    find = shapes.Shape.__init__
    monkeypatch.setattr(shapes.Shape, "__init__", lambda self, *a: made.append(1) or find(self, *a))
    monkeypatch.setattr(shapes, "_shapes", {})
    monkeypatch.setattr(shapes, "_texts", {})
    for k in range(300):
        f = read_program(f"procedure m{k} {{ read a{k}; call b{k}; }} procedure b{k} {{ while (x{k} > {k}) {{ y = (y{k} + {k}) * {k}; }} }}")
        assert pairs(f).of("next_t") and len(made) == 2


def test_a_segment_is_split_once(monkeypatch):
    """Whatever stands around it: texts that differ are looked up in pieces (F9 orders_next_bip)."""
    split = []
    find = shapes._segment
    monkeypatch.setattr(shapes, "_segment", lambda text: split.append(text) or find(text))
    monkeypatch.setattr(shapes, "_texts", {})
    rng = np.random.default_rng(24)
    texts = ["procedure p { if (a == 0) then { " + " ".join(f"v{x} = (v{y} + {z}) * rate;" for x, y, z in rng.integers(0, 4, (7, 3))) + " } else { b = 1; } }" for _ in range(300)]
    for text in texts:
        assert _said(read_program, text) == _said(parse_program, text)
    assert len(set(texts)) == 300 and len(split) == len(set(split)) <= 64 + 6


def test_a_short_procedure_is_looked_up_by_its_text(monkeypatch):
    """Also between programs, and what it means depends on where it stands (F14 orders_modifies_p, F18 orders_parent_t)."""
    cut, plans = [], []
    find, plan = shapes._segments, shapes._plan
    monkeypatch.setattr(shapes, "_segments", lambda text: cut.append(text) or find(text))
    monkeypatch.setattr(shapes, "_plan", lambda parts: plans.append(1) or plan(parts))
    monkeypatch.setattr(shapes, "_short", ({}, {}, {}, {}))
    monkeypatch.setattr(shapes, "_plans", {})
    for k in range(50):
        long = " ".join(f"v{(k + j) % 9} = v{j} + {k};" for j in range(12))
        text = f"procedure main {{ call o1; }}\nprocedure o1 {{ {long} call log; }}\nprocedure log {{ print x; }}"
        assert _said(read_program, text) == _said(parse_program, text)
    assert len(cut) == 50 + 2 and len(plans) == 1
    for text in ("procedure a { call a; }", "procedure a { call b; }\nprocedure b { call a; }", "procedure a { b = 1; }\nprocedure a { b = 1; }", "procedure a { call b; }\nprocedure b { b = 1; }\nprocedure b", "procedure a { b = 1; }\nprocedure ", "procedure a { b = 1; }\nprocedure b { b = 1; }}\nprocedure c { b = 1; }", "x }\nprocedure b { b = 1; }", "procedure a { call b; } procedure b { b = 1; }\nprocedure c { call b; }"):
        for _ in range(2):
            assert _said(read_program, text) == _said(parse_program, text), text


def test_odd_ends_of_segments():
    inner = ["a = 1", "a = 1;", "a = 1;;", ";a = 1;", "{a = 1;}", "while (a > 1) {;a = 1;}", "while (a > 1) {a = 1;};", "if (a > 1) then {a = 1;} else {b = 2;}", "a = b + 00;", "a = \u0663;", "call q;", "call q", "procedure q { a = 1; }", "procedure = 1;", "a = 1; }\u00a0procedure q { a = 2;", "a = 1; } x procedure q { a = 2;", "a = 1; }procedure procedure { a = 2;", "call q; };procedure q { a = 2;"]
    for before in ("", " ", ";", "}", "{", "x ", "\u00a0"):
        for x in inner:
            for after in ("", "\n", ";", "{", "}", " x", " procedure", "procedure q { print a; }", ";procedure q { print a; }", "x procedure q { print a; };"):
                text = f"{before}procedure p {{ {x} }}{after}"
                assert _said(read_program, text) == _said(parse_program, text), text


def test_what_is_kept_is_bounded(monkeypatch):
    monkeypatch.setattr(shapes, "_MOST_HELD", 2_000)
    monkeypatch.setattr(shapes, "_shapes", {})
    monkeypatch.setattr(shapes, "_held", 0)
    for k in range(1, 60):
        f = read_program("procedure p { " + "a = b + 1; " * k + "}")
        assert set(pairs(f).of("next_t")) == {(x, y) for x in range(1, k + 1) for y in range(x + 1, k + 1)}
        assert len(shapes._shapes) < 30


def test_texts_of_odd_orders(spark):
    """Nulls and orders without items; rows are moved before they are gathered."""
    from codeloom.sources.tables import order_programs

    orders = spark.createDataFrame([(1, 7, "F", "1-x"), (2, 7, None, "1-x"), (3, 7, "P", "1-x"), (4, None, "O", "2-y")], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string")
    items = spark.createDataFrame([(1, 5, 6, 2), (1, 4, 4, 1), (2, None, 3, None), (4, 8, 9, 1)], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int")
    out = order_programs(orders, items)
    end = " } else { budget = budget - 1; } call log; }"
    tail = "\nprocedure log { spent = spent + v0; print spent; }"
    assert {tuple(r) for r in out.collect()} == {
        ("7-1", "procedure main { read budget; while (budget > 0) { call o1; call o2; } print spent; }\nprocedure o1 { if (status == 0) then { v0 = (v0 + 1) * rate; v2 = (v1 + 2) * rate;" + end
            + "\nprocedure o2 { if (status == null) then { v3 = (null + null) * rate;" + end + tail),
        ("2", "procedure main { read budget; while (budget > 0) { call o1; } print spent; }\nprocedure o1 { if (status == 1) then { v1 = (v0 + 1) * rate;" + end + tail),
    }
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("REPARTITION_BY_COL") == 2 and "format_string" not in plan


def test_few_and_many_pairs_alike(monkeypatch):
    """Neither way makes the statements' facts (F8 orders_while_pattern, F12 orders_with)."""
    from codeloom.operators import within

    rng = np.random.default_rng(23)
    for text in [some_program(rng) for _ in range(30)]:
        for few in (0, 10**6):
            monkeypatch.setattr(within, "FEW", few)
            got, want = ShapedPairs(read_program(text)), Pairs(parse_program(text))
            for name in ("next", "next_t", "parent_t", "next_bip"):
                assert set(got.of(name)) == set(want.of(name))
            assert got.kinds == want.kinds and got.named("call", 8) == want.named("call", 8) and got.named("read", 7) == want.named("read", 7)
            assert "stmts" not in vars(got.facts)


def test_affects_without_loops_are_found_on_the_way(monkeypatch):
    """Nothing is walked again where control only goes on (F17 orders_affects_t)."""
    from codeloom.operators import within

    texts = ["procedure p { a = a + b; b = a * 2; call q; if (a > b) then { a = b; b = a; } else { c = a; call q; a = c + b; } c = a; a = b + c; } procedure q { b = c; print b; c = b; }"]
    rng = np.random.default_rng(25)
    texts += ["procedure p { if (a == 0) then { " + " ".join(f"v{x} = (v{y} + 1) * rate;" for x, y in rng.integers(0, 4, (9, 2))) + " } else { v1 = v1 - 1; } call q; } procedure q { v2 = v2 + v0; }" for _ in range(40)]
    for text in texts[:1] + [t.replace("call q;", "while (a > 0) { v0 = v3 + v0; call q; } v3 = v0;") for t in texts[1:]] + texts[1:]:
        for name in ("affects", "affects_t"):
            assert sorted(ShapedPairs(read_program(text)).of(name)) == sorted(Pairs(parse_program(text)).of(name)), text
    monkeypatch.setattr(within, "walk", None)
    for text in texts[1:]:
        assert ShapedPairs(read_program(text)).of("affects_t") is not None


def test_texts_are_made_last(spark):
    """Items move and are sorted as numbers; nulls, negative keys, the least and greatest places (F9 orders_next_bip)."""
    from itertools import product

    from codeloom.sources.tables import order_programs

    orders = [(1, 7, "F", "1-x"), (2, 7, None, "1-x"), (3, 7, "Z", "1-x"), (4, 8, "P", None)]
    items = [(k, by, to, n) for k in (1, 2, 4, None) for by, to, n in product((None, -7, 0, 6), (None, -1, 9), (None, -(2**31), -1, 3, 3, 2**31 - 1))]
    out = order_programs(spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string"), spark.createDataFrame(items, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int"))

    def body(key, status):
        rest = lambda x: None if x is None else x % 4 if x >= 0 else -(-x % 4)
        first = lambda x: (x is not None, x or 0)
        var = lambda x: "null" if x is None else f"v{x}"
        mine = sorted(((n, rest(to), rest(by)) for k, by, to, n in items if k == key), key=lambda r: tuple(map(first, r)))
        return f" {{ if (status == {status}) then {{ " + " ".join(f"{var(to)} = ({var(by)} + {'null' if n is None else n}) * rate;" for n, to, by in mine) + " } else { budget = budget - 1; } call log; }"

    tail = "\nprocedure log { spent = spent + v0; print spent; }"
    assert {tuple(r) for r in out.collect()} == {
        ("7-1", "procedure main { read budget; while (budget > 0) { call o1; call o2; } print spent; }\nprocedure o1" + body(1, 0) + "\nprocedure o2" + body(2, "null") + tail),
        ("8", "procedure main { read budget; while (budget > 0) { call o1; } print spent; }\nprocedure o1" + body(4, 2) + tail),
    }
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert "rate" in plan and "rate" not in plan.split("REPARTITION_BY_COL", 1)[1]
