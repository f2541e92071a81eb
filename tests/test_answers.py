"""Answers found in the tasks that hold the programs against the plan of joins."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest

import codeloom.engine as engine
import codeloom.operators.flow as flow
from codeloom.engine import Engine
from codeloom.plans.pql import parse_query
from codeloom.queries import ORDER_CASES
from codeloom.sources import simple
from codeloom.sources.simple import ProgramError, parse_program
from tests.test_flow import some_program
from tests.test_front_end import pairs, program

ODD = [
    "", "  ", "procedure p { }", "procedure p { a = ; }", "procedure p { a == 1; }", "procedure p { if (a) then { b=1; } else { c=1; } }", "procedure p { while (a>1) then { b=1; } }",
    "procedure p { if (a>1) { b=1; } else {c=2;} }", "procedure p { if (a>1) then { b=1; } }", "procedure p { while (a>1) { b=1; } else {c=2;} }", "procedure p { a=1; } else { b=1; }", "procedure p { a=1; } x",
    "procedure p {a=1;}procedure p{b=1;}", "procedure p { call q; }", "procedure p { call p; }", "procedure p { a = 01; }", "procedure p {a=1;}\0 junk", "procedure p { a=1; }\v", "procedure p{while(a>1){a=1;}", "procedure p { readx; }",
    "procedure p { if=2; read=if; read read; print print; call=1; call q; } procedure q { while = 1; then=2; }", "procedure procedure { procedure = 1; }", "procedure p { if (1==1) then{a=1;}else{while(2>1){b=1;}} c=1;}", "procedure p{a=b=c;}",
]


def test_statements_read_at_once():
    def said(f, text):
        try:
            return f(text)
        except ProgramError as e:
            return str(e)

    rng, quick = np.random.default_rng(3), 0
    for text in ODD + [some_program(rng) for _ in range(200)]:
        assert said(parse_program, text) == said(lambda t: simple._Program(t).run(), text), text
    for text in ("procedure p { a = b + 1; if (a > 0) then { call q; } else { read a; } }procedure q { print a; }", some_program(rng)):
        quick += simple._quick(text) is not None
    assert quick == 2


def test_searches_share_states(monkeypatch):
    rng = np.random.default_rng(4)
    for _ in range(60):
        p = program(some_program(rng))
        for name in ("affects_bip", "affects_bip_t"):
            monkeypatch.setattr(flow, "FEW", 10**6)
            monkeypatch.setattr(flow, "ROUNDS", int(rng.integers(1, 13)))
            together = pairs(flow.KERNELS[name](p))
            monkeypatch.setattr(flow, "FEW", 0)
            assert together == pairs(flow.KERNELS[name](p))


QUERIES = [q for q, _ in ORDER_CASES.values()] + [
    "assign a; Select a such that Affects(a, _)",
    "call c; procedure p; Select <c.procName, p, c> such that Calls(p, _)",
    "read r; print p; Select <r.varName, p.varName>",
    "stmt s; variable v; Select <v, s> such that Uses(s, v)",
    "while w; stmt s; Select <w, s, w> such that Next*(w, s) and Next(s, _)",
    "stmt s; Select s such that Next*(s, s)",
    "stmt a, b, c; Select <a, c> such that Follows(a, b) and Next(b, c)",
    'procedure p; variable v; Select <p, v> such that Modifies(p, v) with p.procName = "p1"',
    "prog_line n; assign a; constant k; Select <n, k> such that AffectsBip*(a, n) with k.value = a.stmt#",
    "if i; assign a; variable v; Select <i, v, a> pattern i(v, _, _) and a(v, _)",
    "stmt s; Select BOOLEAN such that Next(1, 2) with 3 = 3",
    "stmt s; Select BOOLEAN such that Follows(_, t)",
    "Select BOOLEAN with 3 = 4",
    "stmt s; Select s such that Parent*(s, 3)",
    "while w; Select w such that Next*(w, 99999999999999999999)",
    "stmt s; Select s such that Uses(_, s)",
]


@pytest.fixture(scope="module")
def corpora(spark):
    rng = np.random.default_rng(8)
    rows = [(f"p{k}", some_program(rng)) for k in range(24)] + [("bad", "procedure p { a = ; }"), ("null", None), (None, "procedure p { a = a; }")]
    src = spark.createDataFrame(rows, "program_id string, text string")
    e = Engine.corpus(spark, src)
    plan = Engine.corpus(spark, src, keep=True)
    yield e, plan
    e.release()
    plan.release()


@pytest.mark.parametrize("pql", QUERIES)
def test_answers_are_the_plans(corpora, pql):
    got, want = corpora[0].query(pql), corpora[1].query_plan(parse_query(pql))
    assert got.dtypes == want.dtypes
    assert Counter(got.collect()) == Counter(want.collect())


def test_one_pass_without_joins(corpora):
    """Neither facts nor pairs are stored or moved: only texts are, once, to deal them."""
    e = corpora[0]
    for pql, _ in ORDER_CASES.values():
        plan = e.query(pql)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Join" not in plan and "InMemoryTable" not in plan, pql


def test_large_programs_among_small(spark, monkeypatch):
    rng = np.random.default_rng(9)
    texts = sorted((some_program(rng) for _ in range(12)), key=len)
    monkeypatch.setattr(engine, "LARGE", len(texts[6]))
    src = spark.createDataFrame([(f"p{k}", t) for k, t in enumerate(texts)], "program_id string, text string")
    e, plan = Engine.corpus(spark, src), Engine.corpus(spark, src, keep=True)
    for pql in ("prog_line a, b; Select <a, b> such that NextBip*(a, b)", "stmt s; Select BOOLEAN such that Next*(s, s)"):
        assert Counter(e.query(pql).collect()) == Counter(plan.query_plan(parse_query(pql)).collect())
    files = e._texts[0].inputFiles()
    e.release()
    plan.release()
    assert files and not any(spark._jvm.java.io.File(f.removeprefix("file:")).exists() for f in files)


def test_unshared_synonyms_go_before_pairs_meet(spark):
    """events_next_t: no table of pairs is made distinct for a synonym that only one clause names."""
    from codeloom.queries import EVENT_CASES
    from codeloom.sources.tables import event_programs

    e = Engine(spark, event_programs(spark.read.parquet("/root/testdata/sf0.001/events.parquet")))
    plan = e.query(EVENT_CASES["events_next_t"][0])._jdf.queryExecution().optimizedPlan().toString()
    made = [x for x in plan.splitlines() if "Aggregate [" in x]
    assert made and not any("s_a#" in x and "s_x#" in x for x in made)


@pytest.mark.parametrize("even", [True, False])
def test_texts_move_only_where_they_lie_unevenly(spark, even):
    """(F9 orders_next_bip)"""
    texts = [(f"p{k}", "procedure p { " + "a = b; " * 100 + "}") for k in range(2_000)]
    e = Engine.corpus(spark, spark.createDataFrame(texts, "program_id string, text string").repartition(spark.sparkContext.defaultParallelism if even else 1))
    out = e.query("stmt a, b; Select <a, b> such that Follows(a, b)")
    assert ("Exchange" in out._jdf.queryExecution().executedPlan().toString()) != even
    assert out.count() == 2_000 * 99 and out.distinct().count() == 2_000 * 99
    e.release()


def test_a_last_round_of_tasks_counts():
    """A task more than cores, all of a size, takes twice as long as they should (F14 to F16, F18: texts of 60 times sf0.1 on 12 cores)."""
    assert engine.longest([10] * 12, 12) == 10 and engine.longest([10] * 13, 12) == 20
    assert engine.longest([16] * 12 + [8], 12) == 24 > engine.EVEN * (16 * 12 + 8) / 12
    assert engine.longest([], 4) == 0 and engine.longest([9, 1, 1, 1], 2) == 9
