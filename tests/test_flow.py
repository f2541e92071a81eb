"""Relations of control flow against plain searches on the graph with every call chain written out."""

from __future__ import annotations

import numpy as np
import pytest

import codeloom.operators.flow as flow
from codeloom.engine import Engine
from codeloom.sources.printing import program_text
from codeloom.sources.simple import parse_program
from tests.test_front_end import pairs, program


def closed(edges: set[tuple]) -> set[tuple]:
    g, out = flow.adjacent(edges), set()
    for n in list(g):
        out |= {(n, m) for m in flow.walk(g, g[n])}
    return out


def written_out(f) -> set[tuple]:
    """Edges between (chain of calls, statement)."""
    after, lists, last, entry = flow.adjacent(f.nexts), {}, {}, {}
    for s in f.stmts:
        lists[s[3]] = s  # the last of each list
        entry.setdefault(s[2], s[0])
    inner = {}
    for s in lists.values():
        inner.setdefault(s[5] or s[2], []).append(s)

    def tails(s):
        return [n for t in inner[s[0]] for n in tails(t)] if s[1] == "if" else [s[0]]

    for p, _ in f.procs:
        last[p] = tails(inner[p][0])
    out = set()

    def instance(chain: tuple, proc: str) -> list:
        ends = {}
        for s in f.stmts:
            if s[2] == proc:
                n = s[0]
                ends[n] = [(chain, n)]
                if s[8]:
                    out.add(((chain, n), ((*chain, n), entry[s[8]])))
                    ends[n] = instance((*chain, n), s[8])
                out.update((e, (chain, m)) for e in ends[n] for m in after.get(n, ()))
        return [e for n in last[proc] for e in ends[n]]

    called = {s[8] for s in f.stmts}
    for p, _ in f.procs:
        if p not in called:
            instance((p,), p)
    return out


def carried(edges, f, kills, of) -> set[tuple]:
    """(definition, use) over the edges; of: a node's statement."""
    g = flow.adjacent(edges)
    nodes = {n for e in edges for n in e}
    sets, reads = dict(f.modifies), {}
    for n, v, _ in f.uses:
        reads.setdefault(n, set()).add(v)
    assigns, out = {a[0] for a in f.assigns}, set()
    for d in nodes:
        if of(d) in assigns:
            seen, todo = set(), list(g.get(d, ()))
            while todo:
                n = todo.pop()
                if n not in seen:
                    seen.add(n)
                    if of(n) in assigns and sets[of(d)] in reads.get(of(n), ()):
                        out.add((d, n))
                    if sets[of(d)] not in kills(of(n)):
                        todo += g.get(n, ())
    return out


def plain(f) -> dict[str, set[tuple]]:
    calls = closed({(s[2], s[8]) for s in f.stmts if s[8]})
    writes = {}
    for s in f.stmts:
        writes.setdefault(s[2], set()).update(v for n, v in f.modifies if n == s[0])
    by_call = {p: writes[p].union(*(writes[q] for x, q in calls if x == p)) for p in writes}
    own = {s[0]: by_call[s[8]] if s[8] else {v for n, v in f.modifies if n == s[0]} for s in f.stmts}
    direct = {s[0]: set() if s[8] else own[s[0]] for s in f.stmts}
    edges = written_out(f)
    affects = carried(set(f.nexts), f, own.get, lambda n: n)
    bip = carried(edges, f, direct.get, lambda n: n[1])
    cut = lambda rows: {(a[1], b[1]) for a, b in rows}
    return {"next_t": closed(set(f.nexts)), "affects": affects, "affects_t": closed(affects), "next_bip": cut(edges), "next_bip_t": cut(closed(edges)), "affects_bip": cut(bip), "affects_bip_t": cut(closed(bip)), "calls_t": calls}


def some_program(rng) -> str:
    """Procedures p0, p1, .. that call later ones, also last in branches and loops."""
    n = int(rng.integers(1, 5))
    name = lambda: "abcd"[rng.integers(0, 4)]

    def body(k: int, depth: int) -> str:
        out = []
        for _ in range(int(rng.integers(1, 4))):
            kind = rng.integers(0, 8)
            if kind < 3:
                out.append(f"{name()} = {name()} + {name()};")
            elif kind < 5 and k + 1 < n:
                out.append(f"call p{rng.integers(k + 1, n)};")
            elif kind == 5:
                out.append(f"{'read' if rng.integers(0, 2) else 'print'} {name()};")
            elif depth < 2:
                out.append(f"while ({name()} > 0) {{ {body(k, depth + 1)} }}" if kind == 6 else f"if ({name()} > 0) then {{ {body(k, depth + 1)} }} else {{ {body(k, depth + 1)} }}")
            else:
                out.append(f"{name()} = {name()};")
        return " ".join(out)

    return " ".join(f"procedure p{k} {{ {body(k, 0)} }}" for k in range(n))


@pytest.mark.parametrize("block", [3, flow.BLOCK])
def test_against_written_out_chains(monkeypatch, block):
    monkeypatch.setattr(flow, "BLOCK", block * 8 if block < 8 else block)
    rng = np.random.default_rng(block)
    for _ in range(250):
        text = some_program(rng)
        f, p = parse_program(text), program(text)
        want = plain(f)
        for name, rows in want.items():
            assert pairs(flow.KERNELS[name](p)) == rows, (name, text)
        for name in flow.WIDE:
            parts = [pairs(flow.KERNELS[name](p, part=k)) for k in range(3 * len(f.stmts) // flow.BLOCK + 1)]
            assert set().union(*parts) == want[name] and sum(map(len, parts)) == len(want[name])
        for n in (1, len(f.stmts)):
            for name in flow.OF_STATEMENTS:
                assert {y for x, y in pairs(flow.KERNELS[name](p, left=n)) if x == n} == {y for x, y in want[name] if x == n}, (name, n, text)
                assert {x for x, y in pairs(flow.KERNELS[name](p, right=n)) if y == n} == {x for x, y in want[name] if y == n}, (name, n, text)


def test_deep_programs():
    deep = 20_000
    f = parse_program("procedure p { " + "while (x > 0) { " * deep + "a = " + "(1 + " * deep + "1" + ")" * deep + ";" + " }" * deep + " if (" + "!(" * deep + "x == 1" + ")" * deep + ") then { a = 1; } else { a = 2; } }")
    assert len(f.stmts) == deep + 4 and f.stmts[0][6] == deep + 1
    assert parse_program(program_text(f)) == f


def test_long_chains_of_calls():
    p = program("".join(f"procedure p{k} {{ call p{k + 1}; }}" for k in range(1200)) + "procedure p1200 { a = a; }")
    assert pairs(p.next_bip()) == {(k, k + 1) for k in range(1, 1201)}
    assert len(pairs(p.next_bip_t())) == 1200 * 1201 // 2 and not pairs(p.affects_bip())


def test_many_call_chains():
    """Each procedure calls the next twice: 2^22 chains."""
    text = "".join(f"procedure p{k} {{ call p{k + 1}; call p{k + 1}; }}" for k in range(22)) + "procedure p22 { a = a + b; b = a; }"
    p = program(text)
    assert pairs(p.affects_bip_t()) == {(45, 45), (45, 46), (46, 45), (46, 46)}
    small = "".join(f"procedure p{k} {{ call p{k + 1}; call p{k + 1}; }}" for k in range(4)) + "procedure p4 { a = a + b; b = a; }"
    want = plain(parse_program(small))
    assert all(pairs(flow.KERNELS[k](program(small))) == want[k] for k in want)


def test_odd_programs_leave_others_alone(spark):
    deep = "procedure p { " + "while (x > 0) { " * 3000 + "a = a;" + " }" * 3000 + " }"
    fan = "".join(f"procedure p{k} {{ call p{k + 1}; call p{k + 1}; }}" for k in range(22)) + "procedure p22 { a = a; }"
    texts = [("deep", deep), ("fan", fan), ("bad", "procedure p { a = ; }"), ("null", None), ("plain", "procedure p { a = a; while (a > 0) { a = a; } }")]
    e = Engine.corpus(spark, spark.createDataFrame(texts, "program_id string, text string"))
    got = {(r[0], r[1], r[2]) for r in e.query("assign a, b; Select <a, b> such that AffectsBip*(a, b)").collect()}
    assert got == {("deep", 3001, 3001), ("fan", 45, 45), ("plain", 1, 3), ("plain", 3, 3)}
    assert [r["program_id"] for r in e.errors.collect()] == ["bad"]
    counts = e.query("while w; assign a; Select w such that Parent*(w, a)").groupBy("program_id").count()
    assert sorted(map(tuple, counts.collect())) == [("deep", 3000), ("plain", 1)]
    assert e.timings
    e.release()


def test_constants_start_the_search(spark):
    text = "procedure p { a = 1; while (a > 0) { b = a; a = b; } c = b; }"
    for e in (Engine.load(spark, text), Engine.corpus(spark, spark.createDataFrame([("program", text)], "program_id string, text string"), keep=True)):
        assert e.evaluate("stmt s; Select s such that Next*(3, s)") == ["2", "3", "4", "5"]
        assert e.evaluate("stmt s; Select s such that Next*(s, 3)") == ["1", "2", "3", "4"]
        assert e.evaluate("assign s; Select s such that Affects*(1, s)") == ["3", "4", "5"]
        assert e.evaluate("Select BOOLEAN such that Next*(99999999999999999999, _)") == ["FALSE"]
        held = set(e.relations._held)
        e.release()
    assert {("next_t", 3, None), ("next_t", None, 3), ("affects_t", 1, None)} <= held and not e.relations._held


def test_large_programs_take_the_way_of_a_corpus(spark):
    text = "procedure p { " + "a = a + 1; " * 1500 + "while (a > 0) { print a; } }"
    e = Engine.load(spark, text)
    assert not e.relations.small
    assert e.evaluate("stmt s; Select s such that Next*(1499, s)") == ["1500", "1501", "1502"]
    assert len(e.evaluate("assign a; assign b; Select a such that Affects(a, b)")) == 1499
    assert e.evaluate("stmt s; Select s such that Parent*(s, 1502)") == ["1501"]
    e.release()


def test_programs_are_read_from_files(spark, tmp_path):
    (tmp_path / "one.txt").write_text("procedure p {\n  read x;\n  print x;\n}\n")
    (tmp_path / "two.txt").write_text("procedure q { call r; } procedure r { y = 1; }")
    e = Engine.read(spark, f"{tmp_path}/*.txt")
    got = {(r["program_id"].rsplit("/", 1)[1], r["c1"]) for r in e.query("procedure p; Select p").collect()}
    assert got == {("one.txt", "p"), ("two.txt", "q"), ("two.txt", "r")}
    e.release()
