"""The driver's queries of the engine, with their expected rows as SQL."""

from __future__ import annotations

from codeloom.engine import Engine
from codeloom.operators.fixpoint import closure
from codeloom.plans.pql import listing, parse_query
from codeloom.sources.printing import printed
from codeloom.sources.tables import containment, event_programs, order_programs, trade

MAIN = """
procedure main {
  read x; y = x * 2 + 1;
  while (x > 0) { if (y == 1) then { call sub; } else { print y; } x = x - 1; }
  print x; }
procedure sub { y = y + x * 2; z = 10; }
"""
LOOPS = """
procedure run {
  total = 0; read n;
  while (n > 0) { step = n / 2; total = total + step; if (step > 3) then { n = n - step; } else { read n; } }
  last = total * n; total = last + step; last = total; }
"""
CALLS = """
procedure top { u = 3; call mid; w = u + v; while (w > u) { call low; v = v - u; } u = w; }
procedure mid { v = u * 2; if (v > 5) then { call low; } else { w = v; } }
procedure low { u = u + w; w = v; }
"""
ROLL = "procedure roll { call turn; call turn; } procedure turn { x = y; y = z; z = t; }"
NESTED = """
procedure alpha { if (k > 0) then { call beta; } else { while (k < 9) { call gamma; } } call delta; }
procedure beta { call gamma; } procedure gamma { call delta; } procedure delta { k = k + 1; }
"""
KILLED = "procedure p { a = c; call q; b = a + c; } procedure q { a = 7; }"
NAMES = "procedure x { x = 1; call y; } procedure y { print x; }"

_AFFECTS = "1-5 1-9 4-5 4-7 4-10 5-5 5-9 7-4 7-7 7-9 9-10 10-11"
_NEXT = "1-2 2-3 3-4 3-8 4-5 4-6 5-7 6-7 7-3 9-10"

#: name: program, query, rows (cells joined by '-'; "+" before them: their transitive closure)
CASES: dict[str, tuple[str, str, str]] = {
    "scan_stmt": (MAIN, "stmt s; Select s", "1 2 3 4 5 6 7 8 9 10"),
    "scan_prog_line": (MAIN, "prog_line n; Select n", "1 2 3 4 5 6 7 8 9 10"),
    "scan_if": (MAIN, "if i; Select i", "4"),
    "scan_while": (MAIN, "while w; Select w", "3"),
    "scan_call": (MAIN, "call c; Select c", "5"),
    "scan_assign": (MAIN, "assign a; Select a", "2 7 9 10"),
    "scan_read": (MAIN, "read r; Select r", "1"),
    "scan_print": (MAIN, "print p; Select p", "6 8"),
    "scan_variable": (MAIN, "variable v; Select v", "x y z"),
    "scan_procedure": (MAIN, "procedure p; Select p", "main sub"),
    "scan_constant": (MAIN, "constant c; Select c", "0 1 2 10"),
    "attr_proc_name": (MAIN, "call c; procedure p; Select <c.procName, p.procName>", "sub-main sub-sub"),
    "attr_var_name": (MAIN, "print p; read r; variable v; Select <p.varName, r.varName, v.varName>", "x-x-x x-x-y x-x-z y-x-x y-x-y y-x-z"),
    "attr_value": (MAIN, "constant c; Select c.value", "0 1 2 10"),
    "attr_stmt_no": (MAIN, "print p; Select p.stmt#", "6 8"),
    "tuple_cross": (MAIN, "while w; procedure p; Select <w, p, w>", "3-main-3 3-sub-3"),
    "boolean_true": (MAIN, "stmt s; Select BOOLEAN such that Follows(s, 8)", "TRUE"),
    "boolean_false": (MAIN, "Select BOOLEAN such that Next*(8, 1)", "FALSE"),
    "boolean_plain": (MAIN, "Select BOOLEAN", "TRUE"),
    "error_semantic": (MAIN, "stmt s; Select BOOLEAN such that Follows(_, t)", "FALSE"),
    "error_syntax": (MAIN, "stmt s; Select BOOLEAN such that Follows(s", ""),
    "error_tuple": (MAIN, "stmt s; Select s such that Uses(_, s)", ""),
    "error_attribute": (MAIN, 'stmt s; Select BOOLEAN with s.procName = "main"', "FALSE"),
    "error_attribute_of_result": (MAIN, "stmt s; Select s.value", ""),
    "error_program": ("procedure p { call p; }", "stmt s; Select BOOLEAN", ""),
    "follows_pairs": (MAIN, "stmt a, b; Select <a, b> such that Follows(a, b)", "1-2 2-3 3-8 4-7 9-10"),
    "follows_t_pairs": (MAIN, "stmt a, b; Select <a, b> such that Follows*(a, b)", "1-2 1-3 1-8 2-3 2-8 3-8 4-7 9-10"),
    "parent_pairs": (MAIN, "stmt a, b; Select <a, b> such that Parent(a, b)", "3-4 3-7 4-5 4-6"),
    "parent_t_pairs": (MAIN, "stmt a, b; Select <a, b> such that Parent*(a, b)", "3-4 3-5 3-6 3-7 4-5 4-6"),
    "uses_stmt": (MAIN, "stmt s; variable v; Select <s, v> such that Uses(s, v)", "2-x 3-x 3-y 4-x 4-y 5-x 5-y 6-y 7-x 8-x 9-x 9-y"),
    "uses_proc": (MAIN, "procedure p; variable v; Select <p, v> such that Uses(p, v)", "main-x main-y sub-x sub-y"),
    "modifies_stmt": (MAIN, "stmt s; variable v; Select <s, v> such that Modifies(s, v)", "1-x 2-y 3-x 3-y 3-z 4-y 4-z 5-y 5-z 7-x 9-y 10-z"),
    "modifies_proc": (MAIN, "procedure p; variable v; Select <p, v> such that Modifies(p, v)", "main-x main-y main-z sub-y sub-z"),
    "uses_forms": (MAIN, 'assign a; call c; procedure p; Select <a, c> such that Uses(a, "y") and Uses(c, _) and Uses("sub", "x") and Modifies(p, "x") and Uses(8, "x")', "9-5"),
    "calls_pairs": (NESTED, "procedure p, q; Select <p, q> such that Calls(p, q)", "alpha-beta alpha-gamma alpha-delta beta-gamma gamma-delta"),
    "calls_t_pairs": (NESTED, "procedure p, q; Select <p, q> such that Calls*(p, q)", "alpha-beta alpha-delta alpha-gamma beta-delta beta-gamma gamma-delta"),
    "next_pairs": (MAIN, "prog_line a, b; Select <a, b> such that Next(a, b)", _NEXT),
    "next_t_pairs": (MAIN, "prog_line a, b; Select <a, b> such that Next*(a, b)", "+" + _NEXT),
    "affects_pairs": (LOOPS, "assign a, b; Select <a, b> such that Affects(a, b)", _AFFECTS),
    "affects_t_pairs": (LOOPS, "assign a, b; Select <a, b> such that Affects*(a, b)", "+" + _AFFECTS),
    "next_bip_pairs": (CALLS, "prog_line a, b; Select <a, b> such that NextBip(a, b)", "1-2 2-8 3-4 4-5 4-7 5-12 6-4 8-9 9-10 9-11 10-12 11-3 12-13 13-3 13-6"),
    "next_bip_t_pairs": (CALLS, "prog_line a, b; Select <a, b> such that NextBip*(a, b)", "1-2 1-3 1-4 1-5 1-6 1-7 1-8 1-9 1-10 1-11 1-12 1-13 2-3 2-4 2-5 2-6 2-7 2-8 2-9 2-10 2-11 2-12 2-13 3-4 3-5 3-6 3-7 3-12 3-13 4-4 4-5 4-6 4-7 4-12 4-13 5-4 5-5 5-6 5-7 5-12 5-13 6-4 6-5 6-6 6-7 6-12 6-13 8-3 8-4 8-5 8-6 8-7 8-9 8-10 8-11 8-12 8-13 9-3 9-4 9-5 9-6 9-7 9-10 9-11 9-12 9-13 10-3 10-4 10-5 10-6 10-7 10-12 10-13 11-3 11-4 11-5 11-6 11-7 11-12 11-13 12-3 12-4 12-5 12-6 12-7 12-12 12-13 13-3 13-4 13-5 13-6 13-7 13-12 13-13"),
    "affects_bip_pairs": (CALLS, "assign a, b; Select <a, b> such that AffectsBip(a, b)", "1-3 1-8 1-12 3-7 3-12 6-6 6-13 8-3 8-6 8-11 8-13 12-3 12-6 12-12 13-7 13-12"),
    "affects_bip_t_pairs": (CALLS, "assign a, b; Select <a, b> such that AffectsBip*(a, b)", "1-3 1-6 1-7 1-8 1-11 1-12 1-13 3-6 3-7 3-12 3-13 6-6 6-7 6-12 6-13 8-3 8-6 8-7 8-11 8-12 8-13 12-3 12-6 12-7 12-12 12-13 13-6 13-7 13-12 13-13"),
    "affects_bip_t_by_calls": (ROLL, "assign a, b; Select <a, b> such that AffectsBip*(a, b)", "4-3 5-4"),
    "next_bip_t_nested": (NESTED, "prog_line a; Select a such that NextBip*(6, a)", "5 7 8"),
    "same_synonym": (MAIN, "stmt s; Select s such that Next*(s, s)", "3 4 5 6 7"),
    "semi_wildcard": (MAIN, "stmt s; Select s such that Parent(s, _) and Next(_, s)", "3 4"),
    "exists_only_component": (MAIN, 'stmt s; while w; Select s such that Modifies(s, "z") and Parent(w, _) and Follows(_, _)', "3 4 5 10"),
    "join_chain": (MAIN, "stmt a, b, c, d; Select <a, d> such that Follows(a, b) and Next(b, c) and Parent(c, d)", "1-4 1-7 2-5 2-6 4-4 4-7"),
    "pattern_assign_exact": (MAIN, 'assign a; Select a pattern a(_, "(x * 2) + 1")', "2"),
    "pattern_assign_partial": (MAIN, 'assign a; Select a pattern a(_, _"x * 2"_)', "2 9"),
    "pattern_assign_wild": (MAIN, 'assign a; Select a pattern a("y", _)', "2 9"),
    "pattern_assign_lhs": (MAIN, "assign a; variable v; Select <a, v> pattern a(v, _)", "2-y 7-x 9-y 10-z"),
    "pattern_if": (MAIN, "if i; variable v; Select <i, v> pattern i(v, _, _)", "4-y"),
    "pattern_while": (MAIN, "while w; variable v; Select <w, v> pattern w(v, _)", "3-x"),
    "pattern_condition_wild": (MAIN, "if i; while w; Select <i, w> pattern i(_, _, _) and w(_, _)", "4-3"),
    "with_const_const": (MAIN, "Select BOOLEAN with 12 = 12", "TRUE"),
    "with_attr_const": (MAIN, 'call c; Select c with c.procName = "sub"', "5"),
    "with_stmt_stmt": (MAIN, "assign a; stmt s; Select s such that Follows(a, _) with s.stmt# = a.stmt#", "2 9"),
    "with_stmt_value": (MAIN, "stmt s; constant c; Select <s, c> with s.stmt# = c.value", "1-1 2-2 10-10"),
    "with_prog_line": (MAIN, "prog_line n; Select n with n = 3", "3"),
    "with_proc_call": (MAIN, "procedure p; call c; Select <p, c> with p.procName = c.procName", "sub-5"),
    "with_read_print": (MAIN, "read r; print p; variable v; Select <r, p> with r.varName = p.varName and v.varName = r.varName", "1-8"),
    "with_print_print": (MAIN, "print p, q; Select <p, q> with p.varName = q.varName", "6-6 8-8"),
    "with_print_procedure": (NAMES, "print q; procedure p; Select <q, p> with q.varName = p.procName", "3-x"),
    "with_value_value": (MAIN, "constant a, b; Select BOOLEAN with a.value = b.value and a.value = 10", "TRUE"),
    "with_long_constant": ("procedure p { a = 99999999999999999999; }", "stmt s; constant c; Select BOOLEAN with s.stmt# = c.value", "FALSE"),
    "form_const_syn": (MAIN, "stmt s; Select s such that Next(3, s)", "4 8"),
    "form_syn_const": (MAIN, "stmt s; Select s such that Next*(s, 8)", "1 2 3 4 5 6 7"),
    "form_const_any": (MAIN, "Select BOOLEAN such that Parent(3, _) and Parent(_, 7)", "TRUE"),
    "form_const_const": (MAIN, "Select BOOLEAN such that Next(7, 3) and Follows*(1, 8)", "TRUE"),
    "form_any_any": (MAIN, "Select BOOLEAN such that Affects(_, _) and Calls*(_, _)", "TRUE"),
    "form_no_such_statement": (MAIN, "stmt s; Select BOOLEAN such that Follows(99, s)", "FALSE"),
    "form_no_such_name": (MAIN, 'Select BOOLEAN such that Uses("nobody", "x")', "FALSE"),
    "uses_const_syn": (MAIN, 'variable v; Select v such that Uses("sub", v)', "x y"),
    "uses_by_kind": (MAIN, 'while w; call c; print q; Select <w, c, q> such that Uses(w, "x") and Uses(c, "x") and Uses(q, "y")', "3-5-6"),
    "modifies_const_syn": (MAIN, "variable v; Select v such that Modifies(3, v)", "x y z"),
    "modifies_any": (MAIN, 'call c; procedure p; Select <c, p> such that Modifies(c, _) and Modifies(p, _) and Modifies("sub", _) and Modifies(4, _)', "5-main 5-sub"),
    "calls_forms": (NESTED, 'procedure p; Select p such that Calls(p, "delta") and Calls*(_, p)', "gamma"),
    "calls_t_const": (NESTED, 'procedure q; Select q such that Calls*("beta", q)', "gamma delta"),
    "affects_forms": (LOOPS, "assign a; Select a such that Affects(a, 10) and Affects(1, _)", "4 9"),
    "affects_killed_by_call": (KILLED, "Select BOOLEAN such that Affects(1, 3)", "FALSE"),
    "affects_bip_from_callee": (KILLED, "assign a, b; Select <a, b> such that AffectsBip(a, b)", "4-3"),
    "pattern_partial_constant": (MAIN, 'assign a; Select a pattern a("y", _"2"_)', "2 9"),
    "pattern_exact_constant": (MAIN, 'assign a; Select a pattern a("z", "10")', "10"),
    "pattern_condition_names": (MAIN, 'if i; while w; Select <i, w> pattern i("y", _, _) and w("x", _)', "4-3"),
    "pattern_condition_constant": ("procedure p { while (1 > 0) { a = 1; } while (b > 0) { a = 1; } }", "while w; Select w pattern w(_, _)", "3"),
    "attr_numbers": (MAIN, "read r; call c; while w; if i; Select <r.stmt#, c.stmt#, w.stmt#, i.stmt#>", "1-5-3-4"),
    "clauses_in_any_order": (MAIN, 'assign a; while w; Select a with a.stmt# = 7 such that Parent(w, a) pattern a(_, _"x"_) such that Uses(a, "x")', "7"),
    "keywords_as_names": ("procedure while { if = 2; read = if; read read; }", "assign a; Select a", "1 2"),
    "with_name_join": (NAMES, "procedure p; variable v; Select <p, v> with p.procName = v.varName", "x-x"),
}


#: 77 statements: 30 in a list, a loop of 20, a branch of 10 and 10, 5 more.
BLOCKS = "procedure blocks { " + " ".join(f"a{k} = a{k + 1};" for k in range(30)) + " while (x > 0) { " + " ".join(f"b{k} = a{k};" for k in range(20)) + " } if (x == 1) then { " + "read c; " * 10 + "} else { " + "print c; " * 10 + "} " + "c = c + 1; " * 5 + "}"
_COMPONENTS = "stmt s1, s2, s3, s4, s5, s6, s7, s8, s9, s10, s11, s12, s13, s14, s15, s16, s17, s18, s19, s20; Select <s1, s4, s7, s10, s13> such that Follows*(s1, s2) and Follows*(s2, s3) and Follows*(s3, 5) such that Follows*(s4, s5) and Follows*(s5, s6) and Follows*(s6, 36) such that Follows*(s7, s8) and Follows*(s8, s9) and Follows*(s9, 57) such that Follows*(s10, s11) and Follows*(s11, s12) and Follows*(s12, 68) such that Follows(s13, s14)"
_COMPONENTS_SQL = """
with f(s, list) as (
  select range, 0 from range(1, 32) union all select unnest([52, 73, 74, 75, 76, 77]), 0
  union all select range, 1 from range(32, 52) union all select range, 2 from range(53, 63) union all select range, 3 from range(63, 73)
), placed as (select s, list, row_number() over (partition by list order by s) as pos, lead(s) over (partition by list order by s) as then_s from f
), third as (select a.s, e.s as e from placed a join placed e on e.list = a.list and a.pos + 3 <= e.pos)
select a.s::int as c1, b.s::int as c2, c.s::int as c3, d.s::int as c4, x.s::int as c5 from third a, third b, third c, third d, placed x where a.e = 5 and b.e = 36 and c.e = 57 and d.e = 68 and x.then_s is not null"""


def many_components(spark, sf_dir):
    """20 synonyms and 13 clauses in 5 parts that share no synonym."""
    return Engine.load(spark, BLOCKS).query(_COMPONENTS).drop("program_id")


def _case(name: str):
    program, pql, _ = CASES[name]

    def run(spark, sf_dir):
        e = Engine.load(spark, program)
        if "BOOLEAN" in pql:
            return e.strings(pql).select("answer")
        rows = e.query(pql)
        return rows.select(*(c for c in rows.columns if c != "program_id"))

    run.__name__ = name
    return run


def _case_sql(name: str) -> str:
    _, pql, rows = CASES[name]
    result = pql.split("Select", 1)[1].split(" such that")[0].split(" pattern")[0].split(" with")[0]
    width = result.count(",") + 1
    names = "answer" if "BOOLEAN" in pql else ", ".join(f"c{k + 1}" for k in range(width))
    cells = [r.split("-") for r in rows.lstrip("+").split()]
    if not cells:
        return f"select * from (values ({', '.join(['null::varchar'] * width)})) t({names}) where false"
    text = name in ("scan_constant", "attr_value", "with_stmt_value")
    value = lambda k, c: f"'{c}'" if not c.isdigit() or (text and (width == 1 or k == 1)) else f"{c}::int"
    values = ", ".join(f"({', '.join(value(k, c) for k, c in enumerate(r))})" for r in cells)
    if rows.startswith("+"):
        return f"with recursive e(l, r) as (values {values}), t as (select l, r from e union select t.l, e.r from t join e on t.r = e.l) select l as c1, r as c2 from t"
    return f"select * from (values {values}) t({names})"


_EVENTS = """
with e as (
  select user_id::varchar as program_id, event_id::int as s, event_type as t, ts, (props->>'$.k')::int as k from events
), p as (
  select *, case when t in ('purchase', 'click') then 'assign' when t = 'signup' then 'read' else 'print' end as kind,
         'v' || (k % 7) as target, case when t = 'error' then 'failed' else 'v' || ((k // 7) % 7) end as source,
         row_number() over w as pos, lead(s) over w as then_s
  from e window w as (partition by program_id order by ts, s)
)
"""
EVENT_CASES: dict[str, tuple[str, str]] = {
    "events_follows": ("stmt a, b; Select <a, b> such that Follows(a, b)", "select program_id, s as c1, then_s as c2 from p where then_s is not null"),
    "events_follows_t": ("stmt a, b; Select <a, b> such that Follows*(a, b)", "select a.program_id, a.s as c1, b.s as c2 from p a join p b on a.program_id = b.program_id and a.pos < b.pos"),
    "events_next_t": ("prog_line a, b; assign x; Select <a, x> such that Next*(a, x) and Next(x, b)", "select a.program_id, a.s as c1, b.s as c2 from p a join p b on a.program_id = b.program_id and a.pos < b.pos where b.kind = 'assign' and b.then_s is not null"),
    "events_uses": ("stmt s; variable v; Select <s, v> such that Uses(s, v)", "select program_id, s as c1, source as c2 from p where kind != 'read'"),
    "events_modifies": ("stmt s; variable v; Select <s, v> such that Modifies(s, v)", "select program_id, s as c1, target as c2 from p where kind != 'print'"),
    "events_pattern": ('assign a; print q; Select <a, q> pattern a("v3", _"v2"_) such that Follows(a, q)', "select a.program_id, a.s as c1, b.s as c2 from p a join p b on a.program_id = b.program_id and b.s = a.then_s where a.kind = 'assign' and a.target = 'v3' and a.source = 'v2' and b.kind = 'print'"),
    "events_with": ("read r; print q; Select <r, q> such that Follows(r, q) with r.varName = q.varName", "select a.program_id, a.s as c1, b.s as c2 from p a join p b on a.program_id = b.program_id and b.s = a.then_s where a.kind = 'read' and b.kind = 'print' and a.target = b.source"),
    "events_affects": ("assign a, b; Select <a, b> such that Affects(a, b)", """, d as (
  select u.program_id, u.s as use_s, max_by(m.s, m.pos) as def_s, max_by(m.kind, m.pos) as def_kind
  from p u join p m on u.program_id = m.program_id and m.pos < u.pos and m.kind != 'print' and m.target = u.source
  where u.kind = 'assign' group by u.program_id, u.s
) select program_id, def_s as c1, use_s as c2 from d where def_kind = 'assign'"""),
    "events_boolean": ("stmt a, b; Select BOOLEAN such that Affects(a, b) and Follows(a, b)", """, d as (
  select u.program_id, u.s as use_s, max_by(m.s, m.pos) as def_s, max_by(m.kind, m.pos) as def_kind
  from p u join p m on u.program_id = m.program_id and m.pos < u.pos and m.kind != 'print' and m.target = u.source
  where u.kind = 'assign' group by u.program_id, u.s
) select q.program_id, max(coalesce(d.def_s = p.s and d.use_s = p.then_s and d.def_kind = 'assign', false)) as result
  from (select distinct program_id from p) q join p on p.program_id = q.program_id left join d on d.program_id = p.program_id and d.use_s = p.then_s group by q.program_id"""),
}


# Programs of orders (see order_programs), as facts by plain arithmetic: n orders, of m items each, in program p.
_ORDERS = """
with recursive li as (
  select l_orderkey as o, l_linenumber as k, 'v' || (l_suppkey % 4) as lhs, 'v' || (l_partkey % 4) as rhs,
         row_number() over (partition by l_orderkey order by l_linenumber, 'v' || (l_suppkey % 4), 'v' || (l_partkey % 4)) as j
  from lineitem
), sized as (
  select o_custkey || '-' || left(o_orderpriority, 1) as p, o_orderkey as o, m from orders join (select o, count(*) as m from li group by o) on o = o_orderkey
), ord as (
  select p, o, m, row_number() over w as i, count(*) over (partition by p) as n,
         (count(*) over (partition by p) + 4 + sum(m + 3) over w - (m + 3))::int as s
  from sized window w as (partition by p order by o)
), prog as (
  select p, any_value(n)::int as n, max(s + m + 3)::int as z from ord group by p
), item as (
  select ord.p, s, m, (s + j)::int as a, lhs, rhs, k from ord join li on li.o = ord.o
), stmt(p, a, kind, proc, parent, callee) as (
  select p, unnest([1, 2, n + 3, z, z + 1]), unnest(['read', 'while', 'print', 'assign', 'print']), unnest(['main', 'main', 'main', 'log', 'log']), null::int, null from prog
  union all select p, (2 + i)::int, 'call', 'main', 2, 'o' || i from ord
  union all select p, unnest([s, s + m + 1, s + m + 2])::int, unnest(['if', 'assign', 'call']), 'o' || i, unnest([null, s, null])::int, unnest([null, null, 'log']) from ord
  union all select item.p, a, 'assign', 'o' || i, item.s, null from item join ord on ord.p = item.p and ord.s = item.s
), nxt(p, a, b) as (
  select p, unnest([1, 2, 2, z]), unnest([2, 3, n + 3, z + 1]) from prog
  union all select p, (2 + i)::int, (case when i < n then 3 + i else 2 end)::int from ord
  union all select p, unnest([s, s, s + m, s + m + 1])::int, unnest([s + 1, s + m + 1, s + m + 2, s + m + 2])::int from ord
  union all select p, a, a + 1 from item where a < s + m
), uses(p, a, v) as (
  select p, unnest([2, n + 3, z, z, z + 1]), unnest(['budget', 'spent', 'spent', 'v0', 'spent']) from prog
  union all select p, unnest([s, s + m + 1])::int, unnest(['status', 'budget']) from ord
  union all select p, a, unnest([rhs, 'rate']) from item
), sets(p, a, v) as (
  select p, unnest([1, z]), unnest(['budget', 'spent']) from prog
  union all select p, (s + m + 1)::int, 'budget' from ord
  union all select p, a, lhs from item
), calls(p, l, r) as (select distinct p, proc, callee from stmt where callee is not null
), calls_t(p, l, r) as (select * from calls union select t.p, t.l, e.r from calls_t t join calls e on e.p = t.p and e.l = t.r
), below(p, a, s) as (
  select p, a, a from stmt union select b.p, t.parent, b.s from below b join stmt t on t.p = b.p and t.a = b.a where t.parent is not null
), entry as (select p, proc, min(a) as a from stmt group by p, proc
), node(p, c, a) as (
  select stmt.p, case when stmt.proc = 'main' then 0 else x.a end, stmt.a from stmt left join stmt x on x.p = stmt.p and x.callee = stmt.proc
), bip(p, c, a, d, b) as (
  select n.p, n.c, n.a, n.c, x.b from node n join stmt t on t.p = n.p and t.a = n.a and t.callee is null join nxt x on x.p = n.p and x.a = n.a
  union all select n.p, n.c, n.a, n.a, e.a from node n join stmt t on t.p = n.p and t.a = n.a join entry e on e.p = t.p and e.proc = t.callee
  union all select prog.p, y.a, z + 1, 0, x.b
  from prog join stmt y on y.p = prog.p and y.callee = 'log' join stmt m on m.p = prog.p and m.callee = y.proc join nxt x on x.p = m.p and x.a = m.a
), reads as (select u.p, u.a, u.v from uses u join stmt t on t.p = u.p and t.a = u.a where t.kind = 'assign'
), gives as (select s.p, s.a, s.v from sets s join stmt t on t.p = s.p and t.a = s.a where t.kind = 'assign'
), kills as (
  select * from sets union select t.p, t.a, s.v from stmt t join sets s on s.p = t.p join stmt q on q.p = s.p and q.a = s.a
  where t.callee = q.proc or exists (select 1 from calls c where c.p = t.p and c.l = t.callee and c.r = q.proc)
), flow(p, l, v, r) as (
  select g.p, g.a, g.v, x.b from gives g join nxt x on x.p = g.p and x.a = g.a
  union select f.p, f.l, f.v, x.b from flow f join nxt x on x.p = f.p and x.a = f.r where not exists (select 1 from kills k where k.p = f.p and k.a = f.r and k.v = f.v)
), affects(p, l, r) as (select distinct f.p, f.l, f.r from flow f join reads u on u.p = f.p and u.a = f.r and u.v = f.v
), bip_flow(p, c, l, v, d, r) as (
  select n.p, n.c, n.a, g.v, x.d, x.b from node n join gives g on g.p = n.p and g.a = n.a join bip x on x.p = n.p and x.c = n.c and x.a = n.a
  union select f.p, f.c, f.l, f.v, x.d, x.b from bip_flow f join bip x on x.p = f.p and x.c = f.d and x.a = f.r where not exists (select 1 from sets k where k.p = f.p and k.a = f.r and k.v = f.v)
), bip_affects(p, c, l, d, r) as (select distinct f.p, f.c, f.l, f.d, f.r from bip_flow f join reads u on u.p = f.p and u.a = f.r and u.v = f.v
)"""


def _closed(name: str) -> str:
    return f", t(p, l, r) as (select * from {name} union select t.p, t.l, e.r from t join {name} e on e.p = t.p and e.l = t.r) select p as program_id, l as c1, r as c2 from t"


#: name: query, and its rows in SQL after _ORDERS; cells of statements, names or both
ORDER_CASES: dict[str, tuple[str, str]] = {
    "orders_parent_t": ("stmt a, b; Select <a, b> such that Parent*(a, b)", " select p as program_id, a as c1, s as c2 from below where a != s"),
    "orders_parent": ("while w; if i; stmt a, b; call c; Select <a, b> such that Parent(a, b) and Parent(w, c) and Parent(i, _)", " select p as program_id, parent as c1, a as c2 from stmt where parent is not null"),
    "orders_calls": ("procedure p, q; Select <p, q> such that Calls(p, q)", " select p as program_id, l as c1, r as c2 from calls"),
    "orders_calls_t": ("procedure p, q; Select <p, q> such that Calls*(p, q)", " select p as program_id, l as c1, r as c2 from calls_t"),
    "orders_uses_p": ("procedure p; variable v; Select <p, v> such that Uses(p, v)", ", own as (select t.p, t.proc, u.v from uses u join stmt t on t.p = u.p and t.a = u.a) select p as program_id, proc as c1, v as c2 from own union select c.p, c.l, own.v from calls_t c join own on own.p = c.p and own.proc = c.r"),
    "orders_modifies_p": ("procedure p; variable v; Select <p, v> such that Modifies(p, v)", ", own as (select t.p, t.proc, u.v from sets u join stmt t on t.p = u.p and t.a = u.a) select p as program_id, proc as c1, v as c2 from own union select c.p, c.l, own.v from calls_t c join own on own.p = c.p and own.proc = c.r"),
    "orders_uses_s": ("stmt s; variable v; Select <s, v> such that Uses(s, v)", ", own as (select t.p, t.proc, u.v from uses u join stmt t on t.p = u.p and t.a = u.a), called as (select p, proc, v from own union select c.p, c.l, own.v from calls_t c join own on own.p = c.p and own.proc = c.r), direct as (select p, a, v from uses union select t.p, t.a, q.v from stmt t join called q on q.p = t.p and q.proc = t.callee) select distinct b.p as program_id, b.a as c1, d.v as c2 from below b join direct d on d.p = b.p and d.a = b.s"),
    "orders_modifies_s": ("stmt s; variable v; Select <s, v> such that Modifies(s, v)", ", own as (select t.p, t.proc, u.v from sets u join stmt t on t.p = u.p and t.a = u.a), called as (select p, proc, v from own union select c.p, c.l, own.v from calls_t c join own on own.p = c.p and own.proc = c.r), direct as (select p, a, v from sets union select t.p, t.a, q.v from stmt t join called q on q.p = t.p and q.proc = t.callee) select distinct b.p as program_id, b.a as c1, d.v as c2 from below b join direct d on d.p = b.p and d.a = b.s"),
    "orders_next": ("prog_line a, b; Select <a, b> such that Next(a, b)", " select p as program_id, a as c1, b as c2 from nxt"),
    "orders_next_t": ("prog_line a, b; Select <a, b> such that Next*(a, b)", _closed("nxt(p, l, r)").replace("nxt(p, l, r)", "nxt").replace("e.r from t", "e.b from t").replace("e.l = t.r", "e.a = t.r")),
    "orders_affects": ("assign a, b; Select <a, b> such that Affects(a, b)", " select p as program_id, l as c1, r as c2 from affects"),
    "orders_affects_t": ("assign a, b; Select <a, b> such that Affects*(a, b)", _closed("affects")),
    "orders_next_bip": ("prog_line a, b; Select <a, b> such that NextBip(a, b)", " select distinct p as program_id, a as c1, b as c2 from bip"),
    "orders_next_bip_t": ("prog_line a, b; Select <a, b> such that NextBip*(a, b)", ", t(p, c, a, d, b) as (select * from bip union select t.p, t.c, t.a, e.d, e.b from t join bip e on e.p = t.p and e.c = t.d and e.a = t.b) select distinct p as program_id, a as c1, b as c2 from t"),
    "orders_affects_bip": ("assign a, b; Select <a, b> such that AffectsBip(a, b)", " select distinct p as program_id, l as c1, r as c2 from bip_affects"),
    "orders_affects_bip_t": ("assign a, b; Select <a, b> such that AffectsBip*(a, b)", ", t(p, c, l, d, r) as (select * from bip_affects union select t.p, t.c, t.l, e.d, e.r from t join bip_affects e on e.p = t.p and e.c = t.d and e.l = t.r) select distinct p as program_id, l as c1, r as c2 from t"),
    "orders_if_pattern": ('if i; assign a; Select <i, a> pattern i("status", _, _) and a("v1", _"v2 + 3"_) such that Parent(i, a)', " select p as program_id, s as c1, a as c2 from item where lhs = 'v1' and rhs = 'v2' and k = 3"),
    "orders_while_pattern": ('while w; call c; procedure q; variable v; Select <w, c, q> pattern w(v, _) such that Parent(w, c) and Uses(q, v) with c.procName = q.procName', " select p as program_id, 2 as c1, (2 + i)::int as c2, 'o' || i as c3 from ord"),
    "orders_exact_pattern": ('assign a; variable v; Select <a, v> pattern a(v, "budget - 1")', " select p as program_id, (s + m + 1)::int as c1, 'budget' as c2 from ord"),
    "orders_with": ("print q; assign a; call c; Select <q, a, c> with q.varName = \"spent\" such that Next(a, q) and NextBip(c, a)", " select p as program_id, z + 1 as c1, z as c2, t.a as c3 from prog join stmt t using (p) where t.callee = 'log'"),
    "orders_boolean": ("assign a; print q; Select BOOLEAN such that AffectsBip(a, a) and Parent*(_, a) and Next*(q, q)", " select p as program_id, false as result from prog"),
    # 20 synonyms, 13 clauses, 5 parts that meet in the result alone
    "orders_components": ("stmt s1, s2, s3, s4, s5, s6, s7, s8, s9, s10, s11, s12, s13, s14, s15, s16, s17, s18, s19, s20; Select <s1, s4, s7, s10, s13> such that Follows*(s1, s2) and Follows*(s2, s3) and Follows*(s3, 8) such that Follows*(s4, s5) and Follows*(s5, s6) and Follows*(s6, 7) such that Follows*(s7, s8) and Follows*(s8, s9) and Follows*(s9, 8) such that Follows*(s10, s11) and Follows*(s11, s12) and Follows*(s12, 7) such that Follows(s13, s14)",
        ", listed as (select p, proc, parent, parent is not null and kind = 'assign' and exists (select 1 from stmt q where q.p = stmt.p and q.parent = stmt.parent and q.a = stmt.parent + 1) as x, kind, a from stmt), li_stmt as (select s.p, s.a, case when s.proc = 'main' then case when s.parent is null then -1 else -2 end when s.parent is null then (select e.a from entry e where e.p = s.p and e.proc = s.proc) * 3 when exists (select 1 from item where item.p = s.p and item.a = s.a) then s.parent * 3 + 1 else s.parent * 3 + 2 end as list from stmt s), placed as (select *, row_number() over (partition by p, list order by a) as pos, lead(a) over (partition by p, list order by a) as then_a from li_stmt), third as (select a.p, a.a, e.a as e from placed a join placed e on e.p = a.p and e.list = a.list and e.a in (7, 8) and a.pos + 3 <= e.pos) select t1.p as program_id, t1.a as c1, t2.a as c2, t3.a as c3, t4.a as c4, f.a as c5 from third t1 join third t2 on t2.p = t1.p and t2.e = 7 join third t3 on t3.p = t1.p and t3.e = 8 join third t4 on t4.p = t1.p and t4.e = 7 join placed f on f.p = t1.p and f.then_a is not null where t1.e = 8"),
}


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _event_case(name: str):
    def run(spark, sf_dir):
        return Engine(spark, event_programs(_read(spark, sf_dir, "events"))).query(EVENT_CASES[name][0])

    run.__name__ = name
    return run


def _order_case(name: str):
    def run(spark, sf_dir):
        return Engine.corpus(spark, order_programs(_read(spark, sf_dir, "orders"), _read(spark, sf_dir, "lineitem"))).query(ORDER_CASES[name][0])

    run.__name__ = name
    return run


def tables_calls_t(spark, sf_dir):
    """Everything below a region, nation or customer: the closure of an acyclic graph."""
    return closure(containment(*(_read(spark, sf_dir, t) for t in ("region", "nation", "customer", "orders")))).select("l", "r")


def tables_trade_closure_whole(spark, sf_dir):
    """Which nations' trade reaches which, over the whole of lineitem."""
    return closure(trade(*(_read(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "supplier")))).select("l", "r")


def program_listing(spark, sf_dir):
    """A program in its compact printed form."""
    return printed(spark.createDataFrame([("program", MAIN)], "program_id string, text string"))


def next_distances(spark, sf_dir):
    """The fewest steps of control flow between statements."""
    return Engine.load(spark, MAIN).distances().drop("program_id")


def tuple_answers(spark, sf_dir):
    """Answers as texts: a tuple's cells joined by a blank."""
    return Engine.load(spark, MAIN).strings("while w; procedure p; call c; Select <w, p, c.procName>").select("answer")


def query_listing(spark, sf_dir):
    """A query's tree, printed."""
    text = listing(parse_query('assign a; print q; Select <a, q.varName> such that Next*(_, 3) pattern a("x", _) with q.varName = "x"'))
    return spark.createDataFrame([(text,)], "listing string")


TABLE_SQL = {
    "next_distances": "with recursive e(l, r) as (values " + ", ".join(f"({x.replace('-', ', ')})" for x in _NEXT.split()) + "), t as (select l, r, 1 as steps from e union select t.l, e.r, t.steps + 1 from t join e on t.r = e.l where t.steps < 20) select l, r, min(steps)::int as steps from t group by l, r",
    "tuple_answers": "select '3 ' || p || ' sub' as answer from (values ('main'), ('sub')) t(p)",
    "query_listing": "select 'declare assign a' || chr(10) || 'declare print q' || chr(10) || 'select a, q.varName' || chr(10) || 'relation next_t(_, 3)' || chr(10) || 'pattern assign(a, \"x\", _)' || chr(10) || 'with with(q.varName, \"x\")' as listing",
    "program_listing": "select 'program' as program_id, 'procedure main{read x;y = ((x * 2) + 1);while(x > 0){if(y == 1)then{call sub;}else{print y;}x = (x - 1);}print x;}procedure sub{y = (y + (x * 2));z = 10;}' as listing",
    "tables_calls_t": """
with recursive e as (
  select 'r' || n_regionkey as l, 'n' || n_nationkey as r from nation union select 'n' || c_nationkey, 'c' || c_custkey from customer union select 'c' || o_custkey, 'o' || o_orderkey from orders
), t as (select l, r from e union select t.l, e.r from t join e on t.r = e.l) select l, r from t""",
    "tables_trade_closure_whole": """
with recursive e as (
  select distinct c_nationkey as l, s_nationkey as r from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey
  where c_nationkey != s_nationkey
), t as (select l, r from e union select t.l, e.r from t join e on t.r = e.l) select l, r from t""",
}
OWN = {f.__name__: f for f in (many_components, next_distances, tuple_answers, query_listing, program_listing, tables_calls_t, tables_trade_closure_whole)}
QUERIES = {n: _case(n) for n in CASES} | {n: _event_case(n) for n in EVENT_CASES} | {n: _order_case(n) for n in ORDER_CASES} | OWN
SQL = {n: _case_sql(n) for n in CASES} | {n: _EVENTS + q for n, (_, q) in EVENT_CASES.items()} | {n: _ORDERS + q for n, (_, q) in ORDER_CASES.items()} | TABLE_SQL | {"many_components": _COMPONENTS_SQL}
