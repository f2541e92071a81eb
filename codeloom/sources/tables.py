"""Programs made of ordinary tables, so that the engine's operators run over data of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.operators.relations import P
from codeloom.sources.facts import FactTables

#: Added to an int, so that the least is above null's 0.
_FIRST = (1 << 31) + 1


def event_programs(events: DataFrame) -> FactTables:
    """A program for each user: statement = event, in the order of (ts, event_id).

    With k the number in props: purchase and click assign v(k % 7) from v(k // 7 % 7), signup reads v(k % 7),
    view prints v(k // 7 % 7), error prints `failed`.
    """
    k = F.get_json_object("props", "$.k").cast("int")
    e = events.select(F.col("user_id").cast("string").alias(P), F.col("event_id").cast("int").alias("stmt_no"), "event_type", "ts", F.concat(F.lit("v"), k % 7).alias("target"), F.concat(F.lit("v"), F.floor(k / 7) % 7).alias("source"))
    kind = F.when(F.col("event_type").isin("purchase", "click"), "assign").when(F.col("event_type") == "signup", "read").otherwise("print")
    e = e.withColumns({"kind": kind, "shown": F.when(F.col("event_type") == "view", F.col("source")).when(F.col("event_type") == "error", F.lit("failed"))})
    order = Window.partitionBy(P).orderBy("ts", "stmt_no")
    placed = e.withColumns({"pos": F.row_number().over(order) - 1, "then": F.lead("stmt_no").over(order)})
    operand = F.when(F.col("kind") == "read", F.col("target")).otherwise(F.col("shown"))
    stmt = placed.select(P, "stmt_no", "kind", F.col(P).alias("proc_name"), F.lit(1).alias("list_id"), "pos", F.lit(None).cast("int").alias("parent_stmt"), F.col("stmt_no").alias("last_inside"), operand.alias("operand_var"), F.lit(None).cast("string").alias("callee"))
    program = e.select(P).distinct()
    used, rows = F.coalesce("shown", "source"), F.col("rows")
    packed = e.groupBy(P).agg(F.sort_array(F.collect_list(F.struct("ts", "stmt_no", "kind", "target", used.alias("used")))).alias("rows"))
    packed = packed.select(
        P,
        F.transform(rows, lambda x, i: F.struct(x["stmt_no"].alias("stmt_no"), x["kind"].alias("kind"), F.col(P).alias("proc_name"), F.lit(1).alias("list_id"), i.alias("pos"), F.lit(None).cast("int").alias("parent_stmt"), F.lit(None).cast("string").alias("callee"))).alias("stmts"),
        F.transform(F.slice(rows, 1, F.size(rows) - 1), lambda x, i: F.struct(x["stmt_no"].alias("src"), F.get(rows, i + 1)["stmt_no"].alias("dst"))).alias("nexts"),
        F.transform(F.filter(rows, lambda x: x["kind"] != "read"), lambda x: F.struct(x["stmt_no"].alias("stmt_no"), x["used"].alias("var"))).alias("uses"),
        F.transform(F.filter(rows, lambda x: x["kind"] != "print"), lambda x: F.struct(x["stmt_no"].alias("stmt_no"), x["target"].alias("var"))).alias("modifies"),
    )
    return FactTables(
        program=program,
        proc=program.select(P, F.col(P).alias("proc_name"), F.lit(0).alias("proc_idx")),
        stmt=stmt,
        direct_uses=e.where("kind != 'read'").select(P, "stmt_no", used.alias("var"), F.lit(False).alias("in_condition")),
        direct_modifies=e.where("kind != 'print'").select(P, "stmt_no", F.col("target").alias("var")),
        assign_expr=e.where("kind = 'assign'").select(P, "stmt_no", F.col("target").alias("lhs"), F.col("source").alias("rhs_key"), F.array("source").alias("rhs_subtrees")),
        const=program.where(F.lit(False)).select(P, F.lit("").alias("value")),
        cfg_next=placed.where("then is not null").select(P, F.col("stmt_no").alias("src"), F.col("then").alias("dst")),
        packed=packed,
        flat=True,
    )


def order_programs(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """(program_id, text): a program for the orders of each customer and priority, for the front end to parse.

    `main` reads a budget, calls a procedure for each order, o1, o2, .. by order key, in a loop, and prints;
    an order's procedure assigns once for each of its items, in a branch, and calls `log`. Orders without
    items aren't called.
    """
    shown = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    # an item is one number, as numbers move, are gathered and sorted for less: its place (an int, null before all),
    # then both variables; texts are made last
    of = lambda c: F.coalesce(F.col(c) % 4 + 4, F.lit(0))
    item = F.coalesce(F.col("l_linenumber").cast("long") + _FIRST, F.lit(0)) * 64 + of("l_suppkey") * 8 + of("l_partkey")
    # rows move before they are gathered: tasks that read them have hardly two of a key
    items = lineitem.select(F.col("l_orderkey").alias("o_orderkey"), item.alias("item")).repartition("o_orderkey").groupBy("o_orderkey").agg(F.sort_array(F.collect_list("item")).alias("items"))
    status = F.instr(F.lit("FOP"), F.col("o_orderstatus")) - 1
    rows = orders.select("o_orderkey", F.concat_ws("-", "o_custkey", F.substring("o_orderpriority", 1, 1)).alias(P), status.alias("status")).join(items, "o_orderkey")
    rows = rows.select(P, F.struct("o_orderkey", "status", "items").alias("order")).repartition(P)
    rows = rows.groupBy(P).agg(F.sort_array(F.collect_list("order")).alias("orders"))
    var = ["null", *(f"v{k}" for k in range(-3, 4))]
    starts = F.array(*(F.lit(f"{to} = ({by} + ") for to in var for by in var))
    line = lambda x: F.concat(F.get(starts, x.bitwiseAND(63).cast("int")), shown(F.when(x >= 64, F.shiftright(x, 6) - _FIRST)), F.lit(") * rate;"))
    number = lambda i: (i + 1).cast("string")
    calls = F.array_join(F.transform("orders", lambda x, i: F.concat(F.lit("call o"), number(i), F.lit(";"))), " ")
    one = lambda x, i: F.concat(F.lit("procedure o"), number(i), F.lit(" { if (status == "), shown(x["status"]), F.lit(") then { "), F.array_join(F.transform(x["items"], line), " "), F.lit(" } else { budget = budget - 1; } call log; }"))
    text = F.concat(F.lit("procedure main { read budget; while (budget > 0) { "), calls, F.lit(" } print spent; }\n"), F.array_join(F.transform("orders", one), "\n"), F.lit("\nprocedure log { spent = spent + v0; print spent; }"))
    return rows.select(P, text.alias("text"))


def containment(region: DataFrame, nation: DataFrame, customer: DataFrame, orders: DataFrame) -> DataFrame:
    """(program_id, l, r): region over nation over customer over order, as one acyclic graph."""
    named = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    steps = [nation.select(named("r", "n_regionkey"), named("n", "n_nationkey")), customer.select(named("n", "c_nationkey"), named("c", "c_custkey")), orders.select(named("c", "o_custkey"), named("o", "o_orderkey"))]
    every = steps[0].union(steps[1]).union(steps[2]).toDF("l", "r")
    return every.select(F.lit("tables").alias(P), "l", "r").distinct()


def trade(lineitem: DataFrame, orders: DataFrame, customer: DataFrame, supplier: DataFrame) -> DataFrame:
    """(program_id, l, r): customer's nation to supplier's nation, over all items given; cyclic."""
    items = lineitem.select("l_orderkey", "l_suppkey")
    rows = items.join(orders.select("o_orderkey", "o_custkey"), items.l_orderkey == F.col("o_orderkey")).join(customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).where("c_nationkey != s_nationkey")
    return rows.select(F.lit("tables").alias(P), F.col("c_nationkey").alias("l"), F.col("s_nationkey").alias("r")).distinct()
