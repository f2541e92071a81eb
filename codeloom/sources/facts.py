"""Fact tables: one program, or a corpus of programs, as DataFrames keyed by program_id."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.session import workers_find_us
from codeloom.sources.simple import Facts, ProgramError, parse_program

SCHEMAS = {
    "proc": "proc_name string, proc_idx int",
    "stmt": "stmt_no int, kind string, proc_name string, list_id int, pos int, parent_stmt int, last_inside int, operand_var string, callee string",
    "direct_uses": "stmt_no int, var string, in_condition boolean",
    "direct_modifies": "stmt_no int, var string",
    "assign_expr": "stmt_no int, lhs string, rhs_key string, rhs_subtrees array<string>",
    "const": "value string",
    "cfg_next": "src int, dst int",
}
_LISTS = ("procs", "stmts", "uses", "modifies", "assigns", "consts", "nexts")


#: What the kernels of operators/flow.py take of a program, each a list.
PACKED = {
    "stmts": ("stmt", ("stmt_no", "kind", "proc_name", "list_id", "pos", "parent_stmt", "callee")),
    "nexts": ("cfg_next", ("src", "dst")),
    "uses": ("direct_uses", ("stmt_no", "var")),
    "modifies": ("direct_modifies", ("stmt_no", "var")),
}


@dataclass
class FactTables:
    """program: (program_id) of valid programs; the others as in SCHEMAS, with program_id first.

    last_inside is the last statement within a container, in source order, and any other's own number.
    packed: one row a program, with the columns of PACKED. flat: no program has containers or calls.
    """

    program: DataFrame
    proc: DataFrame
    stmt: DataFrame
    direct_uses: DataFrame
    direct_modifies: DataFrame
    assign_expr: DataFrame
    const: DataFrame
    cfg_next: DataFrame
    packed: DataFrame
    flat: bool = False


def _colons() -> dict[str, str]:
    return {k: ",".join(c.replace(" ", ":", 1) for c in v.split(", ")) for k, v in SCHEMAS.items()}


def parsed(sources: DataFrame) -> DataFrame:
    """One row a program: its fact rows as arrays, or the error. sources: (program_id, text)."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    workers_find_us(sources.sparkSession)
    schema = "program_id string, error string, " + ", ".join(f"{k} array<struct<{v}>>" for k, v in _colons().items())
    arrow = to_arrow_schema(sources.sparkSession.createDataFrame([], schema).schema)
    names = {k: [c.split(":")[0] for c in v.split(",")] for k, v in _colons().items()}

    def run(batches):
        rows, size = [], 0
        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                row = {"program_id": i, "error": None} | {k: [] for k in SCHEMAS}
                try:
                    facts = parse_program(text or "")
                    for table, part in zip(SCHEMAS, _LISTS):
                        row[table] = [dict(zip(names[table], r)) for r in getattr(facts, part)]
                except ProgramError as e:
                    row["error"] = str(e)
                rows.append(row)
                size += len(text or "") + 100
                if size > 2_000_000:  # facts take many times their text
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                    rows, size = [], 0
        yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return sources.select(F.col("program_id").cast("string"), F.col("text").cast("string")).mapInArrow(run, schema)


def fact_tables(bundle: DataFrame) -> FactTables:
    good = bundle.where("error is null")
    tables = {k: good.select("program_id", F.explode(k).alias("x")).select("program_id", "x.*") for k in SCHEMAS}
    only = lambda names: lambda x: F.struct(*(x[c].alias(c) for c in names))
    columns = [F.transform(t, only(names)).alias(k) for k, (t, names) in PACKED.items()]
    return FactTables(program=good.select("program_id"), **tables, packed=good.select("program_id", *columns))


def local_facts(spark: SparkSession, facts: Facts, program_id: str = "program") -> FactTables:
    """The facts of one program that was parsed here, as local tables: their sizes are known to the planner."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    def table(schema: str, rows: list[tuple]) -> DataFrame:
        kind = _parse_datatype_string(f"program_id string, {schema}" if schema else "program_id string")
        names = kind.fieldNames()
        return spark.createDataFrame(pa.Table.from_pylist([dict(zip(names, (program_id, *r))) for r in rows], schema=to_arrow_schema(kind)), kind)

    tables = {k: table(v, getattr(facts, part)) for (k, v), part in zip(SCHEMAS.items(), _LISTS)}
    lists, row = dict(zip(SCHEMAS, _LISTS)), []
    for t, names in PACKED.values():
        at = [[c.split()[0] for c in SCHEMAS[t].split(", ")].index(n) for n in names]
        row.append([dict(zip(names, (r[k] for k in at))) for r in getattr(facts, lists[t])])
    schema = ", ".join(f"{k} array<struct<{','.join(c.replace(' ', ':', 1) for c in SCHEMAS[t].split(', ') if c.split()[0] in names)}>>" for k, (t, names) in PACKED.items())
    return FactTables(program=table("", [()]), **tables, packed=table(schema, [tuple(row)]))


def read_programs(spark: SparkSession, path: str) -> DataFrame:
    """(program_id, text) of text files, one program each; the id is the file's path."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("program_id"), F.col("value").alias("text"))
