"""Graph dumps (one JSON object per program) -> fact tables.

A dump maps a unit name to its blocks; a block has an id, parent ids and its
instructions. The fields of an instruction differ by type, so an instruction is read
as a map of variants and a role table says which field plays which part.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsieve.functions.operands import DUMP_KEYS, OPERAND_FIELDS, operation_name, strip_literal
from flowsieve.operators.links import link_accesses
from flowsieve.session import cut

DUMP_SCHEMA = (
    "MAP<STRING, ARRAY<STRUCT<blockId: INT, parentBlock: ARRAY<INT>, blocks: ARRAY<MAP<STRING, VARIANT>>>>>"
)

# Instruction type | input fields | output fields | result fields.
ROLES = """
Terminal_Echo            | expr        |        |
Terminal_Const           | value       | name   |
Terminal_GlobalVar       | var         |        |
Terminal_StaticVar       | defaultVar  | var    |
Terminal_Unset           | exprs       |        |
Terminal_Throw           | expr        |        |
Terminal_Return          | expr        |        |
Stmt_JumpIf              | cond        |        |
Stmt_Property            | defaultVar  |        |
Stmt_Switch              | cond        |        |
Expr_Cast                | expr        | result |
Expr_BinaryOp            | left right  |        | result
Expr_ArrayDimFetch       | var         | result |
Expr_Assign              | expr        | var    | result
Expr_Include             | expr        |        | result
Expr_Isset               | vars        |        | result
Expr_MethodCall          | args        | result |
Expr_StaticCall          | args        | result |
Expr_FuncCall            | args        | result |
Expr_NsFuncCall          | args        | result |
Expr_ConstFetch          | name        | result |
Expr_New                 | class       | result |
Expr_Array               | values      | result |
Expr_AssignRef           | expr        | var    | result
Expr_BooleanNot          | expr        | result |
Expr_BitwiseNot          | expr        | result |
Expr_Clone               | expr        | result |
Expr_Empty               | expr        |        | result
Expr_ConcatList          | list        | result |
Expr_ClassConstFetch     | class::name | result |
Expr_Exit                |             |        | result
Expr_Eval                | expr        | result |
Expr_InstanceOf          | expr class  |        | result
Expr_Print               | expr        |        | result
Expr_Yield               | key         | result |
Expr_UnaryPlus           | expr        | result |
Expr_UnaryMinus          | expr        | result |
Expr_Closure             |             | result |
Expr_StaticPropertyFetch | class name  | result |
Expr_Assertion           | expr        | result |
Iterator_Reset           | var         |        |
Iterator_Valid           | var         |        | result
Iterator_Key             | var         | result |
Iterator_Value           | var         | result |
Iterator_Next            | var         |        |
Phi                      | vars        | result |
"""

CALL_OPS = ["Expr_FuncCall", "Expr_NsFuncCall", "Expr_MethodCall", "Expr_StaticCall"]


@dataclass(frozen=True)
class Facts:
    """The tables that the operators work on."""

    units: DataFrame
    blocks: DataFrame
    ops: DataFrame
    operands: DataFrame
    edges: DataFrame
    params: DataFrame
    returns: DataFrame


def role_table(spark: SparkSession) -> DataFrame:
    """family, role, field and the 1-based position of the field's first operand."""
    rows = []
    for line in ROLES.strip().splitlines():
        family, *lists = [part.strip() for part in line.split("|")]
        for role, fields in zip(("in", "out", "res"), lists, strict=True):
            rows += [(family, role, field, at) for at, field in enumerate(fields.split(), 1)]
    names = ["family", "role", "field", "first_pos"]
    columns = dict(zip(names, map(list, zip(*rows, strict=True)), strict=True))
    columns["first_pos"] = pa.array(columns["first_pos"], type=pa.int32())
    return spark.createDataFrame(pa.table(columns))


def op_family(op: Column) -> Column:
    """Instruction type without the operator or cast name; any text with Phi is a merge."""
    return (
        F.when(op.contains("Phi"), F.lit("Phi"))
        .when(op.startswith("Expr_Cast_"), F.lit("Expr_Cast"))
        .when(op.startswith("Expr_BinaryOp_"), F.lit("Expr_BinaryOp"))
        .when(op.startswith("Expr_StaticCall"), F.lit("Expr_StaticCall"))
        .when(op.startswith("Expr_Closure"), F.lit("Expr_Closure"))
        .when(op.startswith("Expr_Assertion"), F.lit("Expr_Assertion"))
        .otherwise(op)
    )


def assign_roles(ops: DataFrame, fields: str = "fields") -> DataFrame:
    """One row per operand: role, position and the raw variant.

    ``ops`` has op and a map of variants; a field holds one operand or a list of them.
    """
    roles = role_table(ops.sparkSession)
    joined = ops.withColumn("family", op_family(F.col("op"))).join(roles, "family")
    given = F.col(fields)[F.element_at(F.split("field", "::"), 1)]
    items = F.coalesce(F.try_variant_get(given, "$", "array<variant>"), F.array(given))
    keep = [c for c in ops.columns if c != fields]
    return (
        joined.where(given.isNotNull())
        .select(*keep, "family", "role", "field", "first_pos", fields, F.posexplode(items).alias("_i", "item"))
        .where(F.col("item").isNotNull() & ~F.is_variant_null("item"))
        .withColumn("pos", F.col("first_pos") + F.col("_i"))
        .drop("_i", "first_pos")
    )


def read_operand(item: Column, dim: Column | None = None) -> Column:
    """Operand struct of a variant, with the defaults for absent keys."""
    parts = []
    for field, (dtype, default) in OPERAND_FIELDS.items():
        got = F.try_variant_get(item, f"$.{DUMP_KEYS.get(field, field)}", dtype)
        if field == "dim" and dim is not None:
            got = F.coalesce(dim, got)
        parts.append((got if default is None else F.coalesce(got, F.lit(default))).alias(field))
    return F.struct(*parts)


def _text(fields: str, key: str, path: str = "$") -> Column:
    return F.try_variant_get(F.col(fields)[key], path, "string")


def read_graph_corpus(dumps: DataFrame, program: str = "program", text: str = "text") -> Facts:
    """Fact tables of a table of dumps, one program per row; the texts are parsed once."""
    parsed = dumps.select(
        F.col(program).alias("program"), F.explode(F.from_json(text, DUMP_SCHEMA)).alias("_unit", "_blocks")
    )
    return _facts(parsed.select("program", "_unit", F.explode_outer("_blocks").alias("b")))


def _facts(blocks: DataFrame) -> Facts:
    """Fact tables of ``blocks(program, _unit, b)``, a row per block, or one with null ``b`` for a unit without any.

    The parsed instructions are written once, as variants; all tables read that.
    """
    name = F.replace(F.replace("_unit", F.lit("\\"), F.lit("\\\\")), F.lit("()"), F.lit(""))
    rows = cut(
        blocks.select(
            "program", name.alias("unit"), F.col("b.blockId").alias("block"), F.col("b.parentBlock").alias("parents"),
            F.posexplode_outer("b.blocks").alias("seq", "fields"),
        )
    )
    found = rows.select("program", "unit").distinct()
    units = found.select(
        "program",
        "unit",
        F.when(F.col("unit").contains("::"), F.substring_index("unit", "::", 1)).alias("class"),
        F.substring_index("unit", "::", -1).alias("name"),
    )
    # an instruction's place is its own; the first row of a block, or its only one, stands for the block
    listed = rows.where("block IS NOT NULL AND coalesce(seq, 0) = 0").select("program", "unit", "block", "parents")
    raw = rows.where("seq IS NOT NULL").select("program", "unit", "block", "seq", "fields")
    op = F.regexp_extract(_text("fields", "op"), r"(Phi)(?=\()|^\s*(\S+)", 0)
    callee = F.when(op.isin("Expr_FuncCall", "Expr_NsFuncCall", "Expr_MethodCall", "Expr_StaticCall"), F.coalesce(
        _text("fields", "name", "$.value"),
        F.concat(F.lit("$"), _text("fields", "name", "$.var_name")),
    ))
    scope = F.when(op == "Expr_MethodCall", _text("fields", "var", "$.var_name")).when(
        op == "Expr_StaticCall", _text("fields", "class", "$.value")
    )
    shaped = raw.select(
        "program",
        "unit",
        "block",
        "seq",
        F.when(_text("fields", "op").contains("Phi"), F.lit("Phi")).otherwise(op).alias("op"),
        strip_literal(callee).alias("callee"),
        strip_literal(scope).alias("scope"),
        _text("fields", "file").alias("file"),
        _text("fields", "startLine").alias("start_line"),
        _text("fields", "endLine").alias("end_line"),
        "fields",
    )
    ops = shaped.withColumn("operation", operation_name(F.col("op"))).drop("fields")
    operands = _operands(shaped)
    return Facts(
        units=units,
        blocks=listed,
        ops=ops,
        operands=operands,
        edges=_edges(shaped),
        params=_params(shaped),
        returns=operands.where("op = 'Terminal_Return' AND role = 'in'").select("program", "unit", "block", "var"),
    )


def _operands(shaped: DataFrame) -> DataFrame:
    keys = ["program", "unit", "block", "seq", "op"]
    spread = assign_roles(shaped.select(*keys, "fields"))
    # a literal index of an array access belongs to the array operand
    dim = F.when(
        (F.col("op") == "Expr_ArrayDimFetch") & (F.col("role") == "in"), _text("fields", "dim", "$.value")
    )
    plain = read_operand(F.col("item"), dim)
    pair = F.concat_ws("::", _text("fields", "class", "$.value"), _text("fields", "name", "$.value"))
    var = F.when(F.col("field") == "class::name", plain.withField("value", pair)).otherwise(plain)
    return spread.select(*keys, "role", "pos", var.alias("var"))


def _edges(shaped: DataFrame) -> DataFrame:
    def block(key: str) -> Column:
        got = F.col("fields")[key]
        return F.coalesce(F.try_variant_get(got, "$", "int"), F.try_variant_get(got, "$[0]", "int"))

    def edge(label: Column, dst: Column) -> Column:
        return F.struct(label.cast("string").alias("label"), dst.alias("dst"))

    op = F.col("op")
    body = F.when(op.isin("Stmt_Class", "Stmt_Interface"), _text("fields", "name", "$.value")).when(
        op == "Stmt_Trait", F.coalesce(_text("fields", "name", "$.value"), _text("fields", "name"))
    )
    kinds = F.array(
        edge(F.lit("target"), F.when(op == "Stmt_Jump", block("target"))),
        edge(F.lit("if"), F.when(op == "Stmt_JumpIf", block("if"))),
        edge(F.lit("else"), F.when(op == "Stmt_JumpIf", block("else"))),
        edge(F.lit("default"), F.when(op == "Stmt_Switch", block("default"))),
        edge(body, F.when(body.isNotNull(), block("stmts"))),
        edge(F.lit("Block"), F.coalesce(block("defaultBlock"), block("valueBlock"))),
    )
    cases = F.flatten(
        F.transform(
            F.coalesce(F.try_variant_get(F.col("fields")["cases"], "$", "array<variant>"), F.array().cast("array<variant>")),
            lambda c: F.coalesce(F.try_variant_get(c, "$", "array<variant>"), F.array(c)),
        )
    )
    targets = F.coalesce(
        F.try_variant_get(F.col("fields")["targets"], "$", "array<int>"), F.array().cast("array<int>")
    )
    by_case = F.transform(
        targets,
        lambda dst, i: edge(
            F.coalesce(
                F.try_variant_get(F.get(cases, i), "$.value", "string"),
                F.concat(F.lit("Var#"), F.try_variant_get(F.get(cases, i), "$.id", "string")),
            ),
            dst,
        ),
    )
    keys = ["program", "unit", F.col("block").alias("src"), "seq"]
    return shaped.select(*keys, F.inline(F.concat(kinds, by_case))).where("dst IS NOT NULL")


def _params(shaped: DataFrame) -> DataFrame:
    """Parameters by position: the ``Expr_Param`` rows lead the first block in order."""
    return (
        shaped.where(F.col("op").startswith("Expr_Param") & (F.col("block") == 1))
        .where(F.col("fields")["result"].isNotNull())
        .select("program", "unit", (F.col("seq") + 1).alias("pos"), read_operand(F.col("fields")["result"]).alias("var"))
    )


#: What opens a block in a dump. Within a text of the dump its quotes are escaped, so it stands nowhere else.
BLOCK_MARK = '{"blockId":'
# what follows a block: the next one, the name and opening of the next unit, or the end
BLOCK_END = r'(?s)^(.*\})\s*(?:,|\]\s*,\s*("(?:[^"\\]|\\.)*")\s*:\s*\[|\]\s*\})\s*$'
FIRST_UNIT = r'(?s)^\s*\{\s*("(?:[^"\\]|\\.)*")\s*:\s*\[\s*$'
BLOCK_SCHEMA = "STRUCT<blockId: INT, parentBlock: ARRAY<INT>, blocks: ARRAY<MAP<STRING, VARIANT>>>"


def read_large_dumps(spark: SparkSession, path: str) -> Facts:
    """Fact tables of a folder of compact dump files of any size, one program per file.

    Files are cut at the openings of blocks, by Spark's text reader, so a large file is read in as many tasks as it
    has splits, and no row is larger than a block. A unit's name stands behind the last block of the unit before
    it; each block takes the last name before it in its file, carried on from split to split. Units without blocks are
    left out. A piece that is no block raises an error.
    """
    pieces = spark.read.text(path, lineSep=BLOCK_MARK).select(
        F.col("_metadata.file_name").alias("program"), F.col("_metadata.file_block_start").alias("slice"),
        F.monotonically_increasing_id().alias("row"), "value",
    )
    first = F.regexp_extract("value", FIRST_UNIT, 1)
    body, following = F.regexp_extract("value", BLOCK_END, 1), F.regexp_extract("value", BLOCK_END, 2)
    opened = F.when(first != "", first).when(following != "", following)
    pieces = cut(pieces.select("program", "slice", "row", F.when(body != "", F.concat(F.lit(BLOCK_MARK), body)).alias("body"), opened.alias("opened"), (F.trim("value") == "").alias("blank")))
    # a piece's place in its file: the start of its split and its number there, which is below the split's length
    least = pieces.groupBy("program", "slice").agg(F.min("row").alias("_least"))
    placed = cut(pieces.join(least, ["program", "slice"]).withColumn("seq", F.col("slice") + F.col("row") - F.col("_least")).drop("_least", "row"))
    if not placed.where("body IS NULL AND opened IS NULL AND NOT blank").isEmpty():
        raise ValueError("a piece between two openings is no block")
    names = placed.where("opened IS NOT NULL").select("program", "slice", "seq", "opened")
    small = placed.where("body IS NOT NULL").select("program", "slice", "seq")
    accesses = small.withColumn("is_write", F.lit(0)).unionByName(names.drop("opened").withColumn("is_write", F.lit(1)))
    last = link_accesses(accesses, ["program"]).select("program", "seq", "def_seq")
    unit = F.from_json(F.concat(F.lit("["), F.col("opened"), F.lit("]")), "array<string>")[0]
    named = last.join(names.select("program", F.col("seq").alias("def_seq"), unit.alias("_unit")), ["program", "def_seq"])
    blocks = placed.where("body IS NOT NULL").select("program", "seq", "body").join(named, ["program", "seq"])
    return _facts(blocks.select("program", "_unit", F.from_json("body", BLOCK_SCHEMA).alias("b")))


def read_dump_files(spark: SparkSession, path: str) -> Facts:
    """Fact tables of a folder of dump files, one program per file."""
    files = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_name").alias("program"), F.col("value").alias("text")
    )
    return read_graph_corpus(files)
