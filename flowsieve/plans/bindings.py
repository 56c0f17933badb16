"""Fact tables derived from the given tables: programs and block graphs from ``events``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsieve.functions.expressions import BINARY_OPERATORS
from flowsieve.functions.operands import operation_name
from flowsieve.operators.links import link_accesses
from flowsieve.operators.ordered import add_slices, next_value, row_sequence, with_slice
from flowsieve.sources import policy as P

SOURCE_CALL_NAMES = [name for names in P.SOURCE_CALLS.values() for name in names]
FULL_CALL_NAMES = [name for name in P.FULL_SANITIZERS if not name.startswith("Expr_")]
CAST_NAMES = [name for name in P.FULL_SANITIZERS if name.startswith("Expr_")]
CONDITIONAL_NAMES = [
    *dict.fromkeys(
        name for names in P.CONDITIONAL_SANITIZERS.values() for name in names if name not in P.FULL_SANITIZERS
    ),
    "esc_sql",
]
SINK_CALL_NAMES = [
    *dict.fromkeys(row[3] for row in P.policy_rows() if row[0] == "sink"),
    "insert",
]
COMPARATORS = ["=", ">", "<", "<=", "!=", ">="]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(names: list[str], index: Column) -> Column:
    """Name number ``index`` (from 0, taken modulo their number)."""
    return F.element_at(F.array(*[F.lit(n) for n in names]), (index % len(names) + 1).cast("int"))


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One instruction per event, not yet numbered; sliced when the table is large."""
    return add_slices(decode_events(table(spark, sf_dir, "events")), "ts")


def decode_events(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return events.select(
        "event_id",
        "ts",
        F.col("user_id").alias("unit"),
        "event_type",
        k.alias("k"),
        (k % 10).alias("rv"),
        F.floor(k / 10).cast("int").alias("wv"),
    )


def number_events(events: DataFrame) -> DataFrame:
    return row_sequence(events, ["unit"], ["ts", "event_id"], "seq")


def program_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """unit, seq, event_type, k, read variable ``rv`` and written variable ``wv``."""
    return number_events(raw_events(spark, sf_dir))


def program_links(pe: DataFrame) -> DataFrame:
    """Each op with the variable it reads as ``var`` and the ``def_seq`` that reaches it.

    An op is spread into its read and its write, which carries no other columns, so
    the ops are numbered and shuffled once.
    """
    fixed = ["unit", "seq", *with_slice(pe)]
    others = [c for c in pe.columns if c not in fixed]
    payload = F.struct(*others)
    read = F.struct(F.col("rv").alias("var"), F.lit(0).alias("is_write"), payload.alias("_op"))
    write = F.struct(
        F.when(F.col("event_type") != "error", F.col("wv")).alias("var"), F.lit(1).alias("is_write"),
        F.when(F.lit(False), payload).alias("_op"),
    )
    accesses = pe.select(*fixed, F.inline(F.array(read, write))).where("var IS NOT NULL")
    return link_accesses(accesses, ["unit", "var"]).select(*fixed, "var", "def_seq", "_op.*")


def op_columns() -> dict[str, Column]:
    """Instruction, callee, names and place of an event."""
    kind, k = F.col("event_type"), F.col("k")
    op = (
        F.when(kind == "signup", F.when(k % 2 == 0, "Expr_FuncCall").otherwise("Expr_ArrayDimFetch"))
        .when(
            kind == "click",
            F.when(k % 3 == 0, F.concat(F.lit("Expr_BinaryOp_"), pick(BINARY_OPERATORS, k))).otherwise("Expr_Assign"),
        )
        .when(kind == "view", F.when(k % 4 == 0, pick(CAST_NAMES, F.floor(k / 4))).otherwise("Expr_FuncCall"))
        .when(
            kind == "purchase",
            F.when(k % 10 == 0, "Terminal_Echo")
            .when(k % 10 == 1, "Expr_Print")
            .when(k % 10 == 2, "Expr_Eval")
            .when(k % 10 == 3, "Expr_Include")
            .otherwise("Expr_FuncCall"),
        )
        .otherwise("Stmt_JumpIf")
    )
    callee = (
        F.when((kind == "signup") & (k % 2 == 0), pick(SOURCE_CALL_NAMES, k))
        .when((kind == "view") & (k % 4).isin(1, 2), pick(FULL_CALL_NAMES, k))
        .when((kind == "view") & (k % 4 == 3), pick(CONDITIONAL_NAMES, k))
        .when((kind == "purchase") & (k % 10 > 3), pick(SINK_CALL_NAMES, F.col("unit") + k))
    )
    read = F.when((kind == "signup") & (k % 2 == 1), pick(P.SOURCE_VARIABLES, k)).otherwise(
        F.concat(F.lit("v"), F.col("rv"))
    )
    line = F.when(k % 7 == 0, "None").otherwise((F.floor(F.col("seq") / 4) + 1).cast("int").cast("string"))
    return {
        "op": op,
        "operation": operation_name(op),
        "callee": callee,
        "read_name": read,
        "write_name": F.when(kind != "error", F.concat(F.lit("v"), F.col("wv"))),
        "file": F.concat(F.lit("f"), F.col("unit")),
        "start_line": line,
    }


def program_ops(pe: DataFrame) -> DataFrame:
    columns = op_columns()
    return pe.select("*", *[c.alias(name) for name, c in columns.items()])


def sink_arguments(ops: DataFrame) -> DataFrame:
    """Arguments of the sinks: a construct has one, a call three, the variable among them."""
    place = F.when(F.col("callee").isNull(), F.lit(1)).otherwise(F.col("k") % 3 + 1)
    count = F.when(F.col("callee").isNull(), F.lit(1)).otherwise(F.lit(3))
    return (
        ops.where("event_type = 'purchase'")
        .select("unit", "seq", "rv", place.alias("_at"), F.explode(F.sequence(F.lit(1), count)).alias("pos"))
        .select("unit", "seq", "pos", F.when(F.col("pos") == F.col("_at"), F.col("rv")).alias("var"))
    )


def user_callee(ops: DataFrame, units: int) -> Column:
    """Unit that a purchase calls."""
    return (F.col("unit") + F.col("k")) % units


def unit_count(spark: SparkSession, sf_dir: str) -> int:
    return table(spark, sf_dir, "events").agg(F.max("user_id")).first()[0] + 1


def block_columns() -> list[Column]:
    week = F.date_sub(F.to_date("ts"), F.weekday("ts")).cast("string")
    return [
        F.concat(F.col("unit").cast("string"), F.lit("/"), week).alias("unit"),
        F.concat("event_type", F.lit("_"), F.floor(F.col("k") / 25)).alias("block"),
    ]


def block_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with unit ``user/week`` and block ``type_quarter``."""
    events = raw_events(spark, sf_dir)
    others = [c for c in events.columns if c != "unit"]
    return events.select(*block_columns(), *others)


def block_edges(events: DataFrame) -> DataFrame:
    """Distinct (block, next block) in time order."""
    stepped = next_value(events, ["unit"], ["ts", "event_id"], "block", "dst")
    return stepped.where("dst IS NOT NULL").select("unit", F.col("block").alias("src"), "dst").distinct()


def block_list(events: DataFrame) -> DataFrame:
    return events.select("unit", "block").distinct()


def block_entries(events: DataFrame) -> DataFrame:
    return events.groupBy("unit").agg(F.min_by("block", F.struct("ts", "event_id")).alias("block"))


def block_mentions(events: DataFrame) -> DataFrame:
    """(unit, block, var): the two variables each event of a block mentions."""
    return events.select("unit", "block", F.explode(F.array("rv", "wv")).alias("var")).distinct()
