"""Evaluation of operators and casts over columns, with a symbolic form for unknowns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Binary operators with a symbolic form, and the sign used in it.
SYMBOLS = {
    "Equal": "==",
    "Identical": "==",
    "NotEqual": "!=",
    "NotIdentical": "!=",
    "Greater": ">",
    "GreaterOrEqual": ">=",
    "Smaller": "<",
    "SmallerOrEqual": "<=",
    "Plus": "+",
    "Minus": "-",
    "Mul": "*",
    "Div": "/",
    "Mod": "%",
    "Pow": "**",
}
# Operators whose symbolic form is left open, and those without one.
OPEN_OPERATORS = ["BitwiseAnd", "BitwiseOr", "BitwiseXor", "Concat", "ShiftLeft", "ShiftRight"]
VALUE_ONLY = ["Coalesce", "LogicalXor", "Spaceship"]
BINARY_OPERATORS = [*SYMBOLS, *OPEN_OPERATORS, *VALUE_ONLY]
OPEN_TEXT = "NOT IMPLEMENTED"

CASTS = ["Array", "Bool", "Double", "Int", "Object", "String", "Unset"]

# Comparator -> its complement.
COMPLEMENT = {"=": "!=", "!=": "=", ">": "<=", "<=": ">", "<": ">=", ">=": "<"}

# Type predicates and the type they test.
TYPE_PREDICATES = {
    "is_array": "array",
    "is_bool": "bool",
    "is_callable": "callable",
    "is_double": "float",
    "is_float": "float",
    "is_int": "int",
    "is_integer": "int",
    "is_long": "int",
    "is_null": "null",
    "is_numeric": "numeric",
    "is_object": "object",
    "is_real": "float",
    "is_string": "string",
    "is_resource": "resource",
}


def _case(op: Column, branches: dict[str, Column]) -> Column:
    out = None
    for name, value in branches.items():
        out = F.when(op == name, value) if out is None else out.when(op == name, value)
    return out


def symbol_of(op: Column) -> Column:
    return _case(op, {name: F.lit(sign) for name, sign in SYMBOLS.items()})


def symbolic_binary(op: Column, left: Column, right: Column) -> Column:
    """``((left) sign (right))``; operators without a sign stay open or null."""
    text = F.concat(F.lit("(("), left, F.lit(") "), symbol_of(op), F.lit(" ("), right, F.lit("))"))
    return F.when(op.isin(OPEN_OPERATORS), F.lit(OPEN_TEXT)).otherwise(text)


def eval_binary(op: Column, left: Column, right: Column) -> Column:
    """Struct of number, flag, text and expression; one is set, the rest null.

    The operands are BIGINT. An unknown (null) operand leaves the expression with
    ``?`` in its place, except for ``Coalesce``, which is there for such values.
    """
    number = {
        "Plus": F.try_add(left, right).cast("double"),
        "Minus": F.try_subtract(left, right).cast("double"),
        "Mul": F.try_multiply(left, right).cast("double"),
        "Div": F.try_divide(left.cast("double"), right.cast("double")),
        "Mod": F.try_mod(left, right).cast("double"),
        "Pow": F.pow(left.cast("double"), right.cast("double")),
        "BitwiseAnd": left.bitwiseAND(right).cast("double"),
        "BitwiseOr": left.bitwiseOR(right).cast("double"),
        "BitwiseXor": left.bitwiseXOR(right).cast("double"),
        "ShiftLeft": F.call_function("shiftleft", left, right.cast("int")).cast("double"),
        "ShiftRight": F.call_function("shiftright", left, right.cast("int")).cast("double"),
        "Spaceship": F.signum((left - right).cast("double")),
    }
    flag = {
        "Equal": left == right,
        "Identical": left == right,
        "NotEqual": left != right,
        "NotIdentical": left != right,
        "Greater": left > right,
        "GreaterOrEqual": left >= right,
        "Smaller": left < right,
        "SmallerOrEqual": left <= right,
        "LogicalXor": (left != 0) != (right != 0),
    }
    known = left.isNotNull() & right.isNotNull()
    show = [F.coalesce(c.cast("string"), F.lit("?")) for c in (left, right)]
    return F.struct(
        F.when(op == "Coalesce", F.coalesce(left, right).cast("double"))
        .when(known, _case(op, number))
        .alias("number"),
        F.when(known, _case(op, flag)).alias("flag"),
        F.when(known & (op == "Concat"), F.concat(left.cast("string"), right.cast("string"))).alias("text"),
        F.when(~known & (op != "Coalesce"), symbolic_binary(op, *show)).alias("expr"),
    )


def eval_cast(name: Column, value: Column) -> Column:
    """Struct with the value under each cast kind; only the named kind is set."""
    return F.struct(
        F.when(name == "Array", F.array(value)).alias("array"),
        F.when(name == "Bool", value.try_cast("boolean")).alias("bool"),
        F.when(name == "Double", value.try_cast("double")).alias("double"),
        F.when(name == "Int", value.try_cast("bigint")).alias("int"),
        F.when(name == "Object", F.struct(value.alias("scalar"))).alias("object"),
        F.when(name == "String", value).alias("string"),
    )


def fold_constants(op: Column, left: Column, right: Column) -> Column:
    """Text of an operation: its value when both operand texts are numbers, else symbolic."""
    value = eval_binary(op, left.try_cast("bigint"), right.try_cast("bigint"))
    number = value["number"]
    whole = F.when(number == F.floor(number), number.cast("bigint").cast("string")).otherwise(number.cast("string"))
    flag = F.when(value["flag"], F.lit("True")).when(~value["flag"], F.lit("False"))
    return F.coalesce(flag, whole, value["text"], symbolic_binary(op, left, right))


def negate_condition(comparator: Column) -> Column:
    """Comparator of the else edge; an unknown one becomes ``true``."""
    return F.coalesce(_case(comparator, {a: F.lit(b) for a, b in COMPLEMENT.items()}), F.lit("true"))


def guard_type(callee: Column) -> Column:
    """Type that an ``is_*`` predicate tests, else null."""
    return _case(F.lower(callee), {a: F.lit(b) for a, b in TYPE_PREDICATES.items()})


def render_message(category_name: Column) -> Column:
    return F.concat(F.lit("*Dangerous: Tainted Input(s). Possible "), category_name, F.lit("*"))
