"""Column functions on operands, literals, names and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the text form of a literal. (?d) makes only \n a line end.
LITERAL_PART = r"(?d)LITERAL\('?(.*?)'?\)"
LITERAL_WHOLE = r"(?d)^LITERAL\('?(.*?)'?\)$"

OPERAND_FIELDS = {
    "type": ("string", None),
    "by_ref": ("boolean", False),
    "value": ("string", ""),
    "scope": ("string", ""),
    "name": ("string", ""),
    "dim": ("string", ""),
    "id": ("string", "-1"),
}
# field of the operand struct -> key in the dump
DUMP_KEYS = {"by_ref": "byRef", "name": "var_name"}


def normalise_operand(source: dict[str, Column]) -> Column:
    """Struct with every operand field, absent keys replaced by their defaults."""
    fields = []
    for field, (dtype, default) in OPERAND_FIELDS.items():
        given = source.get(field, F.lit(None)).cast(dtype)
        fields.append((given if default is None else F.coalesce(given, F.lit(default))).alias(field))
    return F.struct(*fields)


def render_operand(var: Column) -> Column:
    """Key text of an operand struct: ``Var#id scope<$name>[dim]`` or the bare value."""
    mark = F.when(var["by_ref"], F.lit("&")).otherwise(F.lit(""))
    named = var["name"] != ""
    no_id = F.when(
        named, F.concat(var["scope"], F.lit("<"), mark, F.lit("$"), var["name"], F.lit(">"))
    ).otherwise(var["value"])
    label = F.when(named, F.concat(F.lit("<"), mark, F.lit("$"), var["name"], F.lit(">"))).otherwise(mark)
    dim = F.when(var["dim"] != "", F.concat(F.lit("["), var["dim"], F.lit("]"))).otherwise(F.lit(""))
    with_id = F.concat(F.lit("Var#"), var["id"], var["scope"], label, dim)
    return F.when(var["id"] == "-1", no_id).otherwise(with_id)


def operand_key(var: Column) -> Column:
    """What makes two operands of a unit the same variable."""
    return F.struct(var["value"].alias("value"), var["id"].alias("id"), var["name"].alias("name"))


def is_literal(value: Column) -> Column:
    return value.rlike(LITERAL_PART)


def parse_literal(value: Column) -> Column:
    """``True``/``False``, digits, or quoted text; null when it is no literal."""
    inner = F.regexp_extract(value, LITERAL_WHOLE, 1)
    return F.when(
        value.rlike(LITERAL_WHOLE),
        F.when(F.lower(inner).isin("true", "false"), F.initcap(inner))
        .when(inner.rlike(r"^[0-9]+$"), inner)
        .otherwise(F.concat(F.lit("'"), inner, F.lit("'"))),
    )


def strip_literal(value: Column) -> Column:
    """Name inside ``LITERAL('...')``; other text unchanged."""
    inner = F.substring(value, F.lit(10), F.length(value) - 11)
    return F.when(value.startswith("LITERAL("), inner).otherwise(value)


def callee_name(name: Column, scope: Column) -> Column:
    """``scope::name``, or the name alone when there is no scope."""
    return F.concat_ws("::", strip_literal(scope), strip_literal(name))


def operation_name(op: Column) -> Column:
    """``Terminal_Echo`` -> ``echo``; the text after the first underscore."""
    return F.lower(F.regexp_replace(op, r"^[^_]*_?", ""))


def resolve_path(target: Column, against: Column) -> Column:
    """Absolute path of ``target`` seen from the file ``against``; ``.`` and ``..`` folded."""
    folder = F.regexp_replace(against, r"[^/]*$", "")
    joined = F.when(target.startswith("/"), target).otherwise(F.concat(folder, target))
    parts = F.aggregate(
        F.split(joined, "/"),
        F.array().cast("array<string>"),
        lambda done, part: F.when(part.isin("", "."), done)
        .when(part == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
        .otherwise(F.array_append(done, part)),
    )
    return F.concat(F.lit("/"), F.array_join(parts, "/"))


def flatten_nested(nested: Column) -> Column:
    """One level of a typed nested list; text of any depth goes through ``flatten_json``."""
    return F.flatten(nested)


def flatten_json(nested: Column) -> Column:
    """The scalars of a JSON list nested to any depth, in their order, as text; null for a JSON null."""
    scalars = F.regexp_extract_all(nested, F.lit(r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|[^\s,\[\]]+'), F.lit(0))
    return F.transform(scalars, lambda s: F.get_json_object(F.concat(F.lit("["), s, F.lit("]")), "$[0]"))
