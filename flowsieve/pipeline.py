"""From the fact tables of a corpus to its findings, in one call."""

from __future__ import annotations

from dataclasses import fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsieve.functions.operands import is_literal, render_operand, strip_literal
from flowsieve.operators import calls as calls_of
from flowsieve.operators import taint
from flowsieve.operators.classify import classify_sinks, classify_source_vars, flag_ops
from flowsieve.operators.filters import truncate_at_exit
from flowsieve.operators.links import bind_arguments, link_includes
from flowsieve.session import cut, sizes_in_memory
from flowsieve.sources.dumps import Facts

SEPARATOR = "#"


def corpus_key(program: Column, unit: Column) -> Column:
    """One text for program and unit; different pairs have different texts, whatever signs a program's name has."""
    plain = F.replace(F.replace(program, F.lit("\\"), F.lit("\\\\")), F.lit(SEPARATOR), F.lit("\\" + SEPARATOR))
    return F.concat(F.coalesce(plain, F.lit("\\0")), F.lit(SEPARATOR), unit)


def corpus_keys(facts: Facts) -> Facts:
    """The tables with a ``unit`` that is unique in the corpus (program and unit), for operators keyed by unit.

    Every program has a unit ``main``; without this, facts of different programs would meet.
    The unit's own name stays as ``unit_name``, the program's as ``program``.
    """
    key = corpus_key(F.col("program"), F.col("unit"))
    named = lambda df: df.withColumn("unit_name", F.col("unit")).withColumn("unit", key)
    return Facts(**{f.name: named(getattr(facts, f.name)) for f in fields(facts)})


def call_targets(ops: DataFrame, units: DataFrame) -> DataFrame:
    """Calls of declared units of the same program: (unit, seq, callee); other calls are native."""
    name = F.when(F.col("scope").isNotNull() & (F.col("op") == "Expr_StaticCall"), F.concat_ws("::", "scope", "callee"))
    key = corpus_key(F.col("program"), F.coalesce(name, "callee"))
    wanted = ops.where("callee IS NOT NULL").select("unit", "seq", key.alias("callee"))
    return wanted.join(units.select(F.col("unit").alias("callee")).distinct(), "callee", "left_semi")


def included_units(ops: DataFrame, ins: DataFrame, units: DataFrame) -> DataFrame:
    """Includes of a literal path whose file is a unit of the same program: (unit, call, callee)."""
    sites = ops.where("op = 'Expr_Include'").select("unit", "seq", "program")
    named = ins.where(is_literal(F.col("value"))).select("unit", "seq", strip_literal(F.col("value")).alias("path"))
    paths = sites.join(named, ["unit", "seq"])
    known = units.select("program", F.col("unit_name").alias("unit")).distinct()
    found = link_includes(paths, known.select("unit").distinct()).where("target IS NOT NULL")
    found = found.withColumn("callee", corpus_key(F.col("program"), F.col("target")))
    keyed = units.select(F.col("unit").alias("callee")).distinct()
    return found.select("unit", "seq", "callee").join(keyed, "callee", "left_semi").select("unit", F.col("seq").alias("call"), "callee")


def analyse(
    facts: Facts, policy: DataFrame, categories: DataFrame, strict: bool = False, follow_includes: bool = True
) -> DataFrame:
    """Findings of a corpus: one per program, file and line.

    Programs without a sink and instructions behind an ``exit`` are left out. Sources seed taint, an instruction
    hands it from its inputs to its outputs (a merge from all of its operands), a native call that passes taint between its
    arguments does so; a call of a declared unit hands its arguments to the parameters and gets what the
    unit returns for them: a return goes back to its own call only. An include of a literal path hands the
    variables that the included unit asks for to that unit by their names. Tainted arguments of sinks without an
    accepted sanitizer are findings. Plain mode: a conditional sanitizer clears; ``strict``: it is remembered where it
    lies on all ways, and counts for the sinks that accept it. Everything is keyed by program and unit.
    """
    with sizes_in_memory(facts.ops.sparkSession):
        return cut(_analyse(facts, policy, categories, strict, follow_includes))


def _analyse(facts: Facts, policy: DataFrame, categories: DataFrame, strict: bool, follow_includes: bool) -> DataFrame:
    facts = corpus_keys(facts)
    # one number per instruction of a unit
    place = F.shiftleft(F.col("block").cast("long"), 32) + F.col("seq")
    ops = truncate_at_exit(facts.ops, ["unit", "block"]).withColumn("seq", place)
    ops = cut(flag_ops(ops.withColumn("read_name", F.lit(None).cast("string")), policy))
    watched = cut(classify_sinks(ops, policy).select(F.coalesce("program", F.lit("\\0")).alias("_p")).distinct())
    ops = cut(ops.join(watched, F.coalesce("program", F.lit("\\0")) == F.col("_p"), "left_semi"))
    shown = facts.operands.select(
        "unit", place.alias("seq"), "role", "pos", render_operand(F.col("var")).alias("var"), F.col("var.name").alias("name"), F.col("var.value").alias("value")
    )
    operands = cut(shown.join(ops.select("unit", "seq"), ["unit", "seq"], "left_semi"))
    ins, outs = operands.where("role = 'in'"), operands.where("role = 'out'")
    none = F.lit(0).cast("long")

    calls = cut(call_targets(ops, facts.units))
    native = cut(ops.join(calls, ["unit", "seq"], "left_anti").select("unit", "seq", "callee", "is_source", "is_full", "conditional"))
    open_ops = native.where("NOT is_full" if strict else "NOT is_full AND conditional IS NULL")
    generating = native.where("is_source AND NOT is_full AND conditional IS NULL").select("unit", "seq")
    sources = classify_source_vars(ins, policy).select("unit", "var")
    sources = sources.unionByName(outs.join(generating, ["unit", "seq"], "left_semi").select("unit", "var")).distinct()

    words = taint.sanitizer_words(policy) if strict else [[]]
    written = outs.select("unit", "seq", F.col("var").alias("to_var"))
    inside = cut(ins.select("unit", "seq", "var").join(written, ["unit", "seq"]).join(open_ops, ["unit", "seq"]).select("unit", "var", "to_var", "conditional"))
    passed = calls_of.native_flows(ins.join(native.where("callee IS NOT NULL").select("unit", "seq", "callee"), ["unit", "seq"]), policy, ["unit", "seq"])
    params = facts.params.select("unit", "pos", render_operand(F.col("var")).alias("var"))
    arguments = bind_arguments(ins.join(calls, ["unit", "seq"]), params).select("unit", F.col("seq").alias("call"), "var", "callee", "param")
    if follow_includes:
        sites = cut(included_units(ops, ins, facts.units))
        named = operands.where("name <> ''")
        own = outs.select("unit", "name").distinct()
        asked = named.where("role = 'in'").select("unit", "name", "var").distinct().join(own, ["unit", "name"], "left_anti")
        asked = asked.select(F.col("unit").alias("callee"), "name", F.col("var").alias("param"))
        visible = sites.select("unit", "call").join(named.select("unit", "name", "var").distinct(), "unit")
        arguments = arguments.unionByName(calls_of.include_arguments(sites, asked, visible))
    arguments = cut(arguments.distinct())
    outputs = cut(calls.join(written, ["unit", "seq"]).select("unit", F.col("seq").alias("call"), "callee", F.col("to_var").alias("var")))
    returns = cut(facts.returns.select("unit", render_operand(F.col("var")).alias("var")))
    filled = cut(arguments.select(F.col("callee").alias("unit"), F.col("param").alias("var")).distinct())
    sources, passed = cut(sources), cut(passed)

    def state_of(names: list[str]) -> DataFrame:
        clears = F.coalesce(taint.sanitizer_bit(names, F.col("conditional")), none).alias("clears")
        flows = inside.select("unit", "var", "to_var", clears).unionByName(passed)
        flows = flows.groupBy("unit", "var", "to_var").agg(F.bit_and("clears").alias("clears"))
        return calls_of.matched_taint(flows, arguments, outputs, returns, sources, filled)

    state = taint.by_words(words, state_of, ["unit", "var"]).withColumn("tainted", F.lit(True))
    given = ins.join(state, ["unit", "var"], "left").select("unit", "seq", "pos", "tainted", "sanitizers")
    found = taint.find_flows(ops, given, policy, categories)
    kept = taint.dedupe_findings(found, ["program", "file", "start_line"], ["unit_name", "seq", "category", "message"])
    return kept.select("program", F.col("unit_name").alias("unit"), "file", "start_line", "category", "message")
