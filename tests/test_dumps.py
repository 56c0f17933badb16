"""Dumps of known graphs, read from files."""

import json

import pytest
from pyspark.sql import functions as F

from flowsieve.functions.operands import render_operand
from flowsieve.operators import graph, taint
from flowsieve.operators.classify import flag_ops
from flowsieve.sources import policy
from flowsieve.pipeline import analyse, corpus_keys
from flowsieve.sources.dumps import read_dump_files, read_graph_corpus


def var(id_=None, name=None, value=None):
    found = {"id": id_, "var_name": name, "value": value}
    return {k: str(v) for k, v in found.items() if v is not None}


def lit(text):
    return var(value=f"LITERAL({text})")


def op(kind, line="None", **fields):
    return {"op": kind, "file": "/x.php", "startLine": line, "endLine": line, **fields}


# $x = a() && b();
SHORT_CIRCUIT = {
    "main()": [
        {"blockId": 1, "parentBlock": [], "blocks": [
            op("Expr_FuncCall", 3, name=lit("'a'"), result=var(1)),
            op("Stmt_JumpIf", cond=var(1), **{"if": 2, "else": 3}),
        ]},
        {"blockId": 2, "parentBlock": [1], "blocks": [
            op("Expr_FuncCall", 3, name=lit("'b'"), result=var(2)),
            op("Expr_Cast_Bool", 3, expr=var(2), result=var(3)),
            op("Stmt_Jump", target=3),
        ]},
        {"blockId": 3, "parentBlock": [1, 2], "blocks": [
            op("    Var#4 = Phi(LITERAL(false), Var#3)", result=var(4), vars=[lit("false"), var(3)]),
            op("Expr_Assign", 3, var=var(5, "x"), expr=var(4), result=var(6)),
            op("Terminal_Return", expr=lit("1")),
        ]},
    ]
}

# input is echoed as it is, printed, and evaluated
FLOWS = {
    "main()": [
        {"blockId": 1, "parentBlock": [], "blocks": [
            op("Expr_ArrayDimFetch", 3, var=var(4, "_GET"), dim=lit("'x'"), result=var(5)),
            op("Expr_Assign", 3, var=var(6, "user_specified_input"), expr=var(5), result=var(7)),
            op("Expr_FuncCall", 5, name=lit("'htmlentities'"), args=[var(6, "user_specified_input")], result=var(8)),
            op("Terminal_Echo", 5, expr=var(8)),
            op("Expr_ConcatList", 6, list=[lit("'a'"), var(6, "user_specified_input")], result=var(9)),
            op("Terminal_Echo", 6, expr=var(9)),
            op("Expr_ConcatList", 7, list=[var(6, "user_specified_input")], result=var(10)),
            op("Expr_Print", 7, expr=var(10), result=var(11)),
            op("Expr_Eval", 8, expr=var(6, "user_specified_input"), result=var(12)),
            op("Terminal_Return", expr=lit("1")),
        ]},
    ]
}

SWITCH = {
    "Foo::bar()": [
        {"blockId": 1, "parentBlock": [], "blocks": [
            op("Expr_Param", 1, name=lit("'p'"), result=var(1, "p")),
            op("Stmt_Switch", 2, cond=var(1, "p"), cases=[[lit("1")], lit("2")], targets=[2, 3], default=4),
        ]},
        {"blockId": 2, "parentBlock": [1], "blocks": [op("Expr_MethodCall", 3, var=var(1, "p"), name=lit("'run'"), args=[lit("3")], result=var(2))]},
        {"blockId": 3, "parentBlock": [1], "blocks": [op("Expr_BinaryOp_Plus", 4, left=var(1, "p"), right=lit("1"), result=var(3))]},
        {"blockId": 4, "parentBlock": [1], "blocks": [op("Expr_StaticCall", 5, **{"class": lit("'K'")}, name=lit("'go'"), result=var(4))]},
    ]
}


@pytest.fixture(scope="module")
def facts(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("dumps")
    for name, dump in {"and": SHORT_CIRCUIT, "flows": FLOWS, "switch": SWITCH}.items():
        (folder / f"{name}.json").write_text(json.dumps(dump))
    return read_dump_files(spark, str(folder))


def of(table, program):
    return table.where(F.col("program") == program)


def test_operands(facts):
    rows = of(facts.operands, "and.json").select("block", "seq", "role", "pos", render_operand(F.col("var")).alias("v"))
    got = {tuple(r) for r in rows.collect()}
    assert {(1, 0, "out", 1, "Var#1"), (3, 0, "in", 1, "LITERAL(false)"), (3, 0, "in", 2, "Var#3")} <= got
    assert {(3, 0, "out", 1, "Var#4"), (3, 1, "out", 1, "Var#5<$x>"), (3, 1, "in", 1, "Var#4"), (3, 1, "res", 1, "Var#6")} <= got


def test_array_index_joins_the_operand(facts):
    rows = of(facts.operands, "flows.json").where("op = 'Expr_ArrayDimFetch' AND role = 'in'")
    assert rows.select(render_operand(F.col("var"))).first()[0] == "Var#4<$_GET>[LITERAL('x')]"


def test_edges_and_units(facts):
    edges = {tuple(r) for r in of(facts.edges, "and.json").select("src", "label", "dst").collect()}
    assert edges == {(1, "if", 2), (1, "else", 3), (2, "target", 3)}
    cases = {tuple(r) for r in of(facts.edges, "switch.json").select("label", "dst").collect()}
    assert cases == {("LITERAL(1)", 2), ("LITERAL(2)", 3), ("default", 4)}
    unit = of(facts.units, "switch.json").first()
    assert (unit["unit"], unit["class"], unit["name"]) == ("Foo::bar", "Foo", "bar")
    assert of(facts.params, "switch.json").select("pos", "var.name").first() == (1, "p")


def test_calls(facts):
    calls = {tuple(r) for r in of(facts.ops, "switch.json").where("callee IS NOT NULL").select("op", "scope", "callee").collect()}
    assert calls == {("Expr_MethodCall", "p", "run"), ("Expr_StaticCall", "K", "go")}
    assert {r["op"] for r in of(facts.ops, "and.json").where("block = 3").collect()} == {"Phi", "Expr_Assign", "Terminal_Return"}


def test_reachable(spark, facts):
    edges = of(facts.edges, "and.json").select("unit", F.col("src"), "dst")
    entry = spark.createDataFrame([("main", 1)], "unit string, block int")
    assert {tuple(r) for r in graph.reachable_blocks(edges, entry).select("block", "level").collect()} == {(1, 0), (2, 1), (3, 1)}


def test_three_findings(spark, facts):
    """Echo and print of input are cross-site scripting, eval is code execution."""
    site = policy.site_policy(spark)
    ops = of(facts.ops, "flows.json").withColumn("read_name", F.lit(None).cast("string"))
    operands = of(facts.operands, "flows.json").select(
        "unit", "seq", "role", "pos", render_operand(F.col("var")).alias("var"), F.col("var.name").alias("name")
    )
    listed = site.where("kind = 'source_variable'").select("name")
    seeds = operands.where("role = 'in'").join(listed, "name", "left_semi").select("unit", "var")
    flags = flag_ops(ops, site).where("NOT is_full AND conditional IS NULL").select("unit", "seq")
    ins = operands.where("role = 'in'").select("unit", "seq", "var")
    outs = operands.where("role = 'out'").select("unit", "seq", F.col("var").alias("to_var"))
    flows = ins.join(outs, ["unit", "seq"]).join(flags, ["unit", "seq"], "left_semi").select(
        "unit", "var", F.col("unit").alias("to_unit"), "to_var"
    )
    state = taint.taint_fixpoint(seeds, flows).withColumn("tainted", F.lit(True))
    arguments = (
        operands.where("role = 'in'").join(state, ["unit", "var"], "left")
        .select("unit", "seq", "pos", F.coalesce("tainted", F.lit(False)).alias("tainted"), F.array().cast("array<string>").alias("sanitizers"))
    )
    found = taint.report_flows(ops, arguments, site, policy.category_names(spark))
    got = sorted((r["start_line"], r["category"], r["message"]) for r in found.collect())
    assert [g[:2] for g in got] == [("6", "XSS"), ("7", "XSS"), ("8", "CODE")]
    assert got[2][2] == "*Dangerous: Tainted Input(s). Possible Code Execution*"


def test_analyse_gives_the_three_findings(spark, facts):
    found = analyse(facts, policy.site_policy(spark), policy.category_names(spark)).collect()
    assert sorted((r["program"], r["unit"], r["start_line"], r["category"]) for r in found) == [
        ("flows.json", "main", "6", "XSS"), ("flows.json", "main", "7", "XSS"), ("flows.json", "main", "8", "CODE"),
    ]


def test_programs_do_not_mix(spark):
    """Both programs have a unit main; one declares a function that the other only names."""
    tainted = op("Expr_Assign", 2, var=var(1, "a"), expr=var(2, "_GET"), result=var(3))
    call = op("Expr_FuncCall", 3, name=lit("'show'"), args=[var(1, "a")], result=var(4))
    show = {"show()": [{"blockId": 1, "parentBlock": [], "blocks": [
        op("Expr_Param", 8, name=lit("'x'"), result=var(1, "x")), op("Terminal_Echo", 9, expr=var(1, "x"))]}]}
    block = lambda n, *ops: {"blockId": n, "parentBlock": [], "blocks": list(ops)}
    jump = lambda to: op("Stmt_Jump", 1, target=to)
    dumps = [
        ("p1", json.dumps({"main()": [block(1, tainted, call, jump(2)), block(2)], **show})),
        ("p2", json.dumps({"main()": [block(2, tainted, call, op("Expr_Exit", 4), op("Terminal_Echo", 5, expr=var(1, "a")), jump(3)), block(3)]})),
    ]
    both = read_graph_corpus(spark.createDataFrame(dumps, "program string, text string"))
    keyed = corpus_keys(both)
    entry = keyed.units.where("unit_name = 'main'").select("unit", F.lit(1).alias("block"))
    reached = {tuple(r) for r in graph.reachable_blocks(keyed.edges.select("unit", "src", "dst"), entry).collect()}
    assert ("p1#main", 2, 1) in reached and not any(b == 3 for _, b, _ in reached)
    found = analyse(both, policy.site_policy(spark), policy.category_names(spark)).collect()
    assert [(r["program"], r["unit"], r["start_line"]) for r in found] == [("p1", "show", "9")]


def program(**units):
    return json.dumps({f"{name}()": [{"blockId": 1, "parentBlock": [], "blocks": ops}] for name, ops in units.items()})


def found_in(spark, dumps, **options):
    facts = read_graph_corpus(spark.createDataFrame(dumps, "program string, text string"))
    found = analyse(facts, policy.site_policy(spark), policy.category_names(spark), **options).collect()
    return sorted((r["program"] or "", r["unit"], r["start_line"]) for r in found)


def call(name, line, result, *args):
    return op("Expr_FuncCall", line, name=lit(f"'{name}'"), args=list(args), result=var(result))


INPUT = op("Expr_ArrayDimFetch", 1, var=var(90, "_GET"), dim=lit("'x'"), result=var(1, "a"))
SAME = [op("Expr_Param", 20, name=lit("'x'"), result=var(50, "x")), op("Terminal_Return", 21, expr=var(50, "x"))]


def test_a_return_reaches_its_own_caller_only(spark):
    main = [INPUT, call("same", 2, 2, var(1, "a")), op("Terminal_Echo", 3, expr=var(2))]
    clean = [call("same", 12, 62, lit("'text'")), op("Terminal_Echo", 13, expr=var(62))]
    assert found_in(spark, [("p", program(main=main, other=clean, same=SAME))]) == [("p", "main", "3")]


def test_names_of_programs_are_kept(spark):
    main = [INPUT, op("Terminal_Echo", 3, expr=var(1, "a"))]
    names = ["a#b.php", "a", "a\\#b", None]
    got = found_in(spark, [(name, program(main=main, **{"b.php": SAME})) for name in names])
    assert got == sorted((name or "", "main", "3") for name in names)


def test_native_calls_and_includes(spark):
    push = [INPUT, call("array_push", 2, 3, var(7, "list"), var(1, "a")), op("Terminal_Echo", 3, expr=var(7, "list"))]
    assert found_in(spark, [("p", program(main=push))]) == [("p", "main", "3")]
    hand = [INPUT, op("Expr_Include", 2, expr=lit("'lib/show.php'"), result=var(4))]
    shown = [op("Terminal_Echo", 30, expr=var(33, "a")), op("Terminal_Echo", 31, expr=var(34, "other"))]
    dumps = [("p", program(main=hand, **{"main_show.php": shown}))]
    assert found_in(spark, dumps) == [("p", "main_show.php", "30")]
    assert found_in(spark, dumps, follow_includes=False) == []


def test_a_name_that_is_sink_and_sanitizer_or_source(spark):
    """A tainted argument counts whatever the sink makes of it, and a source is no finding by itself."""
    body = [INPUT, call("readlink", 2, 5, var(1, "a")), op("Terminal_Echo", 3, expr=var(5)), call("file_get_contents", 4, 6, lit("'f'")), op("Terminal_Echo", 5, expr=var(6))]
    assert found_in(spark, [("p", program(main=body))]) == [("p", "main", "2"), ("p", "main", "5")]


def test_sanitizers_over_merges(spark):
    """A merged value counts as escaped only if both of its operands are."""
    def merged(second):
        return [
            INPUT, call("addslashes", 2, 5, var(1, "a")), second,
            op("Phi", 4, vars=[var(5), var(6)], result=var(7)), call("mysql_query", 5, 8, var(7)),
        ]

    both = merged(call("addslashes", 3, 6, var(1, "a")))
    one = merged(op("Expr_Assign", 3, var=var(6), expr=var(1, "a"), result=var(9)))
    assert found_in(spark, [("p", program(main=both)), ("q", program(main=one))], strict=True) == [("q", "main", "5")]


def test_no_programs(spark):
    assert found_in(spark, []) == []
    assert found_in(spark, [("p", program(main=[INPUT]))]) == []


def everything(facts):
    """All tables as sets of texts."""
    return {
        name: sorted(str(sorted(r.asDict(True).items(), key=str)) for r in getattr(facts, name).collect())
        for name in ("units", "blocks", "ops", "operands", "edges", "params", "returns")
    }


def test_large_files_are_read_in_pieces(spark, tmp_path):
    """Blocks of a file in many splits belong to their units, whatever stands in texts and names."""
    make = lambda k: [op("Expr_Assign", k, var=var(j, f"v{j}"), expr=lit("'{\"blockId\":1}],\"x()\":['"), result=var(100 + j)) for j in range(k % 7)]
    units = {f"C\\{{closure}}#{u}::run()": [{"blockId": b + 1, "parentBlock": [b], "blocks": make(u + b)} for b in range(1 + u % 9)] for u in range(120)}
    for name, dump in {"big": {"main()": [], **units}, "flows": FLOWS, "switch": SWITCH, "and": SHORT_CIRCUIT}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(dump, separators=(",", ":")).replace('"main()":[],', ""))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        assert spark.read.text(str(tmp_path), lineSep='{"blockId":').rdd.getNumPartitions() > 8
        from flowsieve.sources.dumps import read_large_dumps

        pieces = everything(read_large_dumps(spark, str(tmp_path)))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert pieces == everything(read_dump_files(spark, str(tmp_path)))
    assert len(pieces["units"]) == 123


def test_a_file_that_is_no_dump(spark, tmp_path):
    from flowsieve.sources.dumps import read_large_dumps

    (tmp_path / "x.json").write_text('{"blockId":1,"blocks":[]')
    with pytest.raises(ValueError, match="no block"):
        read_large_dumps(spark, str(tmp_path))


def test_more_sanitizers_than_a_mask_has_bits(spark):
    """Of ninety sanitizers the last is accepted by the sink, whether it is the only one on the way or not."""
    rows = [("conditional_sanitizer", "X", 1, f"clean{k:03d}", [], []) for k in range(90)]
    rows += [("sink", "XSS", 0, "sink_it", [0], ["clean089"]), ("source_variable", "USERINPUT", 0, "_GET", [], [])]
    site = policy.rows_to_table(spark, rows)
    assert [len(w) for w in taint.sanitizer_words(site)] == [62, 28]

    def through(*names):
        body, last = [INPUT], var(1, "a")
        for k, name in enumerate(names):
            body.append(call(name, 2, 10 + k, last))
            last = var(10 + k)
        return program(main=[*body, call("sink_it", 3, 5, last)])

    dumps = [("one", through("clean089")), ("both", through("clean001", "clean089")), ("other", through("clean001")), ("none", through())]
    facts = read_graph_corpus(spark.createDataFrame(dumps, "program string, text string"))
    found = analyse(facts, site, policy.category_names(spark), strict=True).collect()
    assert sorted(r["program"] for r in found) == ["none", "other"]
