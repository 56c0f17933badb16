"""Feasible walks, shared expressions and nested guards against fixtures and brute force."""

import itertools
import random

import pytest

from flowsieve.operators import guards as G
from flowsieve.operators import symbolic
from flowsieve.operators import walks as W
from flowsieve.operators.symbolic import expression_texts, symbolic_values
from flowsieve.session import cut, cut_counted

EDGES = "unit string, src string, dst string"
ENTRIES = "unit string, block string"
CONDITIONS = "unit string, src string, dst string, var string, cmp string, const int"
WRITES = "unit string, block string, var string"
SIGNS = {
    "=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
}


def holds(conditions):
    """Whether some whole numbers meet (var, cmp, const) rows; constants lie between 0 and 5."""
    for var in {c[0] for c in conditions}:
        mine = [c for c in conditions if c[0] == var]
        if not any(all(SIGNS[cmp](v, const) for _, cmp, const in mine) for v in range(-9, 16)):
            return False
    return True


def brute_walks(edges, conditions, writes, entry, bound):
    found, queue = [], [([entry], [])]
    while queue:
        path, asked = queue.pop()
        found.append(path)
        for _, src, dst in edges:
            if src != path[-1] or path.count(dst) >= bound:
                continue
            met = asked + [(v, c, k) for _, s, d, v, c, k in conditions if (s, d) == (src, dst)]
            if holds(met):
                gone = {v for _, b, v in writes if b == dst}
                queue.append((path + [dst], [m for m in met if m[0] not in gone]))
    return found


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_walks_against_brute_force(spark, seed):
    make = random.Random(seed)
    blocks = "abcde"
    edges = sorted({("u", make.choice(blocks), make.choice(blocks)) for _ in range(8)})
    conditions = [(*make.choice(edges), make.choice("xy"), make.choice(list(SIGNS)), make.randint(0, 5)) for _ in range(7)]
    writes = [("u", make.choice(blocks), make.choice("xy"))]
    tables = [
        spark.createDataFrame(edges, EDGES), spark.createDataFrame([("u", "a")], ENTRIES),
        spark.createDataFrame(conditions, CONDITIONS), spark.createDataFrame(writes, WRITES),
    ]
    found = W.walk_texts(W.feasible_walks(*tables, max_loop=2))
    expected = brute_walks(edges, conditions, writes, "a", 2)
    assert sorted(r["path"] for r in found.collect()) == sorted(">".join(p) for p in expected)
    # with a high bound every state has been met
    long = brute_walks(edges, conditions, writes, "a", 3)
    steps = {("u", a, b) for p in long for a, b in itertools.pairwise(p)}
    graph = W.feasible_states(*tables)
    assert steps <= {tuple(r) for r in graph.edges.collect()}
    assert {p[-1] for p in long} <= {r["block"] for r in graph.blocks().collect()}


@pytest.mark.parametrize("limit", ["3", "200000"])
def test_walks_are_followed_whole_whatever_a_task_may_follow(spark, limit, monkeypatch):
    """Units of one name and of many walks, null blocks and repeated entries; as texts and as paths, and few jobs where a task has room."""
    make = random.Random(8)
    edges, conditions, writes, expected, steps = [], [], [], [], set()
    for unit in "uvw":
        mine = sorted({(unit, make.choice("abcd"), make.choice("abcd")) for _ in range(9)})
        asks = [(*make.choice(mine), make.choice("xy"), make.choice(list(SIGNS)), make.randint(0, 5)) for _ in range(6)]
        gone = [(unit, make.choice("abcd"), "x")]
        edges, conditions, writes = edges + mine, conditions + asks, writes + gone
        expected += [(unit, ">".join(p)) for p in brute_walks(mine, asks, gone, "a", 2)]
        steps |= {(unit, a, b) for p in brute_walks(mine, asks, gone, "a", 3) for a, b in itertools.pairwise(p)}
    starts = [("u", "a"), ("v", "a"), ("w", "a"), ("v", "a"), (None, "a"), ("x", None)]
    expected += [walk for walk in expected if walk[0] == "v"] + [(None, "a"), ("x", "")]
    tables = [
        spark.createDataFrame(edges, EDGES), spark.createDataFrame(starts, ENTRIES),
        spark.createDataFrame(conditions, CONDITIONS), spark.createDataFrame(writes, WRITES),
    ]
    rounds = []
    monkeypatch.setattr(W, "PART_WALKS", 2)
    monkeypatch.setattr(W, "cut_counted", lambda *args: rounds.append(1) or cut_counted(*args))
    spark.conf.set("flowsieve.rows.per.group", limit)
    order = lambda walk: (walk[0] or "", walk[1])
    try:
        found = W.feasible_walks(*tables, max_loop=2, separator=">")
        assert sorted(((r["unit"], r["path"]) for r in found.collect()), key=order) == sorted(expected, key=order)
        if limit == "200000":
            assert len(rounds) <= 3
            return
        graph = W.feasible_states(*tables)
        assert steps <= {tuple(r) for r in graph.edges.collect()}
        assert {(r["unit"], r["block"]) for r in graph.blocks().collect()} >= {(u, p[-1:] or None) for u, p in expected}
    finally:
        spark.conf.unset("flowsieve.rows.per.group")


def test_states_are_the_same_in_tasks_and_step_by_step(spark):
    make = random.Random(3)
    edges = sorted({(u, make.choice("abcde"), make.choice("abcde")) for u in "uv" for _ in range(12)})
    conditions = [(*make.choice(edges), make.choice(["x", "y", None]), make.choice([*SIGNS, "~", None]), make.choice([0, 1, 2, 3, None])) for _ in range(14)]
    tables = [spark.createDataFrame(edges, EDGES), spark.createDataFrame([("u", "a"), ("v", "a")], ENTRIES), spark.createDataFrame(conditions, CONDITIONS)]
    found = []
    for limit in ("200000", "13", "1"):  # whole in a task; broken off in it; not in a task at all
        spark.conf.set("flowsieve.rows.per.group", limit)
        try:
            graph = W.feasible_states(*tables)
            found.append((sorted(graph.edges.collect()), sorted(str(r) for r in graph.states.collect())))
        finally:
            spark.conf.unset("flowsieve.rows.per.group")
    assert found[0] == found[1] == found[2] and len(found[0][1]) > 10


def test_states_of_long_ways_take_as_few_written_tables_as_those_of_short_ones(spark, monkeypatch):
    """A way of 60 blocks through each of two units; what was asked at its start ends the way in one of them only."""
    edges = [(u, f"b{k}", f"b{k + 1}") for u in "uv" for k in range(60)]
    conditions = [("u", "b0", "b1", "x", ">", 3), ("v", "b0", "b1", "x", ">", 3), ("u", "b59", "b60", "x", "=", 2), ("v", "b59", "b60", "x", "=", 5)]
    written = []
    monkeypatch.setattr(W, "cut", lambda *args: written.append(1) or cut(*args))
    monkeypatch.setattr(W, "cut_counted", lambda *args: written.append(1) or cut_counted(*args))
    tables = [spark.createDataFrame(edges, EDGES), spark.createDataFrame([("u", "b0"), ("v", "b0")], ENTRIES), spark.createDataFrame(conditions, CONDITIONS)]
    graph = W.feasible_states(*tables)
    assert sorted(map(tuple, graph.edges.collect())) == sorted(e for e in edges if e != ("u", "b59", "b60"))
    assert graph.states.count() == 121
    assert len(written) <= 3


def test_a_loop_that_asks_more_each_time_comes_to_an_end(spark):
    edges = [("u", "a", "b"), ("u", "b", "a"), ("u", "b", "c"), ("u", "c", "d")]
    conditions = [("u", "a", "b", "x", ">", 3), ("u", "b", "c", "x", "<", 3), ("u", "b", "a", "x", "!=", 4), ("u", "b", "a", "x", "~", 1)]
    tables = [spark.createDataFrame(edges, EDGES), spark.createDataFrame([("u", "a")], ENTRIES), spark.createDataFrame(conditions, CONDITIONS)]
    graph = W.feasible_states(*tables)
    assert {tuple(r) for r in graph.edges.collect()} == {("u", "a", "b"), ("u", "b", "a")}  # 3 < x < 3 has no way out
    # the condition that can't be read leaves the way open, and marks what lies behind it
    marks = {(r["block"], r["imprecise"]) for r in graph.states.select("block", "imprecise").collect()}
    assert marks == {("a", False), ("b", False), ("a", True), ("b", True)}
    with pytest.raises(ValueError, match="walks of"):
        W.feasible_walks(*tables, max_loop=10, max_rows=0).count()
    stopped = W.feasible_walks(*tables, max_loop=10).where("stopped").collect()
    assert len(stopped) == 1 and stopped[0]["step"] == 19


def test_no_entries_no_walks(spark):
    none = spark.createDataFrame([], ENTRIES)
    tables = [spark.createDataFrame([("u", "a", "b")], EDGES), none, spark.createDataFrame([], CONDITIONS)]
    assert W.feasible_walks(*tables).count() == 0 and W.walk_texts(W.feasible_walks(*tables)).count() == 0
    graph = W.feasible_states(*tables)
    assert graph.states.count() == graph.edges.count() == 0


OPS = "unit string, seq int, operator string, leaf string, operands array<struct<def_seq: int, leaf: string>>"


def test_shared_expressions_do_not_double(spark):
    rows = [("u", 1, None, "s1", [])]
    rows += [("u", k, "Plus", None, [(k - 1, None), (k - 1, None)]) for k in range(2, 42)]  # x = x + x
    rows += [("v", 1, None, "s1", []), ("v", 2, None, None, [(1, None)]), ("v", 3, "Plus", None, [(2, None), (1, None)]), ("v", 4, None, None, [(None, "7")])]
    found = symbolic_values(spark.createDataFrame(rows, OPS))
    assert found.nodes.count() == 42  # a text per height, and the constant
    ids = {(r["unit"], r["seq"]): r["id"] for r in found.values.collect()}
    assert len(ids) == len(rows) and ids["v", 2] == ids["v", 1] == ids["u", 1] and ids["v", 3] == ids["u", 2]
    wanted = found.values.where("unit = 'v'").select("id").unionByName(found.values.where("unit = 'u' AND seq IN (3, 41)").select("id"))
    texts = {r["id"]: r["expr"] for r in expression_texts(found, wanted, longest=200).collect()}
    assert texts[ids["v", 3]] == "((s1) + (s1))" and texts[ids["u", 3]] == "((((s1) + (s1))) + (((s1) + (s1))))"
    assert texts[ids["v", 4]] == "7" and texts[ids["u", 41]] is None  # a trillion characters are not written


@pytest.mark.parametrize("limit", ["200000", "5"])
def test_an_operand_is_grouped_in_the_level_of_its_expression_only(spark, limit, monkeypatch):
    """Operands of heights far apart; an expression made of itself has no value, nor has what is made of it."""
    rows = [("u", 1, None, "s", []), ("u", 2, "Minus", None, [(1, None), (None, "t")])]
    rows += [("u", k, "Plus", None, [(k - 1, None), (1, None)]) for k in range(3, 9)] + [("u", 9, "Mul", None, [(2, None), (8, None)])]
    rows += [("c", 1, "Plus", None, [(2, None), (None, "t")]), ("c", 2, "Plus", None, [(1, None), (3, None)]), ("c", 3, None, "s", []), ("c", 4, "Mul", None, [(1, None)])]
    written = []
    monkeypatch.setattr(symbolic, "cut", lambda df: written.append(df.columns) or cut(df))
    spark.conf.set("flowsieve.rows.per.group", limit)
    try:
        found = symbolic_values(spark.createDataFrame(rows, OPS))
        levels = {(r["unit"], r["seq"]): r["level"] for r in found.values.join(found.nodes, "id").collect()}
        assert levels == {("u", 1): 0, ("u", 2): 1, **{("u", k): k - 1 for k in range(3, 10)}, ("c", 3): 0}
        # an operand is written in one level and once in every few when done ones are dropped, not in every level
        assert sum("pos" in columns and "height" in columns for columns in written) <= 8 + 1 + 8 // 5
    finally:
        spark.conf.unset("flowsieve.rows.per.group")


NODES = "cond int, node int, parent int, pos int, mode string, var string, tested_type string, negated boolean"


def tree(rows, spark):
    found = G.guard_trees(spark.createDataFrame(rows, NODES), ["cond"])
    return {(r["cond"], r["var"]): (r["text"], r["types"], r["others"]) for r in found.collect()}


def test_either_of_two_types_and_its_negation(spark):
    """The condition of a value that is whole or fractional, on its if-edge (1) and its else-edge (2)."""
    both = [(1, "is whole", "int"), (2, "is fractional", "float")]
    rows = []
    for cond, negated in ((1, False), (2, True)):
        rows.append((cond, 0, None, 1, "or", None, None, negated))
        rows += [(cond, n, 0, n, None, "a", tested, False) for n, _, tested in both]
    found = tree(rows, spark)
    assert found[1, "a"] == ("(type(LITERAL('int'))|type(LITERAL('float')))", ["float", "int"], False)
    assert found[2, "a"] == ("not((type(LITERAL('int'))|type(LITERAL('float'))))", ["float", "int"], True)


def test_random_guard_trees(spark):
    """Types against the truth of the condition for each type, with one variable."""
    make = random.Random(6)
    types = ["int", "float", "string", "array"]
    rows, expected = [], {}

    def build(cond, node, parent, pos, depth):
        """(rows of the subtree, types that make it true)."""
        negated = make.random() < 0.3
        if depth == 0 or make.random() < 0.2:
            tested = make.choice(types)
            rows.append((cond, node, parent, pos, None, "a", tested, negated))
            true = {tested}
        else:
            mode = make.choice(["or", "and"])
            rows.append((cond, node, parent, pos, mode, None, None, negated))
            parts = [build(cond, node * 4 + k, node, k, depth - 1) for k in range(1, make.randint(2, 4))]
            true = set.union(*parts) if mode == "or" else set.intersection(*parts)
        return {*types, "other"} - true if negated else true

    for cond in range(40):
        expected[cond] = build(cond, 1, None, 1, 4)
    found = tree(rows, spark)
    for cond, true in expected.items():
        _, listed, others = found[cond, "a"]
        assert ({*types, "other"} - set(listed) if others else set(listed)) == true


def test_guards_of_several_variables_and_none(spark):
    rows = [
        (1, 0, None, 1, "and", None, None, None), (1, 1, 0, 1, None, "a", "int", False), (1, 2, 0, 2, None, "b", "string", True),
        (1, 3, 0, 3, None, None, None, False), (2, 0, None, 1, None, None, None, True),
    ]
    assert tree(rows, spark) == {
        (1, "a"): ("type(LITERAL('int'))", ["int"], False),
        (1, "b"): ("not(type(LITERAL('string')))", ["string"], True),
    }
    assert tree([], spark) == {}
