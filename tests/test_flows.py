"""Taint over block graphs and calls against fixtures and brute force."""

import random

from flowsieve.operators import block_states as S
from flowsieve.operators import calls as C
from flowsieve.operators.taint import ALL_OPEN
from flowsieve.sources.policy import load_policy

STEPS = "unit string, block int, seq int, kind string, var string, to_var string, clears long"
EDGES = "unit string, src int, dst int"

# a loop over an array with a merge of a variable at its head (five blocks)
LOOP_EDGES = [("main", 1, 2), ("main", 2, 3), ("main", 2, 4), ("main", 3, 5), ("main", 3, 2), ("main", 5, 2)]


def loop_steps(array_kind, plus_clears=None):
    rows = [
        (1, 1, "copy", None, "v1"), (1, 2, array_kind, None, "v3"), (1, 3, "copy", "v3", None),
        (2, 1, "copy", "v1", "v4"), (2, 1, "copy", "v5", "v4"), (2, 2, "copy", "v3", "v6"), (2, 3, "copy", "v6", None),
        (3, 1, "copy", "v3", "v7"), (3, 2, "copy", "v7", "v8"), (3, 2, "copy", "v7", "v9"), (3, 3, "copy", "v4", "v10"), (3, 4, "copy", "v10", None),
        (4, 1, "copy", "v4", None),
        (5, 1, "copy", "v4", "v11"), (5, 1, "copy", "v8", "v11"), (5, 2, "copy", "v11", "v5"), (5, 2, "copy", "v11", "v12"),
    ]
    return [("main", b, s, k, v, t, plus_clears if (b, s) == (5, 1) else None) for b, s, k, v, t in rows]


def solve(spark, steps, edges):
    steps, edges = spark.createDataFrame(steps, STEPS), spark.createDataFrame(edges, EDGES)
    linked = S.linked_steps(steps)
    origins = S.resolve_definitions(linked)
    entry = S.states_of(*S.block_functions(steps, origins), edges)
    read = S.read_states(linked, origins, entry)
    return {tuple(r)[1:-1]: r[-1] for r in entry.collect()}, {tuple(r)[1:-1]: r[-1] for r in read.collect()}


def test_merge_over_a_back_edge(spark):
    entry, read = solve(spark, loop_steps("source"), LOOP_EDGES)
    assert (4, 1, "v4") in read  # the merged variable that is printed holds what the loop added
    assert (1, "v4") not in entry and (2, "v1") not in entry
    assert {v for b, v in entry if b == 2} == {"v3", "v4", "v5", "v6", "v7", "v8", "v9", "v10", "v11", "v12"}
    clean, nothing = solve(spark, loop_steps("copy"), LOOP_EDGES)
    assert not clean and not nothing


def test_sanitizer_on_the_only_way(spark):
    _, read = solve(spark, loop_steps("source", plus_clears=1), LOOP_EDGES)
    assert read[4, 1, "v4"] == ALL_OPEN - 1  # every way to the print goes through the sum
    assert read[5, 1, "v8"] == ALL_OPEN


def brute(steps, edges, blocks):
    """States at block entries by running instructions over and over; bits as sets of avoided names."""
    by_block = {b: {} for b in blocks}
    for _, b, s, kind, var, to_var, clears in steps:
        by_block[b].setdefault(s, []).append((kind, var, to_var, clears or 0))
    entry = {b: {} for b in blocks}
    reads = {}
    changed = True
    while changed:
        changed = False
        for b in blocks:
            state = dict(entry[b])
            for s in sorted(by_block[b]):
                new = {}
                for kind, var, to_var, clears in by_block[b][s]:
                    if var is not None and var in state:
                        reads[b, s, var] = reads.get((b, s, var), 0) | state[var]
                    if to_var is not None:
                        new.setdefault(to_var, None)
                        made = ALL_OPEN if kind == "source" else state.get(var) if kind == "copy" and var is not None else None
                        if made is not None:
                            new[to_var] = (new[to_var] or 0) | (made & ~clears)
                for v, mask in new.items():
                    if mask is None:
                        state.pop(v, None)
                    else:
                        state[v] = mask
            for _, x, y in edges:
                if x == b:
                    for v, mask in state.items():
                        if entry[y].get(v, -1) != entry[y].get(v, 0) | mask:
                            entry[y][v] = entry[y].get(v, 0) | mask
                            changed = True
    return {(b, v): m for b in blocks for v, m in entry[b].items()}, reads


def test_random_block_graphs(spark):
    make = random.Random(3)
    for _ in range(4):
        blocks = list(range(1, make.randint(2, 7)))
        edges = [("u", make.choice(blocks), make.choice(blocks)) for _ in range(2 * len(blocks))]
        steps = []
        for b in blocks:
            for s in range(make.randint(0, 6)):
                to_var = make.choice(["a", "b", "c", "d", None])
                kind = make.choice(["source", "clean", "copy", "copy", "copy"])
                for _ in range(make.choice([1, 1, 2])):
                    var = make.choice(["a", "b", "c", "d", None])
                    steps.append(("u", b, s, kind, var, to_var, make.choice([None, None, 1, 2, 4])))
        steps = steps or [("u", 1, 1, "source", None, "a", None)]
        expected_entry, expected_reads = brute(steps, edges, blocks)
        entry, read = solve(spark, steps, edges)
        assert entry == expected_entry
        assert read == expected_reads


def test_no_steps(spark):
    assert solve(spark, [], LOOP_EDGES) == ({}, {})


def tables(spark, **rows):
    shapes = {
        "flows": "unit string, var string, to_var string, clears long",
        "arguments": "unit string, call int, var string, callee string, param string",
        "outputs": "unit string, call int, callee string, var string",
        "returns": "unit string, var string",
        "sources": "unit string, var string",
        "params": "unit string, var string",
    }
    return {name: spark.createDataFrame(rows.get(name, []), shape) for name, shape in shapes.items()}


def test_a_return_goes_back_to_its_own_caller(spark):
    given = tables(
        spark,
        flows=[("id", "p", "r", 0), ("a", "x", "y", 0), ("esc", "q", "s", 2)],
        arguments=[("a", 1, "y", "id", "p"), ("b", 1, "k", "id", "p"), ("b", 2, "z", "esc", "q"), ("a", 3, "y", "esc", "q")],
        outputs=[("a", 1, "id", "out"), ("b", 1, "id", "out"), ("a", 3, "esc", "safe"), ("b", 2, "esc", "safe"), ("b", 4, "get", "new")],
        returns=[("id", "r"), ("esc", "s"), ("get", "g")],
        sources=[("a", "x"), ("get", "g")],
        params=[("id", "p"), ("esc", "q")],
    )
    found = {(r["unit"], r["var"]): r["open_mask"] for r in C.matched_taint(**given).collect()}
    assert ("a", "out") in found and ("b", "out") not in found
    assert found["a", "safe"] == ALL_OPEN - 2 and ("b", "safe") not in found
    assert ("b", "new") in found  # what the callee's own source returns


def test_recursive_calls_and_no_calls(spark):
    # f(n) returns n or f(n) again, g hands its parameter to f and back
    given = tables(
        spark,
        flows=[("f", "n", "r", 0), ("f", "o", "r", 0)],
        arguments=[("f", 1, "n", "g", "m"), ("g", 1, "m", "f", "n"), ("main", 1, "s", "f", "n"), ("other", 1, "c", "g", "m")],
        outputs=[("f", 1, "g", "o"), ("g", 1, "f", "h"), ("main", 1, "f", "t"), ("other", 1, "g", "u")],
        returns=[("f", "r"), ("g", "h")],
        sources=[("main", "s")],
        params=[("f", "n"), ("g", "m")],
    )
    found = {(r["unit"], r["var"]) for r in C.matched_taint(**given).collect()}
    assert {("main", "t"), ("f", "r"), ("g", "h"), ("f", "o")} <= found
    assert not {v for v in found if v[0] == "other"}
    assert C.matched_taint(**tables(spark)).count() == 0


def test_native_flows(spark):
    calls = spark.createDataFrame(
        [("u", 1, "array_push", 1, "a"), ("u", 1, "array_push", 2, "b"), ("u", 2, "strlen", 1, "c")],
        "unit string, seq int, callee string, pos int, var string",
    )
    found = C.native_flows(calls, load_policy(spark), ["unit", "seq"])
    assert [tuple(r) for r in found.collect()] == [("u", "b", "a", 0)]
