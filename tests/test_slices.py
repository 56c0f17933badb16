"""Ordered operators give the same rows when a group is spread over slices."""

import pytest
from compare import differences
from conftest import TINY
from pyspark.sql import functions as F

from flowsieve.operators.ordered import SLICE, add_slices, next_value, row_sequence, running_max
from flowsieve.plans import bindings, load_all

QUERIES, ORACLES = load_all()


@pytest.mark.parametrize(
    "name",
    [
        "reaching_definition", "number_symbols", "mark_imprecise", "predecessors", "export_graph", "report_flows",
        "truncate_at_exit", "taint_whole_state", "order_blocks",
    ],
)
def test_query_in_slices(sliced, name):
    assert differences(sliced, TINY, QUERIES[name], ORACLES[name]) == ""


def test_events_are_sliced(sliced):
    events = bindings.raw_events(sliced, TINY)
    sizes = [r["count"] for r in events.groupBy(SLICE).count().collect()]
    assert len(sizes) == 10
    assert max(sizes) < 200


def test_one_hot_group(sliced):
    """One key holds all rows: each task still sees a slice only, results are whole."""
    rows = sliced.range(1000).select(
        F.lit(1).alias("k"), ((F.col("id") * 7919) % 1000).alias("t"), (F.col("id") % 13).alias("v")
    )
    cut = add_slices(rows, "t")
    numbered = row_sequence(cut, ["k"], ["t"], "n").orderBy("t").collect()
    assert [r["n"] for r in numbered] == list(range(1, 1001))
    by_time = sorted((r["t"], r["v"]) for r in numbered)
    seen = {r["t"]: r["m"] for r in running_max(cut, ["k"], ["t"], "v", "m").collect()}
    following = {r["t"]: r["x"] for r in next_value(cut, ["k"], ["t"], "v", "x").collect()}
    best = -1
    for i, (t, v) in enumerate(by_time):
        best = max(best, v)
        assert seen[t] == best
        assert following[t] == (by_time[i + 1][1] if i < 999 else None)
