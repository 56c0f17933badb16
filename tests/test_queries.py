"""Every query that has an SQL statement must give the same rows."""

import pytest
from compare import differences
from conftest import TINY

from flowsieve.plans import load_all

QUERIES, ORACLES = load_all()

# loops take seconds each; the full list runs with ``python tests/compare.py``
LOOPS = {
    "reachable_blocks", "order_blocks", "prune_dead_blocks", "live_variables", "live_variables_interproc",
    "taint_blocks", "prune_unreachable", "taint_whole_state", "findings_summary", "write_findings",
}


def test_names_match():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(set(ORACLES) - LOOPS))
def test_query(spark, name):
    assert differences(spark, TINY, QUERIES[name], ORACLES[name]) == ""
