"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from flowsieve.plans import load_all  # noqa: E402
from flowsieve.session import local_session  # noqa: E402

HEADLINE = [
    "report_flows",
    "taint_fixpoint",
    "reaching_definition",
    "taint_interprocedural",
    "live_variables",
    "sink_relevance",
    "feasible_paths",
    "merge_entry_state",
    "read_graph_corpus",
    "canonicalise_text",
    "scan_references",
    "diff_graphs",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), name="bench")
    queries, _ = load_all()
    spark.read.parquet(f"{folder}/events.parquet").count()  # the JVM is up before the clock starts
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline queries", "value": total, "unit": "sec", "queries": seconds, "sf": folder}))
    spark.stop()


if __name__ == "__main__":
    main()
