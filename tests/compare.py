"""Compare queries with their SQL: ``python tests/compare.py [sf] [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.12g}")
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def counted(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), Counter(tuple(plain(row[i]) for i in order) for row in rows)


def oracle_rows(sf_dir: str, sql: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    got = con.execute(sql)
    return counted([d[0] for d in got.description], got.fetchall())


def spark_rows(df):
    return counted(df.columns, [tuple(r) for r in df.collect()])


def differences(spark, sf_dir: str, fn, sql: str) -> str:
    """Empty when both sides agree."""
    mine, other = spark_rows(fn(spark, sf_dir)), oracle_rows(sf_dir, sql)
    if mine[0] != other[0]:
        return f"columns {mine[0]} / {other[0]}"
    if mine[1] != other[1]:
        extra, lacking = mine[1] - other[1], other[1] - mine[1]
        return (
            f"{sum(mine[1].values())} / {sum(other[1].values())} rows; only Spark {list(extra)[:3]}; "
            f"only SQL {list(lacking)[:3]}"
        )
    return ""


if __name__ == "__main__":
    from flowsieve.plans import load_all
    from flowsieve.session import local_session

    scale = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    folder = f"/root/testdata/sf{scale}"
    session = local_session(8)
    queries, oracles = load_all()
    bad = 0
    for name in sys.argv[2:] or queries:
        start = time.time()
        try:
            if name in oracles:
                text = differences(session, folder, queries[name], oracles[name])
                state = "ok" if not text else "DIFF " + text
            else:
                state = f"rows {queries[name](session, folder).count()}"
        except Exception as error:  # noqa: BLE001
            state = "FAIL " + str(error)[:600]
        bad += not state.startswith(("ok", "rows"))
        print(f"{name:32s} {time.time() - start:6.1f}s {state}", flush=True)
    print("bad:", bad)
