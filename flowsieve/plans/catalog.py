"""Registry of queries and of the SQL that states the same result independently."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from flowsieve.functions.expressions import BINARY_OPERATORS
from flowsieve.plans import bindings as B
from flowsieve.sources import policy as P

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name; ``sql`` is its oracle."""

    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def sql_list(names: list[str]) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


def at(names: list[str], index: str) -> str:
    """SQL for the name number ``index`` modulo their number."""
    return f"({sql_list(names)})[CAST(({index}) % {len(names)} AS INTEGER) + 1]"


def _sink_values() -> str:
    rows = [r for r in P.policy_rows() if r[0] == "sink"] + [r for r in P.SITE_ROWS if r[0] == "sink"]
    return ", ".join(
        f"('{r[1]}', {list(P.SINK_CATEGORIES).index(r[1])}, '{r[3]}', {r[4]}, "
        f"{sql_list(r[5])}::VARCHAR[])"
        for r in rows
    )


CATEGORY_VALUES = ", ".join(f"('{c}', '{n}')" for c, n in P.SINK_CATEGORIES.items())

# name -> (what it builds on, body)
CTES: dict[str, tuple[str, str]] = {
    "ev": (
        "",
        "SELECT event_id, ts, user_id, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events",
    ),
    "pe": (
        "ev",
        """SELECT event_id, ts, user_id AS unit, event_type, k, k % 10 AS rv, k // 10 AS wv,
           CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS seq FROM ev""",
    ),
    "lk": (
        "pe",
        """SELECT r.unit, r.rv AS var, r.seq, w.seq AS def_seq FROM pe r
           ASOF LEFT JOIN (SELECT unit, wv, seq FROM pe WHERE event_type <> 'error') w
           ON r.unit = w.unit AND r.rv = w.wv AND r.seq > w.seq""",
    ),
    # what the names of the policy make of an instruction; a name may be a source, a sanitizer and a sink at once
    "pf": (
        "po",
        f"""SELECT *, coalesce(list_contains({sql_list(B.SOURCE_CALL_NAMES)}, callee), false)
             OR list_contains({sql_list(P.SOURCE_VARIABLES)}, read_name) AS is_source,
           coalesce(list_contains({sql_list(P.FULL_SANITIZERS)}, CASE WHEN op LIKE 'Expr_Cast_%' THEN op ELSE callee END), false) AS is_full,
           coalesce(list_contains({sql_list(B.CONDITIONAL_NAMES)}, callee), false) AS is_conditional FROM po""",
    ),
    "tt": (
        "pf lk",
        """SELECT unit, seq FROM pf WHERE is_source AND NOT is_full AND NOT is_conditional
           UNION SELECT p.unit, p.seq FROM tt JOIN lk ON lk.unit = tt.unit AND lk.def_seq = tt.seq
           JOIN pf p ON p.unit = lk.unit AND p.seq = lk.seq WHERE NOT p.is_source AND NOT p.is_full AND NOT p.is_conditional""",
    ),
    "po": (
        "pe",
        f"""SELECT *, CASE event_type
             WHEN 'signup' THEN CASE WHEN k % 2 = 0 THEN 'Expr_FuncCall' ELSE 'Expr_ArrayDimFetch' END
             WHEN 'click' THEN CASE WHEN k % 3 = 0 THEN 'Expr_BinaryOp_' || {at(BINARY_OPERATORS, "k")} ELSE 'Expr_Assign' END
             WHEN 'view' THEN CASE WHEN k % 4 = 0 THEN {at(B.CAST_NAMES, "k // 4")} ELSE 'Expr_FuncCall' END
             WHEN 'purchase' THEN CASE k % 10 WHEN 0 THEN 'Terminal_Echo' WHEN 1 THEN 'Expr_Print'
               WHEN 2 THEN 'Expr_Eval' WHEN 3 THEN 'Expr_Include' ELSE 'Expr_FuncCall' END
             ELSE 'Stmt_JumpIf' END AS op,
           CASE WHEN event_type = 'signup' AND k % 2 = 0 THEN {at(B.SOURCE_CALL_NAMES, "k")}
             WHEN event_type = 'view' AND k % 4 IN (1, 2) THEN {at(B.FULL_CALL_NAMES, "k")}
             WHEN event_type = 'view' AND k % 4 = 3 THEN {at(B.CONDITIONAL_NAMES, "k")}
             WHEN event_type = 'purchase' AND k % 10 > 3 THEN {at(B.SINK_CALL_NAMES, "unit + k")} END AS callee,
           CASE WHEN event_type = 'signup' AND k % 2 = 1 THEN {at(P.SOURCE_VARIABLES, "k")} ELSE 'v' || rv END AS read_name,
           CASE WHEN event_type <> 'error' THEN 'v' || wv END AS write_name,
           'f' || unit AS file,
           CASE WHEN k % 7 = 0 THEN 'None' ELSE CAST(seq // 4 + 1 AS VARCHAR) END AS start_line FROM pe""",
    ),
    "sinks": ("", f"SELECT * FROM (VALUES {_sink_values()}) t(category, category_rank, name, positions, safe_by)"),
    "categories": ("", f"SELECT * FROM (VALUES {CATEGORY_VALUES}) t(category, category_name)"),
    "os": (
        "po sinks",
        """SELECT po.*, s.category, s.category_rank, s.positions, s.safe_by FROM po JOIN sinks s
           ON s.name = coalesce(po.callee, lower(regexp_replace(po.op, '^[^_]*_?', '')))""",
    ),
    "sa": (
        "po",
        """SELECT unit, seq, pos, CASE WHEN pos = CASE WHEN callee IS NULL THEN 1 ELSE k % 3 + 1 END THEN rv END AS var
           FROM (SELECT *, unnest(range(1, CASE WHEN callee IS NULL THEN 2 ELSE 4 END)) AS pos FROM po
                 WHERE event_type = 'purchase')""",
    ),
    "fl": (
        "os sa tt categories",
        """SELECT os.unit, os.seq, os.file, os.start_line, os.category, os.category_rank, sa.pos,
           '*Dangerous: Tainted Input(s). Possible ' || c.category_name || '*' AS message
           FROM os JOIN sa ON sa.unit = os.unit AND sa.seq = os.seq
             AND (os.positions[1] = 0 OR list_contains(os.positions, sa.pos))
           JOIN lk ON lk.unit = os.unit AND lk.seq = os.seq
           JOIN tt ON tt.unit = lk.unit AND tt.seq = lk.def_seq JOIN categories c ON c.category = os.category
           WHERE sa.var IS NOT NULL""",
    ),
    "be": (
        "ev",
        """SELECT event_id, ts, event_type, k, k % 10 AS rv, k // 10 AS wv,
           user_id || '/' || strftime(date_trunc('week', ts), '%Y-%m-%d') AS unit,
           event_type || '_' || (k // 25) AS block FROM ev""",
    ),
    "bb": ("be", "SELECT DISTINCT unit, block FROM be"),
    "bg": (
        "be",
        """SELECT DISTINCT unit, src, dst FROM (SELECT unit, block AS src,
           lead(block) OVER (PARTITION BY unit ORDER BY ts, event_id) AS dst FROM be) WHERE dst IS NOT NULL""",
    ),
    "b0": ("be", "SELECT unit, first(block ORDER BY ts, event_id) AS block FROM be GROUP BY unit"),
    "bm": (
        "be",
        "SELECT unit, block, rv AS var FROM be UNION SELECT unit, block, wv FROM be",
    ),
}


def with_ctes(names: str, body: str, extra: dict[str, str] | None = None) -> str:
    """``body`` behind the named fragments and whatever they build on."""
    order: list[str] = []

    def need(name: str) -> None:
        for part in CTES[name][0].split():
            need(part)
        if name not in order:
            order.append(name)

    for name in names.split():
        need(name)
    parts = [f"{name} AS {'MATERIALIZED ' if name in ('lk', 'pf') else ''}({CTES[name][1]})" for name in order]
    parts += [f"{name} AS ({text})" for name, text in (extra or {}).items()]
    return f"WITH RECURSIVE {', '.join(parts)} {body}"
