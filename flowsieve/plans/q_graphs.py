"""Queries over block graphs and calls: reachability, liveness, relevance, taint, rewriting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsieve.operators import block_states, classify, graph, links, taint
from flowsieve.operators import calls as calls_of
from flowsieve.operators.compare import order_cases as case_order
from flowsieve.operators.ordered import row_sequence, with_slice
from flowsieve.plans import bindings as B
from flowsieve.plans.catalog import at, query, sql_list, with_ctes
from flowsieve.plans.q_joins import UNITS_SQL, entry_states, numbered_ops, place, straight_ops
from flowsieve.session import cut
from flowsieve.sources import policy


def big(df: DataFrame, *names: str) -> DataFrame:
    for name in names:
        df = df.withColumn(name, F.col(name).cast("bigint"))
    return df


@query(
    with_ctes(
        "pe",
        """SELECT unit, CAST(src AS BIGINT) AS src, label, CAST(dst AS BIGINT) AS dst FROM (
           SELECT unit, seq AS src, 'target' AS label, seq + 1 AS dst FROM pe WHERE event_type = 'signup'
           UNION ALL SELECT unit, seq, 'if', seq + 1 FROM pe WHERE event_type = 'error'
           UNION ALL SELECT unit, seq, 'else', seq + 2 + k % 3 FROM pe WHERE event_type = 'error'
           UNION ALL SELECT unit, seq, 'C' || k, seq + 1 FROM pe WHERE event_type = 'view'
           UNION ALL SELECT unit, seq, 'c' || rv, seq + 1 FROM pe WHERE event_type = 'click'
           UNION ALL SELECT unit, seq, 'default', seq + 2 FROM pe WHERE event_type = 'click')""",
    )
)
def control_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    pe = B.program_events(spark, sf_dir)
    kind, seq = F.col("event_type"), F.col("seq")

    def when(name: str, value: Column) -> Column:
        return F.when(kind == name, value)

    cases = F.array(
        F.struct(F.concat(F.lit("c"), "rv").alias("label"), (seq + 1).alias("dst")),
        F.struct(F.lit("default").alias("label"), (seq + 2).alias("dst")),
    )
    ops = pe.select(
        "unit",
        seq.alias("block"),
        when("signup", seq + 1).alias("target"),
        when("error", seq + 1).alias("if_target"),
        when("error", seq + 2 + F.col("k") % 3).alias("else_target"),
        when("view", seq + 1).alias("body"),
        F.concat(F.lit("C"), "k").alias("body_label"),
        when("click", cases).alias("cases"),
    )
    return big(links.control_edges(ops), "src", "dst")


# a unit has at most 20 blocks (5 types, 4 quarters), so no level is above 19
LEVELS = """SELECT unit, block, 0 AS level FROM b0 UNION SELECT l.unit, e.dst, l.level + 1
    FROM levels l JOIN bg e ON e.unit = l.unit AND e.src = l.block WHERE l.level < 19"""


@query(
    with_ctes("bg b0", "SELECT unit, block, CAST(min(level) AS BIGINT) AS level FROM levels GROUP BY ALL", {"levels": LEVELS})
)
def reachable_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = B.block_events(spark, sf_dir)
    found = graph.reachable_blocks(B.block_edges(events), B.block_entries(events))
    return big(found, "level")


@query(
    with_ctes(
        "bg b0",
        """SELECT unit, block, row_number() OVER (PARTITION BY unit ORDER BY level, block) AS number, level
           FROM (SELECT unit, block, CAST(min(level) AS BIGINT) AS level FROM levels GROUP BY ALL)""",
        {"levels": LEVELS},
    )
)
def order_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return big(graph.order_blocks(reachable_blocks(spark, sf_dir)), "number")


# errors of the top quarter leave the unit: what only they lead to is dead
CUT_EDGES = "SELECT * FROM bg WHERE src <> 'error_3'"
CUT_REACH = """SELECT unit, block FROM b0 UNION SELECT r.unit, e.dst FROM reach r JOIN ce e ON e.unit = r.unit AND e.src = r.block"""


def cut_edges(events: DataFrame) -> DataFrame:
    return B.block_edges(events).where("src <> 'error_3'")


@query(
    with_ctes(
        "bg b0 bb",
        "SELECT unit, block FROM bb WHERE (unit, block) IN (SELECT (unit, block) FROM reach)",
        {"ce": CUT_EDGES, "reach": CUT_REACH},
    )
)
def prune_dead_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = B.block_events(spark, sf_dir)
    return graph.prune_dead_blocks(B.block_list(events), cut_edges(events), B.block_entries(events))


@query(
    with_ctes(
        "bg b0",
        """SELECT DISTINCT e.unit, e.src, e.dst, CASE WHEN e.src LIKE 'signup%' THEN 'target' ELSE 'if' END AS label
           FROM ce e JOIN reach r ON r.unit = e.unit AND r.block = e.src
           WHERE e.src LIKE 'signup%' OR e.dst <> 'purchase_3'""",
        {"ce": CUT_EDGES, "reach": CUT_REACH},
    )
)
def covered_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = B.block_events(spark, sf_dir)
    edges = cut(
        cut_edges(events).withColumn("label", F.when(F.col("src").startswith("signup"), "target").otherwise("if"))
    )
    reached = graph.reachable_blocks(edges, B.block_entries(events))
    return graph.covered_edges(edges, reached, B.block_list(events).where("block <> 'purchase_3'"))


CALLED = f"SELECT DISTINCT user_id AS unit, (user_id + k) % {UNITS_SQL} AS callee FROM ev WHERE event_type = 'purchase'"


@query(
    with_ctes(
        "ev",
        "SELECT unit, CAST(min(level) AS BIGINT) AS level FROM reach GROUP BY unit",
        {
            "calls": CALLED,
            "reach": """SELECT CAST(0 AS BIGINT) AS unit, 0 AS level UNION
                SELECT c.callee, r.level + 1 FROM reach r JOIN calls c ON c.unit = r.unit WHERE r.level < 80""",
        },
    )
)
def reachable_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = B.unit_count(spark, sf_dir)
    events = B.decode_events(B.table(spark, sf_dir, "events")).where("event_type = 'purchase'")
    calls = cut(events.select("unit", B.user_callee(events, units).alias("callee")).distinct())
    roots = events.sparkSession.range(1).select(F.col("id").alias("unit"))
    return big(graph.reachable_units(calls, roots), "level")


LIVE = """SELECT unit, block, var FROM bm UNION SELECT l.unit, e.src, l.var
    FROM live l JOIN bg e ON e.unit = l.unit AND e.dst = l.block"""


@query(with_ctes("bm bg", "SELECT unit, block, CAST(var AS BIGINT) AS var FROM live", {"live": LIVE}))
def live_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = B.block_events(spark, sf_dir)
    return big(graph.live_variables(B.block_mentions(events), B.block_edges(events)), "var")


# every tenth view includes the unit of another user in the same week
WEEK_INCLUDES = f"""SELECT DISTINCT unit, ((CAST(string_split(unit, '/')[1] AS BIGINT) + k // 10) % {UNITS_SQL}) || '/' || string_split(unit, '/')[2] AS callee
    FROM be WHERE event_type = 'view' AND k % 10 = 3"""
WEEK_CALLS = f"""SELECT DISTINCT unit, ((CAST(string_split(unit, '/')[1] AS BIGINT) + k) % {UNITS_SQL}) || '/' || string_split(unit, '/')[2] AS callee
    FROM be WHERE event_type = 'purchase'"""


@query(
    with_ctes(
        "bm bg be",
        "SELECT unit, block, CAST(var AS BIGINT) AS var FROM live WHERE unit IN (SELECT unit FROM ru)",
        {
            "wc": f"{WEEK_CALLS} UNION {WEEK_INCLUDES}",
            "ru": "SELECT DISTINCT unit FROM be WHERE unit LIKE '0/%' UNION SELECT c.callee FROM ru JOIN wc c ON c.unit = ru.unit",
            "live": LIVE,
        },
    )
)
def live_variables_interproc(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = B.unit_count(spark, sf_dir)
    events = B.block_events(spark, sf_dir)
    user, week = F.substring_index("unit", "/", 1).cast("bigint"), F.substring_index("unit", "/", -1)
    other = lambda step: F.concat(((user + step) % units).cast("string"), F.lit("/"), week).alias("callee")
    calls = cut(events.where("event_type = 'purchase'").select("unit", other(F.col("k"))).distinct())
    includes = events.where("event_type = 'view' AND k % 10 = 3").select("unit", other(F.col("wv"))).distinct()
    roots = events.select("unit").where("unit LIKE '0/%'").distinct()
    found = graph.live_variables_interproc(B.block_mentions(events), B.block_edges(events), calls, roots, includes)
    return big(found, "var")


@query(
    with_ctes(
        "bb bg",
        "SELECT unit, block FROM rel",
        {
            "rel": """SELECT unit, block FROM bb WHERE block LIKE 'purchase%' UNION
                SELECT r.unit, e.src FROM rel r JOIN bg e ON e.unit = r.unit AND e.dst = r.block"""
        },
    )
)
def sink_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = B.block_events(spark, sf_dir)
    sinks = B.block_list(events).where("block LIKE 'purchase%'")
    return graph.sink_relevance(sinks, B.block_edges(events))


@query(
    with_ctes(
        "ev",
        """SELECT * FROM (SELECT unit, dst AS block, CAST(var AS BIGINT) AS var, bool_or(tainted) AS tainted FROM s1 JOIN e1 USING (unit, src) GROUP BY ALL)
           EXCEPT ALL
           SELECT * FROM (SELECT unit, dst AS block, CAST(var AS BIGINT) AS var, bool_or(tainted) AS tainted FROM s0 JOIN e0 USING (unit, src) GROUP BY ALL)""",
        {
            "be": """SELECT event_id, ts, event_type, k, k // 10 AS wv, user_id || '/' || strftime(date_trunc('week', ts), '%Y-%m-%d') AS unit,
                event_type || '_' || (k // 25) AS src FROM ev""",
            "e1": "SELECT DISTINCT * FROM (SELECT unit, src, lead(src) OVER (PARTITION BY unit ORDER BY ts, event_id) AS dst FROM be) WHERE dst IS NOT NULL",
            "e0": "SELECT DISTINCT * FROM (SELECT unit, src, lead(src) OVER (PARTITION BY unit ORDER BY ts, event_id) AS dst FROM be WHERE k % 10 <> 3) WHERE dst IS NOT NULL",
            "s1": "SELECT unit, src, wv AS var, bool_or(event_type = 'signup') AS tainted FROM be WHERE event_type <> 'error' GROUP BY ALL",
            "s0": "SELECT unit, src, wv AS var, bool_or(event_type = 'signup') AS tainted FROM be WHERE event_type <> 'error' AND k % 10 <> 3 GROUP BY ALL",
        },
    )
)
def state_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = B.block_events(spark, sf_dir)
    new = entry_states(spark, sf_dir, events).drop("sanitizers")
    old = entry_states(spark, sf_dir, events.where("k % 10 <> 3")).drop("sanitizers")
    return graph.state_delta(new, old)


# ---- taint over graphs ----

# a signup taints what it writes; all but views copy what they read; nothing is killed
BLOCK_TAINT = """SELECT DISTINCT unit, block, wv AS var FROM be WHERE event_type = 'signup'
    UNION SELECT * FROM (
      SELECT t.unit, e.dst AS block, t.var FROM t JOIN {edges} e ON e.unit = t.unit AND e.src = t.block
      UNION ALL SELECT t.unit, t.block, c.wv FROM t JOIN copies c ON c.unit = t.unit AND c.block = t.block AND c.rv = t.var)"""
COPIES = "SELECT DISTINCT unit, block, rv, wv FROM be WHERE event_type NOT IN ('signup', 'view')"


def block_taint(events: DataFrame, edges: DataFrame) -> DataFrame:
    generated = events.where("event_type = 'signup'").select("unit", "block", F.col("wv").alias("var"))
    copies = (
        events.where("event_type NOT IN ('signup', 'view')")
        .select("unit", "block", F.col("rv").alias("var"), F.col("wv").alias("to_var"))
        .distinct()
    )
    return big(taint.taint_blocks(generated, copies, edges), "var")


@query(
    with_ctes(
        "be bg", "SELECT unit, block, CAST(var AS BIGINT) AS var FROM t", {"copies": COPIES, "t": BLOCK_TAINT.format(edges="bg")}
    )
)
def taint_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = B.block_events(spark, sf_dir)
    return block_taint(events, B.block_edges(events))


STATE_NAMES = ["htmlentities", "escapeshellarg", "addslashes", "preg_quote"]


def block_steps(spark: SparkSession, sf_dir: str, events: DataFrame) -> DataFrame:
    """Signups are sources, every fourth view applies a sanitizer, the others clean, errors only read."""
    numbered = row_sequence(events, ["unit"], ["ts", "event_id"], "seq")
    kind, k = F.col("event_type"), F.col("k")
    return numbered.select(
        "unit", "block", *with_slice(numbered), "seq",
        F.when(kind == "signup", "source").when((kind == "view") & (k % 4 != 3), "clean").otherwise("copy").alias("kind"),
        F.when(kind != "signup", F.col("rv")).alias("var"),
        F.when(kind != "error", F.col("wv")).alias("to_var"),
        F.when((kind == "view") & (k % 4 == 3), taint.sanitizer_bit(STATE_NAMES, B.pick(STATE_NAMES, F.col("rv")))).alias("clears"),
    )


# a state is the set of names that some tainted flow avoids, '' for the taint itself; i is the place before an instruction
STATE_PARTS = {
    "ops": f"""SELECT unit, block, rv, wv, event_type, k, CAST(row_number() OVER (PARTITION BY unit, block ORDER BY ts, event_id) AS INTEGER) AS i,
        count(*) OVER (PARTITION BY unit, block) AS n, CASE WHEN event_type = 'view' AND k % 4 = 3 THEN {at(STATE_NAMES, "rv")} ELSE '-' END AS san FROM be""",
    "names": f"SELECT unnest({sql_list(STATE_NAMES + [''])}) AS name",
    "st": """SELECT unit, block, i + 1 AS i, wv AS var, name FROM ops, names WHERE event_type = 'signup'
        UNION SELECT * FROM (
          SELECT s.unit, s.block, s.i + 1, s.var, s.name FROM st s JOIN ops o ON o.unit = s.unit AND o.block = s.block AND o.i = s.i
            WHERE o.event_type = 'error' OR o.wv <> s.var
          UNION ALL SELECT s.unit, s.block, s.i + 1, o.wv, s.name FROM st s JOIN ops o ON o.unit = s.unit AND o.block = s.block AND o.i = s.i
            WHERE o.rv = s.var AND o.san <> s.name AND (o.event_type IN ('click', 'purchase') OR (o.event_type = 'view' AND o.k % 4 = 3))
          UNION ALL SELECT s.unit, e.dst, 1, s.var, s.name FROM st s JOIN (SELECT DISTINCT unit, block, n FROM ops) o
            ON o.unit = s.unit AND o.block = s.block AND s.i = o.n + 1 JOIN bg e ON e.unit = s.unit AND e.src = s.block)""",
}


@query(
    with_ctes(
        "be bg",
        """SELECT t.unit, t.block, CAST(t.var AS BIGINT) AS var, coalesce(string_agg(n.name, ',' ORDER BY n.name) FILTER (a.name IS NULL), '') AS sanitizers
           FROM (SELECT * FROM st WHERE i = 1 AND name = '') t CROSS JOIN (SELECT name FROM names WHERE name <> '') n
           LEFT JOIN (SELECT * FROM st WHERE i = 1) a ON a.unit = t.unit AND a.block = t.block AND a.var = t.var AND a.name = n.name GROUP BY ALL""",
        STATE_PARTS,
    )
)
def taint_block_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is tainted at a block's entry, with the sanitizers that all flows to it meet; writes kill."""
    events = B.block_events(spark, sf_dir)
    state = block_states.taint_block_states(block_steps(spark, sf_dir, events), B.block_edges(events))
    met = F.array_sort(taint.applied_sanitizers(STATE_NAMES, F.col("open_mask")))
    return big(state.select("unit", "block", "var", F.array_join(met, ",").alias("sanitizers")), "var")


@query(
    with_ctes(
        "be bg",
        """SELECT o.unit, o.block, o.event_id, coalesce(string_agg(n.name, ',' ORDER BY n.name) FILTER (a.name IS NULL), '') AS sanitizers
           FROM (SELECT o.*, b.event_id FROM ops o JOIN (SELECT event_id, unit, block, row_number() OVER (PARTITION BY unit, block ORDER BY ts, event_id) AS i FROM be) b
                 ON b.unit = o.unit AND b.block = o.block AND b.i = o.i WHERE o.event_type = 'purchase') o
           JOIN (SELECT * FROM st WHERE name = '') t ON t.unit = o.unit AND t.block = o.block AND t.i = o.i AND t.var = o.rv
           CROSS JOIN (SELECT name FROM names WHERE name <> '') n
           LEFT JOIN st a ON a.unit = o.unit AND a.block = o.block AND a.i = o.i AND a.var = o.rv AND a.name = n.name GROUP BY ALL""",
        STATE_PARTS,
    )
)
def taint_read_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases that read a tainted value, with the sanitizers met on all flows to the very instruction."""
    events = B.block_events(spark, sf_dir)
    steps = block_steps(spark, sf_dir, events)
    linked = cut(block_states.linked_steps(steps))
    origins = cut(block_states.resolve_definitions(linked))
    entry = cut(block_states.states_of(*block_states.block_functions(steps, origins), B.block_edges(events)))
    numbered = row_sequence(events, ["unit"], ["ts", "event_id"], "seq").where("event_type = 'purchase'")
    read = block_states.read_states(linked, origins, entry).select("unit", "seq", "open_mask")
    met = F.array_sort(taint.applied_sanitizers(STATE_NAMES, F.col("open_mask")))
    return numbered.select("unit", "block", "event_id", "seq").join(read, ["unit", "seq"]).select(
        "unit", "block", "event_id", F.array_join(met, ",").alias("sanitizers")
    )


def call_flows(spark: SparkSession, sf_dir: str, *, binary_results: bool = True, includes: bool = False):
    """(seeds, flows) of all programs: value copies inside units, into callees and back.

    A value is named by the op that wrote it; what a unit takes in is ``-(var + 1)``.
    ``flows`` has ``clears``: the bit of a conditional sanitizer on the way, for the
    strict form; ``strict`` marks those rows, which the plain form leaves out.
    """
    units = B.unit_count(spark, sf_dir)
    ops = numbered_ops(spark, sf_dir)
    site = policy.site_policy(spark)
    names = taint.sanitizer_names(site)
    linked = cut(
        straight_ops(ops, spark).select(
            "unit", *with_slice(ops), "seq", "event_type", "k", "rv", "op", "is_source", "is_full", "conditional",
            taint.sanitizer_bit(names, F.col("conditional")).alias("clears"),
            F.coalesce("def_seq", -(F.col("rv") + 1)).cast("bigint").alias("parent"),
            ((F.col("event_type") == "purchase") & (F.col("k") % 9 != 0)).alias("calls_user"),
            B.user_callee(ops, units).alias("callee_unit"),
        )
    )
    seeds = linked.where("is_source AND NOT is_full AND conditional IS NULL AND NOT calls_user").select("unit", F.col("seq").cast("bigint").alias("var"))
    here = F.col("seq").cast("bigint")
    inner = "NOT is_source AND NOT is_full AND NOT calls_user AND event_type <> 'error'"
    if not binary_results:
        inner += " AND NOT startswith(op, 'Expr_BinaryOp_')"
    copies = linked.where(inner).select(
        "unit", F.col("parent").alias("var"), F.col("unit").alias("to_unit"), here.alias("to_var"), "clears",
        F.col("conditional").isNotNull().alias("strict"),
    )
    plain = [F.lit(0).cast("bigint").alias("clears"), F.lit(False).alias("strict")]
    entry = -(F.col("rv") + 1).cast("bigint")
    calls = linked.where("calls_user")
    arguments = calls.select(
        "unit", F.col("parent").alias("var"), F.col("callee_unit").alias("to_unit"), entry.alias("to_var"), *plain
    )
    last = linked.where("event_type <> 'error'").groupBy(F.col("unit").alias("callee_unit")).agg(F.max(here).alias("_last"))
    returns = calls.join(last, "callee_unit").select(
        F.col("callee_unit").alias("unit"), F.col("_last").alias("var"), F.col("unit").alias("to_unit"), here.alias("to_var"), *plain
    )
    flows = copies.unionByName(arguments).unionByName(returns)
    if includes:
        flows = flows.unionByName(include_flows(ops, linked).select("*", *plain))
    return seeds, flows.distinct()


def include_flows(ops: DataFrame, linked: DataFrame) -> DataFrame:
    """An include hands every variable the included unit asks for to that unit's entry."""
    asked = linked.where("parent < 0").select(F.col("unit").alias("callee_unit"), (-F.col("parent") - 1).alias("var")).distinct()
    sites = linked.where("op = 'Expr_Include'").select("unit", *with_slice(linked), "seq", "callee_unit")
    reads = sites.join(asked, "callee_unit").withColumn("var", F.col("var").cast("int"))
    writes = ops.where("event_type <> 'error'").select("unit", *with_slice(ops), F.col("wv").alias("var"), "seq")
    found = links.reaching_definition(reads.select("unit", *with_slice(linked), "var", "seq").distinct(), writes, ["unit", "var"])
    return (
        found.join(sites.select("unit", "seq", "callee_unit"), ["unit", "seq"])
        .join(asked, ["callee_unit", "var"], "left_semi")
        .select(
            "unit",
            F.coalesce("def_seq", -(F.col("var") + 1)).cast("bigint").alias("var"),
            F.col("callee_unit").alias("to_unit"),
            (-(F.col("var") + 1)).cast("bigint").alias("to_var"),
        )
    )


FLOW_PARTS = f"""
    SELECT p.unit, coalesce(lk.def_seq, -(p.rv + 1)) AS var, p.seq, p.k, p.rv, p.op, p.event_type, p.callee, p.is_source, p.is_full, p.is_conditional,
      p.event_type = 'purchase' AND p.k % 9 <> 0 AS calls_user, (p.unit + p.k) % {UNITS_SQL} AS callee_unit
    FROM pf p JOIN lk ON lk.unit = p.unit AND lk.seq = p.seq"""
LAST = "SELECT unit, max(seq) AS seq FROM pe WHERE event_type <> 'error' GROUP BY unit"
FLOWS = """SELECT unit, var, unit AS to_unit, seq AS to_var, CASE WHEN is_conditional THEN callee END AS san FROM fp
      WHERE event_type <> 'error' AND NOT is_source AND NOT is_full AND NOT calls_user {more}
    UNION SELECT unit, var, callee_unit, -(rv + 1), NULL FROM fp WHERE calls_user
    UNION SELECT l.unit, l.seq, fp.unit, fp.seq, NULL FROM fp JOIN last l ON l.unit = fp.callee_unit WHERE calls_user"""
SEEDS = "SELECT unit, CAST(seq AS BIGINT) AS var FROM fp WHERE is_source AND NOT is_full AND NOT is_conditional AND NOT calls_user"
REACHED = SEEDS + """
    UNION SELECT f.to_unit, CAST(f.to_var AS BIGINT) FROM reached r JOIN flows f ON f.unit = r.unit AND f.var = r.var"""


@query(
    with_ctes(
        "pf lk",
        "SELECT unit, var FROM reached",
        {"fp": FLOW_PARTS, "last": LAST, "flows": FLOWS.format(more="AND NOT is_conditional"), "reached": REACHED},
    )
)
def taint_interprocedural(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds, flows = call_flows(spark, sf_dir)
    return taint.taint_fixpoint(seeds, cut(flows.where("NOT strict")))


INCLUDED = """SELECT s.unit, coalesce(w.seq, -(s.var + 1)) AS var, s.callee_unit AS to_unit, -(s.var + 1) AS to_var, NULL AS san
    FROM (SELECT f.unit, f.seq, f.callee_unit, a.var FROM fp f JOIN (SELECT DISTINCT unit, -var - 1 AS var FROM fp WHERE var < 0) a
          ON a.unit = f.callee_unit WHERE f.op = 'Expr_Include') s
    ASOF LEFT JOIN (SELECT unit, wv, seq FROM pe WHERE event_type <> 'error') w ON w.unit = s.unit AND w.wv = s.var AND s.seq > w.seq"""


@query(
    with_ctes(
        "pf lk",
        """SELECT r.unit, CAST(f.seq AS BIGINT) AS seq FROM reached r JOIN fp f ON f.unit = r.unit AND f.var = r.var
           WHERE f.event_type = 'purchase' AND NOT f.calls_user""",
        {
            "fp": FLOW_PARTS,
            "last": LAST,
            "base": FLOWS.format(more="AND NOT is_conditional AND NOT starts_with(op, 'Expr_BinaryOp_')"),
            "inc": INCLUDED,
            "flows": "SELECT unit, var, to_unit, to_var FROM base UNION SELECT unit, var, to_unit, to_var FROM inc",
            "reached": REACHED,
        },
    ).replace("inc AS (", "inc AS MATERIALIZED (")
)
def taint_whole_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Older form: includes are followed, binary results not copied, one row per instruction."""
    seeds, flows = call_flows(spark, sf_dir, binary_results=False, includes=True)
    state = taint.taint_fixpoint(seeds, cut(flows.where("NOT strict")))
    reads = B.program_links(B.program_events(spark, sf_dir)).where("event_type = 'purchase' AND k % 9 = 0")
    native = reads.select("unit", "seq", F.coalesce("def_seq", -(F.col("var") + 1)).cast("bigint").alias("var"))
    return place(native.join(state, ["unit", "var"], "left_semi"))


def call_tables(spark: SparkSession, sf_dir: str, names: list[str]) -> dict[str, DataFrame]:
    """The tables of ``calls.matched_taint`` for all programs: user calls with one argument, and includes."""
    units = B.unit_count(spark, sf_dir)
    ops = numbered_ops(spark, sf_dir)
    here = F.col("seq").cast("bigint")
    linked = cut(
        straight_ops(ops, spark).select(
            "unit", *with_slice(ops), "seq", "event_type", "rv", "op", "is_source", "is_full", "conditional",
            F.coalesce("def_seq", -(F.col("rv") + 1)).cast("bigint").alias("parent"),
            ((F.col("event_type") == "purchase") & (F.col("k") % 9 != 0)).alias("calls_user"),
            B.user_callee(ops, units).alias("callee"),
        )
    )
    entry = -(F.col("rv") + 1).cast("bigint")
    own = linked.where("NOT calls_user AND NOT is_full")
    calls = linked.where("calls_user")
    arguments = calls.select("unit", here.alias("call"), F.col("parent").alias("var"), "callee", entry.alias("param"))
    asked = linked.where("parent < 0").select(F.col("unit").alias("callee"), F.col("rv").alias("name"), F.col("parent").alias("param")).distinct()
    sites = linked.where("op = 'Expr_Include'").select("unit", *with_slice(linked), "seq", (-here).alias("call"), "callee")
    reads = sites.join(asked, "callee").select("unit", *with_slice(linked), "seq", "call", F.col("name").alias("var")).distinct()
    writes = ops.where("event_type <> 'error'").select("unit", *with_slice(ops), F.col("wv").alias("var"), "seq")
    seen = links.reaching_definition(reads, writes, ["unit", "var"])
    visible = seen.select("unit", "call", F.col("var").alias("name"), F.coalesce("def_seq", -(F.col("var") + 1)).cast("bigint").alias("var"))
    arguments = cut(arguments.unionByName(calls_of.include_arguments(sites, asked, visible)))
    return {
        "flows": own.where("NOT is_source AND event_type <> 'error'").select(
            "unit", F.col("parent").alias("var"), here.alias("to_var"), taint.sanitizer_bit(names, F.col("conditional")).alias("clears"),
            F.col("conditional").isNotNull().alias("strict"),
        ),
        "arguments": arguments,
        "outputs": calls.select("unit", here.alias("call"), "callee", here.alias("var")),
        "returns": linked.where("event_type <> 'error'").groupBy("unit").agg(F.max(here).alias("var")),
        "sources": own.where("is_source AND conditional IS NULL").select("unit", here.alias("var")),
        "params": arguments.select(F.col("callee").alias("unit"), F.col("param").alias("var")).distinct(),
    }


# a path has a unit, a root (0: a source inside, below 0: what is handed in) and a value; summaries are paths to the last value
MATCHED_PARTS = {
    "fp": FLOW_PARTS,
    "last": LAST,
    "fl0": "SELECT unit, var, seq AS to_var FROM fp WHERE event_type <> 'error' AND NOT is_source AND NOT is_full AND NOT is_conditional AND NOT calls_user",
    "args": "SELECT unit, seq AS call, var, callee_unit AS callee, -(rv + 1) AS param FROM fp WHERE calls_user",
    "inc": INCLUDED,
    "given": "SELECT unit, var, callee, param FROM args UNION SELECT unit, var, to_unit, to_var FROM inc",
    "p(unit, root, var) USING KEY (unit, root, var)": """
        SELECT DISTINCT CAST(callee AS BIGINT), CAST(param AS BIGINT), CAST(param AS BIGINT) FROM given
        UNION ALL SELECT unit, 0, seq FROM fp WHERE is_source AND NOT is_full AND NOT is_conditional AND NOT calls_user
        UNION (
          SELECT p.unit, p.root, f.to_var FROM p JOIN fl0 f ON f.unit = p.unit AND f.var = p.var
          UNION SELECT p.unit, p.root, a.call FROM p JOIN args a ON a.unit = p.unit AND a.var = p.var
            JOIN recurring.p q ON q.unit = a.callee AND q.root = a.param JOIN last l ON l.unit = q.unit AND l.seq = q.var
          UNION SELECT q.unit, q.root, a.call FROM p s JOIN last l ON l.unit = s.unit AND l.seq = s.var
            JOIN args a ON a.callee = s.unit AND a.param = s.root JOIN recurring.p q ON q.unit = a.unit AND q.var = a.var
          UNION SELECT a.unit, 0, a.call FROM p s JOIN last l ON l.unit = s.unit AND l.seq = s.var
            JOIN args a ON a.callee = s.unit WHERE s.root = 0)""",
    "reach": "SELECT DISTINCT p.unit, p.root, g.callee, g.param FROM p JOIN given g ON g.unit = p.unit AND g.var = p.var",
    "filled": """SELECT CAST(callee AS BIGINT) AS unit, CAST(param AS BIGINT) AS var FROM reach WHERE root = 0
        UNION SELECT r.callee, r.param FROM filled f JOIN reach r ON r.unit = f.unit AND r.root = f.var""",
}


@query(
    with_ctes(
        "pf lk",
        """SELECT unit, var FROM p WHERE root = 0
           UNION SELECT p.unit, p.var FROM p JOIN filled f ON f.unit = p.unit AND f.var = p.root""",
        MATCHED_PARTS,
    )
)
def taint_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tainted values of all programs when a return goes back to its own call only."""
    tables = call_tables(spark, sf_dir, [])
    plain = tables.pop("flows").where("NOT strict").drop("strict")
    return calls_of.matched_taint(plain, **tables).select("unit", "var")


@query(
    with_ctes(
        "pf lk",
        """SELECT p.unit, p.root AS param FROM p JOIN last l ON l.unit = p.unit AND l.seq = p.var""",
        MATCHED_PARTS,
    )
)
def unit_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each unit returns: the parameters whose taint comes out, 0 for a source of its own."""
    tables = call_tables(spark, sf_dir, [])
    returns = cut(tables["returns"])
    paths = calls_of.unit_paths(tables["flows"].where("NOT strict").drop("strict"), **{k: v for k, v in tables.items() if k not in ("flows", "returns")}, returns=returns)
    out = paths.join(returns, ["unit", "var"], "left_semi")
    return out.select("unit", F.when(F.col("root") == calls_of.GENERATED, 0).otherwise(F.substring("root", 2, 20)).cast("bigint").alias("param"))


CONDITIONAL_SQL = ", ".join(f"('{n}')" for n in sorted({*B.CONDITIONAL_NAMES, "sqlite_udf_encode_binary"}))


@query(
    with_ctes(
        "pf lk",
        """SELECT unit, var, coalesce(string_agg(name, ',' ORDER BY name), '') AS sanitizers FROM (
             SELECT t.unit, t.var, n.name FROM (SELECT DISTINCT unit, var FROM avoiding) t
             LEFT JOIN names n ON NOT EXISTS (SELECT 1 FROM avoiding a WHERE a.unit = t.unit AND a.var = t.var AND a.name = n.name)
           ) GROUP BY ALL""",
        {
            "fp": FLOW_PARTS,
            "last": LAST,
            "names": f"SELECT * FROM (VALUES {CONDITIONAL_SQL}) t(name)",
            "flows": FLOWS.format(more=""),
            "seeds": SEEDS,
            "avoiding": """SELECT s.unit, s.var, n.name FROM seeds s, (SELECT name FROM names UNION ALL SELECT '') n
                UNION SELECT f.to_unit, CAST(f.to_var AS BIGINT), a.name FROM avoiding a
                JOIN flows f ON f.unit = a.unit AND f.var = a.var AND coalesce(f.san, '-') <> a.name""",
        },
    )
)
def taint_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tainted values with the conditional sanitizers that every flow to them meets."""
    seeds, flows = call_flows(spark, sf_dir)
    state = taint.taint_strict(seeds, cut(flows))
    met = taint.applied_sanitizers(taint.sanitizer_names(policy.site_policy(spark)), F.col("open_mask"))
    return state.select("unit", "var", F.array_join(met, ",").alias("sanitizers"))


@query(
    with_ctes(
        "os sa pf lk categories",
        """SELECT file, start_line, unit, CAST(seq AS BIGINT) AS seq, category,
             '*Dangerous: Tainted Input(s). Possible ' || category_name || '*' AS message
           FROM (SELECT os.*, c.category_name, row_number() OVER (PARTITION BY os.file, os.start_line ORDER BY os.seq, os.category_rank) AS n
             FROM os JOIN sa ON sa.unit = os.unit AND sa.seq = os.seq AND (os.positions[1] = 0 OR list_contains(os.positions, sa.pos))
             JOIN lk ON lk.unit = os.unit AND lk.seq = os.seq
             JOIN chain t ON t.unit = lk.unit AND t.seq = lk.def_seq JOIN categories c ON c.category = os.category
             WHERE sa.var IS NOT NULL AND NOT list_has_any(t.applied, os.safe_by)) WHERE n = 1""",
        {
            "chain": """SELECT unit, seq, []::VARCHAR[] AS applied FROM pf WHERE is_source AND NOT is_full
                UNION ALL SELECT p.unit, p.seq, CASE WHEN p.is_conditional THEN list_append(c.applied, p.callee) ELSE c.applied END
                FROM chain c JOIN lk ON lk.unit = c.unit AND lk.def_seq = c.seq JOIN pf p ON p.unit = lk.unit AND p.seq = lk.seq
                WHERE NOT p.is_source AND NOT p.is_full"""
        },
    )
)
def report_flows_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings when a conditional sanitizer keeps the taint and only its own sinks accept it."""
    ops = numbered_ops(spark, sf_dir)
    site = policy.site_policy(spark)
    names = taint.sanitizer_names(site)
    flagged = (
        straight_ops(ops, spark)
        .withColumn("clears", taint.sanitizer_bit(names, F.col("conditional")))
        .withColumn("is_clean", F.col("is_full"))
    )
    flagged = cut(flagged)
    state = taint.straight_line_sanitizers(flagged).withColumnRenamed("seq", "def_seq")
    arguments = (
        B.sink_arguments(ops)
        .join(flagged.select("unit", "seq", "def_seq"), ["unit", "seq"])
        .join(state, ["unit", "def_seq"], "left")
        .select(
            "unit", "seq", "pos", (F.col("tainted") & F.col("var").isNotNull()).alias("tainted"),
            taint.applied_sanitizers(names, F.col("open_mask")).alias("sanitizers"),
        )
    )
    found = taint.report_flows(ops, arguments, site, policy.category_names(spark))
    return big(found, "seq")


# ---- rewriting ----

PASSING = "SELECT unit, src AS block, any_value(dst) AS nxt FROM bg WHERE src LIKE 'error%' OR src LIKE 'view%' GROUP BY unit, src HAVING count(*) = 1 AND any_value(dst) <> src"


def passing_blocks(edges: DataFrame) -> DataFrame:
    """Error and view blocks with one way out."""
    return (
        edges.where("src LIKE 'error%' OR src LIKE 'view%'")
        .groupBy("unit", F.col("src").alias("block"))
        .agg(F.count(F.lit(1)).alias("n"), F.max("dst").alias("dst"))
        .where("n = 1")
        .select("unit", "block")
    )


@query(
    with_ctes(
        "bg",
        """SELECT DISTINCT e.unit, e.src, coalesce(f.cur, e.dst) AS dst FROM bg e LEFT JOIN final f ON f.unit = e.unit AND f.block = e.dst
           WHERE (e.unit, e.src) NOT IN (SELECT (unit, block) FROM final)""",
        {
            "ps": PASSING,
            "chase": """SELECT unit, block, nxt AS cur FROM ps UNION
                SELECT c.unit, c.block, p.nxt FROM chase c JOIN ps p ON p.unit = c.unit AND p.block = c.cur""",
            "final": "SELECT unit, block, cur FROM chase WHERE (unit, cur) NOT IN (SELECT (unit, block) FROM ps)",
        },
    )
)
def contract_pass_through(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = cut(B.block_edges(B.block_events(spark, sf_dir)))
    return graph.contract_pass_through(edges, passing_blocks(edges))


MERGE_ROWS = """SELECT e.unit, e.dst AS block, 'm:' || e.dst AS result,
    CASE WHEN s.block IS NOT NULL THEN 'm:' || e.src ELSE 'd:' || e.src END AS operand
    FROM bg e JOIN (SELECT unit, dst AS block FROM bg GROUP BY ALL HAVING count(*) > 1) m ON m.unit = e.unit AND m.block = e.dst
    LEFT JOIN (SELECT unit, dst AS block FROM bg GROUP BY ALL HAVING count(*) > 1) s ON s.unit = e.unit AND s.block = e.src"""


@query(
    with_ctes(
        "bg",
        """SELECT DISTINCT unit, block, result, operand FROM spread s WHERE operand <> result
           AND NOT EXISTS (SELECT 1 FROM gone g WHERE g.unit = s.unit AND 'm:' || g.block = s.operand)""",
        {
            "ps": PASSING,
            "ms": MERGE_ROWS,
            "gone": """SELECT DISTINCT p.unit, p.block FROM ps p JOIN ms o ON o.unit = p.unit AND o.block = p.block
                JOIN ms n ON n.unit = p.unit AND n.block = p.nxt AND n.operand = o.result""",
            "spread": """SELECT unit, block, result, operand FROM ms WHERE (unit, block) NOT IN (SELECT (unit, block) FROM gone)
                UNION SELECT s.unit, s.block, s.result, m.operand FROM spread s JOIN gone g ON g.unit = s.unit AND s.operand = 'm:' || g.block
                JOIN ms m ON m.unit = g.unit AND m.block = g.block""",
        },
    )
)
def lift_merge_operands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merges of bypassed blocks moved into the next block's merge."""
    edges = cut(B.block_edges(B.block_events(spark, sf_dir)))
    merges = cut(merge_table(edges))
    once = passing_blocks(edges).join(
        edges.where("src = dst").select("unit", F.col("src").alias("block")), ["unit", "block"], "left_anti"
    )
    removed = cut(graph.removable_merge_blocks(once, edges, merges))
    return graph.lift_merge_operands(merges, removed)


def merge_table(edges: DataFrame) -> DataFrame:
    """A merge per block with several parents over what each parent hands on."""
    several = edges.groupBy("unit", F.col("dst").alias("block")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    inner = several.select("unit", F.col("block").alias("src"), F.lit("m:").alias("mark"))
    return (
        edges.withColumnRenamed("dst", "block")
        .join(several, ["unit", "block"], "left_semi")
        .join(inner, ["unit", "src"], "left")
        .select(
            "unit", "block", F.concat(F.lit("m:"), "block").alias("result"),
            F.concat(F.coalesce("mark", F.lit("d:")), "src").alias("operand"),
        )
    )


# a read is exposed when no earlier event of the visit to its block wrote the variable: here when the block never writes it
EXPOSED = "SELECT DISTINCT unit, block, rv AS var FROM be WHERE (unit, block, rv) NOT IN (SELECT (unit, block, wv) FROM be WHERE event_type <> 'error')"
PLACED = {
    "defs": "SELECT DISTINCT unit, block, wv AS var FROM be WHERE event_type <> 'error'",
    "asked": f"""{EXPOSED} UNION SELECT a.unit, e.src, a.var FROM asked a JOIN bg e ON e.unit = a.unit AND e.dst = a.block
        WHERE NOT EXISTS (SELECT 1 FROM defs d WHERE d.unit = a.unit AND d.block = e.src AND d.var = a.var)""",
    "par": "SELECT unit, dst AS block, count(*) AS n, min(src) AS one FROM bg GROUP BY ALL",
    "up": """SELECT a.unit, a.block, a.var, a.block AS cur FROM asked a
        UNION SELECT u.unit, u.block, u.var, p.one FROM up u JOIN par p ON p.unit = u.unit AND p.block = u.cur AND p.n = 1
        WHERE u.cur = u.block OR NOT EXISTS (SELECT 1 FROM defs d WHERE d.unit = u.unit AND d.block = u.cur AND d.var = u.var)""",
    "ent": """SELECT u.unit, u.block, u.var, max(CASE WHEN d.block IS NOT NULL AND u.cur <> u.block THEN u.cur
          WHEN p.n > 1 THEN 'merge:' || u.cur END) AS value FROM up u
        LEFT JOIN par p ON p.unit = u.unit AND p.block = u.cur
        LEFT JOIN defs d ON d.unit = u.unit AND d.block = u.cur AND d.var = u.var GROUP BY ALL""",
    "placed": """SELECT DISTINCT a.unit, a.block, a.var, coalesce(d.block, n.value) AS operand FROM asked a
        JOIN par p ON p.unit = a.unit AND p.block = a.block AND p.n > 1
        JOIN bg e ON e.unit = a.unit AND e.dst = a.block
        LEFT JOIN defs d ON d.unit = a.unit AND d.block = e.src AND d.var = a.var
        LEFT JOIN ent n ON n.unit = a.unit AND n.block = e.src AND n.var = a.var""",
}


def placed_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = B.block_events(spark, sf_dir)
    defs = events.where("event_type <> 'error'").select("unit", "block", F.col("wv").alias("var")).distinct()
    reads = events.select("unit", "block", F.col("rv").alias("var")).distinct().join(
        defs, ["unit", "block", "var"], "left_anti"
    )
    return graph.place_merges(reads, defs, B.block_edges(events))


@query(
    with_ctes(
        "be bg",
        "SELECT unit, block, CAST(var AS BIGINT) AS var, operand FROM placed WHERE operand IS NULL OR operand <> 'merge:' || block",
        PLACED,
    )
)
def place_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return big(placed_merges(spark, sf_dir), "var")


def _trivial_pass(now: str, k: int) -> dict[str, str]:
    """CTEs of one pass over the merges of ``now``: those with one operand, the ends of their chains, the merges left."""
    return {
        f"s{k}": f"SELECT unit, result, min(operand) AS o FROM {now} GROUP BY ALL HAVING count(DISTINCT operand) = 1",
        f"c{k}": f"SELECT unit, result, o AS cur FROM s{k} UNION SELECT c.unit, c.result, s.o FROM c{k} c JOIN s{k} s ON s.unit = c.unit AND s.result = c.cur",
        f"f{k}": f"SELECT c.* FROM c{k} c ANTI JOIN s{k} s ON s.unit = c.unit AND s.result = c.cur",
        f"m{k}": f"""SELECT DISTINCT unit, result, operand FROM (
            SELECT m.unit, m.result, CASE WHEN s.result IS NULL THEN m.operand ELSE f.cur END AS operand
            FROM (SELECT * FROM {now} n ANTI JOIN s{k} s ON s.unit = n.unit AND s.result = n.result) m
            LEFT JOIN s{k} s ON s.unit = m.unit AND s.result = m.operand LEFT JOIN f{k} f ON f.unit = m.unit AND f.result = m.operand)
            WHERE operand IS NOT NULL AND operand <> result""",
    }


# a pass more than the block graphs need changes nothing
TRIVIAL_PASSES = 8
TRIVIAL = {
    "m0": """SELECT DISTINCT unit, var || '|merge:' || block AS result, var || '|' || coalesce(operand, 'none') AS operand FROM placed
        WHERE operand IS NULL OR operand <> 'merge:' || block"""
} | {name: body for k in range(1, TRIVIAL_PASSES + 1) for name, body in _trivial_pass(f"m{k - 1}", k).items()}


@query(with_ctes("be bg", f"SELECT unit, result, operand FROM m{TRIVIAL_PASSES}", PLACED | TRIVIAL))
def eliminate_trivial_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merges left when those with a single operand are replaced everywhere."""
    merges = placed_merges(spark, sf_dir).select(
        "unit",
        F.concat_ws("|", "var", F.concat(F.lit("merge:"), "block")).alias("result"),
        F.concat_ws("|", "var", F.coalesce("operand", F.lit("none"))).alias("operand"),
    )
    return graph.eliminate_trivial_merges(merges)[0]


@query(
    with_ctes(
        "ev",
        """SELECT event_id, array_to_string(list_sort(ids), ',') || CASE WHEN named THEN ',n' ELSE '' END AS cases
           FROM (SELECT event_id, list_distinct([k, k % 10, k // 10]) AS ids, k % 3 = 0 AS named FROM ev)""",
    )
)
def order_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = B.decode_events(B.table(spark, sf_dir, "events"))

    def case(id_: Column, key: Column) -> Column:
        return F.struct(id_.cast("string").alias("id"), key.cast("string").alias("key"))

    ids = F.transform(F.array_distinct(F.array("k", "rv", "wv")), lambda x: case(x, x))
    named = F.when(F.col("k") % 3 == 0, F.array(case(F.lit(None), F.lit("n")))).otherwise(
        F.array().cast("array<struct<id:string,key:string>>")
    )
    ordered = case_order(F.concat(named, ids))
    return events.select("event_id", F.array_join(F.transform(ordered, lambda c: c["key"]), ",").alias("cases"))
