"""Queries of the policy joins, links, state merges and findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsieve.functions import expressions as X
from flowsieve.functions.operands import parse_literal
from flowsieve.operators import classify, links, states, taint
from flowsieve.operators.ordered import row_sequence, with_slice
from flowsieve.plans import bindings as B
from flowsieve.plans.catalog import at, query, sql_list, with_ctes
from flowsieve.session import cut
from flowsieve.sources import policy
from flowsieve.sources.policy import (
    FULL_SANITIZERS,
    SOURCE_VARIABLES,
)


def ops_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.program_ops(B.program_events(spark, sf_dir))


def numbered_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ops, numbered once and written, for queries that read them several times."""
    return cut(ops_of(spark, sf_dir))


def place(df: DataFrame, *more: str) -> DataFrame:
    """unit and seq as BIGINT plus the named columns."""
    return df.select("unit", F.col("seq").cast("bigint").alias("seq"), *more)


def in_list(column: str, names: list[str]) -> str:
    return f"list_contains({sql_list(names)}, {column})"


@query(with_ctes("po", f"SELECT unit, CAST(seq AS BIGINT) AS seq, read_name FROM po WHERE {in_list('read_name', SOURCE_VARIABLES)}"))
def classify_source_vars(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classify.classify_source_vars(ops_of(spark, sf_dir), policy.site_policy(spark), "read_name")
    return place(found, "read_name")


@query(with_ctes("po", f"SELECT unit, CAST(seq AS BIGINT) AS seq, callee FROM po WHERE {in_list('callee', B.SOURCE_CALL_NAMES)}"))
def classify_source_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place(classify.classify_source_calls(ops_of(spark, sf_dir), policy.site_policy(spark)), "callee")


@query(
    with_ctes(
        "po",
        f"""SELECT unit, CAST(seq AS BIGINT) AS seq, op, callee FROM po
            WHERE {in_list("CASE WHEN starts_with(op, 'Expr_Cast_') THEN op ELSE callee END", FULL_SANITIZERS)}""",
    )
)
def classify_full_sanitizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place(classify.classify_full_sanitizers(ops_of(spark, sf_dir), policy.site_policy(spark)), "op", "callee")


ALL_CONDITIONAL = [*dict.fromkeys([*[n for v in policy.CONDITIONAL_SANITIZERS.values() for n in v], "esc_sql"])]


@query(
    with_ctes(
        "po",
        f"SELECT unit, CAST(seq AS BIGINT) AS seq, callee AS sanitizers FROM po WHERE {in_list('callee', ALL_CONDITIONAL)}",
    )
)
def classify_conditional_sanitizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classify.classify_conditional_sanitizers(ops_of(spark, sf_dir), policy.site_policy(spark))
    return place(found, F.array_join("sanitizers", ",").alias("sanitizers"))


@query(
    with_ctes(
        "os",
        """SELECT unit, CAST(seq AS BIGINT) AS seq, category, array_to_string(positions, ',') AS positions,
           array_to_string(safe_by, ',') AS safe_by FROM os""",
    )
)
def classify_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classify.classify_sinks(ops_of(spark, sf_dir), policy.site_policy(spark))
    return place(
        found, "category", F.array_join("positions", ",").alias("positions"), F.array_join("safe_by", ",").alias("safe_by")
    )


@query(
    with_ctes(
        "os sa",
        """SELECT os.unit, CAST(os.seq AS BIGINT) AS seq, os.category, CAST(sa.pos AS BIGINT) AS pos
           FROM os JOIN sa ON sa.unit = os.unit AND sa.seq = os.seq
           WHERE os.positions[1] = 0 OR list_contains(os.positions, sa.pos)""",
    )
)
def match_sink_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = ops_of(spark, sf_dir)
    sinks = classify.classify_sinks(ops, policy.site_policy(spark))
    matched = classify.match_sink_arguments(sinks, B.sink_arguments(ops), ["unit", "seq"])
    return place(matched, "category", F.col("pos").cast("bigint").alias("pos"))


# an argument counts as tainted when its instruction number is odd here
APPLIED = ["htmlentities", "escapeshellarg", "addslashes", "preg_quote"]


@query(
    with_ctes(
        "os sa",
        f"""SELECT os.unit, CAST(os.seq AS BIGINT) AS seq, os.category, CAST(sa.pos AS BIGINT) AS pos
           FROM os JOIN sa ON sa.unit = os.unit AND sa.seq = os.seq
           WHERE (os.positions[1] = 0 OR list_contains(os.positions, sa.pos)) AND os.seq % 2 = 1
           AND NOT list_has_any([{at(APPLIED, "os.k")}], os.safe_by)""",
    )
)
def sanitizer_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = ops_of(spark, sf_dir)
    sinks = classify.classify_sinks(ops, policy.site_policy(spark))
    matched = classify.match_sink_arguments(sinks, B.sink_arguments(ops), ["unit", "seq"])
    judged = matched.withColumn("tainted", F.col("seq") % 2 == 1).withColumn(
        "sanitizers", F.array(B.pick(APPLIED, F.col("k")))
    )
    return place(classify.sanitizer_mismatch(judged), "category", F.col("pos").cast("bigint").alias("pos"))


UNITS_SQL = "(SELECT max(user_id) + 1 FROM events)"


# every ninth call goes to a unit that is not declared
def event_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = B.unit_count(spark, sf_dir)
    pe = B.program_events(spark, sf_dir).where("event_type = 'purchase'")
    callee = F.when(F.col("k") % 9 == 0, F.lit(units) + F.col("k")).otherwise(B.user_callee(pe, units))
    return pe.withColumn("callee", callee)


CALLS_SQL = f"""SELECT unit, seq, k, rv, wv, CASE WHEN k % 9 = 0 THEN {UNITS_SQL} + k ELSE (unit + k) % {UNITS_SQL} END AS callee
    FROM pe WHERE event_type = 'purchase'"""


@query(
    with_ctes(
        "pe",
        """SELECT c.unit, CAST(c.seq AS BIGINT) AS seq, c.callee, u.user_id IS NOT NULL AS is_user FROM calls c
           LEFT JOIN (SELECT DISTINCT user_id FROM events) u ON u.user_id = c.callee""",
        {"calls": CALLS_SQL},
    )
)
def resolve_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = B.table(spark, sf_dir, "events").select(F.col("user_id").alias("unit")).distinct()
    return place(links.resolve_calls(event_calls(spark, sf_dir), units), "callee", "is_user")


def event_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A unit has 1 + unit % 3 parameters, named after its number and their place."""
    units = B.table(spark, sf_dir, "events").select(F.col("user_id").alias("unit")).distinct()
    spread = units.select("unit", F.explode(F.sequence(F.lit(1), (F.col("unit") % 3 + 1).cast("int"))).alias("pos"))
    return spread.withColumn("var", F.concat(F.lit("p"), "unit", F.lit("_"), "pos"))


@query(
    with_ctes(
        "pe",
        """SELECT a.unit, CAST(a.seq AS BIGINT) AS seq, a.callee, CAST(a.pos AS BIGINT) AS pos, a.arg, 'p' || u.unit || '_' || a.pos AS param
           FROM (SELECT unit, seq, callee, 1 AS pos, 'v' || rv AS arg FROM calls
                 UNION ALL SELECT unit, seq, callee, 2, 'v' || wv FROM calls) a
           JOIN (SELECT DISTINCT user_id AS unit FROM events) u ON u.unit = a.callee AND a.pos <= u.unit % 3 + 1""",
        {"calls": CALLS_SQL},
    )
)
def bind_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = event_calls(spark, sf_dir)
    arguments = calls.select(
        "unit", "seq", "callee", F.posexplode(F.array(F.concat(F.lit("v"), "rv"), F.concat(F.lit("v"), "wv"))).alias("_i", "arg")
    ).withColumn("pos", F.col("_i") + 1)
    bound = links.bind_arguments(arguments, event_params(spark, sf_dir))
    return place(bound, "callee", F.col("pos").cast("bigint").alias("pos"), "arg", "param")


# a return: a signup is tainted, a view carries the name of a sanitizer, a click is clean
RETURNS_SQL = f"""SELECT user_id AS unit, event_type = 'signup' AS tainted,
    CASE WHEN event_type = 'view' THEN [{at(APPLIED, 'k')}] ELSE []::VARCHAR[] END AS sanitizers
    FROM ev WHERE event_type IN ('signup', 'view', 'click') AND user_id % 4 <> 0"""
MERGED_SQL = """SELECT unit, bool_or(tainted) AS tainted,
    array_to_string(list_sort(list_distinct(flatten(list(sanitizers)))), ',') AS sanitizers FROM returns GROUP BY unit"""


def event_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = B.decode_events(B.table(spark, sf_dir, "events"))
    names = F.when(F.col("event_type") == "view", F.array(B.pick(APPLIED, F.col("k")))).otherwise(
        F.array().cast("array<string>")
    )
    return events.where("event_type IN ('signup', 'view', 'click') AND unit % 4 <> 0").select(
        "unit", (F.col("event_type") == "signup").alias("tainted"), names.alias("sanitizers")
    )


def flat(df: DataFrame) -> DataFrame:
    return df.withColumn("sanitizers", F.array_join("sanitizers", ","))


@query(
    with_ctes(
        "pe",
        """SELECT c.unit, CAST(c.seq AS BIGINT) AS seq, c.callee, coalesce(m.tainted, false) AS tainted,
           coalesce(m.sanitizers, '') AS sanitizers FROM calls c LEFT JOIN merged m ON m.unit = c.callee""",
        {"calls": CALLS_SQL, "returns": RETURNS_SQL, "merged": MERGED_SQL},
    )
)
def bind_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = event_calls(spark, sf_dir).select("unit", "seq", "callee")
    return place(flat(links.bind_returns(calls, event_returns(spark, sf_dir))), "callee", "tainted", "sanitizers")


@query(with_ctes("ev", "SELECT * FROM merged", {"returns": RETURNS_SQL, "merged": MERGED_SQL}))
def merge_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(links.merge_returns(event_returns(spark, sf_dir)))


@query(
    with_ctes(
        "lk",
        """SELECT lk.unit, CAST(lk.def_seq AS BIGINT) AS def_seq, CAST(lk.seq AS BIGINT) AS use_seq
           FROM lk WHERE lk.def_seq IS NOT NULL""",
    )
)
def def_use_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    pe = B.program_events(spark, sf_dir)
    # SSA operands: a write's id is its own number, a read's the number of what reaches it
    reads = B.program_links(pe).select("unit", "var", F.col("def_seq").alias("id"), "seq")
    writes = pe.where("event_type <> 'error'").select("unit", F.col("wv").alias("var"), F.col("seq").alias("id"), "seq")
    edges = links.def_use_edges(writes, reads, ["unit", "var", "id"])
    return edges.select("unit", *[F.col(c).cast("bigint").alias(c) for c in ("def_seq", "use_seq")])


@query(
    with_ctes(
        "lk", "SELECT unit, CAST(var AS BIGINT) AS var, CAST(seq AS BIGINT) AS seq, CAST(def_seq AS BIGINT) AS def_seq FROM lk"
    )
)
def reaching_definition(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = B.program_links(B.program_events(spark, sf_dir))
    return found.select("unit", *[F.col(c).cast("bigint").alias(c) for c in ("var", "seq", "def_seq")])


def merge_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A merge per block with several parents: operands ``v0``, ``v1``; its numbered parents; and the ways in."""
    edges = cut(B.block_edges(B.block_events(spark, sf_dir)).withColumnRenamed("dst", "block").withColumnRenamed("src", "parent"))
    parents = cut(row_sequence(edges, ["unit", "block"], ["parent"], "number"))
    several = parents.where("number = 2").select("unit", "block", F.lit("m").alias("var"))
    named = F.array(*[F.struct(F.lit(k + 1).alias("number"), F.lit(f"v{k}").alias("operand")) for k in range(2)])
    return several.select("*", F.inline(named)), parents, edges.withColumnRenamed("parent", "came_from")


@query(
    with_ctes(
        "bg",
        """SELECT unit, block, came_from, CASE WHEN n = 1 THEN 'v0' ELSE 'v1' END AS operand
           FROM (SELECT unit, dst AS block, src AS came_from, row_number() OVER (PARTITION BY unit, dst ORDER BY src) AS n,
                 count(*) OVER (PARTITION BY unit, dst) AS parents FROM bg) WHERE parents > 1""",
    )
)
def merge_operand_by_predecessor(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = links.merge_operand_by_predecessor(*merge_rows(spark, sf_dir))
    return found.select("unit", "block", "came_from", "operand")


@query(with_ctes("bg bb", "SELECT unit, dst AS block, src FROM bg WHERE src NOT LIKE 'error%'"))
def predecessors(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = B.block_events(spark, sf_dir)
    emitted = B.block_list(events).where("block NOT LIKE 'error%'")
    return links.predecessors(B.block_edges(events), emitted)


@query(
    r"""WITH inc AS (SELECT page_id, '/lib/' || (page_id % 11) || '/p' || (page_id * 7 % 60) || '.php' AS path FROM pages)
        SELECT page_id, path, CASE WHEN EXISTS (SELECT 1 FROM pages p WHERE 'p' || p.page_id || '.php' = regexp_extract(inc.path, '[^/]*$'))
          THEN 'main_' || regexp_extract(path, '[^/]*$') END AS target FROM inc"""
)
def link_includes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = B.table(spark, sf_dir, "pages").select("page_id")
    literal = F.concat(
        F.lit("LITERAL('/lib/"), F.col("page_id") % 11, F.lit("/p"), F.col("page_id") * 7 % 60, F.lit(".php')")
    )
    includes = pages.select("page_id", F.translate(parse_literal(literal), "'", "").alias("path"))
    units = pages.select(F.concat(F.lit("main_p"), "page_id", F.lit(".php")).alias("unit"))
    return links.link_includes(includes, units)


@query(
    with_ctes(
        "pe",
        f"""SELECT unit, CAST(seq AS BIGINT) AS seq, callee, ({sql_list(list(X.TYPE_PREDICATES.values()))})[CAST(k % 16 AS INTEGER) + 1] AS tested_type
            FROM (SELECT *, {at([*X.TYPE_PREDICATES, "is_file", "isset"], "k")} AS callee FROM pe WHERE event_type = 'click')
            WHERE k % 16 < 14""",
    )
)
def guard_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    pe = B.program_events(spark, sf_dir).where("event_type = 'click'")
    calls = pe.withColumn("callee", B.pick([*X.TYPE_PREDICATES, "is_file", "isset"], F.col("k")))
    return place(classify.guard_types(calls), "callee", "tested_type")


# ---- state merges ----

BLOCK_STATES_SQL = f"""SELECT unit, block, wv AS var, bool_or(event_type = 'signup') AS tainted,
    list_distinct(list({at(APPLIED, 'k')}) FILTER (event_type = 'view')) AS sanitizers
    FROM be WHERE event_type <> 'error' GROUP BY ALL"""


def block_states(events: DataFrame) -> DataFrame:
    """State of each variable at the end of the block that writes it."""
    written = events.where("event_type <> 'error'")
    return written.groupBy("unit", "block", F.col("wv").alias("var")).agg(
        F.bool_or(F.col("event_type") == "signup").alias("tainted"),
        F.array_sort(
            F.collect_set(F.when(F.col("event_type") == "view", B.pick(APPLIED, F.col("k"))))
        ).alias("sanitizers"),
    )


def entry_states(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    events = B.block_events(spark, sf_dir) if events is None else events
    edges = B.block_edges(events).select("unit", F.col("src").alias("block"), "dst")
    incoming = block_states(events).join(edges, ["unit", "block"]).select(
        "unit", F.col("dst").alias("block"), F.col("var").cast("bigint").alias("var"), "tainted", "sanitizers"
    )
    return flat(states.merge_union(incoming, ["unit", "block", "var"]))


ENTRY_SQL = """SELECT s.unit, bg.dst AS block, CAST(s.var AS BIGINT) AS var, bool_or(tainted) AS tainted,
    array_to_string(list_sort(list_distinct(flatten(list(coalesce(sanitizers, []::VARCHAR[]))))), ',') AS sanitizers
    FROM states s JOIN bg ON bg.unit = s.unit AND bg.src = s.block GROUP BY ALL"""


@query(with_ctes("bg", ENTRY_SQL, {"states": BLOCK_STATES_SQL}))
def merge_entry_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entry_states(spark, sf_dir)


OP_INPUTS_SQL = f"""SELECT unit, seq, 0 AS part, k % 2 = 0 AS tainted,
    list_distinct([{at(APPLIED, "k")}, {at(APPLIED, "rv")}]) AS names FROM pe
    UNION ALL SELECT lk.unit, lk.seq, 1, d.k % 2 = 0, list_distinct([{at(APPLIED, "d.k")}, {at(APPLIED, "d.rv")}])
    FROM lk JOIN pe d ON d.unit = lk.unit AND d.seq = lk.def_seq"""


@query(
    with_ctes(
        "lk",
        """SELECT a.unit, CAST(a.seq AS BIGINT) AS seq, a.tainted OR coalesce(b.tainted, false) AS tainted,
           array_to_string(list_sort(CASE WHEN b.seq IS NULL THEN a.names ELSE list_intersect(a.names, b.names) END), ',') AS sanitizers
           FROM inputs a LEFT JOIN inputs b ON b.unit = a.unit AND b.seq = a.seq AND b.part = 1 WHERE a.part = 0""",
        {"inputs": OP_INPUTS_SQL},
    )
)
def merge_op_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    pe = B.program_events(spark, sf_dir)
    names = F.array(B.pick(APPLIED, F.col("k")), B.pick(APPLIED, F.col("rv")))
    own = pe.select("unit", "seq", (F.col("k") % 2 == 0).alias("tainted"), names.alias("sanitizers"))
    # inputs of an op: its own old state and the state of what it reads
    read = B.program_links(pe).where("def_seq IS NOT NULL").select("unit", "seq", "def_seq")
    other = read.join(own.withColumnRenamed("seq", "def_seq"), ["unit", "def_seq"]).drop("def_seq")
    merged = states.merge_intersect(own.unionByName(other), ["unit", "seq"])
    return place(flat(merged), "tainted", "sanitizers")


@query(
    with_ctes(
        "pe",
        """SELECT unit, CAST(seq AS BIGINT) AS seq, CAST(1 AS BIGINT) AS pos, 'v' || rv AS var, k % 4 = 0 OR k % 6 = 0 AS tainted
           FROM pe WHERE event_type = 'click' AND k % 2 = 0""",
    )
)
def propagate_through_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    pe = B.program_events(spark, sf_dir).where("event_type = 'click'")
    arguments = pe.select(
        "unit",
        "seq",
        F.when(F.col("k") % 2 == 0, "array_push").otherwise("array_pop").alias("callee"),
        F.inline(
            F.array(
                F.struct(F.lit(1).alias("pos"), F.concat(F.lit("v"), "rv").alias("var"), (F.col("k") % 4 == 0).alias("tainted")),
                F.struct(F.lit(2).alias("pos"), F.concat(F.lit("v"), "wv").alias("var"), (F.col("k") % 6 == 0).alias("tainted")),
            )
        ),
    )
    moved = states.propagate_through_native(arguments, policy.load_policy(spark), ["unit", "seq"])
    return place(moved, F.col("pos").cast("bigint").alias("pos"), "var", "tainted")


# ---- findings ----


def straight_ops(ops: DataFrame, spark: SparkSession) -> DataFrame:
    """Ops with their definition and the flags the policy gives them."""
    flagged = classify.flag_ops(B.program_links(ops), policy.site_policy(spark))
    return flagged.withColumn("is_clean", F.col("is_full") | F.col("conditional").isNotNull())


def tainted_arguments(ops: DataFrame, spark: SparkSession) -> DataFrame:
    """Sink arguments with the state of the definition they read, not of what the sink makes of it."""
    linked = cut(straight_ops(ops, spark))
    state = taint.straight_line_taint(linked).withColumnRenamed("seq", "def_seq")
    return (
        B.sink_arguments(ops)
        .join(linked.select("unit", "seq", "def_seq"), ["unit", "seq"])
        .join(state, ["unit", "def_seq"], "left")
        .withColumn("tainted", F.coalesce(F.col("tainted") & F.col("var").isNotNull(), F.lit(False)))
        .drop("def_seq")
        .withColumn("sanitizers", F.array().cast("array<string>"))
    )


@query(with_ctes("tt", "SELECT unit, CAST(seq AS BIGINT) AS seq FROM tt"))
def taint_fixpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = ops_of(spark, sf_dir)
    return place(taint.straight_line_taint(straight_ops(ops, spark)).where("tainted"))


REPORT_SQL = """SELECT file, start_line, unit, CAST(seq AS BIGINT) AS seq, category, message
    FROM (SELECT *, row_number() OVER (PARTITION BY file, start_line ORDER BY seq, category_rank, pos) AS n FROM fl) WHERE n = 1"""


@query(with_ctes("fl", REPORT_SQL))
def report_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = numbered_ops(spark, sf_dir)
    found = taint.report_flows(
        ops, tainted_arguments(ops, spark), policy.site_policy(spark), policy.category_names(spark)
    )
    return found.withColumn("seq", F.col("seq").cast("bigint"))


@query(
    with_ctes(
        "fl",
        "SELECT category, count(*) AS findings FROM r GROUP BY ROLLUP (category)",
        {"r": REPORT_SQL},
    )
)
def findings_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return states.findings_summary(report_flows(spark, sf_dir))


@query(
    with_ctes(
        "os",
        """SELECT file, start_line, unit, CAST(seq AS BIGINT) AS seq, category FROM (SELECT *,
           row_number() OVER (PARTITION BY file, start_line ORDER BY seq, category_rank) AS n FROM os) WHERE n = 1""",
    )
)
def dedupe_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    sinks = classify.classify_sinks(ops_of(spark, sf_dir), policy.site_policy(spark))
    first = states.dedupe_findings(sinks, ["file", "start_line"], ["unit", "seq", "category"])
    return first.withColumn("seq", F.col("seq").cast("bigint"))


@query(
    with_ctes(
        "po",
        """SELECT CAST(k % 2 AS BIGINT) AS stage, event_type AS module,
           count(DISTINCT CASE WHEN start_line <> 'None' THEN file || ':' || start_line END) AS lines FROM po GROUP BY ALL""",
    )
)
def coverage_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    visits = ops_of(spark, sf_dir).select(
        (F.col("k") % 2).cast("bigint").alias("stage"), F.col("event_type").alias("module"), "file", "start_line"
    )
    return states.coverage_stats(visits)


@query(with_ctes("be", "SELECT unit, block, count(*) AS visits, count(*) > 1 AS looping FROM be GROUP BY ALL"))
def visit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return states.visit_counts(B.block_events(spark, sf_dir))


@query(
    with_ctes(
        "pe",
        """SELECT unit, CAST(var AS BIGINT) AS var,
           count(*) FILTER (role = 'write') AS write_count, CAST(min(seq) FILTER (role = 'write') AS BIGINT) AS write_first,
           CAST(max(seq) FILTER (role = 'write') AS BIGINT) AS write_last, count(*) FILTER (role = 'read') AS read_count,
           CAST(min(seq) FILTER (role = 'read') AS BIGINT) AS read_first, CAST(max(seq) FILTER (role = 'read') AS BIGINT) AS read_last
           FROM (SELECT unit, rv AS var, 'read' AS role, seq FROM pe
                 UNION ALL SELECT unit, wv, 'write', seq FROM pe WHERE event_type <> 'error') GROUP BY ALL""",
    )
)
def variable_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    pe = B.program_events(spark, sf_dir)
    roles = F.array(
        F.struct(F.col("rv").alias("var"), F.lit("read").alias("role")),
        F.struct(F.when(F.col("event_type") != "error", F.col("wv")).alias("var"), F.lit("write").alias("role")),
    )
    accesses = pe.select("unit", F.col("seq").cast("bigint").alias("seq"), F.inline(roles)).where("var IS NOT NULL")
    return states.variable_usage(accesses.withColumn("var", F.col("var").cast("bigint")), ["unit", "var"])


@query(
    with_ctes(
        "pe",
        """SELECT unit, CAST(var AS BIGINT) AS var, role, row_number() OVER (PARTITION BY unit, var, role ORDER BY seq) AS number, CAST(seq AS BIGINT) AS seq
           FROM (SELECT unit, rv AS var, 'read' AS role, seq FROM pe UNION ALL SELECT unit, wv, 'write', seq FROM pe WHERE event_type <> 'error')""",
    )
)
def variable_accesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The instructions that read and write each variable, in order."""
    pe = B.program_events(spark, sf_dir)
    write = F.when(F.col("event_type") != "error", F.col("wv"))
    roles = F.array(F.struct(F.col("rv").alias("var"), F.lit("read").alias("role")), F.struct(write.alias("var"), F.lit("write").alias("role")))
    accesses = pe.select("unit", *with_slice(pe), "seq", F.inline(roles)).where("var IS NOT NULL")
    numbered = states.variable_accesses(accesses, ["unit", "var"])
    return place(numbered, F.col("var").cast("bigint").alias("var"), "role", F.col("number").cast("bigint").alias("number"))


SET_SQL = f"""SELECT event_id, list_distinct([{at(APPLIED, 'k')}, {at(APPLIED, 'k // 10')}]) AS a,
    list_distinct([{at(APPLIED, 'k % 10')}, {at(APPLIED, 'user_id')}]) AS b FROM ev"""


def _state_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = B.decode_events(B.table(spark, sf_dir, "events"))
    return events.select(
        "event_id",
        F.array(B.pick(APPLIED, F.col("k")), B.pick(APPLIED, F.col("wv"))).alias("a"),
        F.array(B.pick(APPLIED, F.col("rv")), B.pick(APPLIED, F.col("unit"))).alias("b"),
    )


@query(
    with_ctes(
        "ev", "SELECT event_id, array_to_string(list_sort(list_distinct(list_concat(a, b))), ',') AS names FROM s", {"s": SET_SQL}
    )
)
def state_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = _state_sets(spark, sf_dir)
    return sets.select("event_id", F.array_join(states.state_union(F.col("a"), F.col("b")), ",").alias("names"))


@query(
    with_ctes("ev", "SELECT event_id, array_to_string(list_sort(list_intersect(a, b)), ',') AS names FROM s", {"s": SET_SQL})
)
def state_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = _state_sets(spark, sf_dir)
    return sets.select("event_id", F.array_join(states.state_intersect(F.col("a"), F.col("b")), ",").alias("names"))
