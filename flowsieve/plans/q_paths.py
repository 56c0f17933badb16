"""Queries of paths, conditions, guards, symbols and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowsieve.functions import expressions as X
from flowsieve.operators import compare, guards, links, paths, symbolic, walks
from flowsieve.operators.block_states import taint_block_states as taint_block_state
from flowsieve.operators.ordered import row_sequence, with_slice
from flowsieve.plans import bindings as B
from flowsieve.plans.catalog import at, query, sql_list, with_ctes
from flowsieve.plans.q_graphs import BLOCK_TAINT, COPIES, STATE_PARTS, big, block_steps, block_taint
from flowsieve.plans.q_joins import place
from flowsieve.session import cut
from flowsieve.sources.policy import SOURCE_VARIABLES


@query(
    with_ctes(
        "bg b0",
        """SELECT unit, array_to_string(path, '>') AS path, EXISTS (SELECT 1 FROM bg e WHERE e.unit = p.unit AND e.src = p.block
             AND list_contains(p.path, e.dst)) AS imprecise FROM p""",
        {
            "p": """SELECT unit, block, [block] AS path FROM b0 UNION ALL SELECT p.unit, e.dst, list_append(p.path, e.dst)
                FROM p JOIN bg e ON e.unit = p.unit AND e.src = p.block WHERE NOT list_contains(p.path, e.dst)"""
        },
    )
)
def enumerate_paths_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ways from the entry that enter no block twice."""
    events = B.block_events(spark, sf_dir)
    found = paths.enumerate_paths(cut(B.block_edges(events)), B.block_entries(events), max_loop=1)
    return found.select("unit", F.array_join("path", ">").alias("path"), "imprecise")


@query(
    with_ctes(
        "bg b0",
        """SELECT unit, array_to_string(path, '>') AS path, EXISTS (SELECT 1 FROM bg e WHERE e.unit = p.unit AND e.src = p.block
             AND len([b FOR b IN p.path IF b = e.dst]) >= 2) AS imprecise FROM p""",
        {
            "p": """SELECT unit, block, [block] AS path FROM b0 UNION ALL SELECT p.unit, e.dst, list_append(p.path, e.dst)
                FROM p JOIN bg e ON e.unit = p.unit AND e.src = p.block WHERE len([b FOR b IN p.path IF b = e.dst]) < 2"""
        },
    )
)
def enumerate_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ways from the entry that go round a loop: each block at most twice, on the whole block graph."""
    events = B.block_events(spark, sf_dir)
    found = paths.enumerate_paths(cut(B.block_edges(events)), B.block_entries(events), max_loop=2)
    return found.select("unit", F.array_join("path", ">").alias("path"), "imprecise")


# ---- walks with their conditions ----

# the first event of a block decides: clicks and errors test a variable, the least target being the if-edge; views
# switch over it, with a case per target and the last one as default; signups write one
WALK_PARTS = {
    "first_of": f"""SELECT unit, block, event_type, rv % 3 AS var, {at(B.COMPARATORS, 'k')} AS cmp, k % 8 AS const
        FROM (SELECT *, row_number() OVER (PARTITION BY unit, block ORDER BY ts, event_id) AS n FROM be) WHERE n = 1""",
    "ranked": "SELECT *, row_number() OVER (PARTITION BY unit, src ORDER BY dst) AS n, count(*) OVER (PARTITION BY unit, src) AS targets FROM bg",
    "ec": """SELECT r.unit, r.src, r.dst, CASE
          WHEN event_type IN ('click', 'error') AND n = 1 THEN [{'var': var, 'cmp': cmp, 'const': const}]
          WHEN event_type IN ('click', 'error') THEN [{'var': var, 'cmp': CASE cmp WHEN '=' THEN '!=' WHEN '!=' THEN '=' WHEN '>' THEN '<='
            WHEN '<=' THEN '>' WHEN '<' THEN '>=' ELSE '<' END, 'const': const}]
          WHEN event_type = 'view' AND n < targets THEN [{'var': var, 'cmp': '=', 'const': n}] ELSE [] END AS conds
        FROM ranked r JOIN first_of f ON f.unit = r.unit AND f.block = r.src""",
    "wr": "SELECT unit, block, list(DISTINCT wv % 3) AS vars FROM be WHERE event_type = 'signup' GROUP BY ALL",
    "go": """SELECT ec.*, coalesce(wr.vars, []) AS gone FROM ec LEFT JOIN wr ON wr.unit = ec.unit AND wr.block = ec.dst""",
}


def _contradiction(conds: str) -> str:
    """SQL: the conditions on some variable leave no whole number."""
    def low(v: int) -> str:
        return f"list_max([c.const + CASE WHEN c.cmp = '>' THEN 1 ELSE 0 END FOR c IN {conds} IF c.var = {v} AND c.cmp IN ('=', '>', '>=')])"

    def high(v: int) -> str:
        return f"list_min([c.const - CASE WHEN c.cmp = '<' THEN 1 ELSE 0 END FOR c IN {conds} IF c.var = {v} AND c.cmp IN ('=', '<', '<=')])"

    def holes(v: int) -> str:
        return f"len(list_distinct([c.const FOR c IN {conds} IF c.var = {v} AND c.cmp = '!=' AND c.const BETWEEN {low(v)} AND {high(v)}]))"

    return " OR ".join(f"coalesce({low(v)} > {high(v)} OR {holes(v)} >= {high(v)} - {low(v)} + 1, false)" for v in range(3))


def walk_tables(events: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(edges, entries, conditions, writes) of the block graph."""
    edges = cut(B.block_edges(events))
    place = Window.partitionBy("unit", "src")
    ranked = edges.withColumn("n", F.row_number().over(place.orderBy("dst"))).withColumn("targets", F.count(F.lit(1)).over(place))
    payload = F.struct("event_type", (F.col("rv") % 3).alias("var"), B.pick(B.COMPARATORS, F.col("k")).alias("cmp"), (F.col("k") % 8).alias("const"))
    first = events.groupBy("unit", F.col("block").alias("src")).agg(F.min_by(payload, F.struct("ts", "event_id")).alias("_f")).select("unit", "src", "_f.*")
    steps = ranked.select(
        F.struct("unit", "src", "dst").alias("path"), F.lit(1).alias("seq"), "unit", "src", F.when(F.col("n") == 1, "if").otherwise("else").alias("label")
    )
    guards_of = first.where("event_type IN ('click', 'error')").withColumn("same_target", F.lit(False))
    tested = paths.path_conditions(steps, guards_of).select("path.*", "var", "cmp", "const")
    case = F.when(F.col("n") == F.col("targets"), "default").otherwise(F.col("n").cast("string"))
    cases = ranked.groupBy("unit", "src").agg(F.map_from_entries(F.collect_list(F.struct(case, F.col("dst")))).alias("cases"))
    switched = paths.switch_conditions(first.where("event_type = 'view'").drop("event_type", "cmp", "const").join(cases, ["unit", "src"]))
    switched = switched.select("unit", "src", "dst", "var", "cmp", F.col("const").cast("int").alias("const"))
    writes = events.where("event_type = 'signup'").select("unit", "block", (F.col("wv") % 3).alias("var")).distinct()
    return edges, B.block_entries(events), cut(tested.unionByName(switched)), writes


@query(
    with_ctes(
        "be bg b0",
        """SELECT w.unit, array_to_string(w.path, '>') AS path, EXISTS (SELECT 1 FROM tried t WHERE t.unit = w.unit AND t.path = w.path AND t.often >= 2) AS stopped FROM w""",
        WALK_PARTS
        | {
            "w": f"""SELECT unit, block, [block] AS path, []::STRUCT(var INTEGER, cmp VARCHAR, const BIGINT)[] AS conds FROM b0
                UNION ALL SELECT unit, dst, list_append(path, dst), [c FOR c IN met IF NOT list_contains(gone, c.var)]
                FROM (SELECT w.unit, g.dst, w.path, g.gone, list_concat(w.conds, g.conds) AS met FROM w JOIN go g ON g.unit = w.unit AND g.src = w.block
                      WHERE len([b FOR b IN w.path IF b = g.dst]) < 2) WHERE NOT ({_contradiction('met')})""",
            "tried": f"""SELECT unit, path, often FROM (SELECT w.unit, w.path, len([b FOR b IN w.path IF b = g.dst]) AS often, list_concat(w.conds, g.conds) AS met
                FROM w JOIN go g ON g.unit = w.unit AND g.src = w.block) WHERE NOT ({_contradiction('met')})""",
        },
    )
)
def feasible_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walks that enter each block at most twice, their conditions met on the way."""
    found = walks.feasible_walks(*walk_tables(B.block_events(spark, sf_dir)), max_loop=2, separator=">")
    return found.select("unit", "path", "stopped")


FEASIBLE_PARTS = WALK_PARTS | {
    "fs": f"""SELECT unit, block, []::STRUCT(var INTEGER, cmp VARCHAR, const BIGINT)[] AS conds FROM b0
        UNION SELECT unit, dst, list_sort(list_distinct([c FOR c IN met IF NOT list_contains(gone, c.var)]))
        FROM (SELECT s.unit, g.dst, g.gone, list_concat(s.conds, g.conds) AS met FROM fs s JOIN go g ON g.unit = s.unit AND g.src = s.block)
        WHERE NOT ({_contradiction('met')})""",
    "fe": f"""SELECT DISTINCT unit, src, dst FROM (SELECT s.unit, g.src, g.dst, list_concat(s.conds, g.conds) AS met
        FROM fs s JOIN go g ON g.unit = s.unit AND g.src = s.block) WHERE NOT ({_contradiction('met')})""",
}


@query(with_ctes("be bg b0", "SELECT unit, src, dst FROM fe", FEASIBLE_PARTS))
def feasible_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that some feasible walk of any length takes."""
    return walks.feasible_states(*walk_tables(B.block_events(spark, sf_dir))).edges


@query(
    with_ctes(
        "be bg b0",
        "SELECT DISTINCT unit, block, CAST(var AS BIGINT) AS var FROM st WHERE i = 1 AND name = ''",
        FEASIBLE_PARTS
        | STATE_PARTS
        | {
            "st": STATE_PARTS["st"]
            .replace("JOIN bg e", "JOIN fe e")
            .replace("FROM ops, names WHERE", "FROM ops, names WHERE (unit, block) IN (SELECT (unit, block) FROM fs) AND")
        },
    )
)
def taint_feasible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tainted variables at block entries when sources, instructions and edges of infeasible blocks don't count."""
    events = B.block_events(spark, sf_dir)
    graph = walks.feasible_states(*walk_tables(events))
    state = taint_block_state(graph.keep(block_steps(spark, sf_dir, events)), graph.edges)
    return big(state.select("unit", "block", "var"), "var")


# a guard per click and error; path = unit and day
GUARD = f"""SELECT unit, seq, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, k, k % 10 AS var, {at(B.COMPARATORS, 'k')} AS cmp, k AS const
    FROM pe WHERE event_type IN ('click', 'error')"""
NEGATED = "CASE cmp WHEN '=' THEN '!=' WHEN '!=' THEN '=' WHEN '>' THEN '<=' WHEN '<=' THEN '>' WHEN '<' THEN '>=' ELSE '<' END"


def guard_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    pe = B.program_events(spark, sf_dir).where("event_type IN ('click', 'error')")
    return pe.select(
        "unit",
        *with_slice(pe),
        "seq",
        F.to_date("ts").cast("string").alias("day"),
        "k",
        F.col("rv").alias("var"),
        B.pick(B.COMPARATORS, F.col("k")).alias("cmp"),
        F.col("k").alias("const"),
    )


@query(
    with_ctes(
        "pe",
        f"""SELECT unit, day, CAST(seq AS BIGINT) AS seq, CAST(var AS BIGINT) AS var,
            CASE WHEN k % 2 = 0 THEN cmp ELSE {NEGATED} END AS cmp, CAST(const AS BIGINT) AS const
            FROM g WHERE k % 13 <> 0""",
        {"g": GUARD},
    )
)
def path_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = guard_rows(spark, sf_dir)
    steps = rows.select(
        F.struct("unit", "day").alias("path"), "seq", "unit", F.col("seq").alias("src"),
        F.when(F.col("k") % 2 == 0, "if").otherwise("else").alias("label"),
    )
    table = rows.select("unit", F.col("seq").alias("src"), "var", "cmp", "const", (F.col("k") % 13 == 0).alias("same_target"))
    met = paths.path_conditions(steps, table)
    return big(met.select("path.unit", "path.day", "seq", "var", "cmp", "const"), "seq", "var", "const")


@query(
    with_ctes(
        "pe",
        f"""SELECT unit, CAST(seq AS BIGINT) AS seq, 'if' AS label, cmp FROM g
            UNION ALL SELECT unit, seq, 'else', {NEGATED} FROM g""",
        {"g": GUARD},
    )
)
def else_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = paths.else_conditions(guard_rows(spark, sf_dir))
    return place(both, "label", "cmp")


@query(
    with_ctes(
        "ev",
        """SELECT event_id, 'v' || k % 10 AS var, '=' AS cmp, 'a' || k AS const, CAST(k AS BIGINT) AS dst FROM ev WHERE event_type = 'click'
           UNION ALL SELECT event_id, 'v' || k % 10, '=', 'b' || k // 10, k + 1 FROM ev WHERE event_type = 'click'""",
    )
)
def switch_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = B.decode_events(B.table(spark, sf_dir, "events")).where("event_type = 'click'")
    k = F.col("k").cast("bigint")
    cases = F.create_map(
        F.concat(F.lit("a"), "k"), k, F.concat(F.lit("b"), "wv"), k + 1, F.lit("default"), k + 2
    )
    return paths.switch_conditions(events.select("event_id", F.concat(F.lit("v"), "rv").alias("var"), cases.alias("cases")))


BOUNDS = """SELECT unit, day, var, max(CASE WHEN cmp IN ('=', '>=') THEN const WHEN cmp = '>' THEN const + {step} END) AS lo,
    min(CASE WHEN cmp IN ('=', '<=') THEN const WHEN cmp = '<' THEN const - {step} END) AS hi,
    max(CASE WHEN cmp = '>' THEN const END) AS above, min(CASE WHEN cmp = '<' THEN const END) AS below,
    list(const) FILTER (cmp = '!=') AS ne FROM g GROUP BY ALL"""


@query(
    with_ctes(
        "pe",
        """SELECT unit, day, NOT bool_or(coalesce(lo > hi OR (lo = hi AND (coalesce(above = lo, false) OR coalesce(below = hi, false)
             OR coalesce(list_contains(ne, lo), false))), false)) AS reachable, false AS imprecise FROM b GROUP BY ALL""",
        {"g": GUARD, "b": BOUNDS.format(step=0)},
    )
)
def feasible_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over real numbers, as the symbols of the path conditions are."""
    return paths.feasible_paths(guard_rows(spark, sf_dir), ["unit", "day"])


@query(
    with_ctes(
        "pe",
        """SELECT unit, day, NOT bool_or(coalesce(lo > hi, false) OR (lo IS NOT NULL AND hi IS NOT NULL AND lo <= hi AND
             len(list_filter(range(lo, hi + 1), lambda x: NOT coalesce(list_contains(ne, x), false))) = 0)) AS reachable,
           false AS imprecise FROM b GROUP BY ALL""",
        {"g": GUARD, "b": BOUNDS.format(step=1)},
    )
)
def feasible_paths_integer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over whole numbers."""
    return paths.feasible_paths(guard_rows(spark, sf_dir), ["unit", "day"], integers=True)


@query(
    with_ctes(
        "pe",
        """SELECT unit, CAST(seq AS BIGINT) AS seq, bool_or(k % 17 = 0) OVER (PARTITION BY unit, day ORDER BY seq) AS imprecise FROM g""",
        {"g": GUARD},
    )
)
def mark_imprecise(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = guard_rows(spark, sf_dir).withColumn("undecided", F.col("k") % 17 == 0)
    return place(paths.mark_imprecise(steps, ["unit", "day"]), "imprecise")


@query(
    with_ctes(
        "lk po",
        f"""SELECT p.unit, CAST(p.seq AS BIGINT) AS seq, CASE WHEN lk.def_seq IS NULL AND NOT list_contains({sql_list(SOURCE_VARIABLES)}, p.read_name)
              THEN false END AS isset FROM po p JOIN lk ON lk.unit = p.unit AND lk.seq = p.seq""",
    )
)
def definitely_assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = B.program_ops(B.program_events(spark, sf_dir))
    linked = B.program_links(ops)
    return place(paths.definitely_assigned(linked, F.col("read_name").isin(SOURCE_VARIABLES)), "isset")


SIGNS = ", ".join(f"('{name}', '{sign}')" for name, sign in X.SYMBOLS.items())


@query(
    with_ctes(
        "po lk",
        "SELECT unit, CAST(seq AS BIGINT) AS seq, expr FROM e",
        {
            "sg": f"SELECT * FROM (VALUES {SIGNS}) t(name, sign)",
            "x": """SELECT p.unit, p.seq, lk.def_seq, p.k, p.rv, s.sign, p.event_type = 'click' AND (p.op = 'Expr_Assign' OR s.sign IS NOT NULL) AS passes
                FROM po p JOIN lk ON lk.unit = p.unit AND lk.seq = p.seq LEFT JOIN sg s ON p.op = 'Expr_BinaryOp_' || s.name""",
            "e": """SELECT unit, seq, CASE WHEN NOT passes THEN 's' || seq WHEN sign IS NULL THEN 'e' || rv
                  ELSE '((e' || rv || ') ' || sign || ' (' || k || '))' END AS expr FROM x WHERE NOT passes OR def_seq IS NULL
                UNION ALL SELECT x.unit, x.seq, CASE WHEN x.sign IS NULL THEN e.expr
                  ELSE '((' || e.expr || ') ' || x.sign || ' (' || x.k || '))' END
                FROM e JOIN x ON x.unit = e.unit AND x.def_seq = e.seq AND x.passes""",
        },
    )
)
def symbolic_expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = B.program_ops(B.program_events(spark, sf_dir))
    linked = B.program_links(ops)
    name = F.when(F.col("op").startswith("Expr_BinaryOp_"), F.substring_index("op", "_", -1))
    passes = (F.col("event_type") == "click") & ((F.col("op") == "Expr_Assign") | name.isin(list(X.SYMBOLS)))
    shaped = linked.select(
        "unit", "seq", "def_seq", name.alias("operator"), F.col("k").cast("string").alias("right"),
        F.when(~F.coalesce(passes, F.lit(False)), F.concat(F.lit("s"), "seq")).alias("leaf"),
        F.concat(F.lit("e"), "rv").alias("entry"),
    )
    return place(paths.symbolic_expression(shaped), "expr")


def two_operands(ops: DataFrame) -> DataFrame:
    """Instructions of the events as rows of ``symbolic_values``: an operation joins what it reads with what it overwrites."""
    linked = B.program_links(ops)
    written = linked.select("unit", *with_slice(linked), "seq", F.col("wv").alias("var"))
    defined = ops.where("event_type <> 'error'").select("unit", *with_slice(ops), "seq", F.col("wv").alias("var"))
    over = links.reaching_definition(written, defined, ["unit", "var"]).select("unit", "seq", F.col("def_seq").alias("over_seq"))
    name = F.when(F.col("op").startswith("Expr_BinaryOp_"), F.substring_index("op", "_", -1))
    operator = F.when(name.isin(list(X.SYMBOLS)), name)
    passes = (F.col("event_type") == "click") & ((F.col("op") == "Expr_Assign") | operator.isNotNull())

    def operand(seq: str, var: str) -> Column:
        return F.struct(F.col(seq).alias("def_seq"), F.when(F.col(seq).isNull(), F.concat(F.lit("e"), F.col(var))).alias("leaf"))

    both = F.array(operand("def_seq", "rv"), operand("over_seq", "wv"))
    return linked.join(over, ["unit", "seq"]).select(
        "unit", "seq", operator.alias("operator"),
        F.when(~F.coalesce(passes, F.lit(False)), F.concat(F.lit("s"), "seq")).alias("leaf"),
        F.when(operator.isNotNull(), both).otherwise(F.array(operand("def_seq", "rv"))).alias("operands"),
    )


@query(
    with_ctes(
        "po lk",
        "SELECT unit, CAST(seq AS BIGINT) AS seq, expr FROM e",
        {
            "sg": f"SELECT * FROM (VALUES {SIGNS}) t(name, sign)",
            "x": """SELECT p.unit, p.seq, lk.def_seq, w.seq AS over_seq, p.rv, p.wv, s.sign, p.event_type = 'click' AND (p.op = 'Expr_Assign' OR s.sign IS NOT NULL) AS passes
                FROM po p JOIN lk ON lk.unit = p.unit AND lk.seq = p.seq LEFT JOIN sg s ON p.op = 'Expr_BinaryOp_' || s.name
                ASOF LEFT JOIN (SELECT unit, wv, seq FROM pe WHERE event_type <> 'error') w ON w.unit = p.unit AND w.wv = p.wv AND p.seq > w.seq""",
            "e(unit, seq, expr) USING KEY (unit, seq)": """
                SELECT unit, seq, CASE WHEN NOT passes THEN 's' || seq WHEN sign IS NULL THEN 'e' || rv ELSE '((e' || rv || ') ' || sign || ' (e' || wv || '))' END
                FROM x WHERE NOT passes OR (def_seq IS NULL AND (sign IS NULL OR over_seq IS NULL))
                UNION (
                  SELECT x.unit, x.seq, CASE WHEN x.sign IS NULL THEN a.expr ELSE '((' || coalesce(a.expr, 'e' || x.rv) || ') ' || x.sign || ' (' || coalesce(b.expr, 'e' || x.wv) || '))' END
                  FROM (SELECT DISTINCT x.* FROM e JOIN x ON x.unit = e.unit AND x.passes AND (x.def_seq = e.seq OR (x.sign IS NOT NULL AND x.over_seq = e.seq))) x
                  LEFT JOIN recurring.e a ON a.unit = x.unit AND a.seq = x.def_seq LEFT JOIN recurring.e b ON b.unit = x.unit AND b.seq = x.over_seq
                  WHERE (x.def_seq IS NULL OR a.expr IS NOT NULL) AND (x.sign IS NULL OR x.over_seq IS NULL OR b.expr IS NOT NULL))""",
        },
    )
)
def symbolic_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of all instructions when both sides of an operation are variables, written out from the shared table."""
    found = symbolic.symbolic_values(two_operands(B.program_ops(B.program_events(spark, sf_dir))))
    texts = symbolic.expression_texts(found, found.values)
    return place(found.values.join(texts, "id"), "expr")


FOLDED = ["Plus", "Minus", "Mul", "Greater", "SmallerOrEqual", "Equal"]


@query(
    with_ctes(
        "ev",
        f"""SELECT event_id, CASE WHEN k % 3 = 1 THEN '((v' || k % 10 || ') ' ||
              ({sql_list([X.SYMBOLS[n] for n in FOLDED])})[CAST(event_id % 6 AS INTEGER) + 1] || ' (' || k // 10 || '))'
            ELSE CASE event_id % 6 WHEN 0 THEN CAST(k + k // 10 AS VARCHAR) WHEN 1 THEN CAST(k - k // 10 AS VARCHAR)
              WHEN 2 THEN CAST(k * (k // 10) AS VARCHAR) WHEN 3 THEN CASE WHEN k > k // 10 THEN 'True' ELSE 'False' END
              WHEN 4 THEN CASE WHEN k <= k // 10 THEN 'True' ELSE 'False' END
              ELSE CASE WHEN k = k // 10 THEN 'True' ELSE 'False' END END END AS folded FROM ev""",
    )
)
def fold_constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = B.decode_events(B.table(spark, sf_dir, "events"))
    left = F.when(F.col("k") % 3 == 1, F.concat(F.lit("v"), "rv")).otherwise(F.col("k").cast("string"))
    folded = X.fold_constants(B.pick(FOLDED, F.col("event_id")), left, F.col("wv").cast("string"))
    return events.select("event_id", folded.alias("folded"))


@query(
    with_ctes(
        "pe",
        """SELECT unit, name, CAST(first_seen AS BIGINT) AS first_seen, n AS number,
             CASE WHEN n <= 26 THEN chr(CAST(96 + n AS INTEGER)) ELSE chr(CAST(96 + (n - 1) // 26 AS INTEGER)) || chr(CAST(97 + (n - 1) % 26 AS INTEGER)) END AS symbol
           FROM (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY first_seen, name) AS n
             FROM (SELECT unit, 'v' || k AS name, min(seq) AS first_seen FROM pe GROUP BY ALL))""",
    )
)
def number_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    accesses = B.program_events(spark, sf_dir).withColumn("name", F.concat(F.lit("v"), "k"))
    found = paths.number_symbols(accesses, "name")
    return big(found.select("unit", "name", "first_seen", "number", "symbol"), "first_seen", "number")


# conditions of a block are those of its clicks and errors; over one visit they must hold together
BLOCK_GUARD = f"""SELECT unit, block AS day, k % 3 AS var, {at(B.COMPARATORS, 'k')} AS cmp, k AS const
    FROM be WHERE event_type IN ('click', 'error')"""


def feasible_blocks(events: DataFrame) -> DataFrame:
    """Blocks whose conditions do not contradict each other; those without any are feasible."""
    rows = events.where("event_type IN ('click', 'error')").select(
        "unit", "block", (F.col("k") % 3).alias("var"), B.pick(B.COMPARATORS, F.col("k")).alias("cmp"), F.col("k").alias("const")
    )
    judged = paths.feasible_paths(rows, ["unit", "block"])
    return B.block_list(events).join(judged.where("NOT reachable"), ["unit", "block"], "left_anti")


@query(
    with_ctes(
        "be bg",
        "SELECT unit, block, CAST(var AS BIGINT) AS var FROM t",
        {
            "g": BLOCK_GUARD,
            "b": BOUNDS.format(step=0),
            "bad": """SELECT unit, day AS block FROM b GROUP BY ALL HAVING bool_or(coalesce(lo > hi OR (lo = hi AND (coalesce(above = lo, false)
                OR coalesce(below = hi, false) OR coalesce(list_contains(ne, lo), false))), false))""",
            "kept": """SELECT * FROM bg WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.unit = bg.unit AND bad.block IN (bg.src, bg.dst))""",
            "copies": COPIES,
            "t": BLOCK_TAINT.format(edges="kept"),
        },
    )
)
def prune_unreachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Taint of the block graph along feasible blocks only."""
    events = B.block_events(spark, sf_dir)
    return block_taint(events, paths.prune_unreachable(B.block_edges(events), feasible_blocks(events)))


# ---- type guards ----

PREDICATE_TYPES = sql_list(list(X.TYPE_PREDICATES.values()))


def guard_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = B.decode_events(B.table(spark, sf_dir, "events")).where("event_type = 'click'")
    tested = X.guard_type(B.pick(list(X.TYPE_PREDICATES), F.col("k")))
    return events.select(
        "event_id", "unit", "k", (F.col("k") % 4).alias("var"), tested.alias("tested_type"), (F.col("k") % 5 == 0).alias("negated")
    )


GUARD_CALLS = f"""SELECT event_id, user_id AS unit, k, k % 4 AS var, ({PREDICATE_TYPES})[CAST(k % 14 AS INTEGER) + 1] AS tested_type, k % 5 = 0 AS negated
    FROM ev WHERE event_type = 'click'"""


@query(
    with_ctes(
        "ev",
        """SELECT event_id, CAST(var AS BIGINT) AS var, 'if' AS label, tested_type, negated FROM gc
           UNION ALL SELECT event_id, var, 'else', tested_type, NOT negated FROM gc""",
        {"gc": GUARD_CALLS},
    )
)
def guard_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = guards.guard_facts(guard_calls(spark, sf_dir))
    return big(facts.select("event_id", "var", "label", "tested_type", "negated"), "var")


# a condition joins the tests of up to twelve neighbouring events
COMBINED = """SELECT guard_id, var, mode, list({'p': pos, 't': tested_type, 'n': negated} ORDER BY pos) AS terms FROM (
      SELECT event_id // 12 AS guard_id, var, CASE WHEN event_id // 12 % 2 = 0 THEN 'or' ELSE 'and' END AS mode, tested_type, negated,
        min(event_id) AS pos FROM gc GROUP BY ALL) GROUP BY ALL"""


def combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    guard_id = F.floor(F.col("event_id") / 12)
    terms = guard_calls(spark, sf_dir).select(
        guard_id.alias("guard_id"), "var", F.col("event_id").alias("pos"),
        F.when(guard_id % 2 == 0, "or").otherwise("and").alias("mode"), "tested_type", "negated",
    )
    return guards.combine_guards(terms, ["guard_id", "var"])


@query(
    with_ctes(
        "ev",
        """SELECT guard_id, CAST(var AS BIGINT) AS var, mode,
             array_to_string(list_transform(terms, lambda t: CASE WHEN t.n THEN '!' ELSE '' END || t.t), ',') AS terms,
             CASE WHEN mode = 'or' AND len(list_filter(terms, lambda t: t.n)) > 0 THEN NULL
               WHEN mode = 'and' AND len(pos_types) > 1 THEN '' ELSE array_to_string(pos_types, ',') END AS types
           FROM (SELECT *, list_sort(list_distinct(list_transform(list_filter(terms, lambda t: NOT t.n), lambda t: t.t))) AS pos_types FROM c)""",
        {"gc": GUARD_CALLS, "c": COMBINED},
    )
)
def combine_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.transform("terms", lambda t: F.concat(F.when(t["negated"], "!").otherwise(""), t["tested_type"]))
    return combined(spark, sf_dir).select(
        "guard_id", F.col("var").cast("bigint").alias("var"), "mode", F.array_join(shown, ",").alias("terms"),
        F.array_join("types", ",").alias("types"),
    )


@query(
    with_ctes(
        "ev",
        """SELECT guard_id, CAST(var AS BIGINT) AS var, CASE WHEN guard_id % 3 = 0 THEN 'not(' || body || ')' ELSE body END AS text FROM (
             SELECT *, CASE WHEN len(terms) > 1 THEN '(' || inner_text || ')' ELSE inner_text END AS body FROM (
               SELECT *, CASE WHEN mode = 'or' THEN array_to_string(parts, '|') ELSE array_to_string(parts, '&') END AS inner_text FROM (
                 SELECT *, list_transform(terms, lambda t: CASE WHEN t.n THEN 'not(type(LITERAL(''' || t.t || ''')))'
                   ELSE 'type(LITERAL(''' || t.t || '''))' END) AS parts FROM c)))""",
        {"gc": GUARD_CALLS, "c": COMBINED},
    )
)
def render_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = guards.render_guard(F.col("terms"), F.col("mode"), F.col("guard_id") % 3 == 0)
    return combined(spark, sf_dir).select("guard_id", F.col("var").cast("bigint").alias("var"), text.alias("text"))


# the events of a unit and day make a tree, number n below number n // 2; leaves test a type
TREE = f"""SELECT *, row_number() OVER (PARTITION BY unit, day ORDER BY ts, event_id) AS node, count(*) OVER (PARTITION BY unit, day) AS nodes FROM (
    SELECT event_id, ts, user_id AS unit, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, k, k % 2 AS var,
      ({PREDICATE_TYPES})[CAST(k % 14 AS INTEGER) + 1] AS tested_type, k % 5 = 0 AS negated FROM ev)"""
# an inner node joins the two sides that speak of a variable; a side that does not is left out
TREE_LEVEL = """SELECT unit, day, node, var, CASE WHEN negated THEN 'not(' || body || ')' ELSE body END AS text FROM (
      SELECT t.unit, t.day, t.node, t.negated, t.var, 'type(LITERAL(' || chr(39) || t.tested_type || chr(39) || '))' AS body
      FROM tree t WHERE 2 * t.node > t.nodes AND {here}
      UNION ALL
      SELECT t.unit, t.day, t.node, t.negated, d.var,
        CASE WHEN count(*) = 2 THEN '(' || arg_min(d.text, d.node) || CASE WHEN t.k % 3 = 0 THEN '|' ELSE '&' END || arg_max(d.text, d.node) || ')' ELSE any_value(d.text) END
      FROM tree t JOIN {below} d ON d.unit = t.unit AND d.day = t.day AND d.node // 2 = t.node WHERE 2 * t.node <= t.nodes AND {here}
      GROUP BY t.unit, t.day, t.node, t.negated, t.k, d.var)"""
TREE_PARTS = {"tree": TREE, "lv8": "SELECT 0 AS unit, '' AS day, 0 AS node, 0 AS var, '' AS text WHERE false"} | {
    f"lv{d}": TREE_LEVEL.format(here=f"t.node >= {2**d} AND t.node < {2 ** (d + 1)}", below=f"lv{d + 1}") for d in range(7, -1, -1)
}


@query(with_ctes("ev", "SELECT unit, day, CAST(var AS BIGINT) AS var, text FROM lv0", TREE_PARTS))
def guard_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested conditions of a day, what they say about the types of their variables."""
    events = B.decode_events(B.table(spark, sf_dir, "events")).withColumn("day", F.to_date("ts").cast("string"))
    numbered = row_sequence(events, ["unit", "day"], ["ts", "event_id"], "node")
    sizes = numbered.groupBy("unit", "day").agg(F.max("node").alias("nodes"))
    is_leaf = 2 * F.col("node") > F.col("nodes")
    nodes = numbered.join(sizes, ["unit", "day"]).select(
        "unit", "day", "node", F.when(F.col("node") > 1, F.floor(F.col("node") / 2).cast("int")).alias("parent"), F.col("node").alias("pos"),
        F.when(F.col("k") % 3 == 0, "or").otherwise("and").alias("mode"), F.when(is_leaf, F.col("k") % 2).alias("var"),
        F.when(is_leaf, X.guard_type(B.pick(list(X.TYPE_PREDICATES), F.col("k")))).alias("tested_type"), (F.col("k") % 5 == 0).alias("negated"),
    )
    return big(guards.guard_trees(nodes, ["unit", "day"]).select("unit", "day", "var", "text"), "var")


# ---- comparison ----


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'missing' WHEN o_orderkey % 10 = 0 THEN 'new' ELSE 'changed' END AS status
       FROM orders WHERE (o_orderkey % 11 = 0) <> (o_orderkey % 10 = 0)
       OR (o_orderkey % 7 = 0 AND o_orderkey % 11 <> 0 AND o_orderkey % 10 <> 0 AND o_totalprice IS NOT NULL)"""
)
def diff_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two snapshots of a table: rows left out on either side, and a changed column."""
    rows = B.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    old = rows.where("o_orderkey % 10 <> 0")
    new = rows.where("o_orderkey % 11 <> 0").withColumn(
        "o_totalprice", F.when(F.col("o_orderkey") % 7 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    )
    return compare.diff_graphs(old, new, ["o_orderkey"], ["o_totalprice", "o_orderstatus"])


NUMBERED_LINES = """SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
    ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS ordinal FROM lineitem"""


@query(
    f"""SELECT l_orderkey, l_linenumber, ordinal, CASE l_orderkey % 5 WHEN 0 THEN 'changed' ELSE 'missing' END AS status
       FROM ({NUMBERED_LINES}) WHERE l_orderkey % 5 IN (0, 1)"""
)
def diff_graphs_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-sided comparison of all lines; rows of one key are told apart by their ordinal, extra new rows do not count."""
    within = Window.partitionBy("l_orderkey", "l_linenumber").orderBy(
        "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"
    )
    rows = B.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.row_number().over(within).cast("bigint").alias("ordinal"), F.col("l_quantity").alias("quantity")
    )
    old = rows.where("l_orderkey % 5 <> 2")
    new = rows.where("l_orderkey % 5 <> 1").withColumn(
        "quantity", F.when(F.col("l_orderkey") % 5 == 0, F.col("quantity") + 1).otherwise(F.col("quantity"))
    )
    return compare.diff_graphs(old, new, ["l_orderkey", "l_linenumber", "ordinal"], ["quantity"], both_ways=False)


@query(
    """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'different' WHEN 1 THEN 'absent' ELSE 'unexpected' END AS status
       FROM documents WHERE doc_id % 6 IN (0, 1, 2)"""
)
def compare_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts against a copy with other line ends, a changed word, and rows left out."""
    docs = B.table(spark, sf_dir, "documents").select("doc_id", "text")
    changed = F.when(F.col("doc_id") % 6 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    copy = docs.where("doc_id % 6 <> 2").select(
        "doc_id", F.concat(F.lit(" "), F.replace(changed, F.lit("\n"), F.lit(" \r\n")), F.lit("\n")).alias("text")
    )
    return compare.compare_golden(docs.where("doc_id % 6 <> 1"), copy, ["doc_id"])
