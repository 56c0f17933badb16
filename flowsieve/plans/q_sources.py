"""Queries of the sources, sinks, profiles and arriving programs."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsieve.functions import text as T
from flowsieve.functions.operands import render_operand
from flowsieve.operators import classify, taint
from flowsieve.pipeline import analyse
from flowsieve.plans import bindings as B
from flowsieve.plans import profiles
from flowsieve.plans.catalog import query, with_ctes
from flowsieve.plans.q_graphs import big
from flowsieve.plans.q_joins import REPORT_SQL, ops_of, report_flows, straight_ops, tainted_arguments
from flowsieve.session import cut, new_folder
from flowsieve.sources import dumps, policy, references, sinks
from flowsieve.streaming.arrival import analyse_arrivals, latest_arrivals

# ---- dumps: a program is fifty neighbouring events, a block ten of them ----

PROGRAM, BLOCK = "event_id // 50", "event_id % 50 // 10 + 1"


def event_dumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON dump per program; its size is bounded by the fifty events."""
    events = B.decode_events(B.table(spark, sf_dir, "events"))
    kind = F.col("event_type")

    def named(letter: str, column: str) -> Column:
        return F.struct(F.col(column).cast("string").alias("id"), F.concat(F.lit(letter), F.col(column)).alias("var_name"))

    read, write = named("r", "rv"), named("w", "wv")
    made = F.struct(F.concat(F.lit("1"), "k").alias("id"))
    place = [
        F.lit("f.php").alias("file"),
        F.when(F.col("k") % 7 == 0, "None").otherwise(F.col("k").cast("string")).alias("startLine"),
        F.col("k").cast("string").alias("endLine"),
    ]

    def op(name: str, *fields: Column) -> Column:
        return F.to_json(F.struct(F.lit(name).alias("op"), *fields, *place))

    block = (F.floor(F.col("event_id") % 50 / 10) + 1).cast("int")
    body = (
        F.when(kind == "signup", op("Expr_FuncCall", F.struct(F.lit("LITERAL('getenv')").alias("value")).alias("name"), F.array(read, write).alias("args"), made.alias("result")))
        .when(kind == "click", op("Expr_Assign", write.alias("var"), read.alias("expr"), made.alias("result")))
        .when(kind == "view", op("Expr_Cast_Int", read.alias("expr"), made.alias("result")))
        .when(kind == "purchase", op("Terminal_Echo", read.alias("expr")))
        .otherwise(op("Stmt_JumpIf", read.alias("cond"), (block % 5 + 1).alias("if"), F.lit(1).alias("else")))
    )
    ops = events.select(
        F.floor(F.col("event_id") / 50).alias("_p"), block.alias("block"), F.struct("event_id", body.alias("body")).alias("_op")
    )
    blocks = ops.groupBy("_p", "block").agg(F.array_sort(F.collect_list("_op")).alias("_ops"))
    texts = blocks.select(
        "_p",
        F.struct(
            "block",
            F.concat(
                F.lit('{"blockId":'), F.col("block"), F.lit(',"parentBlock":[],"blocks":['),
                F.array_join(F.transform("_ops", lambda o: o["body"]), ","), F.lit("]}"),
            ).alias("text"),
        ).alias("_b"),
    )
    whole = texts.groupBy("_p").agg(F.array_sort(F.collect_list("_b")).alias("_bs"))
    return whole.select(
        F.concat(F.lit("p"), "_p").alias("program"),
        F.concat(F.lit('{"main()":['), F.array_join(F.transform("_bs", lambda b: b["text"]), ","), F.lit("]}")).alias("text"),
    )


DUMP_OPS = f"""SELECT 'p' || ({PROGRAM}) AS program, 'main' AS unit, {BLOCK} AS block, k, k % 10 AS rv, k // 10 AS wv, event_type,
    row_number() OVER (PARTITION BY {PROGRAM}, {BLOCK} ORDER BY event_id) - 1 AS seq,
    CASE event_type WHEN 'signup' THEN 'Expr_FuncCall' WHEN 'click' THEN 'Expr_Assign' WHEN 'view' THEN 'Expr_Cast_Int'
      WHEN 'purchase' THEN 'Terminal_Echo' ELSE 'Stmt_JumpIf' END AS op FROM ev"""


@query(
    with_ctes(
        "ev",
        """SELECT program, unit, block, seq, op, 'in' AS role, CAST(1 AS BIGINT) AS pos, 'Var#' || rv || '<$r' || rv || '>' AS operand FROM d
           UNION ALL SELECT program, unit, block, seq, op, 'in', 2, 'Var#' || wv || '<$w' || wv || '>' FROM d WHERE event_type = 'signup'
           UNION ALL SELECT program, unit, block, seq, op, 'out', 1, CASE WHEN event_type = 'click' THEN 'Var#' || wv || '<$w' || wv || '>' ELSE 'Var#1' || k END
             FROM d WHERE event_type IN ('signup', 'click', 'view')
           UNION ALL SELECT program, unit, block, seq, op, 'res', 1, 'Var#1' || k FROM d WHERE event_type = 'click'""",
        {"d": DUMP_OPS},
    )
)
def read_graph_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    operands = dumps.read_graph_corpus(event_dumps(spark, sf_dir)).operands
    shown = operands.select("program", "unit", "block", "seq", "op", "role", "pos", render_operand(F.col("var")).alias("operand"))
    return big(shown, "block", "seq", "pos")


@query(
    with_ctes(
        "ev",
        """SELECT program, unit, block, seq, op, CASE WHEN event_type = 'signup' THEN 'getenv' END AS callee,
             lower(substr(op, instr(op, '_') + 1)) AS operation, CASE WHEN k % 7 = 0 THEN 'None' ELSE CAST(k AS VARCHAR) END AS start_line FROM d""",
        {"d": DUMP_OPS},
    )
)
def read_graph_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = dumps.read_graph_corpus(event_dumps(spark, sf_dir)).ops
    return big(ops.select("program", "unit", "block", "seq", "op", "callee", "operation", "start_line"), "block", "seq")


@query(
    with_ctes(
        "ev",
        """SELECT program, unit, block AS src, label, CASE label WHEN 'if' THEN block % 5 + 1 ELSE 1 END AS dst
           FROM d, (VALUES ('if'), ('else')) l(label) WHERE event_type = 'error'""",
        {"d": DUMP_OPS},
    )
)
def read_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = dumps.read_graph_corpus(event_dumps(spark, sf_dir)).edges
    return big(edges.select("program", "unit", "src", "label", "dst"), "src", "dst")


# ---- a corpus from dumps to findings ----


def call_dumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One dump per fifty events: odd blocks are ``main``, even ones a function that it calls with one argument."""
    events = B.decode_events(B.table(spark, sf_dir, "events"))
    kind, k = F.col("event_type"), F.col("k")

    def value(column: Column) -> Column:
        return F.struct(column.cast("string").alias("id"), F.concat(F.lit("v"), column.cast("string")).alias("var_name"))

    def op(name: Column | str, *more: Column) -> Column:
        return F.to_json(F.struct((F.lit(name) if isinstance(name, str) else name).alias("op"), *more, *place))

    def call(name: Column | str) -> Column:
        text = F.concat(F.lit("LITERAL('"), F.lit(name) if isinstance(name, str) else name, F.lit("')"))
        return op("Expr_FuncCall", F.struct(text.alias("value")).alias("name"), F.array(read).alias("args"), write.alias("result"))

    read, write = value(F.col("rv")), value(F.col("wv"))
    place = [F.lit("f.php").alias("file"), F.when(k % 7 == 0, "None").otherwise(k.cast("string")).alias("startLine"), k.cast("string").alias("endLine")]
    number = (F.floor(F.col("event_id") % 50 / 10) + 1).cast("int")
    is_main = number % 2 == 1
    body = (
        F.when(kind == "signup", call("getenv"))
        .when(kind == "click", op("Expr_Assign", write.alias("var"), read.alias("expr")))
        .when((kind == "view") & (k % 4 == 0), op("Expr_Cast_Int", read.alias("expr"), write.alias("result")))
        .when(kind == "view", call(F.when(is_main, "work").otherwise("trim")))
        .when(kind == "purchase", op("Terminal_Echo", read.alias("expr")))
        .otherwise(op("Stmt_JumpIf", read.alias("cond"), number.alias("if"), number.alias("else")))
    )
    program = F.floor(F.col("event_id") / 50)
    rows = events.select(program.alias("_p"), is_main.alias("_main"), number.alias("block"), F.struct("event_id", body.alias("body")).alias("_op"))
    blocks = rows.groupBy("_p", "_main", "block").agg(F.array_sort(F.collect_list("_op")).alias("_ops"))
    opening, between, closing = F.lit('{"blockId":'), F.lit(',"parentBlock":[],"blocks":['), F.lit("]}")
    texts = blocks.select("_p", "_main", F.struct("block", F.concat(opening, "block", between, F.array_join(F.transform("_ops", lambda o: o["body"]), ","), closing).alias("text")).alias("_b"))
    units = texts.groupBy("_p").agg(*[F.array_join(F.transform(F.array_sort(F.collect_list(F.when(side, F.col("_b")))), lambda b: b["text"]), ",").alias(name) for side, name in ((F.col("_main"), "_in_main"), (~F.col("_main"), "_in_work"))])
    head = '{"blockId":1,"parentBlock":[],"blocks":[{"op":"Expr_Param","name":{"value":"v1"},"result":{"id":"1","var_name":"v1"}},{"op":"Terminal_Return","expr":{"id":"0","var_name":"v0"}}]}'
    work = F.concat_ws(",", F.lit(head), F.when(F.col("_in_work") != "", F.col("_in_work")))
    whole = F.concat(F.lit('{"main()":['), "_in_main", F.lit('],"work()":['), work, F.lit("]}"))
    return units.select(F.concat(F.lit("p#"), "_p", F.lit(".php")).alias("program"), whole.alias("text"))


@query(
    with_ctes(
        "ev",
        """SELECT program, unit, 'f.php' AS file, start_line, 'XSS' AS category, '*Dangerous: Tainted Input(s). Possible Cross-Site Scripting*' AS message
           FROM (SELECT d.*, row_number() OVER (PARTITION BY d.program, start_line ORDER BY block, event_id) AS n FROM d
             JOIN (SELECT program, 'main' AS unit, var FROM m UNION SELECT program, 'work', var FROM w WHERE root = '!'
                   UNION SELECT w.program, 'work', w.var FROM w WHERE root = 'v1' AND program IN (SELECT d.program FROM d JOIN m ON m.program = d.program AND m.var = d.rv WHERE d.calls)) t
             ON t.program = d.program AND t.unit = d.unit AND t.var = d.rv WHERE event_type = 'purchase') WHERE n = 1""",
        {
            "d": f"""SELECT *, unit = 'main' AND event_type = 'view' AND k % 4 <> 0 AS calls FROM (
                SELECT event_id, event_type, k, k % 10 AS rv, k // 10 AS wv, 'p#' || ({PROGRAM}) || '.php' AS program, {BLOCK} AS block,
                  CASE WHEN ({BLOCK}) % 2 = 1 THEN 'main' ELSE 'work' END AS unit, CASE WHEN k % 7 = 0 THEN 'None' ELSE CAST(k AS VARCHAR) END AS start_line FROM ev)""",
            "f": """SELECT program, unit, rv, wv FROM d WHERE event_type IN ('click', 'signup') OR (event_type = 'view' AND k % 4 <> 0 AND NOT calls)""",
            "w": """SELECT DISTINCT program, 'v1' AS root, 1 AS var FROM d UNION SELECT program, '!', wv FROM d WHERE event_type = 'signup' AND unit = 'work'
                UNION SELECT w.program, w.root, f.wv FROM w JOIN f ON f.program = w.program AND f.unit = 'work' AND f.rv = w.var""",
            "m": """SELECT program, wv AS var FROM d WHERE event_type = 'signup' AND unit = 'main'
                UNION SELECT d.program, d.wv FROM d JOIN w ON w.program = d.program AND w.root = '!' AND w.var = 0 WHERE d.calls
                UNION (SELECT m.program, f.wv FROM m JOIN f ON f.program = m.program AND f.unit = 'main' AND f.rv = m.var
                  UNION SELECT m.program, d.wv FROM m JOIN d ON d.program = m.program AND d.rv = m.var AND d.calls
                    JOIN w ON w.program = d.program AND w.root = 'v1' AND w.var = 0)""",
        },
    )
)
def analyse_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of all programs, from their dumps in one call."""
    facts = dumps.read_graph_corpus(cut(call_dumps(spark, sf_dir)))
    return analyse(facts, policy.load_policy(spark), policy.category_names(spark))


# ---- policy ----

POLICY_SQL = ", ".join(f"('{r[0]}', '{r[1]}', '{r[3]}', 0)" for r in policy.policy_rows())
SITE_SQL = ", ".join(f"('{r[0]}', '{r[1]}', '{r[3]}', 1)" for r in policy.SITE_ROWS)
USES = """SELECT name, count(*) AS uses FROM (SELECT callee AS name FROM po UNION ALL
    SELECT CASE WHEN starts_with(op, 'Expr_Cast_') THEN op ELSE lower(substr(op, instr(op, '_') + 1)) END FROM po
    UNION ALL SELECT read_name FROM po) GROUP BY name"""


def name_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each name occurs as callee, operation, cast or variable."""
    ops = ops_of(spark, sf_dir)
    own = F.when(F.col("op").startswith("Expr_Cast_"), F.col("op")).otherwise(F.col("operation"))
    return ops.select(F.explode(F.array("callee", own, "read_name")).alias("name")).groupBy("name").agg(
        F.count(F.lit(1)).alias("uses")
    )


@query(
    with_ctes(
        "po",
        f"""SELECT p.kind, p.category, p.name, coalesce(u.uses, 0) AS uses
            FROM (VALUES {POLICY_SQL}) p(kind, category, name, layer) LEFT JOIN uses u ON u.name = p.name""",
        {"uses": USES},
    )
)
def load_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = policy.load_policy(spark).select("kind", "category", "name")
    return rows.join(name_uses(spark, sf_dir), "name", "left").withColumn("uses", F.coalesce("uses", F.lit(0)))


@query(
    with_ctes(
        "po",
        f"""SELECT p.kind, p.category, p.name, CAST(p.layer AS BIGINT) AS layer, u.uses
            FROM (VALUES {POLICY_SQL}, {SITE_SQL}) p(kind, category, name, layer) JOIN uses u ON u.name = p.name""",
        {"uses": USES},
    )
)
def overlay_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = policy.site_policy(spark).select("kind", "category", "name", F.col("layer").cast("bigint").alias("layer"))
    return rows.join(name_uses(spark, sf_dir), "name")


# ---- sinks ----


@query(with_ctes("fl", REPORT_SQL))
def write_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "findings")
    found = report_flows(spark, sf_dir)
    sinks.write_findings(found, folder)
    return spark.read.schema(found.schema).parquet(folder).select(*found.columns)


@query(
    with_ctes(
        "bg bb",
        """SELECT DISTINCT unit, 'header' AS kind, '"' || unit || '_header" [label="Function ' || unit || ':" shape="rect"]' AS line FROM bb
           UNION ALL SELECT unit, 'node', '"' || unit || '_block_' || block || '" [label="block_' || block || '" shape="rect"]' FROM bb
           UNION ALL SELECT unit, 'edge', '"' || unit || '_block_' || src || '" -> "' || unit || '_block_' || dst || '" [label="'
             || CASE WHEN src LIKE 'error%' THEN 'if' ELSE 'target' END || '"]' FROM bg""",
    )
)
def export_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = B.block_events(spark, sf_dir)
    edges = B.block_edges(events).withColumn("label", F.when(F.col("src").startswith("error"), "if").otherwise("target"))
    return sinks.export_graph(B.block_list(events), edges)


# ---- references ----


@query(
    r"""SELECT page_id, CAST(generate_subscripts(hits, 1) - 1 AS BIGINT) AS pos, regexp_extract(unnest(hits), '^[a-z]+') AS kind,
          trim(replace(replace(replace(regexp_extract(unnest(hits), '="([^"]*)"', 1), '''', ''), ';', ''), ')', '')) AS path
        FROM (SELECT page_id, regexp_extract_all(html, '(?:href|src)="[^"]*"') AS hits FROM pages)"""
)
def scan_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = T.scan_references(B.table(spark, sf_dir, "pages"), "html", ["page_id"], T.PAGE_LINK)
    return big(found.select("page_id", "pos", "kind", "path"), "pos")


@query(
    with_ctes(
        "ev",
        """SELECT event_id, CAST(0 AS BIGINT) AS pos, CASE WHEN k % 2 = 0 THEN 'require' ELSE 'include' END AS kind, k % 3 = 0 AS once,
             event_type || '/m' || k || '.php' AS path FROM ev
           UNION ALL SELECT event_id, 1, 'include', false, '/n' || user_id || '.php' FROM ev""",
    )
)
def scan_includes(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = B.decode_events(B.table(spark, sf_dir, "events"))
    word = F.when(F.col("k") % 2 == 0, "require").otherwise("include")
    once = F.when(F.col("k") % 3 == 0, "_once").otherwise("")
    source = F.concat(
        F.lit("<?php $a = 1;\n"), word, once, F.lit(" ('"), "event_type", F.lit("/m"), "k", F.lit(".php');\ninclude __DIR__.\"/n"),
        "unit", F.lit('.php"; echo $a;'),
    )
    found = T.scan_references(events.select("event_id", source.alias("source")), "source", ["event_id"])
    # the operator that glues a folder constant to a path is no part of the path
    path = F.regexp_replace("path", r"^\.(?=/)", "")
    return big(found.select("event_id", "pos", "kind", "once", path.alias("path")), "pos")


def page_sources(spark: SparkSession, sf_dir: str, circles: bool = False) -> DataFrame:
    """A source text per page: it includes two lower pages, some of them a missing one, with ``circles`` some one that includes it."""
    pages = B.table(spark, sf_dir, "pages").select("page_id", "url")

    def name(of: Column) -> Column:
        return F.concat(F.lit("p"), of.cast("string"), F.lit(".php"))

    p = F.col("page_id")
    text = F.concat(
        F.lit("<?php echo '"), "url", F.lit("';\n"),
        F.when(p >= 1, F.concat(F.lit("require_once('"), name(F.floor(p / 2)), F.lit("');\n"))).otherwise(""),
        F.when(p >= 16, F.concat(F.lit("include '"), name(F.floor(p / 16)), F.lit("';\n"))).otherwise(""),
        F.when(p % 5 == 0, F.lit("require 'gone.php';\n")).otherwise(""),
        F.when(F.lit(circles) & (p % 40 == 3), F.concat(F.lit("include '"), name(2 * p), F.lit("';\n"))).otherwise(""),
        F.lit("done();"),
    )
    return pages.select(name(p).alias("name"), text.alias("text"))


def expansion(spark: SparkSession, sf_dir: str, circles: bool = False) -> tuple[DataFrame, DataFrame]:
    files = cut(page_sources(spark, sf_dir, circles))
    refs = cut(T.scan_references(files, "text", ["name"]).select("name", "pos", "path", "once"))
    return references.expand_references(refs, files.select("name"), files.select("name")), files


@query(
    """WITH RECURSIVE r AS (SELECT page_id AS root, page_id AS target, 0 AS level FROM pages
         UNION SELECT root, CASE WHEN f = 2 THEN target // 2 ELSE target // 16 END, level + 1
           FROM r, (VALUES (2), (16)) v(f) WHERE target >= CASE WHEN f = 2 THEN 1 ELSE 16 END)
       SELECT 'p' || root || '.php' AS root, 'p' || target || '.php' AS target, CAST(min(level) AS BIGINT) AS level
       FROM r WHERE level > 0 GROUP BY ALL"""
)
def expand_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that each file takes in, with the level at which it first does."""
    tree, _ = expansion(spark, sf_dir)
    return tree.where("status = 'expanded'").groupBy("root", "target").agg(F.min("level").cast("bigint").alias("level"))


# inclusions of every page as root, level by level: a level sees what the levels before it included
INCLUSIONS = """ref AS (
      SELECT page_id AS name, 0 AS pos, page_id // 2 AS target, true AS once FROM pages WHERE page_id >= 1
      UNION ALL SELECT page_id, 1, page_id // 16, false FROM pages WHERE page_id >= 16
      UNION ALL SELECT page_id, CASE WHEN page_id >= 16 THEN 2 WHEN page_id >= 1 THEN 1 ELSE 0 END, -1, false FROM pages WHERE page_id % 5 = 0
      {circles}),
    inc(root, place, target, status, level, chain) USING KEY (root, place) AS (
      SELECT page_id, []::BIGINT[], page_id, 'root', 0, [page_id] FROM pages
      UNION
      SELECT root, place, target, CASE WHEN NOT there THEN 'missing' WHEN once AND (before OR place <> first) THEN 'skipped'
          WHEN list_contains(chain, target) THEN 'cycle' ELSE 'expanded' END, level, list_append(chain, target)
      FROM (SELECT *, min(place) OVER (PARTITION BY root, target) AS first FROM (
        SELECT i.root, list_append(i.place, f.pos::BIGINT) AS place, f.target, f.once, i.level + 1 AS level, i.chain, f.target IN (SELECT page_id FROM pages) AS there,
          EXISTS (SELECT 1 FROM recurring.inc x WHERE x.root = i.root AND x.target = f.target AND x.status IN ('expanded', 'skipped', 'cycle')) AS before
        FROM inc i JOIN ref f ON f.name = i.target WHERE i.status IN ('root', 'expanded'))))"""
CIRCLES = """UNION ALL SELECT page_id, CASE WHEN page_id >= 16 THEN 2 ELSE 1 END + CASE WHEN page_id % 5 = 0 THEN 1 ELSE 0 END, 2 * page_id, false
      FROM pages WHERE page_id % 40 = 3"""


@query(
    f"""WITH RECURSIVE {INCLUSIONS.format(circles=CIRCLES)}
       SELECT 'p' || root || '.php' AS root, status, count(*) AS inclusions, CAST(max(level) AS BIGINT) AS deepest FROM inc WHERE status <> 'root' GROUP BY ALL"""
)
def inclusion_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many inclusions of each root are expanded, skipped, missing and circular, when some files include each other."""
    tree, _ = expansion(spark, sf_dir, circles=True)
    return tree.groupBy("root", "status").agg(F.count(F.lit(1)).alias("inclusions"), F.max("level").cast("bigint").alias("deepest"))


# a file's own text: the echo of its address (15 signs around it), a line end per reference, and done();
@query(
    f"""WITH RECURSIVE {INCLUSIONS.format(circles="")},
       own AS (SELECT page_id AS name, length(url) + 15 + 7 AS size FROM pages),
       refs AS (SELECT name, count(*) AS n FROM ref GROUP BY name)
       SELECT 'p' || root || '.php' AS root, CAST(sum(CASE WHEN status = 'missing' THEN 1 ELSE 1 + coalesce(n, 0) END) AS BIGINT) AS pieces,
         CAST(sum(CASE WHEN status = 'missing' THEN 19 ELSE own.size + coalesce(n, 0) END) AS BIGINT) AS size
       FROM inc LEFT JOIN own ON own.name = inc.target LEFT JOIN refs ON refs.name = inc.target
       WHERE status IN ('root', 'expanded', 'missing') GROUP BY root"""
)
def expanded_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces and length of each file's text with everything it includes."""
    tree, files = expansion(spark, sf_dir)
    pieces = references.expanded_source(cut(tree), T.reference_segments(files, "text", ["name"]), files.select("name"))
    return pieces.groupBy("root").agg(F.count(F.lit(1)).alias("pieces"), F.sum(F.length("text")).alias("size"))


# ---- staged runs and arriving programs ----

PROFILE = json.dumps(
    {
        "relevant": [
            {"traversal": "blocks", "modules": [["relevance", "Sink relevance"]]},
            {"traversal": "blocks", "modules": [["taint", "Taint"], ["report", "Report"]]},
        ]
    }
)


def profile_modules(spark: SparkSession) -> dict[str, profiles.Stage]:
    site, names = policy.site_policy(spark), policy.category_names(spark)

    def relevance(ops: DataFrame) -> DataFrame:
        return ops.join(classify.classify_sinks(ops, site).select("unit").distinct(), "unit", "left_semi")

    def taint_ops(ops: DataFrame) -> DataFrame:
        linked = cut(straight_ops(ops, spark).select("unit", "seq", "def_seq", "is_source", "is_clean"))
        state = cut(taint.straight_line_taint(linked).where("tainted").select("unit", "seq"))
        read = state.select("unit", F.col("seq").alias("def_seq"), F.lit(True).alias("reads_taint"))
        reading = linked.join(read, ["unit", "def_seq"]).select("unit", "seq", "reads_taint")
        touched = state.withColumn("reads_taint", F.lit(False)).unionByName(reading)
        return ops.join(touched.groupBy("unit", "seq").agg(F.bool_or("reads_taint").alias("reads_taint")), ["unit", "seq"])

    def report(ops: DataFrame) -> DataFrame:
        arguments = B.sink_arguments(ops.where("reads_taint")).select(
            "unit", "seq", "pos", F.col("var").isNotNull().alias("tainted"), F.array().cast("array<string>").alias("sanitizers")
        )
        return taint.report_flows(ops.drop("reads_taint"), arguments, site, names)

    return {"relevance": relevance, "taint": taint_ops, "report": report}


@query(
    with_ctes(
        "po lk tt fl os",
        """SELECT CAST(0 AS BIGINT) AS stage, 'Sink relevance' AS module, count(DISTINCT file || ':' || start_line) AS lines FROM po
             WHERE start_line <> 'None' AND unit IN (SELECT unit FROM os)
           UNION ALL SELECT 1, 'Taint', count(DISTINCT file || ':' || start_line) FROM po JOIN lk USING (unit, seq)
             WHERE start_line <> 'None' AND unit IN (SELECT unit FROM os)
             AND ((unit, seq) IN (SELECT (unit, seq) FROM tt) OR (unit, def_seq) IN (SELECT (unit, seq) FROM tt))
           UNION ALL SELECT 1, 'Report', count(DISTINCT file || ':' || start_line) FROM fl WHERE start_line <> 'None'""",
    )
)
def run_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = spark.range(1).select(F.lit(PROFILE).alias("text"))
    _, stats = profiles.run_profile(
        ops_of(spark, sf_dir), profiles.parse_profiles(texts), "relevant", profile_modules(spark)
    )
    return big(stats, "stage")


@query(
    with_ctes(
        "po lk tt fl os",
        """SELECT CAST(0 AS BIGINT) AS stage, 'Sink relevance' AS module, count(*) AS rows, count(*) FILTER (start_line <> 'None') AS known_lines
             FROM po WHERE unit IN (SELECT unit FROM os)
           UNION ALL SELECT 1, 'Taint', count(*), count(*) FILTER (start_line <> 'None') FROM po JOIN lk USING (unit, seq) WHERE unit IN (SELECT unit FROM os)
             AND ((unit, seq) IN (SELECT (unit, seq) FROM tt) OR (unit, def_seq) IN (SELECT (unit, seq) FROM tt))
           UNION ALL SELECT 1, 'Report', count(DISTINCT file || ':' || start_line), count(DISTINCT file || ':' || start_line) FILTER (start_line <> 'None') FROM fl""",
    )
)
def profile_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that each stage and module gave, observed as they were written; the seconds are in the table, not in this query."""
    texts = spark.range(1).select(F.lit(PROFILE).alias("text"))
    measures: list[tuple] = []
    profiles.run_profile(ops_of(spark, sf_dir), profiles.parse_profiles(texts), "relevant", profile_modules(spark), measures)
    return big(profiles.measure_table(spark, measures).drop("seconds"), "stage")


def analyse_batch(batch: DataFrame) -> DataFrame:
    """Findings of one batch of events."""
    spark = batch.sparkSession
    ops = cut(B.program_ops(B.number_events(B.add_slices(B.decode_events(batch), "ts"))))
    return taint.report_flows(
        ops, tainted_arguments(ops, spark), policy.site_policy(spark), policy.category_names(spark)
    )


@query(with_ctes("fl", REPORT_SQL))
def arrival_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of the event files as a stream delivers them: two batches, each with a part of every unit."""
    events = B.table(spark, sf_dir, "events")
    source, out, state = (new_folder(spark, name) for name in ("arriving", "arrived", "arrivals"))
    odd = F.coalesce(F.col("event_id") % 2 != 0, F.lit(False))
    for part in (odd, ~odd):
        events.where(part).write.mode("append").parquet(source)
        analyse_arrivals(spark, source, events.schema, analyse_batch, out, state=state, unit="user_id")
    return latest_arrivals(spark, out, "unit").withColumn("seq", F.col("seq").cast("bigint"))
