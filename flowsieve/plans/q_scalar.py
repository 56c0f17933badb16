"""Queries of the scalar functions, filters and inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsieve.functions import expressions as X
from flowsieve.functions import operands as O
from flowsieve.functions import text as T
from flowsieve.operators import classify, filters
from flowsieve.plans import bindings as B
from flowsieve.plans.catalog import at, query, sql_list, with_ctes
from flowsieve.sources import dumps, policy

def operand_json() -> Column:
    """JSON of an operand that leaves out the keys it has no value for."""
    return F.to_json(
        F.struct(
            F.when(F.col("k") % 3 == 0, F.concat(F.lit("LITERAL("), F.col("k"), F.lit(")"))).alias("value"),
            F.when(F.col("k") % 3 == 1, F.concat(F.lit("v"), F.col("rv"))).alias("var_name"),
            F.when(F.col("k") % 2 == 0, F.col("k").cast("string")).alias("id"),
            F.when(F.col("k") % 5 == 0, F.lit("local")).alias("scope"),
            F.when(F.col("k") % 7 == 0, F.lit(True)).alias("byRef"),
            F.when(F.col("k") % 4 == 0, F.concat(F.lit("d"), F.col("wv"))).alias("dim"),
        )
    )


OPERAND_SCHEMA = "type STRING, byRef BOOLEAN, value STRING, scope STRING, var_name STRING, dim STRING, id STRING"
OPERAND_SQL = """SELECT event_id, CAST(NULL AS VARCHAR) AS type, k % 7 = 0 AS by_ref,
    CASE WHEN k % 3 = 0 THEN 'LITERAL(' || k || ')' ELSE '' END AS value,
    CASE WHEN k % 5 = 0 THEN 'local' ELSE '' END AS scope,
    CASE WHEN k % 3 = 1 THEN 'v' || k % 10 ELSE '' END AS name,
    CASE WHEN k % 4 = 0 THEN 'd' || k // 10 ELSE '' END AS dim,
    CASE WHEN k % 2 = 0 THEN CAST(k AS VARCHAR) ELSE '-1' END AS id FROM ev"""


def event_operands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One operand per event, read from JSON with some keys left out."""
    events = B.decode_events(B.table(spark, sf_dir, "events"))
    parsed = events.select("event_id", F.from_json(operand_json(), OPERAND_SCHEMA).alias("j"))
    source = {
        field: F.col(f"j.{dumps.DUMP_KEYS.get(field, field)}") for field in O.OPERAND_FIELDS
    }
    return parsed.select("event_id", O.normalise_operand(source).alias("var"))


@query(with_ctes("ev", OPERAND_SQL))
def normalise_operand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_operands(spark, sf_dir).select("event_id", "var.*")


@query(
    with_ctes(
        "ev",
        """SELECT event_id, CASE WHEN id = '-1'
             THEN CASE WHEN name <> '' THEN scope || '<' || mark || '$' || name || '>' ELSE value END
             ELSE 'Var#' || id || scope || CASE WHEN name <> '' THEN '<' || mark || '$' || name || '>' ELSE mark END
               || CASE WHEN dim <> '' THEN '[' || dim || ']' ELSE '' END END AS text
           FROM (SELECT *, CASE WHEN by_ref THEN '&' ELSE '' END AS mark FROM operands)""",
        {"operands": OPERAND_SQL},
    )
)
def render_operand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_operands(spark, sf_dir).select("event_id", O.render_operand(F.col("var")).alias("text"))


LITERAL_SQL = """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'LITERAL(''' || text || ''')'
    WHEN 1 THEN 'LITERAL(' || n_chars || ')'
    WHEN 2 THEN CASE WHEN doc_id % 8 = 2 THEN 'LITERAL(true)' ELSE 'LITERAL(''' || source || ''')' END
    ELSE lang END AS value FROM documents"""


def document_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A literal of each kind from the whole texts; every fourth value is none."""
    kind = F.col("doc_id") % 4
    value = (
        F.when(kind == 0, F.concat(F.lit("LITERAL('"), F.col("text"), F.lit("')")))
        .when(kind == 1, F.concat(F.lit("LITERAL("), F.col("n_chars"), F.lit(")")))
        .when((kind == 2) & (F.col("doc_id") % 8 == 2), F.lit("LITERAL(true)"))
        .when(kind == 2, F.concat(F.lit("LITERAL('"), F.col("source"), F.lit("')")))
        .otherwise(F.col("lang"))
    )
    return B.table(spark, sf_dir, "documents").select("doc_id", value.alias("value"))


# a line end inside the quotes means no literal
PARSED_SQL = r"""SELECT doc_id, CASE WHEN starts_with(value, 'LITERAL(') AND NOT contains(value, chr(10)) THEN
    CASE WHEN lower(body) IN ('true', 'false') THEN upper(body[1]) || lower(body[2:])
         WHEN regexp_full_match(body, '[0-9]+') THEN body ELSE '''' || body || '''' END END AS literal
    FROM (SELECT doc_id, value, regexp_replace(regexp_replace(value[9:-2], '^''', ''), '''$', '') AS body FROM lits)"""


@query(with_ctes("ev", PARSED_SQL, {"lits": LITERAL_SQL}))
def parse_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_literals(spark, sf_dir).select("doc_id", O.parse_literal(F.col("value")).alias("literal"))


@query(
    with_ctes(
        "ev",
        r"SELECT doc_id FROM lits WHERE regexp_matches(value, 'LITERAL\([^\n]*\)')",
        {"lits": LITERAL_SQL},
    )
)
def is_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_literals(spark, sf_dir).where(O.is_literal(F.col("value"))).select("doc_id")


@query(
    r"""WITH refs AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '[?#].*$', '') AS against,
          unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href,
          generate_subscripts(regexp_extract_all(html, 'href="([^"]*)"', 1), 1) - 1 AS pos FROM pages),
        t AS (SELECT *, CASE pos % 3 WHEN 0 THEN href WHEN 1 THEN '../a' || href ELSE './b/.././..' || href END AS target FROM refs),
        j AS (SELECT page_id, pos, target, string_split(CASE WHEN starts_with(target, '/') THEN target
                ELSE regexp_replace(against, '[^/]*$', '') || target END, '/') AS parts FROM t)
        SELECT page_id, CAST(pos AS BIGINT) AS pos, target, '/' || array_to_string(list_reduce(
          list_transform(parts, lambda p: [p]), lambda acc, x: CASE WHEN x[1] IN ('', '.') THEN acc
            WHEN x[1] = '..' THEN acc[1:len(acc) - 1] ELSE list_concat(acc, x) END, []::VARCHAR[]), '/') AS path FROM j"""
)
def resolve_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = B.table(spark, sf_dir, "pages")
    refs = pages.select(
        "page_id",
        F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://[^/]*", ""), r"[?#].*$", "").alias("against"),
        F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("pos", "href"),
    )
    target = (
        F.when(F.col("pos") % 3 == 0, F.col("href"))
        .when(F.col("pos") % 3 == 1, F.concat(F.lit("../a"), F.col("href")))
        .otherwise(F.concat(F.lit("./b/.././.."), F.col("href")))
    )
    return refs.withColumn("target", target).select(
        "page_id",
        F.col("pos").cast("bigint").alias("pos"),
        "target",
        O.resolve_path(F.col("target"), F.col("against")).alias("path"),
    )


@query(
    with_ctes(
        "pe",
        """SELECT event_id, CAST(generate_subscripts(c, 1) - 1 AS BIGINT) AS pos, unnest(c) AS case_value
           FROM (SELECT event_id, flatten([[k, rv], [wv], CASE WHEN k % 2 = 0 THEN [k + 1] ELSE [] END]) AS c FROM pe)""",
    )
)
def flatten_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = B.decode_events(B.table(spark, sf_dir, "events"))
    nested = F.array(
        F.array("k", "rv"), F.array("wv"), F.when(F.col("k") % 2 == 0, F.array(F.col("k") + 1)).otherwise(F.array())
    )
    flat = events.select("event_id", F.posexplode(O.flatten_nested(nested)).alias("pos", "case_value"))
    return flat.withColumn("pos", F.col("pos").cast("bigint"))


@query(
    with_ctes(
        "pe",
        """SELECT event_id, CAST(generate_subscripts(c, 1) - 1 AS BIGINT) AS pos, unnest(c) AS case_value
           FROM (SELECT event_id, [CAST(k AS VARCHAR), CAST(rv AS VARCHAR), 'a,[' || wv || ']"'] AS c FROM pe)""",
    )
)
def flatten_nested_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists in lists to several levels, with brackets, commas and quotes inside a text."""
    events = B.decode_events(B.table(spark, sf_dir, "events"))
    nested = F.concat(F.lit("["), "k", F.lit(",[["), "rv", F.lit(', []],[[["a,['), "wv", F.lit(']\\""]]]]]'))
    flat = events.select("event_id", F.posexplode(O.flatten_json(nested)).alias("pos", "case_value"))
    return flat.withColumn("pos", F.col("pos").cast("bigint"))


@query(
    with_ctes(
        "po",
        """SELECT event_id, CASE WHEN k % 3 = 0 THEN 'C' || wv || '::' ELSE '' END || callee AS name
           FROM po WHERE callee IS NOT NULL""",
    )
)
def callee_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = B.program_ops(B.program_events(spark, sf_dir)).where("callee IS NOT NULL")
    quoted = F.when(F.col("k") % 2 == 0, F.concat(F.lit("LITERAL('"), "callee", F.lit("')"))).otherwise(F.col("callee"))
    scope = F.when(F.col("k") % 3 == 0, F.concat(F.lit("LITERAL('C"), F.col("wv"), F.lit("')")))
    return ops.select("event_id", O.callee_name(quoted, scope).alias("name"))


@query(
    with_ctes(
        "po",
        "SELECT op, lower(substr(op, instr(op, '_') + 1)) AS operation, count(*) AS ops FROM po GROUP BY op",
    )
)
def operation_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = B.program_ops(B.program_events(spark, sf_dir))
    return ops.groupBy("op").agg(F.count(F.lit(1)).alias("ops")).select(
        "op", O.operation_name(F.col("op")).alias("operation"), "ops"
    )


@query(
    with_ctes(
        "ev",
        """SELECT event_id, 'in' AS role, CAST(1 AS BIGINT) AS pos, 'r' || k % 10 AS value FROM ev
           UNION ALL SELECT event_id, 'in', 2, 'w' || k // 10 FROM ev WHERE event_type IN ('signup', 'click')
           UNION ALL SELECT event_id, CASE event_type WHEN 'signup' THEN 'out' WHEN 'view' THEN 'out' ELSE 'res' END, 1,
             'x' || k FROM ev WHERE event_type IN ('signup', 'click', 'view')""",
    )
)
def assign_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = B.decode_events(B.table(spark, sf_dir, "events"))

    def var(letter: str, column: str) -> Column:
        return F.struct(F.concat(F.lit(letter), F.col(column)).alias("value"))

    kind, r, w, x = F.col("event_type"), var("r", "rv"), var("w", "wv"), var("x", "k")
    fields = (
        F.when(kind == "signup", F.to_json(F.struct(F.array(r, w).alias("args"), x.alias("result"))))
        .when(kind == "click", F.to_json(F.struct(r.alias("left"), w.alias("right"), x.alias("result"))))
        .when(kind == "view", F.to_json(F.struct(r.alias("expr"), x.alias("result"))))
        .when(kind == "purchase", F.to_json(F.struct(r.alias("expr"))))
        .otherwise(F.to_json(F.struct(r.alias("cond"))))
    )
    op = (
        F.when(kind == "signup", "Expr_FuncCall")
        .when(kind == "click", "Expr_BinaryOp_Plus")
        .when(kind == "view", "Expr_Cast_Int")
        .when(kind == "purchase", "Terminal_Echo")
        .otherwise("Stmt_Switch")
    )
    ops = events.select("event_id", op.alias("op"), F.from_json(fields, "MAP<STRING, VARIANT>").alias("fields"))
    return dumps.assign_roles(ops).select(
        "event_id", "role", F.col("pos").cast("bigint").alias("pos"), dumps.read_operand(F.col("item"))["value"].alias("value")
    )


@query(
    with_ctes(
        "ev",
        f"""SELECT event_id, op,
            CASE WHEN op = 'Coalesce' THEN coalesce(l, r)
              WHEN l IS NULL OR r IS NULL THEN NULL
              WHEN op = 'Plus' THEN l + r WHEN op = 'Minus' THEN l - r WHEN op = 'Mul' THEN l * r
              WHEN op = 'Div' AND r <> 0 THEN CAST(l AS DOUBLE) / r WHEN op = 'Mod' AND r <> 0 THEN l % r
              WHEN op = 'Pow' THEN l ** r WHEN op = 'BitwiseAnd' THEN l & r WHEN op = 'BitwiseOr' THEN l | r
              WHEN op = 'BitwiseXor' THEN xor(l, r) WHEN op = 'ShiftLeft' THEN l << r WHEN op = 'ShiftRight' THEN l >> r
              WHEN op = 'Spaceship' THEN sign(l - r) END::DOUBLE AS number,
            CASE WHEN op IN ('Equal', 'Identical') THEN l = r WHEN op IN ('NotEqual', 'NotIdentical') THEN l <> r
              WHEN op = 'Greater' THEN l > r WHEN op = 'GreaterOrEqual' THEN l >= r WHEN op = 'Smaller' THEN l < r
              WHEN op = 'SmallerOrEqual' THEN l <= r WHEN op = 'LogicalXor' THEN (l <> 0) <> (r <> 0) END AS flag,
            CASE WHEN op = 'Concat' THEN CAST(l AS VARCHAR) || CAST(r AS VARCHAR) END AS text,
            CASE WHEN (l IS NULL OR r IS NULL) AND op NOT IN ('Coalesce', 'LogicalXor', 'Spaceship') THEN
              CASE WHEN op IN {tuple(X.OPEN_OPERATORS)} THEN 'NOT IMPLEMENTED' ELSE
              '((' || coalesce(CAST(l AS VARCHAR), '?') || ') ' || ({sql_list(list(X.SYMBOLS.values()))})[i + 1]
              || ' (' || coalesce(CAST(r AS VARCHAR), '?') || '))' END END AS expr
            FROM (SELECT event_id, event_id % 23 AS i, {at(X.BINARY_OPERATORS, "event_id")} AS op,
              CAST(k AS BIGINT) AS l, CASE WHEN k % 11 <> 0 THEN CAST(k * 7 % 5 AS BIGINT) END AS r FROM ev)""",
    )
)
def eval_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = B.decode_events(B.table(spark, sf_dir, "events"))
    op = B.pick(X.BINARY_OPERATORS, F.col("event_id"))
    left = F.col("k").cast("bigint")
    right = F.when(F.col("k") % 11 != 0, (F.col("k") * 7 % 5).cast("bigint"))
    return events.select("event_id", op.alias("op"), X.eval_binary(op, left, right).alias("r")).select(
        "event_id", "op", "r.*"
    )


@query(
    with_ctes(
        "ev",
        f"""SELECT event_id, kind, CASE kind WHEN 'Array' THEN '["' || v || '"]'
              WHEN 'Bool' THEN CASE WHEN v IN ('true', '1') THEN 'true' WHEN v = '0' THEN 'false' END
              WHEN 'Double' THEN CASE WHEN k % 4 IN (0, 2) THEN CAST(CAST(v AS DOUBLE) AS VARCHAR) END
              WHEN 'Int' THEN CASE WHEN k % 4 = 0 THEN v END
              WHEN 'Object' THEN '{{"scalar":"' || v || '"}}' WHEN 'String' THEN v END AS cast_value
            FROM (SELECT event_id, k, {at(X.CASTS, "event_id")} AS kind, CASE k % 4 WHEN 0 THEN CAST(k AS VARCHAR)
              WHEN 1 THEN event_type WHEN 2 THEN k || '.5' ELSE 'true' END AS v FROM ev)""",
    )
)
def eval_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = B.decode_events(B.table(spark, sf_dir, "events"))
    kind, k = B.pick(X.CASTS, F.col("event_id")), F.col("k")
    value = (
        F.when(k % 4 == 0, k.cast("string"))
        .when(k % 4 == 1, F.col("event_type"))
        .when(k % 4 == 2, F.concat(k, F.lit(".5")))
        .otherwise("true")
    )
    done = events.select("event_id", kind.alias("kind"), X.eval_cast(kind, value).alias("c"))
    shown = F.coalesce(
        F.to_json("c.array"), F.col("c.bool").cast("string"), F.col("c.double").cast("string"),
        F.col("c.int").cast("string"), F.to_json("c.object"), F.col("c.string"),
    )
    return done.select("event_id", "kind", shown.alias("cast_value"))


@query(with_ctes("ev", "SELECT event_id, event_type || ' + ' || k || ' + ' || user_id AS text FROM ev"))
def eval_concat_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = B.decode_events(B.table(spark, sf_dir, "events"))
    parts = events.select(
        "event_id",
        F.posexplode(F.array("event_type", F.col("k").cast("string"), F.col("unit").cast("string"))).alias("pos", "text"),
    )
    return filters.eval_concat_list(parts, ["event_id"], " + ")


@query(
    r"""SELECT doc_id, md5(body) AS digest, length(body) AS size FROM (SELECT doc_id,
        regexp_replace(regexp_replace(trim('  ' || replace(text, chr(10), ' ' || chr(9) || chr(13) || chr(10)) || chr(13) || ' ',
          ' ' || chr(9) || chr(10) || chr(13) || chr(0) || chr(11)), '\r\n|\r', chr(10), 'g'),
          '[ \t\v\x00]+(\n)', '\1', 'g') AS body FROM documents)"""
)
def canonicalise_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rough = F.concat(F.lit("  "), F.replace("text", F.lit("\n"), F.lit(" \t\r\n")), F.lit("\r "))
    body = T.canonicalise_text(rough)
    return B.table(spark, sf_dir, "documents").select(
        "doc_id", F.md5(body).alias("digest"), F.length(body).cast("bigint").alias("size")
    )


@query(
    r"""WITH w AS (SELECT doc_id, lang, source, regexp_extract(text, '[A-Za-z]+') AS word FROM documents),
        a AS (SELECT DISTINCT lower(lang) AS alias, 'Lang\' || upper(lang) AS target FROM documents),
        t AS (SELECT doc_id, 0 AS pos, 'param' AS tag, word || '|null' AS raw, word AS core, '' AS head, '|null' AS tail FROM w WHERE word <> ''
          UNION ALL SELECT doc_id, 1, 'return', '?' || lang || '[]', lang, '?', '[]' FROM w WHERE word <> ''
          UNION ALL SELECT doc_id, 2, 'var', '\' || source || '&int', source, '', '&int' FROM w WHERE word <> ''
          UNION ALL SELECT doc_id, 3, 'type', '$' || lang, '$' || lang, '', '' FROM w WHERE word <> ''
          UNION ALL SELECT doc_id, 4, 'param', '12' || lang, '12' || lang, '', '' FROM w WHERE word <> '')
        SELECT t.doc_id, CAST(t.pos AS BIGINT) AS pos, t.tag, t.raw, t.head || coalesce(a.target, t.core) || t.tail AS resolved
        FROM t LEFT JOIN a ON lower(t.core) = a.alias"""
)
def extract_type_tags_first_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = B.table(spark, sf_dir, "documents")
    word = F.regexp_extract("text", "[A-Za-z]+", 0)
    comment = F.concat(
        F.lit("/**\n * @param "), word, F.lit("|null $a\n * @return ?"), "lang", F.lit("[]\n * @var \\"), "source",
        F.lit("&int\n * @type $"), "lang", F.lit("\n * @param 12"), "lang", F.lit(" */"),
    )
    tagged = docs.where(word != "").select("doc_id", comment.alias("comment"))
    aliases = docs.select(F.col("lang").alias("alias"), F.concat(F.lit("Lang\\"), F.upper("lang")).alias("target")).distinct()
    tags = T.type_tags(tagged, "comment", ["doc_id"])
    return T.resolve_type_tags(tags, ["doc_id"], aliases).withColumn("pos", F.col("pos").cast("bigint"))


@query(
    r"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, text FROM documents),
        a AS (SELECT DISTINCT lower(lang) AS alias, 'Lang\' || upper(lang) AS target FROM documents),
        w AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS place
          FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}]+') AS words FROM documents)),
        t AS (SELECT doc_id, 0 AS pos, 'return' AS tag, '?' || lang || '[]' AS raw, lang AS core, '?' AS head, '[]' AS tail FROM d
          UNION ALL SELECT doc_id, 1, 'var', '\' || source || '&int', source, '', '&int' FROM d
          UNION ALL SELECT doc_id, 2, 'type', '$' || lang, '$' || lang, '', '' FROM d
          UNION ALL SELECT doc_id, 3, 'param', '12' || lang, '12' || lang, '', '' FROM d
          UNION ALL SELECT doc_id, place + 3, 'param', word || '|null', word, '', '|null' FROM w)
        SELECT t.doc_id, CAST(t.pos AS BIGINT) AS pos, t.tag, t.raw, t.head || coalesce(a.target, t.core) || t.tail AS resolved
        FROM t LEFT JOIN a ON lower(t.core) = a.alias"""
)
def extract_type_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tag for every word of every text, in any script, behind four tags for every document."""
    docs = B.table(spark, sf_dir, "documents")
    lang, source, text = (F.coalesce(name, F.lit("")) for name in ("lang", "source", "text"))
    words = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    comment = F.concat(
        F.lit("/**\n * @return ?"), lang, F.lit("[]\n * @var \\"), source, F.lit("&int\n * @type $"), lang, F.lit("\n * @param 12"), lang,
        F.array_join(F.transform(words, lambda w: F.concat(F.lit("\n * @param "), w, F.lit("|null $a"))), ""), F.lit("\n */"),
    )
    aliases = docs.select(F.lower("lang").alias("alias"), F.concat(F.lit("Lang\\"), F.upper("lang")).alias("target")).distinct()
    tags = T.type_tags(docs.select("doc_id", comment.alias("comment")), "comment", ["doc_id"])
    return T.resolve_type_tags(tags, ["doc_id"], aliases).withColumn("pos", F.col("pos").cast("bigint"))


GUARD_SQL = f"SELECT event_id, CASE WHEN k % 17 = 0 THEN '~' ELSE {at(B.COMPARATORS, 'k')} END AS cmp, event_type FROM ev"


@query(
    with_ctes(
        "ev",
        """SELECT event_id, cmp, CASE cmp WHEN '=' THEN '!=' WHEN '!=' THEN '=' WHEN '>' THEN '<=' WHEN '<=' THEN '>'
           WHEN '<' THEN '>=' WHEN '>=' THEN '<' ELSE 'true' END AS negated
           FROM g WHERE event_type IN ('click', 'error')""",
        {"g": GUARD_SQL},
    )
)
def negate_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = B.decode_events(B.table(spark, sf_dir, "events")).where("event_type IN ('click', 'error')")
    cmp = F.when(F.col("k") % 17 == 0, "~").otherwise(B.pick(B.COMPARATORS, F.col("k")))
    return events.select("event_id", cmp.alias("cmp"), X.negate_condition(cmp).alias("negated"))


@query(
    with_ctes(
        "os categories",
        """SELECT os.unit, CAST(os.seq AS BIGINT) AS seq, os.category,
           '*Dangerous: Tainted Input(s). Possible ' || c.category_name || '*' AS message
           FROM os JOIN categories c ON c.category = os.category""",
    )
)
def render_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = B.program_ops(B.program_events(spark, sf_dir))
    sinks = classify.classify_sinks(ops, policy.site_policy(spark))
    return sinks.join(policy.category_names(spark), "category").select(
        "unit", F.col("seq").cast("bigint").alias("seq"), "category", X.render_message(F.col("category_name")).alias("message")
    )


@query(
    with_ctes(
        "pe",
        """SELECT unit, CAST(seq AS BIGINT) AS seq FROM (SELECT unit, seq,
             min(CASE WHEN event_type = 'error' AND k % 3 = 0 THEN seq END) OVER (PARTITION BY unit, CAST(ts AS DATE)) AS stop
             FROM pe) WHERE stop IS NULL OR seq < stop""",
    )
)
def truncate_at_exit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pe = B.program_events(spark, sf_dir)
    leaves = (F.col("event_type") == "error") & (F.col("k") % 3 == 0)
    ops = pe.select(
        "unit", F.to_date("ts").alias("block"), "seq", F.when(leaves, "exit").otherwise("other").alias("operation")
    )
    return filters.truncate_at_exit(ops, ["unit", "block"]).select("unit", F.col("seq").cast("bigint").alias("seq"))


DECLARED = ["Stmt_Trait", "Stmt_Class", "Stmt_Interface", "Stmt_ClassMethod", "Stmt_Function", "Terminal_Const", "Expr_Assign"]


@query(
    with_ctes(
        "pe",
        f"""SELECT kind, name, count(*) AS declared, min(unit) AS first_unit, min_by(seq, (unit, seq))::BIGINT AS first_seq
            FROM (SELECT unit, seq, 'n' || k AS name, {at(["trait", "class", "interface", "method", "function", "constant", "x"], "event_id")} AS kind
            FROM pe) WHERE kind <> 'x' GROUP BY kind, name""",
    )
)
def declaration_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    pe = B.program_events(spark, sf_dir)
    ops = pe.select(
        "unit", "seq", B.pick(DECLARED, F.col("event_id")).alias("op"), F.concat(F.lit("n"), F.col("k")).alias("name")
    )
    return filters.declaration_inventory(ops).select(
        "kind", "name", "declared", F.col("first.unit").alias("first_unit"), F.col("first.seq").cast("bigint").alias("first_seq")
    )


CALLING = ["Expr_FuncCall", "Expr_NsFuncCall", "Expr_MethodCall", "Expr_StaticCall", "Expr_New", "Expr_Assign"]


@query(
    with_ctes(
        "ev",
        f"""SELECT kind, caller, callee, count(*) AS calls FROM (SELECT user_id AS caller, 'n' || k AS callee,
            {at(["function", "namespaced", "method", "static", "new", "x"], "event_id")} AS kind FROM ev)
            WHERE kind <> 'x' GROUP BY ALL""",
    )
)
def call_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = B.decode_events(B.table(spark, sf_dir, "events"))
    ops = events.select(
        "unit", B.pick(CALLING, F.col("event_id")).alias("op"), F.concat(F.lit("n"), F.col("k")).alias("callee")
    )
    return filters.call_inventory(ops)


@query(
    with_ctes(
        "ev",
        "SELECT DISTINCT user_id AS unit, value, id, name FROM o JOIN ev USING (event_id)",
        {"o": OPERAND_SQL},
    )
)
def variable_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    owners = B.table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("unit"))
    return filters.variable_inventory(event_operands(spark, sf_dir).join(owners, "event_id"), ["unit"])


@query(
    with_ctes(
        "po",
        "SELECT unit, CAST(seq AS BIGINT) AS seq, CAST(start_line AS BIGINT) AS line FROM po WHERE start_line <> 'None'",
    )
)
def located_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = B.program_ops(B.program_events(spark, sf_dir))
    return filters.located_ops(ops).select(
        "unit", F.col("seq").cast("bigint").alias("seq"), F.col("line").cast("bigint").alias("line")
    )
