"""Policy of sources, sanitizers and sinks as a dimension table.

``load_policy`` reads the built-in rows or a file with the same columns. Site-specific
rows come from such a file: ``overlay_policy`` lays it over the base.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowsieve.sources.sink_rows import SINK_ROWS

POLICY_SCHEMA = (
    "kind STRING, category STRING, rank INT, name STRING, positions ARRAY<INT>, safe_by ARRAY<STRING>"
)

# Category names in the order in which sinks are tested.
SINK_CATEGORIES = {
    "XSS": "Cross-Site Scripting",
    "CODE": "Code Execution",
    "EXEC": "Command Execution",
    "DATABASE": "SQL Injection",
    "SSRF": "Server-Side Request Forgery",
    "HTTP_HEADER": "HTTP Response Splitting",
    "POP": "PHP Object Injection",
    "OTHER": "Possible Flow Control",
    "CONNECT": "Protocol Injection",
    "SESSION_FIXATION": "Session Fixation",
    "REFLECTION": "Reflection Injection",
    "FILE_READ": "File Disclosure",
    "FILE_AFFECT": "File Manipulation",
    "LDAP": "LDAP Injection",
    "XPATH": "XPath Injection",
    "FILE_INCLUDE": "File Inclusion",
}

# Variables that hold untrusted input.
SOURCE_VARIABLES = """
_GET _POST _COOKIE _REQUEST _FILES _SERVER HTTP_GET_VARS HTTP_POST_VARS HTTP_COOKIE_VARS
HTTP_REQUEST_VARS HTTP_POST_FILES HTTP_SERVER_VARS HTTP_RAW_POST_DATA argc argv
""".split()

# Calls that return untrusted data.
SOURCE_CALLS = {
    "FILE_INPUT": """
        bzread dio_read exif_imagetype exif_read_data exif_thumbnail fgets fgetss file
        file_get_contents fread get_meta_tags glob gzread readdir read_exif_data scandir zip_read
        """.split(),
    "DATABASE_INPUT": """
        mysql_fetch_array mysql_fetch_assoc mysql_fetch_field mysql_fetch_object mysql_fetch_row
        pg_fetch_all pg_fetch_array pg_fetch_assoc pg_fetch_object pg_fetch_result pg_fetch_row
        sqlite_fetch_all sqlite_fetch_array sqlite_fetch_object sqlite_fetch_single sqlite_fetch_string
        """.split(),
    "OTHER_INPUT": """
        get_headers getallheaders get_browser getenv gethostbyaddr runkit_superglobals
        import_request_variables
        """.split(),
}

# Calls and casts that clean a value for every category.
FULL_SANITIZERS = """
Expr_Cast_Bool Expr_Cast_Int Expr_Cast_Double Expr_Cast_Unset intval floatval doubleval
filter_input urlencode rawurlencode round floor strlen strrpos strpos strftime strtotime md5
md5_file sha1 sha1_file crypt crc32 hash mhash hash_hmac password_hash mcrypt_encrypt
mcrypt_generic base64_encode ord sizeof count bin2hex levenshtein abs bindec decbin dechex decoct
hexdec rand max min metaphone tempnam soundex money_format number_format date_format filetype
nl_langinfo bzcompress convert_uuencode gzdeflate gzencode gzcompress http_build_query
lzf_compress zlib_encode imap_binary iconv_mime_encode bson_encode sqlite_udf_encode_binary
session_name readlink getservbyport getprotobynumber gethostname gethostbynamel gethostbyname
""".split()

# Calls that clean a value for one kind of sink.
CONDITIONAL_SANITIZERS = {
    "XSS": "htmlentities htmlspecialchars highlight_string esc_attr esc_html".split(),
    "PREG": ["preg_quote"],
    "SYSTEM": ["escapeshellarg", "escapeshellcmd"],
    "SQL": """
        addslashes dbx_escape_string db2_escape_string ingres_escape_string maxdb_escape_string
        maxdb_real_escape_string mysql_escape_string mysql_real_escape_string mysqli_escape_string
        mysqli_real_escape_string pg_escape_string pg_escape_bytea sqlite_escape_string
        sqlite_udf_encode_binary cubrid_real_escape_string
        """.split(),
}
# Names that only sinks refer to.
SINK_ONLY_SANITIZERS = {"FILE": ["basename", "dirname", "pathinfo"], "XPATH": ["addslashes"], "LDAP": []}

# A call that passes taint from some arguments to others, 0 meaning any.
PROPAGATORS = [("array_push", [1], [0])]

# Additions for one well-known site.
SITE_ROWS = [
    ("conditional_sanitizer", "SQL", 3, "esc_sql", [], []),
    ("sink", "DATABASE", 3, "insert", [0], [*CONDITIONAL_SANITIZERS["SQL"], "esc_sql"]),
]


def sanitizer_list(label: str | None) -> list[str]:
    if label is None:
        return []
    return {**CONDITIONAL_SANITIZERS, **SINK_ONLY_SANITIZERS}[label]


def policy_rows() -> list[tuple]:
    """Built-in rows in the column order of ``POLICY_SCHEMA``."""
    order = list(SINK_CATEGORIES)
    rows: list[tuple] = [("source_variable", "USERINPUT", 0, name, [], []) for name in SOURCE_VARIABLES]
    for rank, (category, names) in enumerate(SOURCE_CALLS.items()):
        rows += [("source_call", category, rank, name, [], []) for name in names]
    rows += [("full_sanitizer", "STRING", 0, name, [], []) for name in FULL_SANITIZERS]
    for rank, (category, names) in enumerate(CONDITIONAL_SANITIZERS.items()):
        rows += [("conditional_sanitizer", category, rank, name, [], []) for name in names]
    for category, sinks in SINK_ROWS.items():
        rows += [("sink", category, order.index(category), name, where, sanitizer_list(safe)) for name, where, safe in sinks]
    rows += [("propagator", ",".join(map(str, source)), 0, name, to, []) for name, to, source in PROPAGATORS]
    return rows


def rows_to_table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """A driver-side table of policy size; Spark knows its size and broadcasts it by that."""
    columns = list(zip(*rows, strict=True))
    types = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.string())]
    names = ["kind", "category", "rank", "name", "positions", "safe_by"]
    arrays = [pa.array(list(c), type=t) for c, t in zip(columns, types, strict=True)]
    return spark.createDataFrame(pa.table(arrays, names=names))


def load_policy(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Built-in rows, or those of a JSON-lines file or folder with the policy columns."""
    if path is None:
        return rows_to_table(spark, policy_rows())
    return spark.read.schema(POLICY_SCHEMA).json(path)


def overlay_policy(base: DataFrame, extra: DataFrame) -> DataFrame:
    """Rows of both; where kind, category and name agree, the overlay's row wins."""
    both = base.withColumn("layer", F.lit(0)).unionByName(extra.withColumn("layer", F.lit(1)))
    best = Window.partitionBy("kind", "category", "name").orderBy(F.desc("layer"), "rank")
    return both.withColumn("_place", F.row_number().over(best)).where("_place = 1").drop("_place")


def site_policy(spark: SparkSession) -> DataFrame:
    """The built-in base with the site rows laid over it."""
    return overlay_policy(load_policy(spark), rows_to_table(spark, SITE_ROWS))


def category_names(spark: SparkSession) -> DataFrame:
    """category, its rank and the name used in messages."""
    return spark.createDataFrame(
        pa.table(
            {
                "category": list(SINK_CATEGORIES),
                "category_rank": pa.array(range(len(SINK_CATEGORIES)), type=pa.int32()),
                "category_name": list(SINK_CATEGORIES.values()),
            }
        )
    )
