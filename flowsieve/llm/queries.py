"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsieve.llm.binary_codes import near_vectors
from flowsieve.llm.line_runs import drop_repeated_lines
from flowsieve.llm.merkle_manifest import fold_proof, leaf_digest, merkle_manifest, proof_digest
from flowsieve.llm.mixing import mix_sources
from flowsieve.llm.oracles import MERKLE, RUNS
from flowsieve.llm.periodic_runs import periodic_runs
from flowsieve.llm.pseudo_likelihood import pseudo_log_likelihood
from flowsieve.llm.rule_quality import quality
from flowsieve.llm.superminhash import near_duplicates
from flowsieve.llm.token_blocks import read_tokens, write_tokens
from flowsieve.llm.topk import top_scores
from flowsieve.llm.toxicity import toxicity
from flowsieve.llm.tree_bpe import encode_documents
from flowsieve.llm.url_rank import judge_urls
from flowsieve.session import new_folder

#: (host, path, verdict) of the URL query.
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_log_likelihood(table(spark, sf_dir, "documents"))


def op2_patched_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return read_tokens(spark, folder)


def op3_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    short = drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return short.select("doc_id", "line_dedup.n_lines", "line_dedup.n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op4_binary_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op5_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_url_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    judged = judge_urls(table(spark, sf_dir, "pages"), rules)
    return judged.select("page_id", "judged.host", "judged.path", "judged.rule", "judged.verdict")


def op7_histogram_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_scores(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    taken = (F.col("mix.copies") * F.col("mix.size")).alias("taken")
    return mixed.select("doc_id", "mix.size", "mix.source_size", "mix.target", taken)


def op9_subword_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "toxicity.*")


def op10_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def crc(column: str) -> Column:
    """Unsigned crc32 of a whole number's decimal digits."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chars = F.col("n_chars") + F.when(crc("doc_id") % 7 == 0, 1).otherwise(0)
    leaf, shown = (leaf_digest(*[F.col(c) for c in ("doc_id", "source", "lang")], n, F.col("text")) for n in (F.col("n_chars"), chars))
    manifest = merkle_manifest(docs, leaf, carried={"shown": shown})
    folded = fold_proof(F.col("shown"), F.col("proof"))
    manifest = manifest.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), folded.alias("folded_root"))
    return manifest.withColumn("verified", F.col("folded_root") == F.col("root"))


def _with_period(text: Column, h: Column) -> Column:
    """Every tenth text repeats a passage of its words to its end."""
    g = F.floor(h / 10)

    def planted(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        places = F.sequence(F.lit(0).cast("long"), n - 1)
        moved = F.transform(places, lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")))
        return F.when(n > 0, F.array_join(moved, " "))

    # the words are a variable of a function, so that they are made once and not for each place
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    changed = F.transform(F.array(words), planted)[0]
    return F.when(h % 10 == 0, F.coalesce(changed, text)).otherwise(text)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", _with_period(F.col("text"), crc("doc_id")).alias("text"))
    found = periodic_runs(docs).withColumn("runs", F.col("periodic.runs"))
    key = F.expr("transform(runs, r -> struct(-r.length AS a, r.start AS b, r.period AS c))")
    found = found.withColumn("best", F.array_min(key))
    start, length, period = F.col("best.b"), -F.col("best.a"), F.col("best.c")
    shown = F.expr(r"array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"),
        F.floor(length * 1000 / period).alias("exponent_milli"), F.sha2(shown, 256).alias("runs_sha256"),
        F.sha2("periodic.collapsed", 256).alias("collapsed_sha256"),
    )


def op13_rule_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "quality.*")


QUERIES = {
    "op1_pseudo_likelihood": op1_pseudo_likelihood,
    "op2_patched_blocks": op2_patched_blocks,
    "op3_line_runs": op3_line_runs,
    "op4_binary_codes": op4_binary_codes,
    "op5_superminhash": op5_superminhash,
    "op6_url_rank": op6_url_rank,
    "op7_histogram_topk": op7_histogram_topk,
    "op8_mix_sources": op8_mix_sources,
    "op9_subword_toxicity": op9_subword_toxicity,
    "op10_tree_bpe": op10_tree_bpe,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_rule_quality": op13_rule_quality,
}

ORACLES = {
    "op11_merkle_manifest": MERKLE,
    "op12_periodic_runs": RUNS,
    "op3_line_runs": r"""
WITH split AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, line, pos,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM split),
repeated AS (
  SELECT key, max(doc_id) AS top FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT k.doc_id, k.line, k.pos, r.key IS NOT NULL AND k.doc_id < r.top AS gone
  FROM keyed k LEFT JOIN repeated r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""",
    "op8_mix_sources": r"""
WITH sized AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^ 	-
]+')), 0)::BIGINT AS size
  FROM documents),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT source, source_size, 2.0::DOUBLE * source_size AS most,
         [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER] AS weight
  FROM sums),
ordered AS (
  SELECT *, 1.5::DOUBLE * sum(source_size) OVER ()
            - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
  FROM weighed),
level AS (
  SELECT arg_min(rest / open, most / weight) FILTER (WHERE most / weight > rest / open) AS per_weight FROM ordered),
targets AS (
  SELECT source, source_size, CASE WHEN per_weight IS NULL THEN most ELSE least(most, weight * per_weight) END AS target
  FROM weighed, level),
rates AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
         ('0x' || md5('mix:' || coalesce(d.doc_id::VARCHAR, ''))[1:13])::BIGINT / 4503599627370496.0::DOUBLE AS draw
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       ((floor(rate)::BIGINT + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM rates
""",
}
