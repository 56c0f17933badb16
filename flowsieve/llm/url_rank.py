"""URL filter: rules by host and path, and trust and distrust that spread over host links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsieve.session import cut, cut_counted

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hosts of absolute and protocol-relative links.
LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s<>]+)"""


def lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): the host behind the first ``://`` with A-Z lower-cased, the path up to ``?`` or ``#``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    return lower(host), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rules_of_hosts(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, rules): the rules (path, rule, verdict) that name the host or a domain it is in.

    ``rules`` has host, path and verdict. Every host is joined by its suffixes at dots, so the work
    is a few rows per host, however many rules there are.
    """
    labels = F.split("host", "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    ends = hosts.select("host", F.explode(suffixes).alias("domain"))
    named = rules.select(
        F.col("host").alias("domain"), F.struct("path", F.concat("host", "path").alias("rule"), "verdict").alias("found")
    )
    return ends.join(named, "domain").groupBy("host").agg(F.collect_set("found").alias("rules"))


def longest_rule(rules: Column, path: Column) -> Column:
    """The longest rule whose path the url's path starts with; equal lengths by text."""
    fit = F.filter(rules, lambda r: F.startswith(path, r["path"]))
    sized = F.transform(fit, lambda r: F.struct(F.length(r["rule"]).alias("n"), r["rule"].alias("rule"), r["verdict"].alias("verdict")))
    return F.array_max(sized)


def host_edges(pages: DataFrame, html_col: str) -> DataFrame:
    """(src, dst, links) between different hosts, from the links of all pages (with ``__host``); summed before they are shuffled."""
    found = F.explode(F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(LINK), F.lit(1)))
    links = pages.select(F.col("__host").alias("src"), found.alias("dst")).withColumn("dst", lower(F.col("dst")))
    return links.where("src <> dst AND src <> '' AND dst <> ''").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("links"))


def spread(seeds: DataFrame, edges: DataFrame, damping: float, tolerance: float) -> DataFrame:
    """(kind, host, score): seeds (kind, host, seed) spread over edges (kind, src, dst, share).

    score = seed + damping * sum(share * score of the neighbours), so a host without edges keeps its
    seed. Every round changes scores by at most damping times the change before it; the loop ends
    when no score changes by more than the tolerance. Hosts that nothing reaches have no row.
    """
    seeds, edges = cut(seeds), cut(edges)
    now = seeds.withColumnRenamed("seed", "score")
    while True:
        passed = edges.join(now.withColumnRenamed("host", "src"), ["kind", "src"]).select(
            "kind", F.col("dst").alias("host"), (F.col("share") * F.col("score") * damping).alias("part")
        )
        parts = seeds.select("kind", "host", F.col("seed").alias("part")).unionByName(passed)
        new = parts.groupBy("kind", "host").agg(F.sum("part").alias("score"))
        old = now.select("kind", "host", F.col("score").alias("before"))
        change = F.abs(F.col("score") - F.coalesce("before", F.lit(0.0)))
        now, moving = cut_counted(new.join(old, ["kind", "host"], "left"), change > tolerance)
        now = now.select("kind", "host", "score")
        if not moving:
            return now


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    url_col: str = "url",
    html_col: str = "html",
    damping: float = 0.85,
    tolerance: float = 1e-4,
    threshold: float = 0.5,
) -> DataFrame:
    """The rows of ``pages`` with the column ``judged`` (host, path, rule, verdict, trust, distrust).

    Where a rule fits, the longest one decides. For the others the host decides: the share of its pages
    that rules allow is its seed of trust, the share they block its seed of distrust. Trust spreads
    along links, distrust against them (who links to a blocked host is suspect). A host
    whose distrust is above its trust by ``threshold`` is blocked. Null urls and urls without
    ``://`` have an empty host and path and are allowed; repeated rows count as
    pages; null html has no links; an empty table gives no rows; other columns pass through.
    """
    host, path = url_parts(F.col(url_col).cast("string"))
    split = pages.withColumns({"__host": host, "__path": path})
    hosts = split.groupBy(F.col("__host").alias("host")).agg(F.count(F.lit(1)).alias("pages"))
    fitting = cut(rules_of_hosts(hosts, rules))
    fitting = fitting.select(F.col("host").alias("__named"), F.col("rules").alias("__rules"))
    ruled = split.join(fitting, F.col("__host") == F.col("__named"), "left").withColumn(
        "__rule", longest_rule(F.col("__rules"), F.col("__path"))
    )
    shares = ruled.groupBy(F.col("__host").alias("host")).agg(
        F.avg((F.coalesce(F.col("__rule.verdict"), F.lit("")) == "allow").cast("double")).alias("trust"),
        F.avg((F.coalesce(F.col("__rule.verdict"), F.lit("")) == "block").cast("double")).alias("distrust"),
    )
    seeds = shares.select("host", F.expr("stack(2, 'trust', trust, 'distrust', distrust) AS (kind, seed)")).where("seed > 0")
    links = cut(host_edges(split, html_col))
    shared = links.join(links.groupBy("src").agg(F.sum("links").alias("all")), "src")
    shared = shared.select("src", "dst", (F.col("links") / F.col("all")).alias("share"))
    forward = shared.select(F.lit("trust").alias("kind"), "src", "dst", "share")
    backward = shared.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "share")
    scores = spread(seeds, forward.unionByName(backward), damping, tolerance)
    wide = scores.groupBy(F.col("host").alias("__scored")).agg(
        F.max(F.when(F.col("kind") == "trust", F.col("score"))).alias("__trust"),
        F.max(F.when(F.col("kind") == "distrust", F.col("score"))).alias("__distrust"),
    )
    scored = ruled.join(cut(wide), F.col("__host") == F.col("__scored"), "left")
    trust, distrust = (F.coalesce(F.col(c), F.lit(0.0)) for c in ("__trust", "__distrust"))
    by_host = F.when(distrust - trust >= threshold, F.lit("block")).otherwise(F.lit("allow"))
    judged = F.struct(
        F.col("__host").alias("host"),
        F.col("__path").alias("path"),
        F.col("__rule.rule").alias("rule"),
        F.coalesce(F.col("__rule.verdict"), by_host).alias("verdict"),
        trust.alias("trust"),
        distrust.alias("distrust"),
    )
    return scored.select(*[F.col(c) for c in pages.columns if c != "judged"], judged.alias("judged"))
