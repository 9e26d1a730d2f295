"""URL filters: host-suffix and path-prefix expressions, joined with the
rules on short hash prefixes and confirmed by full digests.

A rule is a host and a path; it fits its host and all subdomains where the
URL's path starts with the rule's.  Each distinct URL is expanded into the
expressions (host suffix + path prefix) that a rule could have -- only
suffixes of as many labels and prefixes of as many characters as some rule
has --, the expressions meet the rules in an equi-join on 32 bits of their
SHA-256, and the full digests decide.  The longest rule wins (of equal
lengths the longer host, then ``block``).  Which verdict a URL gets is
worked out once per distinct URL; rows join it back on the URL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repeatlens.llm.common import table

#: Host, path, verdict.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
DEFAULT = "allow"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in
    lower case; '' for null or no ``://``."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), URL, 1), _UPPER, _LOWER)


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; '' as above."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), URL, 2)


def _hashed(df: DataFrame, expression: str) -> DataFrame:
    """``df`` with the expression's digest and its first 32 bits."""
    return df.withColumn("digest", F.sha2(expression, 256)).withColumn(
        "short", F.conv(F.substring("digest", 1, 8), 16, 10).cast("long"))


def expressions(urls: DataFrame, labels: list[int], lengths: list[int]) -> DataFrame:
    """(url, expression): host suffixes of ``labels`` labels joined with path
    prefixes of ``lengths`` characters."""
    parts = urls.select("url", F.split(host(F.col("url")), r"\.", -1).alias("h"),
                        path(F.col("url")).alias("p"))
    suffixes = F.transform(
        F.filter(F.lit(labels).cast("array<int>"), lambda n: n <= F.size("h")),
        lambda n: F.array_join(F.slice("h", F.size("h") - n + 1, n), "."))
    prefixes = F.transform(
        F.filter(F.lit(lengths).cast("array<int>"), lambda n: n <= F.length("p")),
        lambda n: F.substring(F.col("p"), F.lit(1), n))
    each = parts.select("url", "p", F.explode(suffixes).alias("s"), prefixes.alias("pre"))
    return each.select("url", "s", F.explode("pre").alias("x")).select(
        "url", F.concat("s", "x").alias("expression"))


def judge(pages: DataFrame, rules: DataFrame, url_col: str = "url") -> DataFrame:
    """``pages`` with host, path, rule and verdict.

    ``rules``: host, path, verdict; null parts are taken as '', repeated
    rules count once, and with both verdicts for one rule ``block`` wins.  A
    URL that is null or has no ``://`` has an empty host and path, so it fits
    rules for the empty host only; without a rule the verdict is ``allow``.
    Columns of those four names in ``pages`` are replaced.  Empty pages, empty
    result; empty rules, all allowed.
    """
    spark = pages.sparkSession
    named = rules.select(F.coalesce("host", F.lit("")).alias("h"),
                         F.coalesce("path", F.lit("")).alias("p"), "verdict").distinct()
    # how many labels and characters rules have: bounded by their longest, not
    # by their number
    shape = named.agg(F.collect_set(F.size(F.split("h", r"\.", -1))).alias("labels"),
                      F.collect_set(F.length("p")).alias("lengths")).first()
    known = _hashed(named.withColumn("rule", F.concat("h", "p")), "rule")
    urls = pages.select(F.col(url_col).alias("url")).filter("url is not null").distinct()
    asked = _hashed(expressions(urls, sorted(shape.labels), sorted(shape.lengths)), "expression")
    fits = asked.alias("a").join(known.alias("k"), "short").filter("a.digest = k.digest")
    best = fits.groupBy("a.url").agg(F.max(F.struct(
        F.length("k.rule").alias("n"), F.length("k.h").alias("hn"),
        (F.col("k.verdict") == "block").alias("blocks"), F.col("k.rule").alias("rule"),
        F.col("k.verdict").alias("verdict"))).alias("best"))
    best = best.select(F.col("url").alias("_u_url"), F.col("best.rule").alias("_u_rule"),
                       F.col("best.verdict").alias("_u_verdict"))
    new = {"host": host(F.col(url_col)), "path": path(F.col(url_col)), "rule": F.col("_u_rule"),
           "verdict": F.coalesce("_u_verdict", F.lit(DEFAULT))}
    out = pages.join(best, pages[url_col] == best["_u_url"], "left")
    return out.withColumns(new).drop("_u_url", "_u_rule", "_u_verdict")


def rule_table(spark, rules=RULES) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def op6_url_filters(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, rule_table(spark)).select("page_id", "host", "path", "rule", "verdict")


def oracle() -> str:
    """DuckDB SQL for ``op6_url_filters``: rules tested one by one."""
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    return rf"""
WITH parts AS (
    SELECT row_number() OVER () AS rid, page_id,
           translate(regexp_extract(coalesce(url, ''), '{URL}', 1),
                     '{_UPPER}', '{_LOWER}') AS host,
           regexp_extract(coalesce(url, ''), '{URL}', 2) AS path FROM pages),
  rules(h, p, verdict) AS (VALUES {rules}),
  best AS (
    SELECT rid, arg_max(h || p, length(h || p)) AS rule,
           arg_max(verdict, length(h || p)) AS verdict
    FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
    GROUP BY rid)
SELECT page_id, host, path, rule, coalesce(verdict, '{DEFAULT}') AS verdict
FROM parts LEFT JOIN best USING (rid)"""
