"""URL allow and block rules by expression digests (operator 6, DataFrame functions only).

A URL is expanded into expressions: each suffix of its host, in whole labels,
with each prefix of its path that ends in a slash.  Expressions and rules meet
in an equi-join on the first digits of their SHA-256; the full digest and the
rest of the rule's path are confirmed afterwards and the longest fitting rule
wins.  Expansion goes only as deep as the deepest rule, which the rules bound,
not the URL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
PREFIX_DIGITS = 8
DEFAULT_VERDICT = "allow"
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, UPPER.lower())


def with_host_and_path(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds host and path; both empty without ``://``."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.substr(F.col(url), at + F.lit(3))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + F.lit(1)), "^[^?#]*", 0)
    return df.withColumns({"host": lower_ascii(F.coalesce(host, F.lit(""))), "path": F.coalesce(path, F.lit(""))})


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, action string")


def url_filter(pages: DataFrame, rules: DataFrame, default: str = DEFAULT_VERDICT) -> DataFrame:
    """Verdict for each page's url.

    ``rules`` has host, path and action (allow or block).  A rule fits its host
    and all subdomains, where the path starts with the rule's.  The longest
    rule (host and path) wins, among these the longer host, then block; without
    a rule the verdict is ``default``.  Returns page_id, host, path, rule, verdict,
    one row per input row.  A null url, or one without ``://``, has an empty
    host and path; null rule parts are empty and an empty rule host fits none;
    repeated pages and rules change nothing; other columns are ignored.
    """
    r = rules.select(lower_ascii(F.coalesce("host", F.lit(""))).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), F.col("action"))
    r = r.where("rule_host <> ''").distinct()
    r = r.withColumns(
        {
            "labels": F.size(F.split("rule_host", "\\.")),
            "depth": F.size(F.split("rule_path", "/")) - 1,
            "digest": F.sha2(F.concat("rule_host", F.regexp_extract("rule_path", "^(.*/)?", 0)), 256),
        }
    )
    r = r.withColumn("digits", F.substring("digest", 1, PREFIX_DIGITS))
    deepest = r.agg(F.max("labels"), F.max("depth")).first()  # two numbers
    labels, depth = deepest[0] or 0, deepest[1] or 0
    urls = with_host_and_path(pages.select("url")).select("host", "path").distinct()
    parts = urls.withColumns({"label_list": F.split("host", "\\."), "segments": F.split("path", "/")})
    suffixes = F.transform(
        F.sequence(F.lit(1), F.least(F.size("label_list"), F.lit(max(labels, 1)))), lambda i: F.array_join(F.slice("label_list", F.size("label_list") - i + 1, i), ".")
    )
    cut = F.least(F.size("segments") - 1, F.lit(depth))
    prefixes = F.transform(F.sequence(F.lit(0), cut), lambda j: F.when(j == 0, "").otherwise(F.concat(F.array_join(F.slice("segments", F.lit(1), j), "/"), F.lit("/"))))
    asked = parts.select("host", "path", F.explode(suffixes).alias("suffix"), prefixes.alias("prefixes")).select("host", "path", "suffix", F.explode("prefixes").alias("prefix"))
    asked = asked.withColumn("asked_digest", F.sha2(F.concat("suffix", "prefix"), 256)).withColumn("digits", F.substring("asked_digest", 1, PREFIX_DIGITS))
    fits = asked.join(r, "digits").where((F.col("asked_digest") == F.col("digest")) & F.col("path").startswith(F.col("rule_path")))
    rank = F.struct(F.length("rule_host") + F.length("rule_path"), F.length("rule_host"), F.when(F.col("action") == "block", 1).otherwise(0))
    best = fits.groupBy("host", "path").agg(F.max_by(F.struct("rule_host", "rule_path", "action"), rank).alias("best"))
    found = with_host_and_path(pages.select("page_id", "url")).join(best, ["host", "path"], "left")
    return found.select("page_id", "host", "path", F.concat("best.rule_host", "best.rule_path").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))


def query(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict."""
    return url_filter(pages, rule_table(pages.sparkSession, RULES))


ORACLE = """
with split as (
  select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages
), parts as (
  select page_id, regexp_extract(rest, '^[^/?#]*') as raw_host, rest from split
), urls as (
  select page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(substr(rest, length(raw_host) + 1), '^[^?#]*') as path from parts
), rules(rh, rp, action) as (
  values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), fits as (
  select distinct u.host, u.path, rh || rp as rule, action, row_number() over (partition by u.host, u.path order by length(rh || rp) desc, length(rh) desc) as k
  from (select distinct host, path from urls) u join rules on (u.host = rh or ends_with(u.host, '.' || rh)) and starts_with(u.path, rp)
)
select page_id, urls.host as host, urls.path as path, rule, coalesce(action, 'allow') as verdict
from urls left join fits on fits.host = urls.host and fits.path = urls.path and k = 1
"""
