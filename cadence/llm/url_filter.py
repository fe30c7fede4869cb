"""URL filter: pattern rules indexed by their rarest literal token.

A rule is a regular expression over ``host + path`` with the literal tokens that
every address it fits must hold. Each rule is filed under the one of its tokens
that the fewest addresses hold; the tokens of an address fetch its candidate
rules, and only those run their expression. DataFrame operations only.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadence.llm.common import saved

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Host and path of an address: after the first "://", up to "/", "?", "#" or the end; then up to "?", "#" or the end.
ADDRESS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
RULE_COLUMNS = [("rule", "string"), ("pattern", "string"), ("tokens", "array<string>"), ("verdict", "string")]
#: Verdict of addresses that no rule fits.
DEFAULT = "allow"


def tokens_of(text: str) -> list[str]:
    """Runs of ASCII letters and digits, lower-cased."""
    return [t for t in re.split("[^a-z0-9]+", text.translate(str.maketrans(UPPER, LOWER))) if t]


def host_rule(rule: str, verdict: str) -> tuple[str, str, list[str], str]:
    """A rule such as ``example.net/en/``: the host and all its subdomains, paths
    that start with the rule's. Tokens that the path may continue are not literal."""
    host, slash, path = rule.partition("/")
    path = slash + path
    sure = path[:max((i + 1 for i, c in enumerate(path) if not re.match("[A-Za-z0-9]", c)), default=0)]
    return rule, rf"(?s)^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}", tokens_of(host + " " + sure), verdict


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, ADDRESS, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, ADDRESS, 2), F.lit(""))


def _tokens(address: Column) -> Column:
    """Distinct tokens of an address, and "" for the rules that have none."""
    return F.array_distinct(F.concat(F.array(F.lit("")), F.split(F.translate(address, UPPER, LOWER), "[^a-z0-9]+")))


def rule_index(addresses: DataFrame, rules: DataFrame) -> DataFrame:
    """(token, rule, pattern, verdict): each rule under its rarest token in
    ``addresses`` (column ``address``), the first by order among equals, "" for a
    rule without tokens. The counts are one grouped sum over all addresses,
    restricted to the tokens of the rules."""
    asked = rules.select("rule", "pattern", "verdict", F.explode_outer("tokens").alias("token"))
    wanted = asked.select("token").where("token is not null").distinct()
    held = (addresses.select(F.explode(_tokens(F.col("address"))).alias("token"))
            .join(wanted, "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("n")))
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("token", F.lit("")).alias("token")))
    filed = asked.join(held, "token", "left").groupBy("rule", "pattern", "verdict").agg(rarest.alias("rarest"))
    return saved(filed.select("rarest.token", "rule", "pattern", "verdict"), "rules")


def filter_urls(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url",
                default: str = DEFAULT) -> DataFrame:
    """(page_id, host, path, rule, verdict), a row for each row of ``pages``.

    Of the rules that fit, the longest (``rule``) wins, the first by order among
    equally long ones; ``rule`` is null and ``verdict`` the default where none
    fits. A null address, or one without "://", has empty host and path. Repeated
    rows come back as often; an empty table gives no rows; without rules, every
    address gets the default.

    The index is joined by equality: Spark broadcasts it where its written size is
    below the session's limit and shuffles (with skew splitting) otherwise. What
    is gathered per address is one minimum, so a token that a third of all
    addresses hold makes no hot key."""
    p = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"))
    p = p.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    address = F.concat("host", "path")
    index = rule_index(p.select(address.alias("address")), rules)
    rows = p.groupBy("page_id", "host", "path").agg(F.count(F.lit(1)).alias("times")).withColumn("address", address)
    fetched = rows.withColumn("token", F.explode(_tokens(F.col("address")))).join(index, "token", "left")
    fits = F.when(F.expr("address rlike pattern"), F.struct((-F.length("rule")).alias("shorter"), "rule", "verdict"))
    best = fetched.groupBy("page_id", "host", "path", "times").agg(F.min(fits).alias("won"))
    return best.select("page_id", "host", "path", F.col("won.rule").alias("rule"),
                       F.coalesce("won.verdict", F.lit(default)).alias("verdict"),
                       F.explode(F.expr("array_repeat(1, cast(times as int))")).alias("_")).drop("_")


def rules_frame(spark, rules: list[tuple[str, str, list[str], str]]) -> DataFrame:
    """Rules of :func:`host_rule` as a DataFrame (literals in the plan)."""
    empty = spark.range(0).select(*[F.lit(None).cast(t).alias(n) for n, t in RULE_COLUMNS])
    if not rules:
        return empty
    made = [F.struct(F.lit(r).alias("rule"), F.lit(p).alias("pattern"),
                     F.array(*map(F.lit, t)).cast("array<string>").alias("tokens"), F.lit(v).alias("verdict")) for r, p, t, v in rules]
    return spark.range(1).select(F.inline(F.array(*made)))


#: The rules of the registered query.
QUERY_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def query(spark, sf_dir: str) -> DataFrame:
    """op1: every address of ``pages`` under QUERY_RULES."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return filter_urls(pages, rules_frame(spark, [host_rule(r, v) for r, v in QUERY_RULES]))


SQL = f"""
WITH u AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '{ADDRESS}', 1), '{UPPER}', '{LOWER}'), '') AS host,
         coalesce(regexp_extract(url, '{ADDRESS}', 2), '') AS path FROM pages),
r(rule, host, path, verdict) AS (VALUES {", ".join(f"('{r}', '{r[:r.index('/')]}', '{r[r.index('/'):]}', '{v}')" for r, v in QUERY_RULES)}),
best AS (
  SELECT u.host, u.path, min({{'shorter': -length(r.rule), 'rule': r.rule, 'verdict': r.verdict}}) AS won
  FROM (SELECT DISTINCT host, path FROM u) u JOIN r
    ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path)
  GROUP BY u.host, u.path)
SELECT u.page_id, u.host, u.path, won.rule AS rule, coalesce(won.verdict, '{DEFAULT}') AS verdict
FROM u LEFT JOIN best ON best.host = u.host AND best.path = u.path
"""
