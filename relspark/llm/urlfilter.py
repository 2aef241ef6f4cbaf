"""URL filters: host-suffix and path-prefix expressions joined to rules by short hash prefixes.

Every url is expanded into its host's suffixes; those that some rule has are found by a join on the first ``prefix_bytes`` bytes of their SHA-256 and
confirmed by all of it. Each is then expanded with the path's prefixes, of the lengths that paths of rules of that host have, and the expressions
``host suffix + path prefix`` are joined to the rules and confirmed likewise. Of the rules that fit, the longest wins, then the longest host, then
block. The plan doesn't grow with the rules; only one number of theirs, the labels of the deepest host, comes to the driver.

Defined cases: a null url or one without ``://`` has an empty host and path and no rule; repeated rows are judged alike; the
verdict without a rule is ``default``. Only the id and the url are read, so other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER

#: (verdict, host, path): the rules of the query.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
RULE_TYPE = "verdict string, host string, path string"


def parts(url: Column) -> tuple[Column, Column]:
    """A url's host and path; empty ones where it is null or has no ://."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    tail = F.substring(rest, F.length(host) + 1, F.length(rest))
    return lowered(host), F.regexp_extract(tail, r"\A[^?#]*", 0)


def digest(host: Column, path: Column) -> Column:
    """Of the expression; a space, which no host holds a rule for, keeps host and path apart."""
    return F.unhex(F.sha2(F.encode(F.concat(host, F.lit(" "), path), "UTF-8"), 256))


def lowered(host: Column) -> Column:
    """A-Z as a-z, other characters as they are."""
    return F.translate(host, UPPER, LOWER)


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", prefix_bytes: int = 4) -> DataFrame:
    """Per row of pages: page_id, host, path, rule, verdict. ``rules`` has verdict, host and path."""
    short = lambda full: F.substring(full, 1, prefix_bytes)
    rules = rules.select("verdict", lowered(F.col("host")).alias("rule_host"), F.col("path").alias("rule_path")).dropna()
    labels = lambda host: F.size(F.split(host, r"\.", -1))
    deepest = rules.agg(F.coalesce(F.max(labels("rule_host")), F.lit(0))).first()[0]
    hosts = rules.groupBy("rule_host").agg(F.collect_set(F.length("rule_path")).alias("lengths")).select("rule_host", "lengths", digest(F.col("rule_host"), F.lit("")).alias("full"))
    rules = rules.withColumn("full", digest(F.col("rule_host"), F.col("rule_path")))
    host, path = parts(F.col(url_col))
    split = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    each = split.select("host", "path").distinct()
    suffixes = F.transform(F.sequence(F.lit(1), F.least(labels("host"), F.lit(max(1, deepest)))), lambda k: F.call_function("substring_index", F.col("host"), F.lit("."), -k))
    each = each.select("host", "path", F.explode(suffixes).alias("h")).withColumn("full", digest(F.col("h"), F.lit(""))).alias("e")
    known = each.join(hosts.alias("r"), short(F.col("e.full")) == short(F.col("r.full"))).where((F.col("e.full") == F.col("r.full")) & (F.col("h") == F.col("rule_host")))
    prefixes = F.filter("lengths", lambda n: n <= F.length("path"))
    tried = known.select("host", "path", "h", F.explode(F.transform(prefixes, lambda n: F.left(F.col("path"), n))).alias("p"))
    tried = tried.withColumn("full", digest(F.col("h"), F.col("p"))).alias("e")
    rule = F.struct(
        F.length(F.concat("rule_host", "rule_path")).alias("length"), F.length("rule_host").alias("host_length"), "verdict", F.concat("rule_host", "rule_path").alias("rule")
    )
    fits = (F.col("e.full") == F.col("r.full")) & (F.col("h") == F.col("rule_host")) & (F.col("p") == F.col("rule_path"))
    best = tried.join(rules.alias("r"), short(F.col("e.full")) == short(F.col("r.full"))).where(fits).groupBy("host", "path").agg(F.max(rule).alias("best"))
    return split.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict")
    )
