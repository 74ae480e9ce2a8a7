"""URL rules by expression lookup.

Each URL's host is expanded into itself and its parent domains, its path into
the prefixes whose length some rule has. Every (host, path prefix) expression
is hashed; rules and expressions meet in an equi-join on a short hash prefix,
and the full digest confirms a match. Of the confirmed rules the one with the
longest host and path wins. Everything is DataFrame functions.

Distinct (host, path) pairs are expanded, not rows, so a host with a large
share of the pages is expanded once per path. Whether the rules are broadcast
is left to the planner, which knows their size.

Defined results: a null url, or one without ``://``, has an empty host and
path, and no rule fits an empty host; repeated rows are judged alike; equal
rules count once, and of a block and an allow rule for the same expression the
allow rule holds; of two fitting rules of equal length the one with the longer
host wins; other columns are ignored; an empty table gives an empty
result. A path that does not start with a rule's path (an empty one included)
does not fit it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
HASH_PREFIX = 8  # hexadecimal digits, 32 bits


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(verdict, host, path) tuples as a DataFrame; use any DataFrame with
    these columns instead where the list is long."""
    q = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    values = ", ".join(f"({q(v)}, {q(h)}, {q(p)})" for v, h, p in rules)
    if not values:
        return spark.range(0).selectExpr("'' AS verdict", "'' AS host", "'' AS path")
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(verdict, host, path)")


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def with_host_path(pages: DataFrame, url: str = "url") -> DataFrame:
    """Add host and path as the contract splits them."""
    u = F.coalesce(F.col(url).cast("string"), F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return pages.withColumn("host", _ascii_lower(host)).withColumn("path", path)


def _digest(host: Column, path: Column) -> Column:
    # a host holds no slash, so the expression cannot be read two ways
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def classify(pages: DataFrame, rules: DataFrame, *, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule (host and path of the deciding rule) and
    verdict for every row of ``pages`` (page_id, url)."""
    urls = with_host_path(pages.select("page_id", "url"))
    book = (rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL AND host <> ''")
            .groupBy(_ascii_lower(F.col("host")).alias("rule_host"), F.col("path").alias("rule_path"))
            .agg(F.min("verdict").alias("rule_verdict"))
            .withColumn("rule_digest", _digest(F.col("rule_host"), F.col("rule_path")))
            .withColumn("rule_key", F.substring("rule_digest", 1, HASH_PREFIX)))
    # path lengths that occur among the rules: a scalar subquery, at most as
    # many entries as there are characters in the longest rule
    lengths = book.agg(F.collect_set(F.length("rule_path"))).scalar()
    labels = F.split("host", r"\.", -1)
    hosts = (urls.where("host <> ''").select("host", "path").distinct()
             .withColumn("labels", labels).withColumn("lengths", lengths))
    expressions = (
        hosts.select(
            "host", "path",
            F.explode(F.transform(F.sequence(F.lit(1), F.size("labels")),
                                  lambda i: F.array_join(F.slice("labels", i, F.size("labels")), "."))).alias("suffix"),
            "lengths")
        .select("host", "path", "suffix",
                F.explode(F.filter("lengths", lambda n: n <= F.length("path"))).alias("n"))
        .withColumn("digest", _digest(F.col("suffix"), F.col("path").substr(F.lit(1), F.col("n"))))
        .withColumn("key", F.substring("digest", 1, HASH_PREFIX)))
    won = (expressions.join(book, (F.col("key") == F.col("rule_key")) & (F.col("digest") == F.col("rule_digest")))
           .groupBy("host", "path")
           .agg(F.max_by(F.struct("rule_host", "rule_path", "rule_verdict"),
                         F.struct(F.length("rule_host") + F.length("rule_path"), F.length("rule_host"))).alias("r")))
    return (urls.join(won, ["host", "path"], "left")
            .select("page_id", "host", "path",
                    F.concat("r.rule_host", "r.rule_path").alias("rule"),
                    F.coalesce("r.rule_verdict", F.lit(default)).alias("verdict")))
