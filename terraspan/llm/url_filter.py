"""URL filter lists by hashed expressions, DataFrame operations only.

Each URL is expanded into host-suffix and path-prefix expressions (only the
suffix lengths and prefix lengths that some rule has), the expressions are
joined with the rules on a short prefix of their SHA-256, and a hit counts
only if the full digests are equal.  Of the hits the longest rule wins.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values: (host, path prefix, verdict).
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; empty without ``://`` or for null."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    tail = F.substring(rest, F.length(raw) + 1, F.length(rest))
    path = F.regexp_extract(tail, r"^[^?#]*", 0)
    return F.translate(F.coalesce(raw, F.lit("")), UPPER, LOWER), F.coalesce(path, F.lit(""))


def rules_frame(spark: SparkSession, rules: Iterable[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
    prefix_chars: int = 8,
) -> DataFrame:
    """One row per page: id, host, path, rule, verdict.

    A rule fits its host and all subdomains if the path starts with the
    rule's.  Longest rule wins; of equal length the longer host, then block.
    No fit, or no rules at all: rule null, verdict ``default``.  Rules without
    host or path (null) fit nothing; one without a verdict gives ``default``.
    Rows that repeat an id and URL are judged once and returned as often as
    they occur, with null ids as well.  Null URLs have empty host and path;
    URLs of any length are judged whole.
    Extra columns are ignored, whatever their names.  An empty table gives an
    empty one.

    The planner broadcasts the rules if their size allows that; else the join
    is on hash prefixes, of which those of short expressions (``org/``) are
    frequent: only the join reads by them, so adaptive execution splits them.
    """
    rule = F.concat("host", "path")
    # host and path stay apart in the digest
    key = F.concat("host", F.lit("\n"), "path")
    rules = rules.where(F.col("host").isNotNull() & F.col("path").isNotNull()).select(
        rule.alias("rule"),
        F.sha2(key.cast("binary"), 256).alias("digest"),
        F.length("host").alias("host_chars"),
        F.size(F.split("host", r"\.", -1)).alias("labels"),
        F.length("path").alias("path_chars"),
        F.col("verdict").alias("rule_verdict"),
    )
    shape = rules.agg(F.collect_set("labels"), F.collect_set("path_chars")).first()
    known = rules.select(
        F.substring("digest", 1, prefix_chars).alias("short"), F.col("digest").alias("rule_digest"),
        "rule", "host_chars", "rule_verdict",
    )
    labels, lengths = sorted(shape[0]) or [1], sorted(shape[1]) or [1]

    urls = pages.groupBy(F.col(id_col).alias("id"), F.col(url_col).alias("url")).agg(F.count(F.lit(1)).alias("n"))
    host, path = host_and_path(F.col("url"))
    urls = urls.withColumns({"host": host, "path": path}).withColumn("part", F.split("host", r"\.", -1))
    suffixes = F.array_compact(
        F.array(*[
            F.when(
                F.size("part") >= k,
                F.array_join(F.slice("part", F.greatest(F.size("part") - k + 1, F.lit(1)), k), "."),
            )
            for k in labels
        ])
    )
    prefixes = F.array_compact(
        F.array(*[F.when(F.length("path") >= k, F.substring("path", 1, k)) for k in lengths])
    )
    expressions = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, F.lit("\n"), p))))
    each = urls.select("id", "url", "n", "host", "path", F.explode_outer(expressions).alias("expression"))
    each = each.withColumn("digest", F.sha2(F.col("expression").cast("binary"), 256))
    hits = each.join(known, F.substring("digest", 1, prefix_chars) == F.col("short"), "left")
    confirmed = F.when(
        F.col("digest") == F.col("rule_digest"),
        F.struct(
            F.length("rule").alias("chars"), "host_chars",
            (F.col("rule_verdict") == "block").alias("block"), "rule", "rule_verdict",
        ),
    )
    best = hits.groupBy("id", "url", "n", "host", "path").agg(F.max(confirmed).alias("best"))
    best = best.select("*", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy"))
    return best.select(
        F.col("id").alias(id_col), "host", "path",
        F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.rule_verdict"), F.lit(default)).alias("verdict"),
    )
