"""URL filters: host-suffix and path-prefix expressions, joined on short hash prefixes."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hex digits of the hash prefix on which expressions and rules are joined.
PREFIX = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """Lower-cased host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end; empty for null or without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty for null or without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """(verdict, host, path) triples as a table, built from SQL literals only."""
    q = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    rows = ", ".join(f"({q(v)}, {q(h)}, {q(p)})" for v, h, p in rules)
    if not rows:
        return spark.sql("SELECT '' AS verdict, '' AS host, '' AS path WHERE false")
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(verdict, host, path)")


def filter_urls(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """One row per input row: key, host, path, rule, verdict.

    Every URL expands into host suffixes (label by label) and path prefixes of the lengths that the rules have.
    The SHA-256 of each expression is joined on its first PREFIX hex digits with the rules' digests; the full digest
    then confirms the hit, and the longest rule wins (ties: the longer host, then block before allow). Without a
    rule the verdict is `default`. Null and malformed URLs have an empty host and path and fit no rule; repeated
    rows and keys stay apart; an empty table gives no rows; other columns of the input play no part. Rules with a
    null are ignored; of equal (host, path) rules, block wins.

    Scale: the only shuffle carries (row, host, path) once per URL: the expressions of a URL are made and reduced
    in the same task before it. Its key is unique, so a hot host doesn't gather. The rule side is left to the
    optimizer, which broadcasts it by its size only.
    """
    rules = rules.where("verdict IS NOT NULL AND host IS NOT NULL AND path IS NOT NULL").select(
        F.sha2(F.concat("host", F.lit("\n"), "path"), 256).alias("full"), F.concat("host", "path").alias("rule"), "verdict", F.length("host").alias("h"), F.length("path").alias("p"), F.size(F.split("host", r"\.")).alias("n")
    )
    shapes = sorted({(r["n"], r["p"]) for r in rules.select("n", "p").distinct().collect()})  # a few numbers, as the rules' shapes
    ranked = rules.groupBy("full", "rule", "h", "p").agg(F.max("verdict").alias("verdict"))  # block > allow
    ranked = ranked.withColumn("prefix", F.substring("full", 1, PREFIX))

    urls = pages.select(F.col(key).alias("k"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path")).withColumn("row", F.monotonically_increasing_id())
    labels = F.split("host", r"\.")

    def expression(n: int, p: int) -> Column:
        suffix = F.array_join(F.slice(labels, F.size(labels) - n + 1, n), ".")
        return F.when((F.size(labels) >= n) & (F.length("path") >= p), F.sha2(F.concat(suffix, F.lit("\n"), F.substring("path", 1, p)), 256))

    made = F.array_compact(F.array(*(expression(n, p) for n, p in shapes))) if shapes else F.array().cast("array<string>")
    hits = (
        urls.withColumn("digest", F.explode_outer(made))
        .join(ranked, (F.substring("digest", 1, PREFIX) == F.col("prefix")) & (F.col("digest") == F.col("full")), "left")
        .groupBy("row", "k", "host", "path")
        .agg(F.max(F.when(F.col("rule").isNotNull(), F.struct((F.col("h") + F.col("p")).alias("size"), "h", "verdict", "rule"))).alias("best"))
    )
    return hits.select(F.col("k").alias(key), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
