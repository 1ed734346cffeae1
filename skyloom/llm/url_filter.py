"""URL blocking by hashed host-suffix and path-prefix expressions.

Each distinct URL is expanded into (host suffix, path prefix) expressions, of the numbers
of labels and the path lengths that the rules have: however long a URL, it has no more
expressions than these. Expressions and rules meet in an equi-join on a short prefix of
their SHA-256 digests; the full digest then confirms the match, and of several rules the
longest wins (the last in text order among equally long ones).

A URL that is null or lacks "://" has an empty host and path, fits no rule and gets the
default verdict. Repeated rows and null ids are judged alike and all returned. An empty table
gives an empty result; without rules all get the default. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm.common import ascii_lower, materialize

#: Fixed values: (verdict, rule as host and path).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
PREFIX_CHARS = 8  # 32 bits of the digest
BROADCAST_ROWS = 100_000


def url_host(url: Column) -> Column:
    """From after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    """From after the host up to `?`, `#` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_suffixes(host: Column, labels: list[int]) -> Column:
    """The host's last labels, as many as given by each of `labels`; shorter hosts have fewer suffixes."""
    parts = F.split(host, r"\.", -1)
    return F.transform(F.filter(F.array(*map(F.lit, labels)), lambda k: k <= F.size(parts)), lambda k: F.array_join(F.slice(parts, -k, k), "."))


def path_prefixes(path: Column, sizes: list[int]) -> Column:
    """The path's beginnings of each of the given lengths; shorter paths have fewer."""
    return F.transform(F.filter(F.array(*map(F.lit, sizes)), lambda k: k <= F.char_length(path)), lambda k: F.substring(path, F.lit(1), k))


def rule_shapes(rules: DataFrame) -> tuple[list[int], list[int]]:
    """Which numbers of host labels and which path lengths the rules have; longer expressions fit none."""
    host, path = F.substring_index("rule", "/", 1), F.regexp_extract("rule", r"(?s)^[^/]*(.*)$", 1)
    shapes = rules.agg(F.collect_set(F.size(F.split(host, r"\.", -1))).alias("labels"), F.collect_set(F.char_length(path)).alias("sizes")).first()
    return sorted(shapes["labels"]), sorted(shapes["sizes"])


def rule_table(spark: SparkSession, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    table = spark.createDataFrame(list(rules), "verdict string, rule string").dropDuplicates(["rule"])
    digest = F.sha2("rule", 256)
    return table.withColumn("digest", digest).withColumn("short", F.substring(digest, 1, PREFIX_CHARS))


def judge_urls(pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Per input row: page_id, host, path, rule (null if none fits), verdict."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    rows = rows.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    labels, sizes = rule_shapes(rules)
    if not labels:
        return rows.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    if rules.count() <= BROADCAST_ROWS:
        rules = F.broadcast(rules)
    targets = materialize(rows.select("host", "path").where("host <> ''").distinct(), "url-targets")
    expressions = (
        targets.select("host", "path", F.explode(host_suffixes(F.col("host"), labels)).alias("suffix"))
        .select("host", "path", "suffix", F.explode(path_prefixes(F.col("path"), sizes)).alias("lead"))
        .withColumn("full", F.sha2(F.concat("suffix", "lead"), 256))
        .withColumn("short", F.substring("full", 1, PREFIX_CHARS))
    )
    matched = (
        expressions.join(rules, "short")
        .where(F.col("full") == F.col("digest"))
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.length("rule").alias("size"), "rule", "verdict")).alias("won"))
        .select("host", "path", F.col("won.rule").alias("rule"), F.col("won.verdict").alias("ruled"))
    )
    ruled = rows.where("host <> ''").join(matched, ["host", "path"], "left")
    hostless = rows.where("host = ''").select("*", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("ruled"))
    return ruled.unionByName(hostless).select("page_id", "host", "path", "rule", F.coalesce("ruled", F.lit(default)).alias("verdict"))
